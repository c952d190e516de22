"""The driver's event tables replayed as streams: the registered queries of the keyed operators.

A replay reads the table with a file source until all of it is processed (``availableNow``; the
last micro-batch without data closes what the watermark has passed), appends the results to
Parquet in the shared checkpoint folder and reads them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solera.mapping import Lake
from solera.session import ensure_checkpoint_dir


class StreamLake(Lake):
    """Canonical streams over one of the tables; every other table is read as it stands."""

    def __init__(self, lk: Lake, streamed: str, **options):
        super().__init__(lk.spark, lk.sf_dir)
        self.batch, self.streamed, self.options = lk, streamed, options

    def raw(self, name: str) -> DataFrame:
        if name != self.streamed:
            return super().raw(name)
        schema = super().raw(name).schema
        # a pattern: as a plain path, a table of one file is taken for its own folder
        return self.spark.readStream.schema(schema).options(**self.options).parquet(f"{self.sf_dir}/{name}.parque[t]")

    def dim_par(self) -> DataFrame:
        return self.batch.dim_par()


def replayed(lk: Lake, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows that the stream of ``build`` appends until its source is exhausted."""
    df = build()
    root = f"{ensure_checkpoint_dir(lk.spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return lk.spark.read.schema(df.schema).parquet(f"{root}/out")


def as_ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})

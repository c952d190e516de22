"""Small helpers shared by the operators: words, written intermediates, table reads."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solera.session import materialize

#: ASCII white space: what separates words in every operator of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows per Arrow batch for the operators that run Python on whole texts; texts may be long.
TEXT_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(text_of(text), SPACE, -1), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def line_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACE, -1), ""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read again: cuts the
    lineage, survives lost executors, and several readers share the work."""
    return materialize(df, f"llm-{name}")


def text_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch so that a Python worker holds few whole texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], object]):
    """``fit`` of a bounded sample's rows, run in one task, so that the driver holds but the model."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            yield pd.DataFrame({"model": [pickle.dumps(fit(pd.concat(rows, ignore_index=True)))]})

    found = sample.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit(pd.DataFrame(columns=sample.columns))

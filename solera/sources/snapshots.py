"""Raw snapshot zone: ``<root>/<table>/loaded_at=YYYY-MM-DDTHH/part-*.csv``.

* ``write_snapshot`` (A2): CSV with header, minimal quoting, NULL written as an empty field,
  one folder per load stamp.  A rerun in the same hour replaces exactly that folder (dynamic
  partition overwrite), earlier loads are untouched.
* ``read_raw`` (A3/A4): all columns as strings, header row, the load stamp comes from
  partition discovery as a *string* column (the schema pins its type, so no timestamp
  inference).  Filters on ``loaded_at`` become partition filters and prune folders.
* ``load_tsv`` (A8): tab-separated bulk text with ``\\N`` as NULL.
* ``as_of`` (A19): ignore loads stamped after T.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMP_FORMAT = "%Y-%m-%dT%H"   # fixed folder-name format of a load stamp


def load_stamp(when: dt.datetime) -> str:
    return when.strftime(STAMP_FORMAT)


def string_schema(columns: list[str], with_stamp: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), True) for c in columns]
    if with_stamp:
        fields.append(T.StructField("loaded_at", T.StringType(), True))
    return T.StructType(fields)


def write_snapshot(df: DataFrame, root: str, table: str, loaded_at: str,
                   files_per_load: int | None = None) -> str:
    """A2: write ``df`` as the ``loaded_at`` snapshot of ``table``; returns the table folder.

    Every column is written as text (NULL -> empty field).  ``files_per_load`` bounds the
    number of files of the load (a round-robin repartition, no key skew); by default each
    task writes its own file, which keeps the write fully parallel.
    """
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    as_text = as_text.withColumn("loaded_at", F.lit(loaded_at))
    if files_per_load:
        as_text = as_text.repartition(files_per_load)
    path = f"{root.rstrip('/')}/{table}"
    (as_text.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")  # only this load, whatever the session's mode
     .option("header", True).option("quoteAll", False).option("emptyValue", "").option("nullValue", "")
     .partitionBy("loaded_at").csv(path))
    return path


def read_raw(spark: SparkSession, root: str, table: str, columns: list[str]) -> DataFrame:
    """A3 + A4: every column a string, plus the ``loaded_at`` stamp from the folder name."""
    return (spark.read.schema(string_schema(columns)).option("header", True)
            .option("emptyValue", None).csv(f"{root.rstrip('/')}/{table}"))


def with_loaded_at_from_path(df: DataFrame) -> DataFrame:
    """A4 (path form): the stamp taken from the file path by pattern, for folders read without
    partition discovery."""
    return df.withColumn("loaded_at", F.regexp_extract(F.col("_metadata.file_path"), r"loaded_at=([^/]+)", 1))


def load_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated text, ``\\N`` as NULL, typed by ``schema``."""
    return (spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N")
            .option("header", False).csv(path))


def as_of(df: DataFrame, stamp: str, col: str = "loaded_at") -> DataFrame:
    """Roll back to the state at ``stamp`` (loads stamped later are ignored).
    Stamps sort lexicographically like time, so this is a partition filter."""
    return df.where(F.col(col) <= F.lit(stamp))

"""Processed zone (Parquet) and warehouse sinks.

* ``write_dim`` (A6): Parquet + Snappy overwrite; the row count is taken with
  ``DataFrame.observe`` during the write (no second job).
* ``write_partitioned`` (A7): Hive-style partitions (fact by anio/mes, aggregate by anio).
  A ``rebalance`` hint lets AQE split a partition value holding a third of the data into
  several write tasks instead of one.
* ``read_processed`` (A5).
* ``load_warehouse`` (A9): project and cast to the warehouse contract (drops anio/mes,
  amount rounded to decimal(14,2)) and overwrite the warehouse table folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WAREHOUSE_FACT_CONTRACT = [
    ("transaccion_id", "bigint"), ("fecha_id", "int"), ("tipo_energia_id", "smallint"),
    ("proveedor_id", "bigint"), ("cliente_id", "bigint"), ("tipo", "string"),
    ("cantidad_mwh", "decimal(12,3)"), ("precio_usd", "decimal(10,2)"), ("monto_usd", "decimal(14,2)"),
]


def read_processed(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def write_dim(df: DataFrame, root: str, name: str) -> int:
    """Overwrite ``root/name`` as Snappy Parquet; returns the rows written."""
    obs = Observation(f"rows_{name}")
    (df.observe(obs, F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").option("compression", "snappy").parquet(f"{root.rstrip('/')}/{name}"))
    return int(obs.get["rows"])


def write_partitioned(df: DataFrame, root: str, name: str, cols: list[str],
                      max_records_per_file: int = 5_000_000) -> int:
    """Partitioned Parquet write behind a ``rebalance`` hint on the partition columns:
    AQE sizes the write tasks from the measured shuffle data, splitting a partition value
    that holds a third of the rows into many tasks/files (and merging tiny ones), so no
    single task writes a whole hot month.  ``maxRecordsPerFile`` bounds file size."""
    obs = Observation(f"rows_{name}")
    out = df.hint("rebalance", *cols)
    (out.observe(obs, F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").option("compression", "snappy")
     .option("maxRecordsPerFile", max_records_per_file)
     .option("partitionOverwriteMode", "static")  # the whole table: months that are gone go
     .partitionBy(*cols).parquet(f"{root.rstrip('/')}/{name}"))
    return int(obs.get["rows"])


def to_contract(df: DataFrame, contract=WAREHOUSE_FACT_CONTRACT) -> DataFrame:
    """Project and cast to a column contract (HALF_UP rounding for narrower decimals)."""
    cols = []
    for name, typ in contract:
        c = F.col(name)
        if typ.startswith("decimal"):
            scale = int(typ.split(",")[1].rstrip(")"))
            c = F.round(c, scale)
        cols.append(c.cast(typ).alias(name))
    return df.select(*cols)


def load_warehouse(df: DataFrame, root: str, name: str = "fact_transaccion") -> int:
    """Truncate-and-load of the warehouse copy (overwrite of the table folder)."""
    return write_dim(to_contract(df), root, name)

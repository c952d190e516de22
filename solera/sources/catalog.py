"""Catalogue work: schema discovery (A13), schema drift (A14), audit log (A16), row counts.

Folder listing and catalogue registration happen on the driver (metadata only, bounded by
the number of tables); schema inference and counting are Spark jobs.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_folders(spark: SparkSession, root: str) -> list[str]:
    """Immediate sub-folders of ``root`` through the Hadoop FileSystem of the session (works
    for local paths and object stores alike)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(path)
                  if st.isDirectory() and not st.getPath().getName().startswith(("_", ".")))


def partition_columns(spark: SparkSession, root: str) -> list[str]:
    """Partition columns of a table folder, outermost first, from its ``column=value`` folders (one
    branch of the tree is listed); folders of mixed names at one level are an error."""
    out: list[str] = []
    while True:
        names = list_folders(spark, root)
        cols = {n.split("=", 1)[0] for n in names if "=" in n}
        if not cols:
            return out
        if len(cols) > 1 or any("=" not in n for n in names):
            raise ValueError(f"{root} holds folders of different kinds: {names[:5]}")
        out += cols
        root = f"{root.rstrip('/')}/{names[0]}"


def discover(spark: SparkSession, root: str, fmt: str = "csv", database: str = "raw") -> DataFrame:
    """One table per folder under ``root``.  Each folder's schema is inferred (a Spark
    job), the table is registered as an external table at that location and its partitions
    are recovered.  Returns (table, location, n_columns, partition columns)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    rows = []
    for name in list_folders(spark, root):
        loc = f"{root.rstrip('/')}/{name}"
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True).option("inferSchema", True)
        schema = reader.load(loc).schema
        parts = partition_columns(spark, loc)
        opts = "OPTIONS (header 'true')" if fmt == "csv" else ""
        part_sql = f"PARTITIONED BY ({', '.join(parts)})" if parts else ""
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE {database}.{name} ({cols}) USING {fmt} {opts} {part_sql} LOCATION '{loc}'")
        if parts:
            spark.sql(f"ALTER TABLE {database}.{name} RECOVER PARTITIONS")
        rows.append((name, loc, len(schema.fields), ",".join(parts)))
    return spark.createDataFrame(rows, "table string, location string, n_columns int, partitions string")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Registered tables with their column counts (catalogue metadata)."""
    rows = [(t.name, len(spark.catalog.listColumns(t.name, database)))
            for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "table string, n_columns int")


def schema_diff(expected: T.StructType, actual: T.StructType, policy: str = "update") -> DataFrame:
    """Per column (added / removed / type_changed) and the action under ``policy``:
    ``update`` adds new columns and marks removed ones deprecated; ``fail`` fails on any
    unexpected column.  Pure metadata (bounded by the column count)."""
    from pyspark.sql import SparkSession as _S
    spark = _S.getActiveSession()
    exp = {f.name: f.dataType.simpleString() for f in expected.fields}
    act = {f.name: f.dataType.simpleString() for f in actual.fields}
    rows = []
    for c in sorted(set(exp) | set(act)):
        if c not in exp:
            change, action = "added", "fail" if policy == "fail" else "add_column"
        elif c not in act:
            change, action = "removed", "fail" if policy == "fail" else "deprecate"
        elif exp[c] != act[c]:
            change, action = "type_changed", "fail" if policy == "fail" else "update_type"
        else:
            continue
        rows.append((c, change, exp.get(c), act.get(c), action))
    return spark.createDataFrame(rows, "column string, change string, expected_type string, actual_type string, action string")


AUDIT_SCHEMA = "proceso string, fin timestamp, estado string, filas long, mensaje string, detalles string"


def log_step(spark: SparkSession, path: str, proceso: str, estado: str, filas: int | None,
             mensaje: str | None, detalles: dict | None = None) -> None:
    """Append one audit row (details as JSON text) to the audit table folder."""
    row = [(proceso, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), estado,
            None if filas is None else int(filas), mensaje,
            json.dumps(detalles, default=str) if detalles is not None else None)]
    spark.createDataFrame(row, AUDIT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def table_counts(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Row counts per (schema, table) plus per-schema subtotals and a grand total
    (``rollup``); subtotal rows carry NULL in the rolled-up columns."""
    parts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(s).alias("esquema"), F.lit(t).alias("tabla"), "filas")
             for (s, t), df in tables.items()]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return counts.rollup("esquema", "tabla").agg(F.sum("filas").cast("long").alias("filas"))


# ---------------------------------------------------------------- drift carried out
RESCUE = "_rescatado"
_INTEGERS = ["tinyint", "smallint", "int", "bigint"]
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}


class SchemaDriftError(RuntimeError):
    pass


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds every value of both exactly; text holds everything.  The order of
    several types does not matter."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    names = (a.simpleString(), b.simpleString())
    if all(n in _INTEGERS for n in names):
        return max((a, b), key=lambda t: _INTEGERS.index(t.simpleString()))
    if {"date", "timestamp"} == set(names) or {"date", "timestamp_ntz"} == set(names):
        return a if names[1] == "date" else b
    exact = [isinstance(t, T.DecimalType) or n in _INTEGERS for t, n in zip((a, b), names)]
    if all(exact):
        digits = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_DIGITS[n], 0) for t, n in zip((a, b), names)]
        whole, scale = (max(d[i] for d in digits) for i in (0, 1))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if all(n in ("float", "double", *_INTEGERS[:3]) for n in names):  # 53 bits hold an int
        return T.DoubleType()
    return T.StringType()


def widen(schemas: list[T.StructType]) -> T.StructType:
    """One schema for several: every column of any of them, in order of appearance, nullable, with the
    widest of its types."""
    cols: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s.fields:
            cols[f.name] = wider(cols[f.name], f.dataType) if f.name in cols else f.dataType
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


def evolve(expected: T.StructType, actual: T.StructType, policy: str = "update") -> T.StructType:
    """The table's schema after a load of schema ``actual``: new columns are added, types widened,
    columns that are gone stay (NULL from now on).  ``fail`` raises on any difference."""
    if policy == "fail" and {f.name: f.dataType for f in expected} != {f.name: f.dataType for f in actual}:
        raise SchemaDriftError(f"expected {expected.simpleString()}, found {actual.simpleString()}")
    return widen([expected, actual])


def fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: missing ones NULL, others cast.  What does not fit (a value its
    type cannot hold, a column the schema lacks) is kept as text in the map ``_rescatado``; NULL when
    everything fits."""
    have, own = set(df.columns), {f.name for f in schema.fields}
    cols, entries = [], []
    for f in schema.fields:
        if f.name not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        value = c if df.schema[f.name].dataType == f.dataType else c.try_cast(f.dataType)
        if value is not c:
            src = df.schema[f.name].dataType
            # a cast that cuts digits or fractions off does not fit either
            cut = (value.try_cast(src) != c) if not isinstance(src, T.StringType) and not isinstance(f.dataType, T.StringType) else F.lit(False)
            lost = c.isNotNull() & (value.isNull() | F.coalesce(cut, F.lit(True)))
            value = F.when(~lost, value)
            entries.append(F.when(lost, F.struct(F.lit(f.name).alias("key"), c.cast("string").alias("value"))))
        cols.append(value.alias(f.name))
    for n in df.columns:
        if n not in own and n != RESCUE:
            c = F.col(f"`{n}`")
            entries.append(F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.cast("string").alias("value"))))
    none = F.lit(None).cast("map<string,string>")
    rescue = none
    if entries:
        kept = F.array_compact(F.array(*entries))
        rescue = F.when(F.size(kept) > 0, F.map_from_entries(kept))
    return df.select(*cols, rescue.alias(RESCUE))


def read_merged(spark: SparkSession, folders: list[str], fmt: str = "parquet", schema: T.StructType | None = None,
                base: str | None = None) -> DataFrame:
    """Merge on read: the loads in ``folders``, each with the schema of its time, as one table.  Without
    ``schema`` it is the widest of all loads and nothing is rescued; with one, see ``fit``.  Folders of one
    schema are one scan, so the plan grows with the number of versions, not of loads."""
    def reader():
        r = spark.read.format(fmt)
        if fmt == "csv":
            r = r.option("header", True).option("inferSchema", True)
        return r.option("basePath", base) if base else r
    versions: dict[str, tuple[T.StructType, list[str]]] = {}
    for p in folders:
        s = reader().load(p).schema
        versions.setdefault(s.json(), (s, []))[1].append(p)
    target = schema or widen([s for s, _ in versions.values()])
    out = None
    for s, paths in versions.values():
        part = fit(reader().schema(s).load(paths), target)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = fit(spark.createDataFrame([], target), target)
    return out

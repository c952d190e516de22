"""The batch lake run: sources -> raw snapshots -> typed dims / fact -> monthly aggregate ->
warehouse copy -> reconciliation -> audit row.  One Spark application; the driver only
orders the steps.

Layout under ``work_root`` (on a cluster a shared folder):
``raw/<table>/loaded_at=<stamp>/``  ``processed/dim_*``  ``processed/fact/anio=/mes=/``
``processed/agg_resumen_mensual/anio=/``  ``warehouse/fact_transaccion``  ``audit/carga_log``
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solera.mapping import Lake
from solera.operators import analytics as A
from solera.operators import transform as B
from solera.sources import catalog, lake as L, snapshots as S

# column contracts of the source tables (text in the raw zone, these types once processed)
CONTRACTS: dict[str, dict[str, str]] = {
    "tipo_energia": {"tipo_energia_id": "smallint", "codigo": "string", "nombre": "string",
                     "factor_co2_kg_mwh": "decimal(8,2)", "renovable": "boolean"},
    "ciudad": {"ciudad_id": "int", "nombre": "string", "pais": "string", "lat": "decimal(9,6)",
               "lon": "decimal(9,6)", "poblacion": "int"},
    "proveedor": {"proveedor_id": "bigint", "nombre": "string", "tipo_energia_id": "smallint",
                  "pais": "string", "capacidad_mw": "decimal(10,2)", "activo": "boolean",
                  "fecha_alta": "date"},
    "cliente": {"cliente_id": "bigint", "nombre": "string", "segmento": "string", "ciudad_id": "int",
                "tipo_id": "string", "id_externo": "string", "activo": "boolean", "fecha_alta": "date"},
    "transaccion": {"transaccion_id": "bigint", "fecha": "date", "tipo": "string",
                    "proveedor_id": "bigint", "cliente_id": "bigint", "tipo_energia_id": "smallint",
                    "cantidad_mwh": "decimal(12,3)", "precio_usd": "decimal(10,2)"},
}
DIM_KEYS = {"tipo_energia": "tipo_energia_id", "ciudad": "ciudad_id",
            "proveedor": "proveedor_id", "cliente": "cliente_id"}


def read_source(lk: Lake, table: str, jdbc: dict | None = None) -> DataFrame:
    """A1: full-table extract of a source table.  With ``jdbc`` (url, table, partition column,
    bounds, partitions, properties) it is a partitioned parallel JDBC read; otherwise the
    canonical table derived from the driver tables."""
    if jdbc:
        return lk.spark.read.jdbc(jdbc["url"], jdbc.get("table", table), column=jdbc["column"],
                                  lowerBound=jdbc["lower"], upperBound=jdbc["upper"],
                                  numPartitions=jdbc.get("partitions", 64),
                                  properties=jdbc.get("properties", {}))
    src = {"tipo_energia": lk.dim_tipo_energia, "ciudad": lk.dim_ciudad,
           "proveedor": lk.dim_proveedor, "cliente": lk.dim_cliente}
    if table in src:
        return src[table]().select(*CONTRACTS[table].keys())
    if table == "transaccion":
        return lk.fact().select(*CONTRACTS["transaccion"].keys())
    raise KeyError(table)


def extract_sources(lk: Lake, raw_root: str, loaded_at: str, tables=None) -> list[str]:
    """A1 + A2 for every source table; returns the table folders written."""
    return [S.write_snapshot(read_source(lk, t), raw_root, t, loaded_at)
            for t in (tables or list(CONTRACTS))]


def build_dim(spark: SparkSession, raw_root: str, table: str) -> DataFrame:
    """Raw scan -> newest row per key (keys absent from the newest load are kept) ->
    typed contract."""
    raw = S.read_raw(spark, raw_root, table, list(CONTRACTS[table]))
    latest = B.scd1_latest(raw, DIM_KEYS[table], "loaded_at")
    return B.conform(latest, CONTRACTS[table])


def fact_from_text(tx: DataFrame) -> DataFrame:
    """B11 core: typed fact from text rows of the newest load: date key, anio, mes, NULLIF on
    the side ids, amount = quantity x price (unrounded decimal(23,5))."""
    typed = B.conform(tx, CONTRACTS["transaccion"])
    return typed.select(
        "transaccion_id",
        "fecha",
        F.date_format("fecha", "yyyyMMdd").cast("int").alias("fecha_id"),
        "tipo_energia_id", "proveedor_id", "cliente_id", "tipo",
        "cantidad_mwh", "precio_usd",
        (F.col("cantidad_mwh") * F.col("precio_usd")).alias("monto_usd"),
        F.year("fecha").alias("anio"), F.month("fecha").alias("mes"))


def build_fact(spark: SparkSession, raw_root: str) -> DataFrame:
    """B9 + B11: only the newest transaction load, typed."""
    raw = S.read_raw(spark, raw_root, "transaccion", list(CONTRACTS["transaccion"]))
    return fact_from_text(B.latest_load(raw).drop("loaded_at"))


def reconcile(a: DataFrame, b: DataFrame, amount: str = "monto_usd", date_key: str = "fecha_id",
              tolerance_per_row: float = 0.005) -> DataFrame:
    """A10: count, sum(amount), min/max(date key) of both sides and their deltas; ``ok`` when
    counts and date bounds agree and the amount delta is within ``tolerance_per_row`` x rows
    (the warehouse rounds amounts to cents).  Two global aggregates, no join."""
    def stats(df: DataFrame, p: str) -> list:
        return [df.agg(F.count(F.lit(1))).scalar().alias(f"{p}_filas"),
                df.agg(F.sum(amount).cast("decimal(38,5)")).scalar().alias(f"{p}_monto"),
                df.agg(F.min(date_key)).scalar().alias(f"{p}_min_fecha"),
                df.agg(F.max(date_key)).scalar().alias(f"{p}_max_fecha")]
    row = a.sparkSession.range(1).select(*stats(a, "a"), *stats(b, "b"))
    return row.select(
        "*",
        (F.col("a_filas") - F.col("b_filas")).alias("delta_filas"),
        (F.col("a_monto") - F.col("b_monto")).alias("delta_monto"),
        ((F.col("a_filas") == F.col("b_filas"))
         & (F.abs(F.col("a_monto") - F.col("b_monto")) <= F.col("a_filas") * F.lit(tolerance_per_row))
         & (F.col("a_min_fecha") == F.col("b_min_fecha"))
         & (F.col("a_max_fecha") == F.col("b_max_fecha"))).alias("ok"))


def run(spark: SparkSession, sf_dir: str, work_root: str, loaded_at: str | None = None,
        extract: bool = True) -> dict:
    """The whole batch run.  Returns row counts per step (taken during the writes)."""
    work_root = work_root.rstrip("/")
    raw, proc, wh = f"{work_root}/raw", f"{work_root}/processed", f"{work_root}/warehouse"
    audit = f"{work_root}/audit/carga_log"
    lk = Lake(spark, sf_dir)
    stamp = loaded_at or S.load_stamp(dt.datetime.now(dt.timezone.utc))
    counts: dict[str, int] = {}
    t0 = time.time()
    if extract:
        extract_sources(lk, raw, stamp)
        catalog.log_step(spark, audit, "extract", "ok", None, f"loaded_at={stamp}")
    for table in ("tipo_energia", "ciudad", "proveedor", "cliente"):
        counts[f"dim_{table}"] = L.write_dim(build_dim(spark, raw, table), proc, f"dim_{table}")
    catalog.log_step(spark, audit, "dims", "ok", sum(counts.values()), None, counts)
    fact = build_fact(spark, raw)
    counts["fact"] = L.write_partitioned(fact, proc, "fact", ["anio", "mes"])
    catalog.log_step(spark, audit, "fact", "ok", counts["fact"], None)
    fact_p = L.read_processed(spark, proc, "fact")
    dim_te = L.read_processed(spark, proc, "dim_tipo_energia")
    agg = A.agg_monthly(fact_p, dim_te)
    counts["agg_resumen_mensual"] = L.write_partitioned(agg, proc, "agg_resumen_mensual", ["anio"])
    counts["warehouse_fact"] = L.load_warehouse(fact_p, wh)
    rec = reconcile(fact_p, L.read_processed(spark, wh, "fact_transaccion")).first()
    counts["reconcile_ok"] = int(bool(rec["ok"]))
    catalog.log_step(spark, audit, "aggregate+warehouse", "ok" if rec["ok"] else "reconcile_mismatch",
                     counts["warehouse_fact"], None, {"seconds": round(time.time() - t0, 3)})
    return counts

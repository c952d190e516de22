"""Ordered listings with caller clamps and paging.

Paging is ``orderBy(...).offset(o).limit(n)`` which Spark plans as a top-k
(``TakeOrderedAndProject``): each task keeps its best ``o + n`` rows, so a page never sorts
the whole table.  For deep pages use ``keyset_page`` (a filter on the last key seen, which
pushes down to the scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solera.functions.scalar import clamp, pair_label
from solera.operators.transform import opt_filter

# --- fixed values: caller clamps ----------------------------------------------------------------
MAX_SUPPLIERS = 1000
MAX_CLIENTS = 2000
MAX_TRANSACTIONS = 2000
MAX_TICKS = 1000
MAX_NOTIFICATIONS = 200
MAX_TICK_HOURS = 720
# -------------------------------------------------------------------------------------------------


def order_by(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    """L1/L2: multi-key order with explicit NULL placement: ``spec`` = [(col, 'asc'|'desc'|
    'asc_nulls_last'|'desc_nulls_last'|...)]."""
    cols: list[Column] = [getattr(F.col(c), d)() for c, d in spec]
    return df.orderBy(*cols)


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0, cap: int | None = None) -> DataFrame:
    """L3/L4: clamp the limit to [1, cap] and the offset to >= 0, then one ordered page."""
    n = clamp(limit, 1, cap) if cap else max(1, int(limit))
    o = max(0, int(offset))
    out = df.orderBy(*order)
    if o:
        out = out.offset(o)
    return out.limit(n)


def keyset_page(df: DataFrame, key: str, after=None, limit: int = 100, descending: bool = False) -> DataFrame:
    """Deep paging by key: rows after the last key of the previous page."""
    out = df
    if after is not None:
        out = out.where(F.col(key) < F.lit(after)) if descending else out.where(F.col(key) > F.lit(after))
    return out.orderBy(F.col(key).desc() if descending else F.col(key).asc()).limit(limit)


def latest_n(df: DataFrame, ts: str, n: int, tiebreak: str | None = None) -> DataFrame:
    """Newest ``n`` rows by ``ts`` (top-k)."""
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Repeatable "random" sample of ``n`` rows (``ORDER BY random() LIMIT n`` made
    deterministic): order by SHA-256 of ``seed:id``, a top-k (``TakeOrderedAndProject``)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    return df.orderBy(key, F.col(id_col)).limit(n)


# ---------------------------------------------------------------- the listings themselves
def suppliers(prov: DataFrame, types: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    df = prov.join(types.select("tipo_energia_id", F.col("codigo").alias("tipo_energia")), "tipo_energia_id")
    df = df.select("proveedor_id", "nombre", "tipo_energia", "pais", "capacidad_mw", "fecha_alta", "activo")
    return page(df, ["proveedor_id"], limit, offset, MAX_SUPPLIERS)


def clients(cli: DataFrame, cities: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    df = cli.join(cities.select("ciudad_id", F.col("nombre").alias("ciudad")), "ciudad_id")
    df = df.select("cliente_id", "tipo_id", "id_externo", "nombre", "ciudad", "segmento", "fecha_alta", "activo")
    return page(df, ["cliente_id"], limit, offset, MAX_CLIENTS)


def cities(ciu: DataFrame) -> DataFrame:
    return ciu.select("ciudad_id", "nombre", "pais", "lat", "lon", "poblacion").orderBy(
        F.col("pais").asc_nulls_last(), F.col("nombre").asc_nulls_last())


def energy_types(te: DataFrame) -> DataFrame:
    return te.select("tipo_energia_id", "codigo", "nombre", "factor_co2_kg_mwh", "renovable").orderBy("tipo_energia_id")


def transactions(fact: DataFrame, types: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    df = fact.join(types.select("tipo_energia_id", F.col("codigo").alias("tipo_energia")), "tipo_energia_id")
    df = df.select("transaccion_id", "fecha", "tipo", "proveedor_id", "cliente_id", "tipo_energia",
                   "cantidad_mwh", "precio_usd", "monto_usd")
    # transaccion_id is not unique in the derived data: the rest of the row breaks ties
    return page(df, [F.col("transaccion_id").desc(), F.col("fecha").desc(), F.col("tipo_energia"),
                     F.col("cantidad_mwh").desc(), F.col("monto_usd").desc()], limit, offset, MAX_TRANSACTIONS)


def fx_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("par_id", "base", "cotizada", "descripcion", "activo").orderBy("par_id")


def fx_ticks(ticks: DataFrame, pairs: DataFrame, label: str | None = None, hours: int = 24,
             limit: int = 100, as_of=None) -> DataFrame:
    """Ticks of the last ``hours`` (<= 720) before ``as_of`` (default newest tick), optional
    pair label filter (``COALESCE(:par, label)`` semantics), newest first, <= 1000 rows."""
    h = clamp(hours, 1, MAX_TICK_HOURS)
    n = clamp(limit, 1, MAX_TICKS)
    df = ticks.join(pairs.select("par_id", pair_label().alias("par_label")), "par_id")
    df = df.withColumn("spread", F.col("precio_venta") - F.col("precio_compra"))
    ref = ticks.agg(F.max("capturado_en")).scalar() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    df = df.where(F.col("capturado_en") >= ref - F.make_interval(hours=F.lit(h)))
    df = opt_filter(df, "par_label", label)          # B4: label = COALESCE(:par, label)
    return df.select("tick_id", "par_id", "par_label", "precio_compra", "precio_venta", "spread", "fuente",
                     "capturado_en").orderBy(F.col("capturado_en").desc(), F.col("tick_id").desc()).limit(n)


def notifications(notif: DataFrame, pairs: DataFrame, limit: int = 200) -> DataFrame:
    n = clamp(limit, 1, MAX_NOTIFICATIONS)
    df = notif.join(pairs.select("par_id", pair_label().alias("par_label")), "par_id", "left")
    return df.select("notificacion_id", "cliente_id", "tipo", "par_id", "par_label", "precio_referencia",
                     "score_confianza", "canal", "enviada_en", "leida", "convertida").orderBy(
        F.col("enviada_en").desc(), F.col("notificacion_id").desc()).limit(n)


def models(registry: DataFrame) -> DataFrame:
    """Models, newest first; features and metrics as maps of their JSON."""
    as_map = "map<string,string>"
    return (registry.select("modelo_id", "version", "algoritmo", F.from_json("features", as_map).alias("features"),
                            F.from_json("metricas", as_map).alias("metricas"), "activo", "entrenado_en")
            .orderBy(F.desc("entrenado_en"), "modelo_id"))

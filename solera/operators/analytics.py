"""Aggregations, named reports and KPIs over the energy star schema and the FX tables.

Conventions shared with the SQL twins (``solera.plans.oracle``):

* quantity sums are ``decimal(38,3)``, amount sums ``decimal(38,5)`` -- exact, no float drift;
* averages (and rates) are exact: integer sums of the scaled values divided with one
  rounding to 6 decimals (``exact_avg``), returned as double -- no float summation order;
* every computed column carries an explicit alias.

Scale: each report aggregates the fact *before* it meets a dimension that can grow with the
data (clients), so the join sees one row per key rather than one per line item.  Joins with
bounded dimensions (energy types, cities) are left to AQE, which broadcasts them once their
measured size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solera.functions.scalar import exact_avg, exact_ratio, rate_pct, scaled_int

QTY = "decimal(38,3)"
AMT = "decimal(38,5)"


def sum_qty(c: str = "cantidad_mwh") -> Column:
    return F.sum(c).cast(QTY)


def sum_amt(c: str = "monto_usd") -> Column:
    return F.sum(c).cast(AMT)


def avg_price(c: Column | str = "precio_usd") -> Column:
    """Exact mean of a 2-decimal price, 6 decimals."""
    return exact_avg(c, 2, 6)


def _types(dim_tipo: DataFrame, alias: str = "tipo_energia") -> DataFrame:
    return dim_tipo.select("tipo_energia_id", F.col("codigo").alias(alias))


# ---------------------------------------------------------------- named queries Q1-Q3
def q1_monthly_sales(fact: DataFrame, dim_tipo: DataFrame, limit: int = 200) -> DataFrame:
    """Monthly sales (venta) per energy type, ordered by (anio, mes, type), top ``limit``."""
    return (fact.where(F.col("tipo") == "venta")
            .join(_types(dim_tipo), "tipo_energia_id")
            .groupBy("anio", "mes", "tipo_energia")
            .agg(sum_qty().alias("mwh_total"), sum_amt().alias("monto_usd_total"))
            .orderBy("anio", "mes", "tipo_energia")
            .limit(limit))


def client_totals(fact: DataFrame) -> DataFrame:
    """Per-client sale totals -- the map-side-combinable core of Q2 and the top-client view."""
    return (fact.where(F.col("tipo") == "venta")
            .groupBy("cliente_id")
            .agg(F.count(F.lit(1)).alias("num_compras"),
                 F.sum("cantidad_mwh").alias("mwh"),
                 F.sum("monto_usd").alias("monto")))


def client_totals_by_order(lineitem: DataFrame, part: DataFrame, orders: DataFrame) -> DataFrame:
    """The same per-client sale totals as ``client_totals(fact)``, computed from the driver
    tables with an order-grain pre-aggregation: line items (sales only) x part prices are
    summed per order *before* the orders join.  The order aggregate is already hash
    partitioned by the order key, so the join with ``orders`` shuffles only ``orders``; the
    line items cross one shuffle instead of two."""
    li = (lineitem.where(~F.coalesce(F.col("l_returnflag") == "R", F.lit(False)))
          .select("l_orderkey", "l_partkey", F.col("l_quantity").cast("decimal(12,3)").alias("q")))
    p = part.select("p_partkey", F.col("p_retailprice").cast("decimal(10,2)").alias("pr"))
    per_order = (li.join(p, li.l_partkey == p.p_partkey, "left")
                 .groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.sum(F.col("q") * F.col("pr")).alias("m")))
    o = orders.select("o_orderkey", "o_custkey")
    return (per_order.join(o, per_order.l_orderkey == o.o_orderkey)
            .groupBy(F.col("o_custkey").alias("cliente_id"))
            .agg(F.sum("n").alias("num_compras"), F.sum("q").alias("mwh"), F.sum("m").alias("monto")))


def q2_top_customers(fact: DataFrame | None, dim_cliente: DataFrame, dim_ciudad: DataFrame,
                     k: int = 5, per_client: DataFrame | None = None) -> DataFrame:
    """Top-k clients by volume bought.  Groups by (name, segment, city) like the
    reference, so namesakes merge; ties broken by name, segment, city for a stable top-k.
    ``per_client`` may be given pre-computed (``client_totals_by_order``)."""
    per_client = per_client if per_client is not None else client_totals(fact)
    cli = dim_cliente.select("cliente_id", "nombre", "segmento", "ciudad_id")
    ciu = dim_ciudad.select("ciudad_id", F.col("nombre").alias("ciudad"))
    return (per_client.join(cli, "cliente_id").join(ciu, "ciudad_id")
            .groupBy("nombre", "segmento", "ciudad")
            .agg(F.sum("num_compras").alias("num_compras"),
                 F.sum("mwh").cast(QTY).alias("mwh_total"),
                 F.sum("monto").cast(AMT).alias("monto_usd_total"))
            .orderBy(F.desc("mwh_total"), "nombre", "segmento", "ciudad")
            .limit(k))


def q3_margin(fact: DataFrame, dim_tipo: DataFrame) -> DataFrame:
    """Average price per side per energy type and the sale-minus-purchase margin,
    ``DESC NULLS LAST``.  One aggregation with conditional averages (same values as the
    reference's two-level aggregate + conditional MAX pivot, one shuffle fewer)."""
    buy = F.when(F.col("tipo") == "compra", F.col("precio_usd"))
    sell = F.when(F.col("tipo") == "venta", F.col("precio_usd"))
    agg = (fact.join(_types(dim_tipo), "tipo_energia_id")
           .groupBy("tipo_energia")
           .agg(F.sum(scaled_int(buy, 2)).alias("s_c"), F.count(buy).alias("n_c"),
                F.sum(scaled_int(sell, 2)).alias("s_v"), F.count(sell).alias("n_v")))
    return (_margins(agg, "s_c", "n_c", "s_v", "n_v")
            .orderBy(F.desc_nulls_last("margen_absoluto"), "tipo_energia"))


def margins_by_part(per_part: DataFrame, dim_tipo: DataFrame) -> DataFrame:
    """G4/G9 from ``Lake.part_totals``: a side's average weighs the part's price by its rows, the
    same exact sums as over single transactions."""
    cents = scaled_int("precio_usd", 2)
    priced = F.col("precio_usd").isNotNull()
    agg = (per_part.join(_types(dim_tipo), "tipo_energia_id").groupBy("tipo_energia")
           .agg(*[e for side, p in (("compra", "c"), ("venta", "v"))
                  for e in (F.sum(F.when(F.col(f"n_{side}") > 0, cents * F.col(f"n_{side}"))).alias(f"s_{p}"),
                            F.sum(F.when(priced, F.col(f"n_{side}")).otherwise(0)).alias(f"n_{p}"))]))
    return _margins(agg, "s_c", "n_c", "s_v", "n_v")


def _margins(df: DataFrame, s_c: str, n_c: str, s_v: str, n_v: str) -> DataFrame:
    """Averages per side and their unrounded difference, each rounded once, from the sums in
    cents and the counts."""
    c, v = exact_ratio(F.col(s_c), F.col(n_c) * 100, 6), exact_ratio(F.col(s_v), F.col(n_v) * 100, 6)
    diff = exact_ratio(F.col(s_v) * F.col(n_c) - F.col(s_c) * F.col(n_v), F.col(n_v) * F.col(n_c) * 100, 6)
    return df.select("tipo_energia", c.alias("precio_compra_avg"), v.alias("precio_venta_avg"), diff.alias("margen_absoluto"))


def margin_pivot(fact: DataFrame, dim_tipo: DataFrame) -> DataFrame:
    """G9 view form of the margin with ``groupBy().pivot()`` over the fixed side values."""
    p = (fact.join(_types(dim_tipo), "tipo_energia_id")
         .groupBy("tipo_energia").pivot("tipo", ["compra", "venta"])
         .agg(F.sum(scaled_int("precio_usd", 2)).alias("s"), F.count("precio_usd").alias("n")))
    return _margins(p, "compra_s", "compra_n", "venta_s", "venta_n")


# ---------------------------------------------------------------- aggregate tables / views
def agg_monthly(fact: DataFrame, dim_tipo: DataFrame) -> DataFrame:
    """G1: monthly aggregate by (anio, mes, energy code, side); unknown types form a NULL group."""
    te = dim_tipo.select(F.col("tipo_energia_id").alias("te_id"), F.col("codigo").alias("tipo_energia_codigo"))
    return (fact.join(te, fact.tipo_energia_id == te.te_id, "left")
            .groupBy("anio", "mes", "tipo_energia_codigo", "tipo")
            .agg(F.count(F.lit(1)).alias("num_transacciones"),
                 sum_qty().alias("mwh_total"),
                 sum_amt().alias("monto_usd_total"),
                 avg_price().alias("precio_promedio")))


def monthly_summary(fact: DataFrame) -> DataFrame:
    """G7 view: per (anio, mes, side) count, volume, amount, average price."""
    return (fact.groupBy("anio", "mes", "tipo")
            .agg(F.count(F.lit(1)).alias("num_transacciones"),
                 sum_qty().alias("mwh_total"),
                 sum_amt().alias("monto_usd_total"),
                 avg_price().alias("precio_promedio")))


def top_customers_view(fact: DataFrame | None, dim_cliente: DataFrame, dim_ciudad: DataFrame,
                       per_client: DataFrame | None = None) -> DataFrame:
    """G8 view: every client with its sale totals (no limit), keyed by client id."""
    cli = dim_cliente.select("cliente_id", "nombre", "segmento", "ciudad_id")
    ciu = dim_ciudad.select("ciudad_id", F.col("nombre").alias("ciudad"))
    per_client = per_client if per_client is not None else client_totals(fact)
    return (per_client.join(cli, "cliente_id").join(ciu, "ciudad_id", "left")
            .select("cliente_id", "nombre", "segmento", "ciudad", "num_compras",
                    F.col("mwh").cast(QTY).alias("mwh_total"),
                    F.col("monto").cast(AMT).alias("monto_usd_total")))


def monthly_balance(fact: DataFrame) -> DataFrame:
    """Per calendar month, purchased vs sold volume (conditional sums, one pass)."""
    return (fact.groupBy(F.trunc("fecha", "month").alias("mes"))
            .agg(F.sum(F.when(F.col("tipo") == "compra", F.col("cantidad_mwh")).otherwise(0)).cast(QTY).alias("compras_mwh"),
                 F.sum(F.when(F.col("tipo") == "venta", F.col("cantidad_mwh")).otherwise(0)).cast(QTY).alias("ventas_mwh")))


def duplicates(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Key groups occurring more than once (``HAVING COUNT(*) > 1``)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_filas")).where(F.col("n_filas") > 1)


def kpis(fact: DataFrame | None, dim_proveedor: DataFrame, dim_cliente: DataFrame,
         dim_ciudad: DataFrame, dim_tipo: DataFrame, per_part: DataFrame | None = None) -> DataFrame:
    """One KPI row.  The fact aggregate is the row; the dimension counts are scalar
    subqueries (each input scanned once, no join).  ``per_part`` (``Lake.part_totals``) may take
    the fact's place."""
    if per_part is None:
        rows, totals = fact, [F.count(F.lit(1)), sum_qty(), sum_amt()]
    else:
        rows = per_part
        totals = [F.coalesce(F.sum(F.col("n_compra") + F.col("n_venta")), F.lit(0).cast("long")), sum_qty(),
                  F.sum(F.col("cantidad_mwh") * F.col("precio_usd")).cast(AMT)]
    return rows.agg(
        dim_proveedor.agg(F.count_if(F.col("activo"))).scalar().alias("proveedores_activos"),
        dim_cliente.agg(F.count_if(F.col("activo"))).scalar().alias("clientes_activos"),
        dim_ciudad.agg(F.count(F.lit(1))).scalar().alias("ciudades"),
        dim_tipo.agg(F.count(F.lit(1))).scalar().alias("tipos_energia"),
        *[c.alias(n) for c, n in zip(totals, ("transacciones_totales", "mwh_transados", "monto_usd_total"))])


def daily_sales(fact: DataFrame, dim_tipo: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Daily sales per type over the last ``days`` days before ``as_of`` (default: the
    newest transaction date, so reruns give the same answer)."""
    sales = fact.where(F.col("tipo") == "venta")
    if as_of is None:
        newest = sales.agg(F.max("fecha")).scalar()
        sales = sales.where(F.col("fecha") >= F.date_sub(newest, days))
    else:
        sales = sales.where(F.col("fecha") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return (sales.join(_types(dim_tipo), "tipo_energia_id")
            .groupBy("tipo_energia", F.col("fecha").alias("dia"))
            .agg(sum_qty().alias("mwh_total"), avg_price().alias("precio_promedio"))
            .orderBy(F.desc("dia"), F.desc("mwh_total"), "tipo_energia"))


def category_counts(df: DataFrame, col: str, domain: list[str], out: str = "categoria") -> DataFrame:
    """Counts per category over a fixed domain; absent categories appear with 0.
    Values outside the domain are reported too (so nothing is silently dropped)."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{out} string, orden int")
    counts = df.groupBy(F.col(col).alias(out)).agg(F.count(F.lit(1)).alias("n"))
    return (dom.join(counts, out, "full")
            .select(out, F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equi-width histogram; step = (max-min)/bins (1 when max == min); the top edge goes
    to the last bin; NaN and NULL are dropped; empty bins appear with 0."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    lo = vals.agg(F.min("x")).scalar()
    hi = vals.agg(F.max("x")).scalar()
    step = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    idx = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / step).cast("int"))
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    (lo + F.col("bin") * step).alias("desde"),
                    (lo + (F.col("bin") + 1) * step).alias("hasta"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def funnel(stages: DataFrame) -> DataFrame:
    """G16 + W3: ``stages(orden, etapa, n)`` -> share of the previous stage (first = 100).
    Runs over the stage rows only (a handful), so the global window is tiny."""
    w = Window.orderBy("orden")
    prev = F.lag("n").over(w)
    return stages.select("orden", "etapa", "n",
                         F.when(prev.isNull(), F.lit(100.0)).otherwise(rate_pct(F.col("n"), prev)).alias("pct_anterior"))


def notification_funnel(notif: DataFrame) -> DataFrame:
    """G16 on notifications: sent -> read -> converted."""
    one = notif.agg(F.count(F.lit(1)).alias("enviadas"),
                    F.count_if(F.col("leida")).alias("leidas"),
                    F.count_if(F.col("convertida")).alias("convertidas"))
    stages = one.select(F.inline(F.array(
        F.struct(F.lit(1).alias("orden"), F.lit("enviadas").alias("etapa"), F.col("enviadas").alias("n")),
        F.struct(F.lit(2).alias("orden"), F.lit("leidas").alias("etapa"), F.col("leidas").alias("n")),
        F.struct(F.lit(3).alias("orden"), F.lit("convertidas").alias("etapa"), F.col("convertidas").alias("n")),
    )))
    return funnel(stages)


def fx_dashboard(pairs: DataFrame, ticks: DataFrame, portfolios: DataFrame, notif: DataFrame,
                 as_of=None, active_model: Column | str | None = None) -> DataFrame:
    """G11 + G12: one FX dashboard row.  ``ticks_24h`` counts ticks in the 24 h before
    ``as_of`` (default: newest tick).  CTR = read*100/total, conversion = converted*100/read,
    2 decimals HALF_UP, 0 when the denominator is 0."""
    if as_of is None:
        as_of_col = ticks.agg(F.max("capturado_en")).scalar()
    else:
        as_of_col = F.lit(as_of).cast("timestamp_ntz")
    since = as_of_col - F.expr("INTERVAL 24 HOURS")
    row = notif.agg(
        pairs.agg(F.count_if(F.col("activo"))).scalar().alias("pares_activos"),
        ticks.agg(F.count(F.lit(1))).scalar().alias("ticks_totales"),
        ticks.where(F.col("capturado_en") >= since).agg(F.count(F.lit(1))).scalar().alias("ticks_24h"),
        portfolios.agg(F.count(F.lit(1))).scalar().alias("portafolios"),
        F.count(F.lit(1)).alias("notificaciones_total"),
        F.count_if(F.col("leida")).alias("notificaciones_leidas"),
        F.count_if(F.col("convertida")).alias("notificaciones_convertidas"),
        exact_avg("score_confianza", 2, 4).alias("score_promedio"))
    return row.select("*",
                      (active_model if isinstance(active_model, Column) else F.lit(active_model)).cast("string").alias("modelo_activo"),
                      rate_pct("notificaciones_leidas", "notificaciones_total").alias("ctr_pct"),
                      rate_pct("notificaciones_convertidas", "notificaciones_leidas").alias("conversion_pct"))

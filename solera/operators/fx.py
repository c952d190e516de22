"""FX notification analytics (G24-G30) and conversion attribution.

Exact percentiles and AUC are computed over a *histogram* of the value (``groupBy(value)``
with map-side partial counts), whose running counts go over ranges of values and then over one
row per range (``running_counts``); a continuous score has as many values as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solera.functions.scalar import epoch_seconds, exact_ratio, rate_pct, scaled_int
from solera.operators.features import CHUNK_ROWS, asof_fill
from solera.session import materialize

# --- fixed values ---------------------------------------------------------------------------
ATTRIBUTION_MINUTES = 30
UPLIFT_ROLLBACK = -0.15          # roll back when uplift stays below -15 % ...
UPLIFT_WINDOW_HOURS = 24         # ... for 24 hours
SLO_P99_SECONDS = 5
SPREAD_RATE = 0.002              # venta = compra * 1.002
# --------------------------------------------------------------------------------------------


SKETCH_K = 1024


def ctr_by_channel(notif: DataFrame) -> DataFrame:
    """Per channel sent / read / converted, CTR and conversion (2 dp, 0 on empty)."""
    g = notif.groupBy("canal").agg(F.count(F.lit(1)).alias("enviadas"),
                                   F.count_if(F.col("leida")).alias("leidas"),
                                   F.count_if(F.col("convertida")).alias("convertidas"))
    return g.select("*", rate_pct("leidas", "enviadas").alias("ctr_pct"),
                    rate_pct("convertidas", "leidas").alias("conversion_pct"))


def recommendation_mix(notif: DataFrame) -> DataFrame:
    """Share of each recommendation type (percent of all notifications)."""
    total = notif.agg(F.count(F.lit(1))).scalar()
    return notif.groupBy("tipo").agg(F.count(F.lit(1)).alias("n")).select(
        "tipo", "n", rate_pct(F.col("n"), total).alias("pct"))


def running_counts(hist: DataFrame, col: str, count: str, group: list[str] | None = None) -> DataFrame:
    """``hist`` (one row per value) with ``_before`` (the sum of ``count`` over smaller values of
    the group) and ``_n`` (the group's sum).  Values are dealt out by range and written; sums run
    within a range, then over one row per range, so no task sees all distinct values."""
    group = group or []
    h = materialize(hist.repartitionByRange(*group, col).withColumn("_range", F.spark_partition_id()), "value_ranges")
    w = Window.partitionBy(*group, "_range").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    per = h.groupBy(*group, "_range").agg(F.sum(count).alias("_c"))
    wr = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_range").alias("_of_range"),
                     F.coalesce(F.sum("_c").over(wr), F.lit(0)).alias("_offset"), F.sum("_c").over(Window.partitionBy(*group)).alias("_n"))
    same = h["_range"] == per["_of_range"]
    for g in group:
        same = same & h[g].eqNullSafe(per[f"_of_{g}"])
    local = F.coalesce(F.sum(count).over(w), F.lit(0))
    return h.join(per, same).select(*hist.columns, (local + F.col("_offset")).alias("_before"), "_n")


def discrete_percentiles(df: DataFrame, col: str, probs: list[float], group: list[str] | None = None) -> DataFrame:
    """Exact lower percentiles: the smallest value whose cumulative count reaches
    ``ceil(p * n)`` (p = 0 -> the minimum).  Computed on the value histogram."""
    group = group or []
    hist = df.where(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_counts(hist, col, "_c", group)
    # integer arithmetic for the rank (basis points) so no float rounding moves a boundary
    asked = F.inline(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(int(round(p * 10000))).cast("long").alias("_bp")) for p in probs]))
    need = F.greatest(F.lit(1), F.floor((F.col("_bp") * F.col("_n") + 9999) / 10000))
    return (cum.select("*", asked).where((F.col("_before") < need) & (need <= F.col("_before") + F.col("_c")))
            .select(*group, "p", F.col(col).alias("valor")))


def daily_sketches(df: DataFrame, col: str, ts: str, k: int = SKETCH_K) -> DataFrame:
    """G25 at scale: per day a mergeable quantile sketch (KLL) of a column, some KB whatever the day
    holds; NULLs and NaN are left out.  Days are stored once; ``sketched_percentiles`` merges them."""
    x = F.col(col).cast("double")
    return (df.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.to_date(ts).alias("dia"))
            .agg(F.kll_sketch_agg_double(x, k).alias("resumen")))


def sketched_percentiles(days: DataFrame, probs=(0.05, 0.25, 0.5, 0.75, 0.95), unit: str | None = None) -> DataFrame:
    """Percentiles per day, or per ``unit`` (week, month) by merging days; no row of the table is read.
    The rank of a value given is within about 0.4 % of the one asked (k = 1024; the sketch draws
    at random, so two runs may differ within it)."""
    period = F.col("dia") if unit is None else F.trunc("dia", unit)
    merged = days.groupBy(period.alias("periodo")).agg(F.kll_merge_agg_double("resumen").alias("resumen"))
    asked = F.inline(F.array(*[F.struct(F.lit(float(p)).alias("p"),
                                        F.kll_sketch_get_quantile_double("resumen", F.lit(float(p))).alias("valor")) for p in probs]))
    return merged.select("periodo", F.kll_sketch_get_n_double("resumen").alias("filas"), asked)


def distribution_drift(df: DataFrame, col: str, ts: str, lo: float, hi: float, bins: int = 20) -> DataFrame:
    """Drift of a column from one day to the next day that has rows: the largest difference between
    their shares below a bin's edge (Kolmogorov-Smirnov on ``bins`` bins of [lo, hi], values outside
    in the outer bins), exact to 6 decimals.  One aggregation with map-side sums; what follows
    runs on a row a day.  NULLs and NaN are left out."""
    x = F.col(col).cast("double")
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins)))
    days = (df.where(x.isNotNull() & ~F.isnan(x) & F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("dia"))
            .agg(F.count(F.lit(1)).alias("filas"), F.array(*[F.count_if(b <= i) for i in range(bins)]).alias("_c")))
    w = Window.orderBy("dia")  # one row per day
    pairs = days.select("*", *[F.lag(c).over(w).alias(a) for c, a in (("dia", "dia_anterior"), ("filas", "_pf"), ("_c", "_pc"))])
    n, m = (F.col(c).cast("decimal(19,0)") for c in ("filas", "_pf"))
    far = F.array_max(F.zip_with("_c", "_pc", lambda a, p: F.abs(a * m - p * n)))
    return pairs.where("_pf IS NOT NULL").select("dia", "dia_anterior", "filas", exact_ratio(far, n * m, 6).alias("distancia"))


def score_percentiles(notif: DataFrame, probs=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Score distribution percentiles (drift monitoring)."""
    return discrete_percentiles(notif, "score_confianza", list(probs))


def active_users(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """DAU / WAU / MAU -- distinct users per day, ISO week and month, all three from one
    pass over the distinct (user, day) pairs."""
    days = events.select(user, F.to_date(ts).alias("_d")).distinct()
    grains = F.inline(F.array(*[F.struct(F.lit(g).alias("granularidad"), F.trunc("_d", unit).alias("periodo"))
                                for g, unit in (("semana", "week"), ("mes", "month"))],
                              F.struct(F.lit("dia").alias("granularidad"), F.col("_d").alias("periodo"))))
    return (days.select(user, grains).distinct().groupBy("granularidad", "periodo")
            .agg(F.count(user).alias("usuarios_activos")))


def daily_user_sketches(events: DataFrame, user: str = "user_id", ts: str = "ts", lg_k: int = 14) -> DataFrame:
    """G26 at scale: one HyperLogLog sketch of the users per day (a few KB), merged map-side.
    Days are disjoint, so a day's sketch is stored once and never built again."""
    return events.groupBy(F.to_date(ts).alias("dia")).agg(F.hll_sketch_agg(user, lg_k).alias("usuarios"))


def active_users_from_sketches(days: DataFrame) -> DataFrame:
    """DAU, WAU and MAU from stored daily sketches: weeks and months are unions of days, no event
    is read.  Estimates (relative standard error about 0.83 / sqrt(2^lg_k): 0.65 % at 14); one row
    per period as ``active_users`` gives."""
    grains = F.inline(F.array(F.struct(F.lit("dia").alias("granularidad"), F.col("dia").alias("periodo")),
                              *[F.struct(F.lit(g).alias("granularidad"), F.trunc("dia", unit).alias("periodo"))
                                for g, unit in (("semana", "week"), ("mes", "month"))]))
    return (days.select("usuarios", grains).groupBy("granularidad", "periodo")
            .agg(F.hll_sketch_estimate(F.hll_union_agg("usuarios")).alias("usuarios_activos")))


def ab_uplift(notif: DataFrame, arm_col: str = "brazo", ts: str = "enviada_en") -> DataFrame:
    """Hourly click-through rate (read / sent) and conversion per arm (A control, B
    treatment), CTR uplift = B/A - 1 and the rollback flag when it stays below -15 % for 24
    consecutive hourly points.  The window runs over one row per hour (bounded by the time span)."""
    conv, read = F.coalesce(F.col("convertida"), F.lit(False)), F.coalesce(F.col("leida"), F.lit(False))
    hourly = (notif.groupBy(F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hora"))
              .agg(*[c for a in ("A", "B") for c in (
                  F.count_if((F.col(arm_col) == a) & conv).alias(f"c_{a}"),
                  F.count_if((F.col(arm_col) == a) & read).alias(f"r_{a}"),
                  F.count_if(F.col(arm_col) == a).alias(f"n_{a}"))]))
    # exact ratios: rate = r/n per arm, uplift = (r_B n_A) / (n_B r_A) - 1
    up = hourly.select("hora", exact_ratio("c_A", "n_A", 9).alias("conv_A"), exact_ratio("c_B", "n_B", 9).alias("conv_B"),
                       exact_ratio("r_A", "n_A", 9).alias("ctr_A"), exact_ratio("r_B", "n_B", 9).alias("ctr_B"),
                       exact_ratio(F.col("r_B") * F.col("n_A") - F.col("n_B") * F.col("r_A"),
                                   F.col("n_B") * F.col("r_A"), 9).alias("uplift"))
    hour_idx = (F.unix_micros(F.col("hora").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    w = Window.orderBy(hour_idx).rangeBetween(-(UPLIFT_WINDOW_HOURS - 1), 0)
    return up.select("hora", "ctr_A", "ctr_B", "conv_A", "conv_B", "uplift",
                     ((F.count("uplift").over(w) == UPLIFT_WINDOW_HOURS)
                      & (F.max("uplift").over(w) < UPLIFT_ROLLBACK)).alias("rollback"))


def pnl_change(portfolios: DataFrame, ticks: DataFrame, rate_pair: int = 0, days=(7, 30)) -> DataFrame:
    """Portfolio value change over 7 / 30 days at the newest daily close of the rate pair
    (value = usd + cop / rate).  Closes are the last mid of each UTC day; the reference close
    is the last close on or before the newest day minus N days.  Scalar subqueries, no join."""
    mid = (F.col("precio_compra") + F.col("precio_venta")) / 2
    t = ticks.where(F.col("par_id") == rate_pair).select(F.to_date("capturado_en").alias("d"),
                                                         epoch_seconds("capturado_en").alias("t"), "tick_id", mid.alias("mid"))
    closes = t.groupBy("d").agg(F.max_by("mid", F.struct("t", "tick_id")).alias("close"))
    newest = closes.agg(F.max("d")).scalar()
    r_now = closes.agg(F.max_by("close", "d")).scalar()
    now = F.col("saldo_usd") + F.try_divide(F.col("saldo_cop"), r_now)
    cols = [F.col("cliente_id"), F.round(now, 6).alias("valor")]
    for n in days:
        r_then = closes.where(F.col("d") <= F.date_sub(newest, n)).agg(F.max_by("close", "d")).scalar()
        then = F.col("saldo_usd") + F.try_divide(F.col("saldo_cop"), r_then)
        cols.append(F.round(F.try_divide(now, then) - 1, 9).alias(f"cambio_{n}d"))
    return portfolios.select(*cols)


def eval_scores(scored: DataFrame, score: str = "score_confianza", label: str = "convertida",
                ts: str = "enviada_en", holdout_days: int = 14, k: int = 100, id_col: str = "notificacion_id") -> DataFrame:
    """Temporal holdout (the last ``holdout_days`` days before the newest row) and, on
    it, rank-sum AUC (ties get the average rank), precision@k and recall@k (top k by score,
    ties by ``id_col``).  Ranks come from the score histogram; top-k is ``TakeOrderedAndProject``."""
    newest = scored.agg(F.max(ts)).scalar()
    test = scored.where(F.col(ts) >= newest - F.make_interval(days=F.lit(holdout_days)))
    y = F.col(label).cast("int")
    hist = test.groupBy(score).agg(F.count(F.lit(1)).alias("c"), F.sum(y).alias("pos"))
    ranked = running_counts(hist, score, "c")
    two_avg_rank = 2 * F.col("_before") + F.col("c") + 1          # twice the average rank of a tie group
    sums = ranked.agg(F.sum(F.col("pos") * two_avg_rank).alias("rank_sum2"), F.sum("pos").alias("n_pos"),
                      F.sum("c").alias("n"))
    n_pos, n = F.col("n_pos"), F.col("n")
    auc = exact_ratio(F.col("rank_sum2") - n_pos * (n_pos + 1), 2 * n_pos * (n - n_pos), 9)
    top = test.orderBy(F.col(score).desc(), F.col(id_col)).limit(k)
    top_pos = top.agg(F.sum(y)).scalar()
    return sums.select(n.alias("n_test"), n_pos.alias("n_pos"), auc.alias("auc"),
                       exact_ratio(top_pos, F.lit(k), 9).alias("precision_at_k"),
                       exact_ratio(top_pos, n_pos, 9).alias("recall_at_k"))


def slo_report(decisions: DataFrame, p99_slo_s: int = SLO_P99_SECONDS) -> DataFrame:
    """Delivery latency (deliver_at - enviada_en, whole seconds) p50 / p99 over sent
    notifications, the count over the SLO, and the attributed revenue (spread on the
    reference price of converted notifications)."""
    sent = decisions.where(F.col("decision") == "sent")
    lat = (F.unix_seconds(F.col("deliver_at").cast("timestamp")) - F.unix_seconds(F.col("enviada_en").cast("timestamp")))
    sent = sent.withColumn("latencia_s", lat)
    pct = discrete_percentiles(sent, "latencia_s", [0.5, 0.99])
    p50 = pct.where(F.col("p") == 0.5).agg(F.max("valor")).scalar()
    p99 = pct.where(F.col("p") == 0.99).agg(F.max("valor")).scalar()
    return sent.agg(F.count(F.lit(1)).alias("enviadas"),
                    F.count_if(F.col("latencia_s") > p99_slo_s).alias("fuera_slo"),
                    exact_ratio(F.sum(F.when(F.col("convertida"), scaled_int("precio_referencia", 2))) * round(SPREAD_RATE * 10**6),
                                F.lit(10**8), 6).alias("ingreso_atribuido")
                    ).select("*", p50.alias("p50_s"), p99.alias("p99_s"))


def unit_cost(total_cost: DataFrame, cost_col: str, notif: DataFrame) -> DataFrame:
    """Cost per notification sent = total cost / notifications."""
    return total_cost.agg(F.sum(cost_col).alias("costo_total")).select(
        "*", notif.agg(F.count(F.lit(1))).scalar().alias("notificaciones"),
        F.try_divide(F.col("costo_total"), notif.agg(F.count(F.lit(1))).scalar()).alias("costo_unitario"))


def attribute_conversions(clicks: DataFrame, txs: DataFrame, user: str, ts: str,
                          minutes: int = ATTRIBUTION_MINUTES, rows: int = CHUNK_ROWS) -> DataFrame:
    """A click converts when the same user has a transaction within ``minutes``
    after it (``(click, click + minutes]``).  The first transaction after each click is an
    as-of lookup on reversed time (chunked, exact, no pair enumeration), so a user with a
    third of all clicks is still split by rows."""
    c = clicks.withColumn("_nt", -epoch_seconds(ts))
    tx = txs.select(user, (-epoch_seconds(ts)).alias("_nt"), epoch_seconds(ts).alias("t_tx"))
    nxt = asof_fill(tx, c, user, "_nt", ["t_tx"], strict=True, rows=rows)
    delay = F.col("asof_t_tx") + F.col("_nt")        # t_tx - t_click
    return (nxt.withColumn("segundos_a_conversion", delay)
            .withColumn("convertida", F.coalesce(delay <= minutes * 60, F.lit(False)))
            .drop("_nt", "asof_t_tx"))

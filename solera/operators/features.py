"""Rolling market, portfolio and user features (W1-W10) and as-of enrichment.

Scale design
------------
The natural window key of a tick feature is the currency pair, and there are only a handful
of pairs: ``Window.partitionBy(pair)`` would put a fifth (or a third) of all ticks in one
task.  Time-ordered features are computed per **(key, chunk)** instead, a chunk being about
``CHUNK_ROWS`` consecutive rows of a key (``chunk_starts``), however dense the key is:

* unbounded look-back (previous tick, price "at least 1 h ago", EMA, position): the value is
  first resolved inside the chunk and the remainder comes from a carry computed over a
  *chunk-level* table (one row per key and chunk).
* counts and sums over trailing windows are differences of two running totals of integers,
  which are exact, so no row is copied whatever the window's length (``trailing``).
* the rolling deviation merges moments (count, mean, squared deviations), which cannot be
  subtracted: a frame is the end of one pane and the start of the next (panes as long as the
  frame), each a running merge inside a chunk with the pane's other chunks merged before it.

Nothing is written and no job runs while a query is built: where a chunk begins follows from the
data alone (``chunk_starts``), so every branch of a plan that reads the rows finds the same ones.

Timestamps are handled as epoch seconds (double) so frames are plain numeric ranges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solera.functions.scalar import epoch_seconds, exact_ratio, scaled_int

# --- fixed values ---------------------------------------------------------------------------
EMA_SPAN = 200                         # EMA-200
VOLATILITY_WINDOW_S = 300              # 5 minutes
RETURN_LAG_S = 3600                    # 1 hour
MULTI_WINDOWS_S = {"5m": 300, "1h": 3600, "24h": 86400}
# target USD share of a portfolio per risk profile (our choice; the design names the feature only)
PROFILE_USD_TARGET = {"conservador": 70.0, "moderado": 50.0, "agresivo": 30.0}
# --------------------------------------------------------------------------------------------

#: Rows of a chunk, about: a chunk begins on a whole second.
CHUNK_ROWS = 500_000
_DAY_S = 86400


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _day(t: Column) -> Column:
    return F.floor(F.floor(t) / _DAY_S).cast("long")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys that takes a NULL key for a key like any other; the right side's go."""
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = left[keys[0]].eqNullSafe(right[f"_of_{keys[0]}"])
    for k in keys[1:]:
        same = same & left[k].eqNullSafe(right[f"_of_{k}"])
    out = left.join(right, same, how)
    return out if how == "left_semi" else out.drop(*[f"_of_{k}" for k in keys])


def chunk_starts(df: DataFrame, key, t_col: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, ``_day``, ``_starts``): for every day of a key of more than ``rows`` rows, the seconds
    at which its chunks go on or begin, each with the chunk's number in the key.

    Most keys are shorter and cost one partial count.  For the others, rows are counted by second;
    the counts run over the seconds of one (key, day) and over the days of one key."""
    keys = _keys(key)
    timed = df.where(F.col(t_col).isNotNull()).select(*keys, F.floor(F.col(t_col)).cast("long").alias("_sec"))
    long = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).drop("_n")
    # at most one key for every ``rows`` rows, sent to the rows: a join by key would put all rows of a key in one task
    n = (_joined(timed, F.broadcast(long), keys, "left_semi").groupBy(*keys, "_sec").agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", _day(F.col("_sec"))))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = n.groupBy(*keys, "_day").agg(F.sum("_n").alias("_n"))
    days = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    today = Window.partitionBy(*keys, "_day").orderBy("_sec").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_here", F.coalesce(F.sum("_n").over(today), F.lit(0)))
    n = _joined(n, days, [*keys, "_day"], "inner").withColumn("_nth", F.floor((F.col("_before") + F.col("_here")) / rows))
    return (n.groupBy(*keys, "_day", "_nth").agg(F.min("_sec").alias("_sec"))
            .groupBy(*keys, "_day").agg(F.collect_list(F.struct("_sec", "_nth")).alias("_starts")))


def chunked(df: DataFrame, key, t_col: str, rows: int = CHUNK_ROWS, base: DataFrame | None = None) -> DataFrame:
    """``df`` with ``_b``, the number of the row's chunk: within a key it grows with time (NULL for
    a row without a time).  Rows are counted in ``base`` (keys and ``t_col``; ``df`` itself unless
    given), a scan that is as dense as ``df`` where ``df`` is costly to work out again."""
    keys = _keys(key)
    starts = chunk_starts(df if base is None else base, keys, t_col, rows)
    df = _joined(df.withColumn("_day", _day(F.col(t_col))), starts, [*keys, "_day"], "left")
    # before the first counted second of its day, a row goes on with the chunk of the days before
    nth = F.array_max(F.transform(F.filter("_starts", lambda s: s["_sec"] <= F.col(t_col)), lambda s: s["_nth"]))
    first = F.array_min(F.transform("_starts", lambda s: s["_nth"]))
    return df.withColumn("_b", F.when(F.col(t_col).isNotNull(), F.coalesce(nth, first, F.lit(0)))).drop("_day", "_starts")


def lag_fill(df: DataFrame, key, t_col: str, order_cols: list[str], value: str, out: str, rows: int = CHUNK_ROWS, base: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: ``value`` of the key's row just before by ``(t_col, *order_cols)``, from
    the chunk or, for its first row, from the last chunk before.  NULL for a row without a time."""
    keys = _keys(key)
    order = [F.col(t_col), *[F.col(c) for c in order_cols]]
    u = chunked(df, keys, t_col, rows, base)
    ends = (u.where(F.col(t_col).isNotNull()).groupBy(*keys, "_b").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")))
    wb = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.select(*keys, "_b", F.lag("_last").over(wb).alias("_carry"))
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    u = u.withColumn("_local", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    u = _joined(u, ends, [*keys, "_b"], "left")
    return u.withColumn(out, F.when(F.col(t_col).isNotNull(), F.coalesce("_local", "_carry")["v"])).drop("_b", "_local", "_carry")


def trailing(df: DataFrame, key, t_col: str, windows: dict[str, int], sums: dict[str, Column], rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with a column ``<sum>_<window>`` for each of ``sums`` (integers, NULL as 0) and of
    ``windows`` (seconds): the sum over the key's rows in ``[t - seconds, t]``.

    Every instant of a key asks for the running total at its end and just before each window's
    start; the running totals go over chunks, then over the chunks of a key.  A row without a
    time gets NULL sums."""
    keys = _keys(key)
    names = list(sums)
    # sums of small integers cannot leave 64 bits; each row of the line is that much narrower
    small = {f.name for f in df.select(*[sums[n].alias(n) for n in names]).schema if f.dataType.simpleString() in ("tinyint", "smallint", "int")}
    kind = {n: "bigint" if n in small else "decimal(38,0)" for n in names}
    inst = (df.where(F.col(t_col).isNotNull()).groupBy(*keys, F.col(t_col).alias("_t0"))
            .agg(*[F.coalesce(F.sum(sums[n].cast(kind[n])), F.lit(0)).cast(kind[n]).alias(n) for n in names]))
    none = [F.lit(0).cast(kind[n]).alias(n) for n in names]
    # _w: the window that asks, counted from 1; 0: the instant itself, which comes after what is asked at its time
    number = {w: i for i, w in enumerate(["", *windows])}
    here = F.struct(F.col("_t0").alias("_at"), F.lit(0).alias("_w"), *names)
    asks = [F.struct((F.col("_t0") - secs).alias("_at"), F.lit(number[w]).alias("_w"), *none) for w, secs in windows.items()]
    line = inst.select(*keys, "_t0", F.inline(F.array(here, *asks)))
    # chunks are counted in all rows of the line: what is asked before a key's first row, or on a day without rows, too
    base = df.select(*keys, F.explode(F.array(F.col(t_col), *[F.col(t_col) - secs for secs in windows.values()])).alias("_at"))
    line = chunked(line, keys, "_at", rows, base)
    w = Window.partitionBy(*keys, "_b").orderBy("_at", F.col("_w").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = line.groupBy(*keys, "_b").agg(*[F.sum(n).alias(n) for n in names])
    per_b = per_b.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_b").alias("_of_b"),
                         *[F.coalesce(F.sum(n).over(wb), F.lit(0)).cast(kind[n]).alias(f"_before_{n}") for n in names])
    same = line["_b"] == per_b["_of_b"]
    for k in keys:
        same = same & line[k].eqNullSafe(per_b[f"_of_{k}"])
    line = line.join(per_b, same).select(*keys, "_t0", "_w", *[(F.sum(n).over(w) + F.col(f"_before_{n}")).cast(kind[n]).alias(n) for n in names])
    at = {(n, x): F.max(F.when(F.col("_w") == i, F.col(n))) for n in names for x, i in number.items()}
    out = line.groupBy(*keys, "_t0").agg(*[(at[n, ""] - at[n, x]).cast("decimal(38,0)").alias(f"{n}_{x}") for n in names for x in windows])
    out = out.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_t0", *[f"{n}_{x}" for n in names for x in windows])
    same = df[t_col] == out["_t0"]
    for k in keys:
        same = same & df[k].eqNullSafe(out[f"_of_{k}"])
    return df.join(out, same, "left").drop("_t0", *[f"_of_{k}" for k in keys])


def _moments(x: str) -> list[Column]:
    return [F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("q")]


def _merged(a: Column, b: Column) -> Column:
    """The moments (n, m, q: count, mean, squared deviations) of two sets together; an empty or
    NULL one changes nothing."""
    none = lambda x: F.coalesce(x["n"], F.lit(0)) == 0
    n = a["n"] + b["n"]
    apart = b["m"] - a["m"]
    both = F.struct(n.alias("n"), (a["m"] + apart * b["n"] / n).alias("m"), (a["q"] + b["q"] + apart * apart * a["n"] * b["n"] / n).alias("q"))
    return F.when(none(a), b).when(none(b), a).otherwise(both)


def trailing_deviation(df: DataFrame, key, t_col: str, seconds: int, value: str, out: str, rows: int = CHUNK_ROWS, base: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: the sample deviation of ``value`` over the key's rows in
    ``[t - seconds, t]``.

    With panes of ``seconds``, a frame that ends in one pane starts in the pane before.  Each row
    asks the pane of ``t`` for its rows up to ``t`` and the pane before for its rows from
    ``t - seconds`` on: two running merges of moments over the rows of a (key, pane, chunk), to
    which the pane's chunks before (or behind) it are merged.  A row without a time gets NULL."""
    keys = _keys(key)
    x, t = F.col(value).cast("double"), F.col(t_col)
    none = F.lit(None).cast("double")
    # 1: the row; 2: asks what lies up to t; 0: asks what lies from t - seconds on
    line = df.where(t.isNotNull()).select(*keys, t.alias("_t0"), F.inline(F.array(
        F.struct(t.alias("_at"), F.lit(1).alias("_side"), x.alias("_x")), F.struct(t.alias("_at"), F.lit(2).alias("_side"), none.alias("_x")),
        F.struct((t - seconds).alias("_at"), F.lit(0).alias("_side"), none.alias("_x")))))
    base = (df if base is None else base).select(*keys, t.alias("_at"))
    line = chunked(line, keys, "_at", rows, base).withColumn("_pane", F.floor(F.col("_at") / seconds))
    part = [*keys, "_pane", "_b"]
    up = Window.partitionBy(*part).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(F.col("_at").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    over = lambda w: F.struct(F.count("_x").over(w).alias("n"), F.avg("_x").over(w).alias("m"), (F.var_pop("_x").over(w) * F.count("_x").over(w)).alias("q"))
    # only panes of several chunks have any before or behind: a row for each chunk of those
    whole = line.groupBy(*part).agg(*_moments("_x")).withColumn("_s", F.struct("n", "m", "q"))
    whole = whole.withColumn("_chunks", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_pane"))).where("_chunks > 1")
    pane = Window.partitionBy(*keys, "_pane").orderBy("_b")
    fold = lambda c: F.reduce(c, F.lit(None).cast("struct<n:bigint,m:double,q:double>"), lambda acc, y: _merged(acc, y))
    whole = whole.select(*part, fold(F.collect_list("_s").over(pane.rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
                         fold(F.collect_list("_s").over(pane.rowsBetween(1, Window.unboundedFollowing))).alias("_behind"))
    line = line.withColumn("_up", over(up)).withColumn("_down", over(down)).where("_side <> 1")
    line = _joined(line, whole, part, "left")
    line = line.withColumn("_s", F.when(F.col("_side") == 2, _merged(F.col("_before"), F.col("_up"))).otherwise(_merged(F.col("_down"), F.col("_behind"))))
    # rows of one instant ask the same; plain columns, which are summed up by hash
    asked = line.groupBy(*keys, "_t0").agg(*[F.max(F.when(F.col("_side") == side, F.col(f"_s.{c}"))).alias(f"_{c}{side}") for side in (0, 2) for c in "nmq"])
    sets = [F.struct(*[F.col(f"_{c}{side}").alias(c) for c in "nmq"]) for side in (0, 2)]
    found = asked.select(*keys, F.col("_t0").alias(t_col), _merged(*sets).alias("_m"))
    found = found.select(*keys, t_col, F.when(F.col("_m.n") > 1, F.sqrt(F.col("_m.q") / (F.col("_m.n") - 1))).alias(out))
    return _joined(df, found, [*keys, t_col], "left")


def asof_fill(data: DataFrame, queries: DataFrame, key, t_col: str, value_cols: list[str],
              order_cols: list[str] | None = None, strict: bool = False,
              rows: int = CHUNK_ROWS) -> DataFrame:
    """For each query row, the values of the last data row of the same key at or before it
    (strictly before when ``strict``), ordered by ``(t_col, *order_cols)``.  No look-back cap:
    rows with nothing earlier in their chunk take the carry from earlier chunks, resolved on
    a chunk-level table.  Returns ``queries`` plus ``value_cols`` (prefixed ``asof_``)."""
    keys = _keys(key)
    order_cols = order_cols or []
    vals = [f"asof_{c}" for c in value_cols]
    payload = [c for c in queries.columns if c not in keys + [t_col] + order_cols]
    d = data.select(*keys, t_col, *order_cols, *[F.col(c).alias(v) for c, v in zip(value_cols, vals)],
                    *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in payload],
                    F.lit(0 if not strict else 1).alias("_side"))
    q = queries.select(*keys, t_col, *order_cols, *[F.lit(None).cast(data.schema[c].dataType).alias(v)
                                                    for c, v in zip(value_cols, vals)],
                       *payload, F.lit(1 if not strict else 0).alias("_side"))
    u = chunked(d.unionByName(q), keys, t_col, rows)
    order = [F.col(t_col), *[F.col(c) for c in order_cols], F.col("_side")]
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    is_data = F.col("_side") == (0 if not strict else 1)
    # carry the whole data row as one struct so all values come from the same row
    pack = F.when(is_data, F.struct(*[F.col(v) for v in vals]))
    local = u.select("*", F.last(pack, ignorenulls=True).over(w).alias("_local"))
    # chunk level: last data row per (key, chunk) and, per chunk, the last one before it
    chunks = (u.groupBy(*keys, "_b")
              .agg(F.max_by(pack, F.when(is_data, F.struct(*order))).alias("_last")))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*keys, "_b", F.last("_last", ignorenulls=True).over(wb).alias("_carry"))
    # a NULL key is a key like any other, inside a chunk (window) and across chunks (join)
    carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"), "_carry")
    same = local["_b"] == carry["_k_b"]
    for k in keys:
        same = same & local[k].eqNullSafe(carry[f"_k_{k}"])
    res = (local.where(~is_data).join(carry, same, "left")
           .withColumn("_v", F.coalesce("_local", "_carry")))
    return res.select(*keys, t_col, *order_cols, *payload, *[F.col(f"_v.{v}").alias(v) for v in vals])


# ---------------------------------------------------------------- tick features
def tick_frame(ticks: DataFrame) -> DataFrame:
    """Ticks with epoch seconds ``t`` and mid price."""
    return ticks.select("tick_id", "par_id", "capturado_en", epoch_seconds("capturado_en").alias("t"),
                        "precio_compra", "precio_venta",
                        ((F.col("precio_compra") + F.col("precio_venta")) / 2).alias("mid"))


def with_returns(tf: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Tick-to-tick return ``mid / previous mid - 1`` per pair (previous by time, then id)."""
    prev = lag_fill(tf, "par_id", "t", ["tick_id"], "mid", "_prev", rows)
    return prev.withColumn("ret", F.try_divide(F.col("mid"), F.col("_prev")) - 1).drop("_prev")


def rolling_volatility(ticks: DataFrame, seconds: int = VOLATILITY_WINDOW_S, rows: int = CHUNK_ROWS) -> DataFrame:
    """Sample std-dev of tick returns over ``[t - seconds, t]`` per pair."""
    tf = tick_frame(ticks)
    out = trailing_deviation(with_returns(tf, rows), "par_id", "t", seconds, "ret", "volatilidad", rows, base=tf)
    return out.select("tick_id", "par_id", "capturado_en", "ret", "volatilidad")


def trailing_return(ticks: DataFrame, seconds: int = RETURN_LAG_S, rows: int = CHUNK_ROWS) -> DataFrame:
    """``mid / mid_asof(t - seconds) - 1`` where the reference price is the last tick at
    least ``seconds`` old (no staleness cap)."""
    tf = tick_frame(ticks)
    # one reference per instant, the last by id; only the time decides what is old enough
    shifted = (tf.groupBy("par_id", (F.col("t") + seconds).alias("t")).agg(F.max_by("mid", "tick_id").alias("mid")))
    res = asof_fill(shifted, tf, "par_id", "t", ["mid"], rows=rows)
    return res.select("tick_id", "par_id", "capturado_en", "mid", F.col("asof_mid").alias("mid_ref"),
                      (F.try_divide(F.col("mid"), F.col("asof_mid")) - 1).alias("retorno"))


def _local_ema(alpha: float):
    decay = 1.0 - alpha

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "tick_id"], kind="mergesort")
        x = pdf["mid"].astype("float64").reset_index(drop=True)
        k = pd.Series(range(1, len(x) + 1), dtype="float64")
        seeded = x.ewm(alpha=alpha, adjust=False).mean()          # y1 = x1
        local = seeded - (decay ** k) * x.iloc[0]                  # zero-start recurrence
        return pd.DataFrame({"tick_id": pdf["tick_id"].to_numpy(), "par_id": pdf["par_id"].to_numpy(),
                             "_b": pdf["_b"].to_numpy(), "t": pdf["t"].to_numpy(),
                             "mid": x.to_numpy(), "k": k.to_numpy(), "local": local.to_numpy()})
    return fn


def _bucket_scan(alpha: float):
    decay = 1.0 - alpha

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        seed = pdf["first_mid"].iloc[0]
        e_in, out = seed, []
        for n, last_local in zip(pdf["n"], pdf["last_local"]):
            out.append(e_in)
            e_in = last_local + (decay ** n) * e_in
        return pd.DataFrame({"par_id": pdf["par_id"].to_numpy(), "_b": pdf["_b"].to_numpy(), "e_in": out})
    return fn


def ema(ticks: DataFrame, n: int = EMA_SPAN, rows: int = CHUNK_ROWS) -> DataFrame:
    """W6 helper: exact EMA (alpha = 2/(n+1), seeded with the first mid) per pair.

    Two-level scan: (1) per (pair, chunk) the zero-started EMA of the chunk's ticks
    (``applyInPandas``; a chunk is bounded by its rows); (2) per pair a scan over the
    chunk summaries (one row per chunk) gives each chunk's incoming EMA; (3) ema =
    local + (1-alpha)^k * incoming.  Nothing holds a whole pair in one task.  A tick without a
    time has a NULL ema and counts for no other."""
    alpha = 2.0 / (n + 1)
    every = tick_frame(ticks).select("tick_id", "par_id", "t", "mid")
    tf = chunked(every.where(F.col("t").isNotNull()), "par_id", "t", rows)
    local = (tf.select("tick_id", "par_id", "_b", "t", "mid").groupBy("par_id", "_b")
             .applyInPandas(_local_ema(alpha), "tick_id long, par_id int, _b long, t double, mid double, k double, local double"))
    summ = (local.groupBy("par_id", "_b")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.max_by("local", "k").alias("last_local"),
                 F.min_by("mid", "k").alias("first_mid")))
    # the seed (first mid of the pair) travels with every summary row via a window on the small table
    wp = Window.partitionBy("par_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summ = summ.withColumn("first_mid", F.first("first_mid").over(wp))
    incoming = summ.groupBy("par_id").applyInPandas(_bucket_scan(alpha), "par_id int, _b long, e_in double")
    incoming = incoming.select(F.col("par_id").alias("_par"), F.col("_b").alias("_bb"), "e_in")
    res = local.join(incoming, local["par_id"].eqNullSafe(incoming["_par"]) & (local["_b"] == incoming["_bb"]))
    res = res.select("tick_id", "par_id", "t", "mid",
                     (F.col("local") + F.pow(F.lit(1.0 - alpha), F.col("k")) * F.col("e_in")).alias("ema"))
    untimed = every.where(F.col("t").isNull()).select(*[F.col(c).cast(res.schema[c].dataType) for c in ("tick_id", "par_id", "t", "mid")])
    return res.unionByName(untimed.withColumn("ema", F.lit(None).cast("double")))


def ema_distance(ticks: DataFrame, n: int = EMA_SPAN, rows: int = CHUNK_ROWS) -> DataFrame:
    """Distance of the mid to its EMA-n: ``mid / ema - 1``."""
    e = ema(ticks, n, rows)
    return e.select("tick_id", "par_id", "mid", "ema", (F.try_divide(F.col("mid"), F.col("ema")) - 1).alias("distancia_ema"))


def market_features(ticks: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """``spread_bps`` and relative volume = ticks in the last 5 min / (ticks in the last
    hour / 12)."""
    out = trailing(tick_frame(ticks), "par_id", "t", {"1h": 3600, "5m": 300}, {"n": F.lit(1)}, rows)
    n_5m, n_1h = F.col("n_5m").cast("long"), F.col("n_1h").cast("long")
    return out.select("tick_id", "par_id",
                      (F.try_divide(F.col("precio_venta") - F.col("precio_compra"), F.col("mid")) * 10000).alias("spread_bps"),
                      n_5m.alias("n_5m"), n_1h.alias("n_1h"), (n_5m / (n_1h / 12.0)).alias("volumen_relativo"))


def multi_window(ticks: DataFrame, windows: dict[str, int] | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Tick count and exact mean mid over several trailing windows."""
    windows = windows or MULTI_WINDOWS_S
    tf = tick_frame(ticks).select("tick_id", "par_id", "t", "mid")
    out = trailing(tf, "par_id", "t", windows, {"n": F.lit(1), "_total": scaled_int("mid", 5), "_k": F.col("mid").isNotNull().cast("int")}, rows)
    cols = [c for name in windows for c in (
        F.col(f"n_{name}").cast("long").alias(f"n_{name}"),
        exact_ratio(F.col(f"_total_{name}"), F.col(f"_k_{name}").cast("long") * 100000, 6).alias(f"mid_{name}"))]
    return out.select("tick_id", "par_id", *cols)


def portfolio_features(portfolios: DataFrame, ticks: DataFrame, rate_pair: int = 0) -> DataFrame:
    """Portfolio shares at the newest mid of ``rate_pair`` (read as COP per USD):
    ``usd_pct_total``, ``cop_pct_total`` and the deviation from the profile's USD target."""
    tf = tick_frame(ticks).where(F.col("par_id") == rate_pair)
    rate = tf.agg(F.max_by("mid", F.struct("t", "tick_id"))).scalar()
    usd = F.col("saldo_usd")
    cop_usd = F.try_divide(F.col("saldo_cop"), rate)
    total = usd + cop_usd
    target = F.create_map(*[F.lit(x) for kv in PROFILE_USD_TARGET.items() for x in kv])[F.col("perfil_riesgo")]
    out = portfolios.select("cliente_id", "perfil_riesgo",
                            F.round(usd * 100 / F.nullif(total, F.lit(0.0)), 6).alias("usd_pct_total"),
                            F.round(cop_usd * 100 / F.nullif(total, F.lit(0.0)), 6).alias("cop_pct_total"),
                            target.alias("_target"))
    return out.withColumn("desviacion_perfil_objetivo", F.round(F.col("usd_pct_total") - F.col("_target"), 6)).drop("_target")


def user_features(tx: DataFrame, user: str, ts: str, amount: str, days: int = 30, rows: int = CHUNK_ROWS) -> DataFrame:
    """Per transaction, the user's count and mean amount over the trailing ``days`` days
    (``[t - days, t]``), from running totals over row-bounded chunks, so a user holding a third
    of the rows is spread over many tasks."""
    tf = tx.withColumn("t", epoch_seconds(ts))
    out = trailing(tf, user, "t", {"w": days * 86400},
                   {"_f": F.lit(1), "_total": scaled_int(amount, 2), "_n": F.col(amount).isNotNull().cast("int")}, rows)
    return (out.withColumn("frecuencia_tx", F.col("_f_w").cast("long"))
            .withColumn("ticket_promedio", exact_ratio(F.col("_total_w"), F.col("_n_w").cast("long") * 100, 6)).drop("t", "_f_w", "_total_w", "_n_w"))


def enrich_asof(events: DataFrame, state: DataFrame, key: str, ts: str, value_cols: list[str],
                rows: int = CHUNK_ROWS) -> DataFrame:
    """Each event enriched with the latest state row of its key at or before the event
    (latest price per pair, latest portfolio per user).  Exact, no look-back cap."""
    ev = events.withColumn("_t", epoch_seconds(ts))
    st = state.withColumn("_t", epoch_seconds(ts)).drop(ts)
    res = asof_fill(st.select(key, "_t", *value_cols), ev, key, "_t", value_cols, rows=rows)
    return res.drop("_t")


# ---------------------------------------------------------------- W1-W3 re-exports
def rank_latest(df: DataFrame, key, order_col: str) -> DataFrame:
    """``row_number() over (partition by key order by order_col desc)`` kept as a column."""
    w = Window.partitionBy(*_keys(key)).orderBy(F.col(order_col).desc())
    return df.withColumn("rn", F.row_number().over(w))


# ---------------------------------------------------------------- S13 sessions
def sessionize(events: DataFrame, user: str, ts: str, id_col: str, gap_s: int = 1800,
               rows: int = CHUNK_ROWS) -> DataFrame:
    """Gap-based sessions per user (a new session starts when the previous event of the
    user is more than ``gap_s`` seconds earlier).  The previous event, then the latest session
    start up to each event, are found by chunks, so a user with a third of all events is still
    split by rows; then one aggregate per (user, session)."""
    t = events.select(user, id_col, epoch_seconds(ts).alias("_t"))
    prev = lag_fill(t, user, "_t", [id_col], "_t", "_tp", rows)
    flagged = prev.withColumn("_new", F.when(F.col("_tp").isNull() | (F.col("_t") - F.col("_tp") > gap_s), F.col("_t")))
    # the last start up to each event: from the chunk, or from the chunks before it
    u = chunked(flagged, user, "_t", rows, base=t)
    ends = u.groupBy(user, "_b").agg(F.max("_new").alias("_last"))
    before = Window.partitionBy(user).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(user, "_b", F.max("_last").over(before).alias("_carry"))
    w = Window.partitionBy(user, "_b").orderBy("_t", id_col).rowsBetween(Window.unboundedPreceding, 0)
    sess = _joined(u.withColumn("_local", F.max("_new").over(w)), ends, [user, "_b"], "left")
    sess = sess.withColumn("asof_s", F.coalesce("_local", "_carry"))
    return (sess.groupBy(user, F.col("asof_s").alias("_s"))
            .agg(F.count(F.lit(1)).alias("eventos"), F.max("_t").alias("_e"))
            .select(user, F.timestamp_micros((F.col("_s") * 1e6).cast("long")).cast("timestamp_ntz").alias("inicio"),
                    F.timestamp_micros((F.col("_e") * 1e6).cast("long")).cast("timestamp_ntz").alias("ultimo_evento"),
                    "eventos"))

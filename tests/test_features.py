"""Window features do not depend on the chunk size (i.e. on how the work is split)."""

from pyspark.sql import functions as F

from paths import SF001
from solera.mapping import Lake
from solera.operators import features as W
from solera.operators import fx as FX


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_rolling_and_asof_independent_of_chunk_size(spark):
    ticks = Lake(spark, SF001).ticks()
    a = W.rolling_volatility(ticks)
    b = W.rolling_volatility(ticks, rows=7)               # many small chunks
    assert _rows(a, ["tick_id", "ret", "volatilidad"]) == _rows(b, ["tick_id", "ret", "volatilidad"])
    r1 = W.trailing_return(ticks)
    r2 = W.trailing_return(ticks, rows=5)                 # the look-up crosses several chunks
    assert _rows(r1, ["tick_id", "mid_ref"]) == _rows(r2, ["tick_id", "mid_ref"])


def test_ema_independent_of_chunk_size(spark):
    ticks = Lake(spark, SF001).ticks()
    e1 = W.ema(ticks)                                     # one chunk per pair and day
    e2 = W.ema(ticks, rows=9)
    a = dict(e1.select("tick_id", "ema").collect())
    b = dict(e2.select("tick_id", "ema").collect())
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= 1e-9 * max(1.0, abs(a[k])) for k in a)


def test_ticks_without_a_time_stay_and_count_for_no_other(spark):
    from solera.operators import rules as R
    ticks = Lake(spark, SF001).ticks()
    lost = {r["tick_id"] for r in ticks.orderBy("tick_id").limit(3).collect()}
    gone = F.col("tick_id").isin(*lost)
    holed = ticks.withColumn("capturado_en", F.when(~gone, F.col("capturado_en")))
    for made, col in ((lambda t: W.ema_distance(t, rows=9), "distancia_ema"), (lambda t: R.trigger_every(t, rows=9), "posicion")):
        got, want = (dict(made(t).select("tick_id", col).collect()) for t in (holed, ticks.where(~gone)))
        assert got.keys() == want.keys() | lost and all(got[k] is None for k in lost)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_trailing_sums_independent_of_chunk_size(spark):
    lk = Lake(spark, SF001)
    cols = ["tick_id", "n_5m", "mid_5m", "n_24h", "mid_24h"]
    assert _rows(W.multi_window(lk.ticks()), cols) == _rows(W.multi_window(lk.ticks(), rows=11), cols)


def test_chunks_follow_rows_also_for_a_null_key(spark):
    # 100 rows of one key in 50 seconds, a null key, a null time, all rows of a second together
    df = spark.createDataFrame([("a", float(k // 2)) for k in range(100)] + [(None, float(k)) for k in range(30)] + [("a", None)],
                               "k string, t double")
    got = W.chunked(df, "k", "t", rows=10).collect()
    assert len(got) == 131
    chunks: dict = {}
    for r in got:
        if r.t is not None:
            chunks.setdefault((r.k, r._b), []).append(r.t)
    assert all(len(c) <= 11 for c in chunks.values()) and len(chunks) == 10 + 3
    for k in ("a", None):
        spans = sorted((b, min(c), max(c)) for (key, b), c in chunks.items() if key == k)
        assert all(x[2] < y[1] for x, y in zip(spans, spans[1:]))
    sums = W.trailing(df, "k", "t", {"3s": 3}, {"n": F.lit(1)}, rows=10)
    assert {(r.k, r.t): r.n_3s for r in sums.collect()} == {
        ("a", None): None, **{("a", float(t)): 2 * min(t + 1, 4) for t in range(50)}, **{(None, float(t)): min(t + 1, 4) for t in range(30)}}


def test_chunks_of_trailing_sums_hold_no_more_than_their_rows(spark, monkeypatch):
    # a day of a row a second, eight days without any, a day; the longest window asks on days without rows and before the first
    times = [float(d * 86400 + s) for d in (0, 9) for s in range(600)]
    df = spark.createDataFrame([("a", t) for t in times], "k string, t double")
    windows = {"10s": 10, "5m": 300, "2d": 2 * 86400}
    lines, chunked = [], W.chunked
    monkeypatch.setattr(W, "chunked", lambda *a, **kw: lines.append(chunked(*a, **kw)) or lines[-1])
    got = {r.t: (r.n_10s, r.n_5m, r.n_2d) for r in W.trailing(df, "k", "t", windows, {"n": F.lit(1)}, rows=100).collect()}
    assert got == {t: tuple(sum(t - s <= x <= t for x in times) for s in windows.values()) for t in times}
    sizes = [r["count"] for r in lines[0].groupBy("k", "_b").count().collect()]
    assert sum(sizes) == 4 * len(times) and max(sizes) <= 100 + 4


def test_attribution_windows(spark):
    import datetime as dt
    t = lambda m: dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    clicks = spark.createDataFrame([(1, 7, t(0)), (2, 7, t(100)), (3, 8, t(0))], "event_id long, user_id long, ts timestamp_ntz")
    txs = spark.createDataFrame([(7, t(30)), (7, t(131)), (8, t(0))], "user_id long, ts timestamp_ntz")
    got = {r.event_id: r.convertida for r in FX.attribute_conversions(clicks, txs, "user_id", "ts").collect()}
    assert got == {1: True, 2: False, 3: False}          # 30 min inclusive, 31 min out, same instant out


def test_percentiles_exact(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 10]], "v double")
    got = {r.p: r.valor for r in FX.discrete_percentiles(df, "v", [0.0, 0.2, 0.5, 0.8, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.2: 1.0, 0.5: 2.0, 0.8: 3.0, 1.0: 10.0}


def test_deviation_over_panes_and_chunks(spark):
    import random
    import statistics
    rng = random.Random(4)
    # one key holds most rows, hundreds of them inside one pane; ties, outliers, nulls
    rows = [("hot", rng.choice((1000.0, 1001.5, 1002.25, 1300.0, 1599.5)) + rng.randrange(300) / 2, rng.choice((1e6, 1.0, -2.5, None, 0.125))) for _ in range(900)]
    rows += [(k, 40.0 * n, float(n % 7)) for k in ("a", None) for n in range(40)] + [("hot", None, 5.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, t double, x double")
    want = {}
    for i, (k, t, _) in enumerate(rows):
        near = [x for kk, tt, x in rows if kk == k and t is not None and tt is not None and t - 300 <= tt <= t and x is not None]
        want[i] = statistics.stdev(near) if len(near) > 1 else None
    for n in (5, 64, 500_000):
        got = dict(W.trailing_deviation(df, "k", "t", 300, "x", "d", rows=n).select("id", "d").collect())
        assert got.keys() == want.keys()
        for i, w in want.items():
            assert (got[i] is None) == (w is None) and (w is None or abs(got[i] - w) <= 1e-9 * max(1.0, w)), (n, i, got[i], w)


def test_lag_crosses_chunks(spark):
    df = spark.createDataFrame([("k", float(t), t) for t in range(50)] + [(None, 1.0, 7), (None, 2.0, 8), ("k", None, 99)], "k string, t double, v int")
    for n in (3, 500_000):
        got = {(r.k, r.v): r.p for r in W.lag_fill(df, "k", "t", ["v"], "v", "p", rows=n).collect()}
        assert got == {("k", 99): None, (None, 7): None, (None, 8): 7, **{("k", t): t - 1 if t else None for t in range(50)}}


def test_sessions_independent_of_chunk_size(spark):
    ev = Lake(spark, SF001).raw("events").select("event_id", "user_id", "ts")
    a, b = (sorted(W.sessionize(ev, "user_id", "ts", "event_id", 1800, rows=n).collect()) for n in (2, 500_000))
    assert a == b and len(a) > 100


def test_building_a_feature_query_runs_no_job(spark, monkeypatch):
    from solera import mapping
    from solera.plans.registry import QUERIES
    reads, read = [], mapping.read_table
    monkeypatch.setattr(mapping, "read_table", lambda *a: reads.append(a) or read(*a))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for name in ("w4_rolling_volatility", "w5_trailing_return", "w6_ema_distance", "w7_market_features", "w9_user_features", "w10_multi_window",
                 "c8_attribute_conversions", "c9_enrich_asof", "s4_trigger_every", "s8_rule_contradiction", "s13_sessions"):
        before, first = jobs(), len(reads)
        QUERIES[name](spark, SF001)
        # a table's schema is read from its footer, which is a job of its own
        assert 0 < jobs() - before <= len(reads) - first, name

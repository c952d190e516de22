"""Keyed streams (decisions, triggers, silence) against their batch twins: files that come one by
one, late rows, and a restart from the checkpoint in the middle."""

import datetime as dt
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paths import SF001
from solera.mapping import Lake, portfolio_updates
from solera.operators import rules as R
from solera.streaming import keyed as K
from solera.streaming import ticks as S


class Feed:
    """A folder whose files are read one a micro-batch, and a query that stops and goes on."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema, self.n = spark, root, schema, 0

    def add(self, df):
        path = str(self.root / "in" / f"f{self.n:03d}")
        df.coalesce(1).write.parquet(path)
        for d, _, files in os.walk(path):
            for f in files:
                os.utime(os.path.join(d, f), (time.time() - 5000 + 10 * self.n,) * 2)
        self.n += 1

    def source(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(self.root / "in"))

    def run(self, df):
        q = (df.writeStream.format("parquet").option("path", str(self.root / "out")).option("checkpointLocation", str(self.root / "state"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        self.q = q
        return self.spark.read.schema(df.schema).parquet(str(self.root / "out"))


@pytest.fixture(scope="module")
def lake(spark):
    return Lake(spark, SF001)


def parts(df, ts, n):
    """``df`` cut into n parts by time, each with its rows in no order."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    step = (hi - lo) / n
    return [df.where((F.col(ts) >= lo + step * k) & ((F.col(ts) < lo + step * (k + 1)) if k < n - 1 else F.lit(True))) for k in range(n)], hi


TRAPS = [  # (id, local hour and minute on 2024-02-10, tipo, par, score, canal)
    (1, 9, 0, "comprar", 1, 0.9), (2, 9, 29, "vender", 1, 0.9), (3, 9, 30, "vender", 1, 0.9), (4, 9, 31, "vender", 1, 0.9), (5, 12, 0, "comprar", 2, 0.65), (6, 12, 1, "comprar", 2, 0.64),
    (7, 13, 0, "comprar", 2, 0.9), (8, 22, 0, "comprar", 0, 0.9), (9, 6, 59, "comprar", 0, 0.9), (10, 7, 0, "vender", 0, 0.9), (11, 23, 30, "vender", 0, 0.9), (12, 21, 59, "vender", 0, 0.9)]


def test_decisions_equal_the_batch_after_a_restart(spark, lake, tmp_path):
    user = lake.portfolios().where(R.channel_opt_in()["push"]).first()["cliente_id"]
    n = lake.notifications().withColumn("enviada_en", F.col("enviada_en").cast("timestamp"))
    t0 = dt.datetime(2024, 2, 10, 5)  # midnight in Bogota
    traps = spark.createDataFrame([(10_000_000 + i, user, tipo, par, 1.0, score, "push", "m", t0 + dt.timedelta(hours=h, minutes=m), False, False) for i, h, m, tipo, par, score in TRAPS], n.schema)
    closing = spark.createDataFrame([(20_000_000, 1, "comprar", 1, 1.0, 0.1, "push", "m", t0 + dt.timedelta(days=4), False, False)], n.schema)
    n = n.unionByName(traps).cache()
    chunks, hi = parts(n, "enviada_en", 5)
    feed = Feed(spark, tmp_path, n.schema)
    stream = lambda: K.decide_stream(feed.source(), lake.portfolios())
    for c in chunks[:3]:
        feed.add(c)
    early = feed.run(stream()).collect()
    late = spark.createDataFrame([(30_000_000, user, "comprar", 1, 1.0, 0.9, "push", "m", dt.datetime(2024, 1, 2), False, False)], n.schema)
    feed.add(late)  # far behind the watermark that the first part left
    for c in [*chunks[3:], closing]:
        feed.add(c)
    got = feed.run(stream())
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0) for p in feed.q.recentProgress if p["stateOperators"])
    want = {(r.notificacion_id, r.deliver_at, r.decision) for r in R.decide(n, lake.portfolios()).collect()}
    rows = [(r.notificacion_id, r.deliver_at.replace(tzinfo=None), r.decision) for r in got.where("notificacion_id <> 20000000").collect()]
    assert len(early) > 0 and dropped == 1
    assert len(rows) == len(set(rows)) and set(rows) == want
    decided = {i - 10_000_000: d for i, _, d in rows if i >= 10_000_000}
    assert decided[2] == decided[3] == "contradiction" and decided[6] == "score" and decided[9] != decided[10] == "contradiction"


def test_triggers_equal_the_batch_after_a_restart(spark, lake, tmp_path):
    ticks = S.as_event_time(lake.ticks(), "capturado_en")
    updates = S.as_event_time(portfolio_updates(lake), "actualizado_en")
    a, b = Feed(spark, tmp_path / "a", ticks.schema), Feed(spark, tmp_path / "b", updates.schema)
    a.root.mkdir(), b.root.mkdir()
    ta, ub = parts(ticks, "capturado_en", 4)[0], parts(updates, "actualizado_en", 4)[0]
    for k in range(4):
        a.add(ta[k])
        b.add(ub[k])
        if k == 1:
            first = a.run(K.triggers_stream(a.source(), b.source())).count()
    got = a.run(K.triggers_stream(a.source(), b.source()))
    key = lambda df: sorted((r.origen, r.clave, r.evento_id, r.motivo) for r in df.collect())
    want = key(R.evaluation_triggers(ticks, updates))
    assert 0 < first < len(want) and key(got) == want
    assert {r[0] for r in want} == {"ticks", "portafolio"}
    # more chunks, the same triggers; an update without a change triggers nothing
    assert key(R.evaluation_triggers(ticks, updates, rows=7)) == want
    assert len([r for r in want if r[0] == "portafolio"]) < updates.count()


def test_a_group_of_users_is_one_call_and_each_keeps_its_own_content():
    class Map(dict):
        reads = writes = 0

        def exists(self):
            return bool(self)

        def getValue(self, key):
            self.reads += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.writes += 1
            self[key] = value

    state = Map()
    handle = type("Handle", (), {"getValueState": lambda *_: None, "getMapState": lambda *_: state})()
    p = K._Trigger(5)
    p.init(handle)

    def call(*rows):
        pdf = pd.DataFrame(rows, columns=["clave", "evento_id", "instante", "contenido"]).assign(origen=R.FROM_PORTFOLIO, grupo=0)
        pdf["instante"] = pd.to_datetime(pdf["instante"], unit="s")
        out = pd.concat(p.handleInputRows((R.FROM_PORTFOLIO, 0), iter([pdf.iloc[:2], pdf.iloc[2:]]), None))
        return sorted(zip(out["clave"], out["evento_id"], strict=True))

    # out of order, two users whose contents alternate between them but not for each of them
    assert call((2, 12, 2, "b"), (1, 10, 1, "a"), (1, 11, 3, "a"), (2, 13, 4, "b"), (3, 14, 5, "c"), (3, 15, 6, "d")) == [(1, 10), (2, 12), (3, 14), (3, 15)]
    assert (state.reads, state.writes) == (0, 3)
    # only the users of the micro-batch are looked up, only what changed is written
    assert call((1, 20, 7, "a"), (3, 22, 9, "c"), (3, 21, 8, "d"), (4, 23, 8, "d")) == [(3, 22), (4, 23)]
    assert (state.reads, state.writes) == (3, 5) and state == {(1,): ("a",), (2,): ("b",), (3,): ("c",), (4,): ("d",)}


def test_users_that_share_a_group_trigger_as_in_the_batch(spark, lake, tmp_path):
    ticks = S.as_event_time(lake.ticks(), "capturado_en")
    updates = S.as_event_time(portfolio_updates(lake), "actualizado_en")
    a, b = Feed(spark, tmp_path / "a", ticks.schema), Feed(spark, tmp_path / "b", updates.schema)
    a.root.mkdir(), b.root.mkdir()
    ta, ub = parts(ticks, "capturado_en", 2)[0], parts(updates, "actualizado_en", 2)[0]
    for k in range(2):
        a.add(ta[k])
        b.add(ub[k])
        got = a.run(K.triggers_stream(a.source(), b.source(), groups=3))
    key = lambda df: sorted((r.origen, r.clave, r.evento_id, r.instante, r.motivo) for r in df.collect())
    assert key(got) == key(R.evaluation_triggers(ticks, updates))


def test_silent_windows_are_filled_and_told(spark, lake, tmp_path):
    ticks = S.as_event_time(lake.ticks(), "capturado_en").where("capturado_en < '2024-01-03'").cache()
    gap = ticks.where("capturado_en < '2024-01-01 06:00' or capturado_en >= '2024-01-01 09:00'")
    feed = Feed(spark, tmp_path, ticks.schema)
    chunks, hi = parts(gap, "capturado_en", 3)
    for c in chunks:
        feed.add(c)
    got = feed.run(K.silence_stream(feed.source(), clock=False))
    # empty windows behind the last counted one are final with the next one
    last = got.agg(F.max("inicio")).first()[0]
    assert last > hi - dt.timedelta(minutes=20)
    closed = F.col("inicio").cast("timestamp") <= F.lit(last)
    want = {(r.inicio.replace(tzinfo=None), r.ticks, r.alarma) for r in S.throughput_alarms_batch(gap).where(closed).collect()}
    rows = {(r.inicio.replace(tzinfo=None), r.ticks, r.alarma) for r in got.where(closed).collect()}
    assert rows == want and sum(n == 0 for _, n, _ in rows) >= 180

    # a feed that pauses: the clock's timers tell one silent window after the other
    live = Feed(spark, tmp_path / "live", ticks.schema)
    live.root.mkdir()
    live.add(chunks[0])
    q = (K.silence_stream(live.source(), patience_s=1).writeStream.format("memory").queryName("s12_live").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "live_state")).trigger(processingTime="500 milliseconds").start())
    try:
        for _ in range(120):
            time.sleep(1)
            if spark.table("s12_live").where("motivo = 'silencio'").count() >= 2:
                break
    finally:
        q.stop()
    told = [r.inicio for r in spark.table("s12_live").where("motivo = 'silencio' and alarma and ticks = 0").orderBy("inicio").collect()]
    last = spark.table("s12_live").where("motivo = 'final'").agg(F.max("inicio")).first()[0]
    assert len(told) >= 2 and told[:2] == [last + dt.timedelta(minutes=k) for k in (1, 2)]

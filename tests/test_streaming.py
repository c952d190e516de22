"""Streams replayed from files with availableNow equal their batch twins."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from paths import SF001
from solera.mapping import Lake
from solera.operators import fx as FX
from solera.operators import rules as R
from solera.streaming import ticks as S


def _stamp(folder, when: float) -> None:
    """Give every data file of ``folder`` the modification time ``when`` (replay order)."""
    for root, _, files in os.walk(folder):
        for f in files:
            os.utime(os.path.join(root, f), (when, when))


@pytest.fixture(scope="module")
def tick_files(spark, tmp_path_factory):
    """Canonical ticks (event time as timestamp) written as Parquet in 6 time-ordered chunks."""
    root = tmp_path_factory.mktemp("ticks")
    t = S.as_event_time(Lake(spark, SF001).ticks(), "capturado_en")
    lo, hi = t.agg(F.min("capturado_en"), F.max("capturado_en")).first()
    step = (hi - lo) / 6
    for i in range(6):
        a, b = lo + step * i, lo + step * (i + 1)
        part = t.where((F.col("capturado_en") >= a) & ((F.col("capturado_en") < b) if i < 5 else F.lit(True)))
        part.coalesce(1).write.parquet(str(root / f"chunk={i:02d}"))
        _stamp(str(root / f"chunk={i:02d}"), time.time() - 1000 + 10 * i)
    return str(root), t.schema, t


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def _run_to_memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_s1_ingest_and_rejects(spark, tmp_path):
    src = tmp_path / "src"
    ticks = Lake(spark, SF001).ticks()
    S.ticks_to_json(S.as_event_time(ticks, "capturado_en")).coalesce(2).write.text(str(src / "a"))
    (src / "b").mkdir()
    (src / "b" / "bad.txt").write_text('not json\n{"tick_id": 1, "par_id": 0, "precio_compra": -1, "precio_venta": 1, '
                                       '"capturado_en": "2024-01-01T00:00:00"}\n{"tick_id": 2}\n')
    q1, q2 = S.start_ingest(spark, str(src) + "/*", str(tmp_path / "raw"), str(tmp_path / "rej"), str(tmp_path / "ck"))
    q1.awaitTermination()
    q2.awaitTermination()
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert raw.count() == ticks.count()
    assert "hora" in raw.columns
    rej = {r.motivo: r["count"] for r in spark.read.parquet(str(tmp_path / "rej")).groupBy("motivo").count().collect()}
    assert rej == {"unparsable": 1, "bad_price": 1, "missing_field": 1}


def test_s2_windows_stream_equals_batch(spark, tick_files):
    path, schema, batch = tick_files
    for size, slide, name in (("5 minutes", None, "s2_tumble"), ("10 minutes", "5 minutes", "s2_slide")):
        _run_to_memory(S.window_features(_stream(spark, path, schema), size, slide), name)
        got = spark.table(name)
        hi = batch.agg(F.max("capturado_en")).first()[0]
        final = F.col("fin") <= F.lit(hi - dt.timedelta(minutes=10))       # windows already closed by the watermark
        want = S.window_features(batch, size, slide, watermark=None).where(final)
        cols = ["inicio", "fin", "par_id", "ticks", F.round("mid_medio", 9).alias("m")]
        assert sorted(got.where(final).select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_s2_late_tick_beyond_watermark_is_dropped(spark, tmp_path):
    """Spark drops rows older than the previous batch's watermark: batch 0 moves the
    watermark to 12:20, batch 1 closes the 12:00 window, the 12:01 tick of batch 2 is late."""
    sch = "tick_id long, par_id int, precio_compra double, precio_venta double, capturado_en timestamp"
    t0 = dt.datetime(2024, 1, 1, 12, 0)
    d = tmp_path / "late"
    batches = [[(1, 0, 1.0, 1.0, t0), (2, 0, 1.0, 1.0, t0 + dt.timedelta(minutes=30))],
               [(3, 0, 1.0, 1.0, t0 + dt.timedelta(minutes=40))],
               [(4, 0, 1.0, 1.0, t0 + dt.timedelta(minutes=1))]]          # 39 minutes late
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, sch).coalesce(1).write.parquet(str(d / f"c{i}"))
        _stamp(str(d / f"c{i}"), time.time() - 100 + 10 * i)
    q = _run_to_memory(S.window_features(_stream(spark, str(d), spark.read.parquet(str(d / "c0")).schema), "5 minutes"), "s2_late")
    got = [(r.inicio, r.ticks) for r in spark.table("s2_late").collect()]
    assert got.count((t0, 1)) == 1 and len([g for g in got if g[0] == t0]) == 1
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0) for p in q.recentProgress if p["stateOperators"])
    assert dropped == 1


def test_s3_latest_state_stream_equals_batch(spark, tick_files, tmp_path):
    path, schema, batch = tick_files
    target = str(tmp_path / "state")
    latest = S.latest_by_key(_stream(spark, path, schema), "par_id", "capturado_en", ["tick_id", "precio_compra"])
    q = (latest.writeStream.outputMode("update").foreachBatch(S.upsert_micro_batch(target, "par_id", "capturado_en"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    state = spark.read.parquet(target)
    assert state.groupBy("par_id").count().where("count > 1").count() == 0      # one row per key
    got = sorted(state.select("par_id", "tick_id").collect())
    want = sorted(S.latest_by_key(batch, "par_id", "capturado_en", ["tick_id"]).select("par_id", "tick_id").collect())
    assert got == want


def test_s4_every_n_stream_equals_batch(spark, tick_files):
    path, schema, batch = tick_files
    _run_to_memory(S.trigger_every_stream(_stream(spark, path, schema), n=5), "s4_stream")
    got = sorted((r.tick_id, r.posicion) for r in spark.table("s4_stream").collect())
    want = sorted((r.tick_id, r.posicion) for r in R.trigger_every(batch, n=5).where("evalua").collect())
    assert got == want


def test_s11_feedback_labels_stream_equals_batch(spark, tmp_path):
    ev = S.as_event_time(Lake(spark, SF001).raw("events"), "ts")
    clicks, txs = tmp_path / "clicks", tmp_path / "txs"
    ev.where("event_type = 'click'").select("event_id", "user_id", "ts").coalesce(1).write.parquet(str(clicks))
    ev.where("event_type = 'purchase'").select("user_id", "ts").coalesce(1).write.parquet(str(txs))
    cs = spark.readStream.schema(spark.read.parquet(str(clicks)).schema).parquet(str(clicks))
    ts = spark.readStream.schema(spark.read.parquet(str(txs)).schema).parquet(str(txs))
    _run_to_memory(S.feedback_labels(cs, ts, 30), "s11")
    got = {r.event_id: r.etiqueta for r in spark.table("s11").collect()}
    want = {r.event_id: int(r.convertida) for r in FX.attribute_conversions(
        spark.read.parquet(str(clicks)), spark.read.parquet(str(txs)), "user_id", "ts").collect()}
    # matched clicks are emitted at once; unmatched ones once the watermark passes them
    assert all(want[k] == v for k, v in got.items())
    assert {k for k, v in want.items() if v == 1} <= set(got)


def test_s12_alarms_stream_equals_batch(spark, tick_files):
    path, schema, batch = tick_files
    _run_to_memory(S.throughput_alarms(_stream(spark, path, schema)), "s12")
    hi = batch.agg(F.max("capturado_en")).first()[0]
    closed = F.col("inicio") < F.lit(hi - dt.timedelta(minutes=11))
    got = sorted(spark.table("s12").where(closed).collect())
    want = sorted(S.throughput_alarms(batch, watermark=None).where(closed).collect())
    assert got == want
    assert S.backlog_alarm({"sources": [{"metrics": {"maxOffsetsBehindLatest": "6000"}}]})
    assert not S.backlog_alarm({"sources": [{"metrics": {}}]})


def test_a15_only_new_files(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    sch = "id long"
    spark.range(0, 10).coalesce(1).write.parquet(str(src / "f1"))
    S.ingest_new_files(spark, str(src) + "/*", spark.range(1).schema, out, ck)
    assert spark.read.parquet(out).count() == 10
    spark.range(10, 15).coalesce(1).write.parquet(str(src / "f2"))
    q = S.ingest_new_files(spark, str(src) + "/*", spark.range(1).schema, out, ck)
    assert spark.read.parquet(out).count() == 15
    assert q.lastProgress is None or q.lastProgress["numInputRows"] <= 5
    assert sch


def test_s3_state_sink_rewrites_only_touched_buckets(spark, tmp_path):
    target = str(tmp_path / "state")
    sink = S.upsert_micro_batch(target, "k", "ts", buckets=8)
    t0 = dt.datetime(2024, 1, 1)
    sch = "k long, ts timestamp, v string"
    sink(spark.createDataFrame([(i, t0, f"a{i}") for i in range(40)], sch), 0)
    before = {d.name: sorted(p.name for p in d.iterdir()) for d in (tmp_path / "state").iterdir() if d.is_dir()}
    # key 7 gets a newer value, key 8 an older one (must not win)
    sink(spark.createDataFrame([(7, t0 + dt.timedelta(hours=1), "new"), (8, t0 - dt.timedelta(hours=1), "old")], sch), 1)
    after = {d.name: sorted(p.name for p in d.iterdir()) for d in (tmp_path / "state").iterdir() if d.is_dir()}
    changed = {b for b in before if before[b] != after.get(b)}
    assert 1 <= len(changed) <= 2 < len(before)
    state = {r.k: r.v for r in spark.read.parquet(target).collect()}
    assert len(state) == 40 and state[7] == "new" and state[8] == "a8"


def test_s3_state_sink_completes_a_stopped_batch(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    target, t0, sch = str(tmp_path / "state"), dt.datetime(2024, 1, 1), "k long, ts timestamp, v string"
    sink = S.upsert_micro_batch(target, "k", "ts", buckets=4)
    real = DataFrameWriter.parquet

    def stop_at(where):
        def parquet(self, path, *a, **kw):
            if path == where:
                raise KeyboardInterrupt
            return real(self, path, *a, **kw)
        return parquet
    first = spark.createDataFrame([(i, t0, f"a{i}") for i in range(20)], sch)
    second = spark.createDataFrame([(3, t0 + dt.timedelta(hours=1), "new")], sch)
    for n, where in ((0, f"{target}/_pending"), (0, target), (1, f"{target}/_pending"), (1, target)):
        monkeypatch.setattr(DataFrameWriter, "parquet", stop_at(where))
        with pytest.raises(KeyboardInterrupt):
            sink([first, second][n], n)
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
        if (n, where) == (0, target):
            sink(first, 0)
    # the stream runs the stopped batch again; another one completes it just as well
    sink(spark.createDataFrame([(99, t0, "x")], sch), 2)
    state = {r.k: r.v for r in spark.read.parquet(target).collect()}
    assert len(state) == 21 and state[3] == "new" and state[4] == "a4"


def test_s13_sessions_stream_equals_batch(spark, tmp_path):
    from solera.operators import features as W
    ev = S.as_event_time(Lake(spark, SF001).raw("events"), "ts").select("event_id", "user_id", "ts")
    src = tmp_path / "ev"
    ev.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(ev.schema).parquet(str(src))
    _run_to_memory(S.session_counts_stream(stream, "user_id", "ts", "30 minutes"), "s13")
    got = {(r.user_id, r.inicio.replace(tzinfo=None)): r.eventos for r in spark.table("s13").collect()}
    want = {(r.user_id, r.inicio): r.eventos for r in W.sessionize(ev, "user_id", "ts", "event_id", 1800).collect()}
    assert got and all(want.get(k) == v for k, v in got.items())     # every emitted (closed) session agrees
    hi = ev.agg(F.max("ts")).first()[0].replace(tzinfo=None)
    closed = {k for k in want if k[1] < hi - dt.timedelta(hours=2)}
    assert closed <= set(got)

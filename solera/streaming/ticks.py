"""Structured Streaming for ticks and notifications.

Every streaming function takes and returns a streaming DataFrame (or starts a query with a
checkpoint) and has a batch twin built from the *same* transformation function, so the
tests can assert stream == batch on the driver ``events`` data replayed from files with
``trigger(availableNow=True)``.

Event times arrive as ``timestamp_ntz`` in the driver data; watermarks need ``timestamp``,
so ``as_event_time`` casts first (session time zone UTC).  No Kafka connector ships offline,
so sources here are file sources; ``readStream.format("kafka")`` drops in unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solera.functions.scalar import exact_avg

# --- fixed values ---------------------------------------------------------------------------
WATERMARK = "10 minutes"
MIN_TICKS_PER_S = 2              # alarm when fewer than 2 ticks/s over a 60 s window
ALARM_WINDOW = "60 seconds"
BACKLOG_MAX = 5000
# --------------------------------------------------------------------------------------------

TICK_JSON_SCHEMA = T.StructType([
    T.StructField("tick_id", T.LongType()),
    T.StructField("par_id", T.IntegerType()),
    T.StructField("precio_compra", T.DoubleType()),
    T.StructField("precio_venta", T.DoubleType()),
    T.StructField("capturado_en", T.TimestampType()),
])


def as_event_time(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


# ---------------------------------------------------------------- S1 ingest + schema validation
def parse_ticks(raw: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON text -> typed ticks, and the reject stream (unparsable text or missing
    required fields / non-positive prices) with the reason."""
    parsed = raw.select(F.col(text_col).alias("raw"),
                        F.from_json(F.col(text_col), TICK_JSON_SCHEMA, {"mode": "PERMISSIVE"}).alias("t"))
    ok = (F.col("t").isNotNull() & F.col("t.tick_id").isNotNull() & F.col("t.par_id").isNotNull()
          & F.col("t.capturado_en").isNotNull() & (F.col("t.precio_compra") > 0) & (F.col("t.precio_venta") > 0))
    valid = parsed.where(ok).select("t.*").withColumn("hora", F.date_format("capturado_en", "yyyy-MM-dd-HH"))
    reason = (F.when(F.col("t").isNull() | F.col("t.tick_id").isNull(), F.lit("unparsable"))
              .when(F.col("t.par_id").isNull() | F.col("t.capturado_en").isNull(), F.lit("missing_field"))
              .otherwise(F.lit("bad_price")))
    rejects = parsed.where(~F.coalesce(ok, F.lit(False))).select("raw", reason.alias("motivo"))
    return valid, rejects


def start_ingest(spark: SparkSession, source_dir: str, raw_out: str, rejects_out: str, checkpoint: str,
                 available_now: bool = True):
    """Text files of JSON ticks -> hourly-partitioned Parquet + reject Parquet.  Two
    file-sink queries (each exactly-once through its own checkpoint and sink log)."""
    raw = spark.readStream.format("text").load(source_dir)
    valid, rejects = parse_ticks(raw)
    trig = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    q1 = (valid.writeStream.format("parquet").option("path", raw_out)
          .option("checkpointLocation", f"{checkpoint}/valid").partitionBy("hora").trigger(**trig).start())
    q2 = (rejects.writeStream.format("parquet").option("path", rejects_out)
          .option("checkpointLocation", f"{checkpoint}/rejects").trigger(**trig).start())
    return q1, q2


def ticks_to_json(ticks: DataFrame) -> DataFrame:
    """Serialise canonical ticks as the JSON text a feed would deliver (for replay tests)."""
    return ticks.select(F.to_json(F.struct(*[F.col(f.name) for f in TICK_JSON_SCHEMA.fields])).alias("value"))


# ---------------------------------------------------------------- S2 window features
def window_features(ticks: DataFrame, size: str = "5 minutes", slide: str | None = None,
                    watermark: str | None = WATERMARK) -> DataFrame:
    """Per pair and event-time window (tumbling, or sliding with ``slide``): tick count,
    mean / min / max mid.  With ``watermark`` (streams) late rows older than the watermark
    are dropped and windows are emitted once final (append mode)."""
    df = ticks.withColumn("mid", (F.col("precio_compra") + F.col("precio_venta")) / 2)
    if watermark:
        df = df.withWatermark("capturado_en", watermark)
    win = F.window("capturado_en", size, slide) if slide else F.window("capturado_en", size)
    return (df.groupBy(win.alias("ventana"), "par_id")
            .agg(F.count(F.lit(1)).alias("ticks"), exact_avg("mid", 5).alias("mid_medio"),
                 F.min("mid").alias("mid_min"), F.max("mid").alias("mid_max"))
            .select(F.col("ventana.start").alias("inicio"), F.col("ventana.end").alias("fin"), "par_id",
                    "ticks", "mid_medio", "mid_min", "mid_max"))


# ---------------------------------------------------------------- S3 latest state per key
def latest_by_key(df: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """S3: latest row per key (the greatest event time, of equal ones the greatest values of
    ``cols`` in order) -- a streaming aggregation whose state is one row per key (update mode),
    or the batch twin."""
    return (df.groupBy(key).agg(F.max(F.struct(ts, *cols)).alias("_l"))
            .select(key, *[F.col(f"_l.{c}").alias(c) for c in [ts, *cols]]))


def upsert_micro_batch(target_path: str, key: str, ts: str, buckets: int = 64):
    """S3 sink for ``foreachBatch``: merge the batch's latest rows into a Parquet state table
    (newer event time wins).  The table is partitioned by ``pmod(hash(key), buckets)``; each
    micro-batch reads and rewrites only the buckets its keys fall in (the current rows come
    through a semi join on the bucket column, i.e. partition pruning, and the write uses
    dynamic partition overwrite), so a batch costs O(touched buckets), not O(state).  The
    merged rows are written to ``_pending`` inside the table before they replace the folders they
    were read from; a batch that stopped in between is completed by the next call (a batch run
    twice changes nothing, as the newest row of a key stays the newest)."""
    pending = f"{target_path.rstrip('/')}/_pending"

    def replace(spark: SparkSession, fs, path) -> None:
        (spark.read.parquet(pending).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_bucket").parquet(target_path))
        fs.delete(path(pending), True)

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(target_path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path(f"{pending}/_SUCCESS")):
            replace(spark, fs, path)
        b = batch.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
        merged = b
        if len(fs.globStatus(path(f"{target_path}/_bucket=*")) or []):  # a read error is an error
            touched = b.select("_bucket").distinct()
            merged = spark.read.parquet(target_path).join(touched, "_bucket", "left_semi").unionByName(b)
        cols = [c for c in merged.columns if c not in (key, ts, "_bucket")]
        latest_by_key(merged, key, ts, cols + ["_bucket"]).write.mode("overwrite").parquet(pending)
        replace(spark, fs, path)
    return fn


# ---------------------------------------------------------------- S4 every N ticks (keyed state)
def trigger_every_stream(ticks: DataFrame, n: int = 5, timeout: str = "NoTimeout") -> DataFrame:
    """Emit every n-th tick per pair.  ``applyInPandasWithState`` keeps one counter per
    pair; within a micro-batch the pair's ticks are ordered by (time, id)."""
    out_schema = "tick_id long, par_id int, capturado_en timestamp, posicion long"
    state_schema = "count long"

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["capturado_en", "tick_id"], kind="mergesort")
        pos = seen + pd.RangeIndex(1, len(batch) + 1).to_numpy()
        state.update((int(seen + len(batch)),))
        hit = pos % n == 0
        yield pd.DataFrame({"tick_id": batch["tick_id"].to_numpy()[hit], "par_id": batch["par_id"].to_numpy()[hit],
                            "capturado_en": batch["capturado_en"].to_numpy()[hit], "posicion": pos[hit]})

    return (ticks.select("tick_id", "par_id", "capturado_en").groupBy("par_id")
            .applyInPandasWithState(fn, out_schema, state_schema, "append", timeout))


# ---------------------------------------------------------------- S11 stream-stream attribution
def feedback_labels(clicks: DataFrame, txs: DataFrame, minutes: int = 30, watermark: str = WATERMARK) -> DataFrame:
    """Label each click 1 when the user transacts within ``minutes`` after it, else 0.
    Stream-stream left outer join on user with a time-range condition (state bounded by the
    watermarks), then one row per click."""
    c = clicks.select("event_id", F.col("user_id").alias("c_user"), F.col("ts").alias("c_ts")).withWatermark("c_ts", watermark)
    t = txs.select(F.col("user_id").alias("t_user"), F.col("ts").alias("t_ts")).withWatermark("t_ts", watermark)
    cond = ((F.col("c_user") == F.col("t_user")) & (F.col("t_ts") > F.col("c_ts"))
            & (F.col("t_ts") <= F.col("c_ts") + F.expr(f"INTERVAL {minutes} MINUTES")))
    joined = c.join(t, cond, "leftOuter")
    labelled = joined.select("event_id", F.col("c_user").alias("user_id"), "c_ts",
                             F.col("t_ts").isNotNull().cast("int").alias("etiqueta"))
    return labelled.dropDuplicatesWithinWatermark(["event_id", "etiqueta"])


# ---------------------------------------------------------------- S12 throughput alarms
def throughput_alarms(ticks: DataFrame, window: str = ALARM_WINDOW, min_per_s: float = MIN_TICKS_PER_S,
                      watermark: str | None = WATERMARK) -> DataFrame:
    """Ticks per tumbling window and the alarm flag when the rate is below ``min_per_s``.
    A grouped count has no row for a window without ticks: ``throughput_alarms_batch`` fills
    them; on a stream the backlog alarm and the source's progress show that nothing comes."""
    df = ticks.withWatermark("capturado_en", watermark) if watermark else ticks
    secs = int(window.split()[0])
    return (df.groupBy(F.window("capturado_en", window).alias("w")).agg(F.count(F.lit(1)).alias("ticks"))
            .select(F.col("w.start").alias("inicio"), "ticks",
                    (F.col("ticks") / F.lit(float(secs)) < min_per_s).alias("alarma")))


def throughput_alarms_batch(ticks: DataFrame, window: str = ALARM_WINDOW, min_per_s: float = MIN_TICKS_PER_S) -> DataFrame:
    """S12 over a table: every window from the first tick to the last, with 0 ticks and an alarm
    where there are none.  A window fills the gap up to the next one, so no calendar is joined."""
    found = throughput_alarms(ticks, window, min_per_s, watermark=None).select("inicio", "ticks")
    secs = int(window.split()[0])
    # the next window by day, and the first of the next day that has one: no window over all rows
    day = F.date_trunc("day", "inicio")
    found = found.withColumn("dia", day)
    days = found.groupBy("dia").agg(F.min("inicio").alias("primera"))
    days = days.select("dia", F.lead("primera").over(Window.orderBy("dia")).alias("dia_siguiente"))
    nxt = F.lead("inicio").over(Window.partitionBy("dia").orderBy("inicio"))
    found = found.withColumn("sig", nxt).join(days, "dia").withColumn("sig", F.coalesce("sig", "dia_siguiente"))
    step = F.expr(f"INTERVAL {secs} SECOND")
    starts = F.when(F.col("sig").isNull(), F.array("inicio")).otherwise(F.sequence(F.col("inicio"), F.col("sig") - step, step))
    return (found.select("inicio", F.explode(starts).alias("w"), "ticks")
            .select(F.col("w").alias("inicio"), F.when(F.col("w") == F.col("inicio"), F.col("ticks")).otherwise(F.lit(0).cast("long")).alias("ticks"))
            .withColumn("alarma", F.col("ticks") / F.lit(float(secs)) < min_per_s))


def backlog_alarm(progress: dict | None, threshold: int = BACKLOG_MAX) -> bool:
    """Backlog alarm from a ``StreamingQueryProgress`` (driver-side metadata): true when
    a source reports more than ``threshold`` offsets behind latest."""
    if not progress:
        return False
    for src in progress.get("sources", []):
        behind = (src.get("metrics") or {}).get("maxOffsetsBehindLatest")
        if behind is not None and float(behind) > threshold:
            return True
    return False


# ---------------------------------------------------------------- A15 incremental new files
def ingest_new_files(spark: SparkSession, source_dir: str, schema: T.StructType, out: str, checkpoint: str,
                     fmt: str = "parquet", transform=None):
    """Process only files not seen before (file-source stream, ``availableNow``: run it
    as a batch job on a schedule; the checkpoint is the bookmark).  Returns the finished query."""
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    if transform is not None:
        src = transform(src)
    q = (src.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# ---------------------------------------------------------------- S13 sessions (stream)
def session_counts_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes",
                          watermark: str = WATERMARK) -> DataFrame:
    """S13 on a stream: ``session_window`` per user with a watermark (append mode emits a
    session once the watermark passes its end).  The batch twin is ``features.sessionize``."""
    return (events.withWatermark(ts, watermark)
            .groupBy(user, F.session_window(ts, gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("eventos"), F.max(ts).alias("ultimo_evento"))
            .select(user, F.col("s.start").alias("inicio"), "ultimo_evento", "eventos"))

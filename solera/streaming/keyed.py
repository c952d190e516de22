"""Keyed state machines on streams: notification decisions (S10 with S5-S9), evaluation triggers
(S4) and feed silence (S12).

Each is a ``StatefulProcessor`` of ``transformWithStateInPandas``: state per key in the RocksDB
store (``with_state_store``), timers in event time (decisions) or processing time (silence), and
a batch twin that the tests hold it against:

=====================  ==============================  =========================================
stream                 key                             batch twin
=====================  ==============================  =========================================
``decide_stream``      user                            ``rules.decide``
``triggers_stream``    pair, or group of users         ``rules.evaluation_triggers``
``silence_stream``     feed                            ``ticks.throughput_alarms_batch``
=====================  ==============================  =========================================
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from solera.operators import rules as R
from solera.streaming.ticks import ALARM_WINDOW, MIN_TICKS_PER_S, WATERMARK

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.datetime(1970, 1, 1)


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with several variables and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the processors are classes of this module: workers that do not start in the repository find it
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (home, env.get("PYTHONPATH", "")) if p)


# ---------------------------------------------------------------- S10 + S5-S9
_DECISION = "notificacion_id long, cliente_id long, deliver_at timestamp, decision string"


class _Decide(StatefulProcessor):
    """One user.  A notification waits in ``queue`` until the watermark has passed its delivery
    time: then every notification to be delivered before it is known (an event still to come is
    delivered no earlier than it was made), so they are decided in order of delivery.  ``sent``
    holds what was sent on the local day of the last decision; it is cleared when the day is over.
    A score that is too low needs no state and is decided at once."""

    def __init__(self, tz: str, min_score: float, cap: int, minutes: int):
        self.tz, self.min_score, self.cap, self.near_us = tz, min_score, cap, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "s long, made long, id long, tipo string, par_id int, ok boolean")
        self.sent = handle.getListState("sent", "day int, s long, tipo string, par_id int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, first = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            low = ~(pdf["score_confianza"] >= self.min_score)
            yield self._out(key, [(r.id, r.s, "score") for r in pdf[low].itertuples()])
            for r in pdf[~low].itertuples():
                self.queue.appendValue((int(r.s), int(r.made), int(r.id), r.tipo, int(r.par_id), bool(r.ok)))
                first = int(r.s) if first is None else min(first, int(r.s))
        if first is not None:
            self.handle.registerTimer(max(first // 1000, watermark) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs() * 1000
        queue = sorted(tuple(x) for x in self.queue.get())
        due, left = [x for x in queue if x[0] < over], [x for x in queue if x[0] >= over]
        sent, out = [tuple(x) for x in self.sent.get()], []
        for s, _, n, tipo, par_id, ok in due:
            day = self._day(s)
            sent = [x for x in sent if x[0] == day]
            if len(sent) >= self.cap:
                out.append((n, s, "rate_limit"))
            elif any(t == R.OPPOSITE.get(tipo) and p == par_id and x >= s - self.near_us for _, x, t, p in sent):
                out.append((n, s, "contradiction"))
            elif not ok:
                out.append((n, s, "opt_in"))
            else:
                out.append((n, s, "sent"))
                sent.append((day, s, tipo, par_id))
        today = self._day(over)
        self._keep(self.queue, left)
        self._keep(self.sent, [x for x in sent if x[0] >= today])
        again = [left[0][0] // 1000 + 1] if left else []
        if sent and sent[-1][0] >= today:  # nothing of the day is kept when it is over
            again.append(self._end_of(sent[-1][0]))
        if again:
            self.handle.registerTimer(max(min(again), over // 1000 + 1))
        yield self._out(key, out)

    def close(self) -> None:
        pass

    def _day(self, us: int) -> int:
        local = dt.datetime.fromtimestamp(us // 1_000_000, ZoneInfo(self.tz)).replace(tzinfo=None)
        return (local - _EPOCH).days

    def _end_of(self, day: int) -> int:
        return int((_EPOCH + dt.timedelta(days=day + 1)).replace(tzinfo=ZoneInfo(self.tz)).timestamp() * 1000) + 1

    @staticmethod
    def _keep(state, rows: list) -> None:
        state.clear()
        if rows:
            state.put(rows)

    @staticmethod
    def _out(key, rows: list) -> pd.DataFrame:
        return pd.DataFrame({"notificacion_id": pd.Series([r[0] for r in rows], dtype="int64"), "cliente_id": pd.Series([key[0]] * len(rows), dtype="int64"),
                             "deliver_at": pd.to_datetime(pd.Series([r[1] for r in rows], dtype="int64"), unit="us"),
                             "decision": pd.Series([r[2] for r in rows], dtype="object")})


def decide_stream(notif: DataFrame, portfolios: DataFrame, tz: str = R.DEFAULT_TZ, min_score: float = R.MIN_SCORE, cap: int = R.DAILY_CAP,
                  minutes: int = R.CONTRADICTION_MINUTES, watermark: str = WATERMARK) -> DataFrame:
    """S10 on a stream: one decision per notification of a known user, as ``rules.decide`` makes
    it, once the watermark has passed its delivery time.  ``portfolios`` is a table or any
    snapshot of it (read anew by each micro-batch).  Rows behind the watermark are dropped and
    counted by Spark; rows without a user or a time are no notification."""
    with_state_store(notif.sparkSession)
    prefs = portfolios.select("cliente_id", R.channel_opt_in().alias("_prefs"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = (notif.where("cliente_id is not null and enviada_en is not null").withColumn("enviada_en", F.col("enviada_en").cast("timestamp"))
            .withWatermark("enviada_en", watermark).join(prefs, "cliente_id", "left").withColumn("_at", R.deliver_at("enviada_en", tz)))
    rows = rows.select(F.col("cliente_id").cast("long").alias("cliente_id"), "enviada_en", us("_at").alias("s"), us("enviada_en").alias("made"),
                       F.col("notificacion_id").cast("long").alias("id"), "tipo", F.coalesce("par_id", F.lit(-1)).cast("int").alias("par_id"), "score_confianza",
                       F.coalesce(F.col("_prefs")[F.col("canal")], F.lit(False)).alias("ok"))
    return rows.groupBy("cliente_id").transformWithStateInPandas(
        statefulProcessor=_Decide(tz, min_score, cap, minutes), outputStructType=_DECISION, outputMode="Append", timeMode="EventTime")


# ---------------------------------------------------------------- S4 both triggers
_TRIGGER = "origen string, clave long, evento_id long, instante timestamp, motivo string"


#: Groups that the users of portfolios are dealt into, the key of their state: a query keeps it for
#: as long as its checkpoint lives.
USER_GROUPS = 4096


class _Trigger(StatefulProcessor):
    """One pair (counts its ticks) or one group of users (remembers the content of each one's
    portfolio).  A user is an entry of the group's map state, read and written only when it has
    updates: what a call costs is paid once a group, not once a user."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.content = handle.getMapState("content", "clave long", "c string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = self._ticks(rows).assign(clave=key[1]) if key[0] == R.FROM_TICKS else self._updates(rows)
        yield pd.DataFrame({"origen": key[0], "clave": pdf["clave"], "evento_id": pdf["evento_id"], "instante": pdf["instante"],
                            "motivo": R.TRIGGER_REASONS[key[0]]}).astype({"clave": "int64", "evento_id": "int64"})

    def close(self) -> None:
        pass

    def _ticks(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat([r[["evento_id", "instante"]] for r in rows], ignore_index=True).sort_values(["instante", "evento_id"])
        seen = self.count.get()[0] if self.count.exists() else 0
        self.count.update((seen + len(pdf),))
        return pdf.iloc[self.n - 1 - seen % self.n::self.n]

    def _updates(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat([r[["clave", "evento_id", "instante", "contenido"]] for r in rows], ignore_index=True).sort_values(["clave", "instante", "evento_id"])
        users, now = pdf["clave"].to_numpy(), pdf["contenido"].to_numpy(dtype="object")
        first = np.append(True, users[1:] != users[:-1])
        known = self.content.exists()
        kept = [self.content.getValue((int(u),)) if known else None for u in users[first]]
        before = np.append(None, now[:-1])
        before[first] = [k[0] if k else None for k in kept]
        for u, old, c in zip(users[first], before[first], now[np.append(first[1:], True)], strict=True):
            if old is None or c != old:
                self.content.updateValue((int(u),), (c,))
        return pdf[[old is None or c != old for old, c in zip(before, now, strict=True)]]


def triggers_stream(ticks: DataFrame, updates: DataFrame, n: int = R.EVERY_N_TICKS, groups: int = USER_GROUPS) -> DataFrame:
    """S4 on two streams that share one keyed state: every n-th tick of a pair, and every update
    of a user's portfolio that changes its content.  Each micro-batch is taken in order of time;
    events must not come in a later one than their successors (as from a log by key)."""
    with_state_store(ticks.sparkSession)
    group = F.when(F.col("origen") == R.FROM_TICKS, F.col("clave")).otherwise(F.pmod(F.xxhash64("clave"), F.lit(groups)))
    both = R.trigger_events(ticks, updates).withColumn("grupo", group)
    return both.groupBy("origen", "grupo").transformWithStateInPandas(
        statefulProcessor=_Trigger(n), outputStructType=_TRIGGER, outputMode="Append", timeMode="None")


# ---------------------------------------------------------------- S12 silence
_SILENCE = "fuente string, inicio timestamp, ticks long, alarma boolean, motivo string"


class _Silence(StatefulProcessor):
    """One feed.  Counted windows come in; those in between are filled with 0.  A processing-time
    timer, set anew by each window that comes, reports the next window as silent when it fires."""

    def __init__(self, secs: int, min_per_s: float, patience_ms: int | None):
        self.secs, self.min_per_s, self.patience_ms = secs, min_per_s, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "final long, told long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("s")
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for s, n in zip(pdf["s"].tolist(), pdf["ticks"].tolist(), strict=True):
            if last is not None:
                out += [(w, 0, "final") for w in range(last + self.secs, s, self.secs)]
            out.append((s, n, "final"))
            last = s
        self.last.update((last, last))
        self._wait(timerValues)
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final, told = self.last.get()
        self.last.update((final, told + self.secs))
        self._wait(timerValues)
        yield self._out(key, [(told + self.secs, 0, "silencio")])

    def close(self) -> None:
        pass

    def _wait(self, timerValues) -> None:
        if self.patience_ms is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def _out(self, key, rows: list) -> pd.DataFrame:
        return pd.DataFrame({"fuente": pd.Series([key[0]] * len(rows), dtype="object"), "inicio": pd.to_datetime(pd.Series([r[0] for r in rows], dtype="int64"), unit="s"),
                             "ticks": pd.Series([r[1] for r in rows], dtype="int64"), "alarma": pd.Series([r[1] / self.secs < self.min_per_s for r in rows], dtype="bool"),
                             "motivo": pd.Series([r[2] for r in rows], dtype="object")})


def silence_stream(ticks: DataFrame, window: str = ALARM_WINDOW, min_per_s: float = MIN_TICKS_PER_S, watermark: str = WATERMARK,
                   patience_s: float | None = None, clock: bool = True) -> DataFrame:
    """S12 with silence: a row per window and feed, also for windows without ticks.

    Ticks are counted per feed and window first (partial counts), so the keyed state sees one row
    a window.  ``motivo`` is ``final`` for a window that the watermark closed, and for the empty
    ones before it, and ``silencio`` for the alarm raised when nothing came for ``patience_s``
    (the window's length) by the clock; such a window gets its final row when the feed resumes.
    Without the ``clock`` (a replay, whose pauses mean nothing) there are only final rows; with it
    a stream goes on until it is stopped."""
    with_state_store(ticks.sparkSession)
    secs = int(window.split()[0])
    counted = (ticks.withWatermark("capturado_en", watermark).groupBy(F.window("capturado_en", window).alias("w"), "fuente").agg(F.count(F.lit(1)).alias("ticks"))
               .select("fuente", F.unix_seconds("w.start").alias("s"), "ticks"))
    return counted.groupBy("fuente").transformWithStateInPandas(
        statefulProcessor=_Silence(secs, min_per_s, int(1000 * (patience_s or secs)) if clock else None), outputStructType=_SILENCE, outputMode="Append",
        timeMode="ProcessingTime" if clock else "None")

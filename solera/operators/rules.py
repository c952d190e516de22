"""Notification rules (S4-S10) in batch form.

Flow (first failing reason wins): score >= 0.65 -> fewer than 3 notifications sent that
local day -> local hour within [07:00, 22:00), otherwise queued to the next 07:00 (a delay,
not a rejection) -> no contradictory notification (comprar vs vender, same user and pair)
sent in the previous 30 minutes -> user opted in to the channel -> sent.

Semantics we fix (the design gives the rules, not these details): rules are evaluated at
the delivery time ``deliver_at`` (creation time, or the next 07:00 for queued ones), the cap
counts notifications *sent* on the local delivery date, and the contradiction window is
``[deliver_at - 30 min, deliver_at]``.  Deliveries happen only between 07:00 and 22:00, so
a window never reaches the previous day and every (user, local date) is independent.

``decide`` is exact and distributed: the sent set of each (user, day) is found with one
pass per allowed notification (``daily_cap`` passes, 3 by default).  Pass k joins the
candidates with a per-group state row (at most k-1 sent notifications as a small array)
and takes, per group, the first eligible candidate after the last sent one that no sent
notification contradicts (``min_by`` -- a partial aggregate, so a user with a third of all
rows is combined map-side).  No group is ever collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solera.operators.features import CHUNK_ROWS, asof_fill, chunked
from solera.functions.scalar import epoch_seconds
from solera.session import ensure_checkpoint_dir

# --- fixed values ---------------------------------------------------------------------------
MIN_SCORE = 0.65
DAILY_CAP = 3
QUIET_START_H, QUIET_END_H = 7, 22       # deliver only in [07:00, 22:00) local time
CONTRADICTION_MINUTES = 30
OPPOSITE = {"comprar": "vender", "vender": "comprar"}
DEFAULT_TZ = "America/Bogota"
EVERY_N_TICKS = 5
FROM_TICKS, FROM_PORTFOLIO = "ticks", "portafolio"
TRIGGER_REASONS = {FROM_TICKS: "cada_n_ticks", FROM_PORTFOLIO: "cambio_portafolio"}
# --------------------------------------------------------------------------------------------


def rule_score(df: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Keep score >= min_score (NULL scores are dropped)."""
    return df.where(F.col("score_confianza") >= min_score)


def deliver_at(ts: str = "enviada_en", tz: str = DEFAULT_TZ, start_h: int = QUIET_START_H,
               end_h: int = QUIET_END_H) -> Column:
    """Delivery time (UTC wall clock, timestamp_ntz): unchanged inside [start, end) local
    hours, else the next local ``start_h``:00."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    h = F.hour(local)
    day_start = F.date_trunc("day", local)
    morning = day_start + F.make_interval(hours=F.lit(start_h))
    queued = F.when(h < start_h, morning).otherwise(morning + F.expr("INTERVAL 1 DAY"))
    local_out = F.when((h >= start_h) & (h < end_h), local).otherwise(queued)
    return F.to_utc_timestamp(local_out, tz).cast("timestamp_ntz")


def rule_quiet_hours(df: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Add ``deliver_at`` and the ``encolada`` flag."""
    return (df.withColumn("deliver_at", deliver_at("enviada_en", tz))
            .withColumn("encolada", F.col("deliver_at") != F.col("enviada_en")))


def local_date(col: str, tz: str = DEFAULT_TZ) -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(col).cast("timestamp"), tz))


def rule_daily_cap(df: DataFrame, cap: int = DAILY_CAP, ts: str = "enviada_en", tz: str = DEFAULT_TZ,
                   id_col: str = "notificacion_id") -> DataFrame:
    """S6 on its own: keep the first ``cap`` rows per (user, local date) by (time, id).
    The rank is ``row_number`` with a ``WindowGroupLimit`` (partial top-k before the shuffle)."""
    from pyspark.sql import Window
    w = Window.partitionBy("cliente_id", local_date(ts, tz)).orderBy(F.col(ts), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def rule_contradiction(df: DataFrame, minutes: int = CONTRADICTION_MINUTES, ts: str = "enviada_en",
                       id_col: str = "notificacion_id") -> DataFrame:
    """S8 on its own: flag rows with an opposite-type row of the same user and pair in the
    ``minutes`` before (strictly earlier by (time, id)).  Exact as-of lookup keyed by
    (user, pair, type), chunked by rows, so hot users are split."""
    t = epoch_seconds(ts)
    data = df.select("cliente_id", "par_id", F.col("tipo").alias("_k"), t.alias("_t"), F.col(id_col).alias("_id"),
                     t.alias("t_prev"))
    opp = F.create_map(*[F.lit(x) for kv in OPPOSITE.items() for x in kv])[F.col("tipo")]
    q = df.select("*", opp.alias("_k"), t.alias("_t"), F.col(id_col).alias("_id"))
    res = asof_fill(data, q, ["cliente_id", "par_id", "_k"], "_t", ["t_prev"], order_cols=["_id"], strict=True)
    flagged = F.coalesce(F.col("_t") - F.col("asof_t_prev") <= minutes * 60, F.lit(False))
    return res.withColumn("contradictoria", flagged).drop("_k", "_t", "_id", "asof_t_prev")


def channel_opt_in(prefs_json: str = "preferencias_notif") -> Column:
    """Parsed preferences map (channel -> opted in)."""
    return F.from_json(F.col(prefs_json), "map<string,boolean>")


def rule_opt_in(df: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Keep notifications whose user opted in to the notification's channel (semi join)."""
    prefs = portfolios.select("cliente_id", F.explode(channel_opt_in()).alias("canal", "ok")).where(F.col("ok"))
    return df.join(prefs.select("cliente_id", "canal"), ["cliente_id", "canal"], "left_semi")


def trigger_every(ticks: DataFrame, n: int = EVERY_N_TICKS, rows: int = CHUNK_ROWS) -> DataFrame:
    """S4 batch twin: mark every n-th tick of each pair (by time, then id).  The position in
    the pair is the position inside a (pair, chunk) plus the ticks of earlier chunks
    (a running sum over the small chunk table), so no pair sits in one task.  A tick without a time
    has no position (NULL) and marks nothing."""
    from pyspark.sql import Window
    every = ticks.select("tick_id", "par_id", "capturado_en", epoch_seconds("capturado_en").alias("t"))
    t = chunked(every.where(F.col("t").isNotNull()), "par_id", "t", rows)
    w = Window.partitionBy("par_id", "_b").orderBy("t", "tick_id")
    local = t.withColumn("_rn", F.row_number().over(w))
    per_b = t.groupBy("par_id", "_b").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy("par_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_b.select("par_id", "_b", F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_off"))
    offs = offs.select(F.col("par_id").alias("_par"), F.col("_b").alias("_bb"), "_off")
    pos = (local.join(offs, local["par_id"].eqNullSafe(offs["_par"]) & (local["_b"] == offs["_bb"]))
           .withColumn("posicion", F.col("_rn") + F.col("_off")))
    untimed = every.where(F.col("t").isNull()).withColumn("posicion", F.lit(None).cast("long"))
    return (pos.select("tick_id", "par_id", "capturado_en", "posicion")
            .unionByName(untimed.select("tick_id", "par_id", "capturado_en", "posicion"))
            .withColumn("evalua", (F.col("posicion") % n) == 0))


def trigger_events(ticks: DataFrame, updates: DataFrame) -> DataFrame:
    """What the two triggers of S4 look at, in one shape: ticks keyed by pair, portfolio updates
    (cliente_id, version_id, actualizado_en, perfil_riesgo, preferencias_notif, ...) keyed by user,
    with the content as JSON of every column but the key, the version and the time.  Rows without
    a key or a time trigger nothing."""
    kept = [c for c in updates.columns if c not in ("cliente_id", "version_id", "actualizado_en")]
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(kept)])) if kept else F.lit("{}")
    shape = lambda origin, key, event, at, c: [F.lit(origin).alias("origen"), F.col(key).cast("long").alias("clave"), F.col(event).cast("long").alias("evento_id"),
                                               F.col(at).cast("timestamp").alias("instante"), c.alias("contenido")]
    both = (ticks.select(*shape(FROM_TICKS, "par_id", "tick_id", "capturado_en", F.lit(None).cast("string")))
            .unionByName(updates.select(*shape(FROM_PORTFOLIO, "cliente_id", "version_id", "actualizado_en", content))))
    return both.where("clave is not null and instante is not null")


def evaluation_triggers(ticks: DataFrame, updates: DataFrame, n: int = EVERY_N_TICKS, rows: int = CHUNK_ROWS) -> DataFrame:
    """S4, both triggers over tables: every n-th tick of a pair, and every update of a user's
    portfolio whose content differs from the one before it (by time, then version).

    The update before is looked up by chunks (``asof_fill``), so no user's updates must fit in
    one task."""
    both = trigger_events(ticks, updates)
    every = trigger_every(ticks.where("par_id is not null"), n, rows).where("evalua").select(
        F.lit(FROM_TICKS).alias("origen"), F.col("par_id").cast("long").alias("clave"), F.col("tick_id").alias("evento_id"), F.col("capturado_en").cast("timestamp").alias("instante"))
    u = both.where(F.col("origen") == FROM_PORTFOLIO).select("clave", "evento_id", "instante", "contenido", epoch_seconds("instante").alias("t"))
    before = asof_fill(u.select("clave", "t", "evento_id", F.struct("contenido").alias("c")), u, "clave", "t", ["c"], order_cols=["evento_id"], strict=True, rows=rows)
    changed = before.where(F.col("asof_c").isNull() | ~F.col("asof_c.contenido").eqNullSafe(F.col("contenido")))
    out = every.unionByName(changed.select(F.lit(FROM_PORTFOLIO).alias("origen"), "clave", "evento_id", "instante"))
    reason = F.create_map(*[F.lit(x) for kv in TRIGGER_REASONS.items() for x in kv])[F.col("origen")]
    return out.withColumn("motivo", reason)


def decide(notif: DataFrame, portfolios: DataFrame, tz: str = DEFAULT_TZ, min_score: float = MIN_SCORE,
           cap: int = DAILY_CAP, minutes: int = CONTRADICTION_MINUTES) -> DataFrame:
    """One decision per notification -- ``sent`` or the first failing rule
    (``score``, ``rate_limit``, ``contradiction``, ``opt_in``) -- plus ``deliver_at``."""
    prefs = portfolios.select("cliente_id", channel_opt_in().alias("_prefs"))
    base = (notif.join(prefs, "cliente_id", "left")
            .withColumn("deliver_at", deliver_at("enviada_en", tz))
            .withColumn("_s", epoch_seconds("deliver_at"))
            .withColumn("_day", local_date("deliver_at", tz))
            .withColumn("_ord", F.struct(F.col("_s"), F.col("enviada_en"), F.col("notificacion_id")))
            .withColumn("_score_ok", F.coalesce(F.col("score_confianza") >= min_score, F.lit(False)))
            .withColumn("_optin_ok", F.coalesce(F.col("_prefs")[F.col("canal")], F.lit(False)))
            .drop("_prefs"))
    group = ["cliente_id", "_day"]
    eligible = base.where(F.col("_score_ok") & F.col("_optin_ok")).select(
        *group, "_ord", "_s", "tipo", "par_id")
    opp = F.create_map(*[F.lit(x) for kv in OPPOSITE.items() for x in kv])

    def contradicted(acc: Column) -> Column:
        return F.exists(acc, lambda x: (x["par_id"] == F.col("par_id")) & (x["tipo"] == opp[F.col("tipo")])
                        & (x["s"] >= F.col("_s") - minutes * 60))

    state = None      # per group: the order of the last sent and the list of the sent
    ensure_checkpoint_dir(notif.sparkSession)
    for _ in range(cap):
        cand = eligible
        if state is not None:
            # cut the lineage between passes: pass k would otherwise plan passes 1..k-1 again
            # inside its own plan.  The state is one small row per (user, day).
            state = state.checkpoint(eager=True)
            cand = cand.join(state, group).where((F.col("_ord") > F.col("_last")) & ~F.coalesce(contradicted(F.col("_acc")), F.lit(False)))
        pick = cand.groupBy(*group).agg(F.min_by(F.struct("_ord", "_s", "tipo", "par_id"), F.col("_ord")).alias("_p"))
        sent = F.struct(F.col("_p._ord").alias("o"), F.col("_p._s").alias("s"), F.col("_p.tipo").alias("tipo"),
                        F.col("_p.par_id").alias("par_id"))
        new = pick.select(*group, F.col("_p._ord").alias("_nl"), F.array(sent).alias("_na"))
        if state is None:
            state = new.withColumnsRenamed({"_nl": "_last", "_na": "_acc"})
        else:       # every group with a candidate has a state since the first pass
            state = (state.join(new, group, "left")
                     .select(*group, F.coalesce("_nl", "_last").alias("_last"), F.concat("_acc", F.coalesce("_na", F.array())).alias("_acc")))
    # the sent list per group has at most ``cap`` entries
    res = (base.join(state.select(*group, F.col("_acc").alias("_sent")), group, "left")
           .withColumn("_sent", F.coalesce("_sent", F.array())))
    before = F.filter(F.col("_sent"), lambda x: x["o"] < F.col("_ord"))
    n_before = F.size(before)
    contra = F.exists(before, lambda x: (x["par_id"] == F.col("par_id")) & (x["tipo"] == opp[F.col("tipo")])
                      & (x["s"] >= F.col("_s") - minutes * 60))
    decision = (F.when(~F.col("_score_ok"), F.lit("score"))
                .when(n_before >= cap, F.lit("rate_limit"))
                .when(contra, F.lit("contradiction"))
                .when(~F.col("_optin_ok"), F.lit("opt_in"))
                .otherwise(F.lit("sent")))
    return res.select(*notif.columns, "deliver_at", decision.alias("decision"))

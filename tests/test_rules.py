"""The rule engine against a sequential brute force, on driver data plus trap rows."""

import datetime as dt

import pandas as pd

from paths import SF001
from solera.mapping import Lake
from solera.operators import rules as R

OFFSET = dt.timedelta(hours=5)      # America/Bogota is UTC-5 all year
T = 10_000_000                       # trap ids, far from the driver ids


def brute_force(notif: pd.DataFrame, prefs: dict) -> dict:
    def deliver(ts):
        local = ts - OFFSET
        if 7 <= local.hour < 22:
            return ts
        base = local.replace(hour=7, minute=0, second=0, microsecond=0)
        if local.hour >= 22:
            base += dt.timedelta(days=1)
        return base + OFFSET

    rows = []
    for r in notif.itertuples():
        d = deliver(r.enviada_en.to_pydatetime())
        rows.append((r.cliente_id, (d - OFFSET).date(), d, r.enviada_en.to_pydatetime(), r.notificacion_id, r))
    rows.sort(key=lambda x: (x[0], x[1], x[2], x[3], x[4]))
    out, sent, cur = {}, [], None
    for user, day, d, _, nid, r in rows:
        if (user, day) != cur:
            cur, sent = (user, day), []
        opp = {"comprar": "vender", "vender": "comprar"}.get(r.tipo)
        if not (r.score_confianza >= 0.65):
            out[nid] = "score"
        elif len(sent) >= 3:
            out[nid] = "rate_limit"
        elif any(t == opp and p == r.par_id and s >= d - dt.timedelta(minutes=30) for s, t, p in sent):
            out[nid] = "contradiction"
        elif not prefs.get(user, {}).get(r.canal, False):
            out[nid] = "opt_in"
        else:
            out[nid] = "sent"
            sent.append((d, r.tipo, r.par_id))
    return out


def _traps(spark):
    t = lambda s: dt.datetime.fromisoformat(s)  # noqa: E731  (UTC wall clock)
    rows = [  # user 900 opted in to push; Bogota 07:00 = 12:00 UTC
        (1, 900, "comprar", 0, 0.65, "push", t("2024-03-01T12:00:00")),   # score exactly 0.65 passes, 07:00 local ok
        (2, 900, "vender", 0, 0.9, "push", t("2024-03-01T12:29:00")),     # opposite at 29 min -> contradiction
        (3, 900, "vender", 0, 0.9, "push", t("2024-03-01T12:31:00")),     # opposite at 31 min -> sent
        (4, 900, "comprar", 1, 0.9, "push", t("2024-03-01T13:00:00")),    # 3rd sent
        (5, 900, "comprar", 1, 0.9, "push", t("2024-03-01T14:00:00")),    # 4th of the day -> rate_limit
        (6, 900, "comprar", 2, 0.9, "push", t("2024-03-01T11:59:00")),    # 06:59 local -> queued to 07:00
        (7, 900, "comprar", 2, 0.9, "push", t("2024-03-02T03:00:00")),    # 22:00 local -> next day 07:00
        (8, 900, "comprar", 2, 0.64, "push", t("2024-03-02T14:00:00")),   # score below
        (9, 900, "comprar", 2, 0.9, "sms", t("2024-03-02T15:00:00")),     # not opted in to sms
    ]
    rows = [(T + r[0],) + r[1:] for r in rows]
    notif = spark.createDataFrame(rows, "notificacion_id long, cliente_id long, tipo string, par_id int, "
                                        "score_confianza double, canal string, enviada_en timestamp_ntz")
    port = spark.createDataFrame([(900, '{"push": true, "email": false, "sms": false}')],
                                 "cliente_id long, preferencias_notif string")
    return notif, port


def test_traps(spark):
    notif, port = _traps(spark)
    got = {r.notificacion_id - T: (r.decision, r.deliver_at) for r in R.decide(notif, port).collect()}
    assert got[1][0] == "sent" and got[2][0] == "contradiction" and got[3][0] == "sent"
    assert got[6][0] == "sent" and got[6][1] == dt.datetime(2024, 3, 1, 12, 0)      # queued to 07:00 local
    assert got[4][0] == "rate_limit"                                                 # 6,1,3 were sent first
    assert got[5][0] == "rate_limit"
    assert got[7][1] == dt.datetime(2024, 3, 2, 12, 0) and got[7][0] == "sent"
    assert got[8][0] == "score" and got[9][0] == "opt_in"


def test_decide_matches_brute_force_on_driver_data(spark):
    lk = Lake(spark, SF001)
    notif, port = lk.notifications(), lk.portfolios()
    t_notif, t_port = _traps(spark)
    cols = ["notificacion_id", "cliente_id", "tipo", "par_id", "score_confianza", "canal", "enviada_en"]
    notif = notif.select(*cols).unionByName(t_notif)
    port = port.select("cliente_id", "preferencias_notif").unionByName(t_port)
    got = {r.notificacion_id: r.decision for r in R.decide(notif, port).select("notificacion_id", "decision").collect()}
    pdf = notif.toPandas()
    import json
    prefs = {r.cliente_id: json.loads(r.preferencias_notif) for r in port.collect()}
    want = brute_force(pdf, prefs)
    assert got == want
    assert {"sent", "score", "opt_in"} <= set(got.values())


def test_stateless_rules_and_trigger(spark):
    notif, port = _traps(spark)
    ids = lambda df: {r.notificacion_id - T for r in df.collect()}
    assert ids(R.rule_score(notif)) == {1, 2, 3, 4, 5, 6, 7, 9}
    q = {r.notificacion_id - T: r.encolada for r in R.rule_quiet_hours(notif).collect()}
    assert q[1] is False and q[6] is True and q[7] is True
    c = {r.notificacion_id - T: r.contradictoria for r in R.rule_contradiction(notif).collect()}
    assert c[2] is True and c[3] is False
    assert ids(R.rule_opt_in(notif, port)) == {1, 2, 3, 4, 5, 6, 7, 8}

"""Registry of named queries: name -> callable(spark, sf_dir) -> DataFrame.

Every entry reads the driver tables through ``solera.mapping.Lake`` (so its work grows with
them) and calls one operator.  ``run_query(spark, sf_dir, name)`` is the single entry point.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from solera import mapping as M
from solera.mapping import Lake
from solera.operators import analytics as A

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def prepare(spark: SparkSession) -> None:
    """Settings every query relies on, applied to whatever session the caller passes:
    event times are UTC wall clock (``timestamp_ntz``), so the session zone must be UTC for
    epoch arithmetic and day boundaries.  Plans that write intermediates look for the checkpoint
    folder themselves, so the others run where none is set."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def query(name: str):
    def deco(fn: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            prepare(spark)
            return _fn(Lake(spark, sf_dir))
        QUERIES[name] = run
        return fn
    return deco


def run_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in QUERIES:
        raise KeyError(f"unknown query {name!r}")
    return QUERIES[name](spark, sf_dir)


# ---------------------------------------------------------------- Q1-Q3 and views
@query("q1_monthly_sales")
def _q1(lk: Lake) -> DataFrame:
    return A.q1_monthly_sales(lk.fact(with_customer=False), lk.dim_tipo_energia())


@query("q2_top_customers")
def _q2(lk: Lake) -> DataFrame:
    per_client = A.client_totals_by_order(lk.raw("lineitem"), lk.raw("part"), lk.raw("orders"))
    return A.q2_top_customers(None, lk.dim_cliente(), lk.dim_ciudad(), per_client=per_client)


@query("q3_margin")
def _q3(lk: Lake) -> DataFrame:
    return A.margins_by_part(lk.part_totals(), lk.dim_tipo_energia()).orderBy(A.F.desc_nulls_last("margen_absoluto"), "tipo_energia")


@query("g1_agg_monthly")
def _g1(lk: Lake) -> DataFrame:
    return A.agg_monthly(lk.fact(with_customer=False), lk.dim_tipo_energia())


@query("g5_monthly_balance")
def _g5(lk: Lake) -> DataFrame:
    return A.monthly_balance(lk.fact(with_customer=False, with_price=False))


@query("g6_duplicate_transactions")
def _g6(lk: Lake) -> DataFrame:
    return A.duplicates(lk.fact(with_customer=False, with_price=False), "transaccion_id")


@query("g7_vw_monthly_summary")
def _g7(lk: Lake) -> DataFrame:
    return A.monthly_summary(lk.fact(with_customer=False))


@query("g8_vw_top_customers")
def _g8(lk: Lake) -> DataFrame:
    per_client = A.client_totals_by_order(lk.raw("lineitem"), lk.raw("part"), lk.raw("orders"))
    return A.top_customers_view(None, lk.dim_cliente(), lk.dim_ciudad(), per_client=per_client)


@query("g9_vw_margin")
def _g9(lk: Lake) -> DataFrame:
    return A.margins_by_part(lk.part_totals(), lk.dim_tipo_energia())


@query("g10_kpis")
def _g10(lk: Lake) -> DataFrame:
    return A.kpis(None, lk.dim_proveedor(), lk.dim_cliente(), lk.dim_ciudad(), lk.dim_tipo_energia(),
                  per_part=lk.part_totals())


@query("g11_fx_dashboard")
def _g11(lk: Lake) -> DataFrame:
    active = M.models(lk).where("activo").agg(A.F.max("version")).scalar()
    return A.fx_dashboard(lk.dim_par(), lk.ticks(), lk.portfolios(), lk.notifications(), active_model=active)


@query("g13_daily_sales")
def _g13(lk: Lake) -> DataFrame:
    return A.daily_sales(lk.fact(with_customer=False), lk.dim_tipo_energia())


@query("g14_notification_type_counts")
def _g14(lk: Lake) -> DataFrame:
    return A.category_counts(lk.notifications(), "tipo", ["comprar", "vender", "observar"])


@query("g15_score_histogram")
def _g15(lk: Lake) -> DataFrame:
    return A.histogram(lk.notifications(), "score_confianza", bins=10)


@query("g16_notification_funnel")
def _g16(lk: Lake) -> DataFrame:
    return A.notification_funnel(lk.notifications())


# ---------------------------------------------------------------- data quality E1-E16
from solera.operators import quality as Q  # noqa: E402
from solera.operators import quality_states as QS  # noqa: E402


def _register_check(check_id: int) -> None:
    @query(f"dq_e{check_id:02d}")
    def _check(lk: Lake) -> DataFrame:
        return Q.run_checks(Q.tables_from_lake(lk), [check_id])


for _c in Q.CHECKS:
    _register_check(_c.id)


@query("dq_run")
def _dq_run(lk: Lake) -> DataFrame:
    return Q.run_checks(Q.tables_from_lake(lk))


@query("dq_summary")
def _dq_summary(lk: Lake) -> DataFrame:
    return Q.dq_summary(Q.run_checks(Q.tables_from_lake(lk)))


@query("dq_report")
def _dq_report(lk: Lake) -> DataFrame:
    return Q.report(Q.run_checks(Q.tables_from_lake(lk)))


@query("dq_incremental")
def _dq_incremental(lk: Lake) -> DataFrame:
    # states of the months before 1996 and of those since, added up
    t = Q.tables_from_lake(lk)
    new = A.F.coalesce(A.F.col("anio") >= 1996, A.F.lit(False))
    states = [QS.fact_states(t.transaccion.where(c), ("anio", "mes")) for c in (~new, new)]
    return QS.run_checks(t, states[0].unionByName(states[1]))


@query("dq_monthly_states")
def _dq_monthly(lk: Lake) -> DataFrame:
    s = QS.fact_states(lk.fact(), ("anio", "mes"))
    return s.groupBy("anio", "mes", "medida").agg(
        A.F.count(A.F.lit(1)).alias("claves"), A.F.sum("n").alias("filas"), A.F.max("n").alias("mayor"),
        *[(A.F.sum(c) / A.F.lit(1000).cast("decimal(4,0)")).cast(A.QTY).alias(c) for c in ("compras", "ventas")],
        A.F.sum("no_positivas").alias("no_positivas"), A.F.sum("fuera_de_rango").alias("fuera_de_rango"))


# ---------------------------------------------------------------- transforms, sources, listings
from pyspark.sql import functions as F  # noqa: E402

from solera.functions.scalar import notif_status  # noqa: E402
from solera.mapping import customer_snapshots, portfolio_updates  # noqa: E402
from solera.operators import listings as LS  # noqa: E402
from solera.operators import transform as B  # noqa: E402
from solera.plans import etl  # noqa: E402
from solera.sources import catalog as CAT  # noqa: E402
from solera.sources import files as FL  # noqa: E402
from solera.sources import lake as LK  # noqa: E402


@query("b8_scd1_latest")
def _b8(lk: Lake) -> DataFrame:
    return B.scd1_latest(customer_snapshots(lk), "cliente_id", "loaded_at")


@query("b9_latest_load")
def _b9(lk: Lake) -> DataFrame:
    return B.latest_load(customer_snapshots(lk), "loaded_at")


@query("b12_upsert")
def _b12(lk: Lake) -> DataFrame:
    snaps = customer_snapshots(lk)
    newest = snaps.agg(F.max("loaded_at")).scalar()
    target = B.scd1_latest(snaps.where(F.col("loaded_at") < newest), "cliente_id")
    updates = snaps.where(F.col("loaded_at") == newest)
    return B.upsert(target, updates, "cliente_id", stamp_col=None)


@query("b11_fact_from_text")
def _b11(lk: Lake) -> DataFrame:
    src = etl.read_source(lk, "transaccion")
    as_text = src.select(*[F.col(c).cast("string").alias(c) for c in src.columns])
    return etl.fact_from_text(as_text)


@query("b2_conform_rejects")
def _b2(lk: Lake) -> DataFrame:
    # the event props text cast to the contract; rows whose value does not fit are quarantined
    ev = lk.raw("events").select(F.col("event_id").cast("string").alias("event_id"),
                                 F.get_json_object("props", "$.k").alias("k"),
                                 F.col("value").cast("string").alias("valor"))
    # contract: k a small integer, valor a price below 100 with two decimals
    contract = {"event_id": "bigint", "k": "tinyint", "valor": "decimal(4,2)"}
    return B.rejects(ev, contract).select(F.col("event_id").cast("long").alias("event_id"), "_bad_columns")


@query("b5_ticks_last_hours")
def _b5(lk: Lake) -> DataFrame:
    recent = B.last_hours(lk.ticks(), "capturado_en", 72)
    return recent.groupBy("par_id").agg(F.count(F.lit(1)).alias("ticks"),
                                        F.round(F.avg("precio_compra"), 6).alias("precio_medio"))


@query("b6_sales_last_days")
def _b6(lk: Lake) -> DataFrame:
    f = lk.fact(with_customer=False, with_price=False).where(F.col("tipo") == "venta")
    return B.last_days(f, "fecha", 30).groupBy("fecha").agg(F.count(F.lit(1)).alias("ventas"))


@query("b13_date_dim")
def _b13(lk: Lake) -> DataFrame:
    f = lk.fact(with_customer=False, with_price=False)
    return B.date_dim(f.agg(F.min("fecha")).scalar(), f.agg(F.max("fecha")).scalar())


@query("b14_b15_tick_prices")
def _b14(lk: Lake) -> DataFrame:
    t = B.with_mid(B.with_spread(lk.ticks()))
    return t.select("tick_id", "par_id", F.round("spread", 9).alias("spread"), F.round("mid", 9).alias("mid"))


@query("b16_notification_status")
def _b16(lk: Lake) -> DataFrame:
    n = lk.notifications()
    return n.groupBy(notif_status().alias("estado")).agg(F.count(F.lit(1)).alias("n"))


@query("b19_parse_props")
def _b19(lk: Lake) -> DataFrame:
    ev = B.parse_json_map(lk.raw("events").select("event_id", "props"), "props", "props_map")
    return ev.select("event_id", F.col("props_map")["k"].cast("int").alias("k"))


@query("b20_erasure_report")
def _b20(lk: Lake) -> DataFrame:
    cli = lk.dim_cliente()
    subjects = lk.raw("customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("cliente_id"))
    _, report = B.erase_subjects({"dim_cliente": (cli, "cliente_id"),
                                  "fact": (lk.fact(), "cliente_id"),
                                  "notificacion": (lk.notifications(), "cliente_id"),
                                  "usuario_portafolio": (lk.portfolios(), "cliente_id")},
                                 subjects, "cliente_id")
    return report


@query("b20_erase_in_place")
def _b20f(lk: Lake) -> DataFrame:
    # the fact written by year, subjects' files rewritten, what is left read again
    from solera.session import ensure_checkpoint_dir
    root = f"{ensure_checkpoint_dir(lk.spark).rstrip('/')}/tables/erasure-{uuid.uuid4().hex}/fact"
    LK.write_partitioned(lk.fact(), root.rsplit("/", 1)[0], "fact", ["anio"])
    subjects = lk.raw("customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("cliente_id"))
    FL.erase_in_files(lk.spark, root, "cliente_id", subjects, "cliente_id", ("anio",))
    left = lk.spark.read.parquet(root)
    return left.groupBy("anio").agg(F.count(F.lit(1)).alias("filas"), F.count("cliente_id").alias("ventas"),
                                    F.sum("monto_usd").cast("decimal(38,5)").alias("monto_usd"))


@query("b21_pii_scan")
def _b21(lk: Lake) -> DataFrame:
    return B.pii_scan(lk.raw("documents"), "text", "doc_id")


@query("b21_pii_tokenize")
def _b21t(lk: Lake) -> DataFrame:
    docs = lk.raw("documents").select("doc_id", "text")
    return B.pii_tokenize(docs, "text", salt="solera", out="text_tokenizado").select("doc_id", "text_tokenizado")


@query("b23_governed_clients")
def _b23(lk: Lake) -> DataFrame:
    return B.governed_view(lk.dim_cliente(), ["cliente_id", "nombre", "segmento", "ciudad_id"], F.col("activo"))


@query("a10_reconcile_warehouse")
def _a10(lk: Lake) -> DataFrame:
    # the copy is written in the warehouse's types and read again, as the load does
    from solera.session import materialize
    f = lk.fact()
    return etl.reconcile(f, materialize(LK.to_contract(f), "warehouse_fact"))


@query("a20_load_differences")
def _a20d(lk: Lake) -> DataFrame:
    # what changed between the last two yearly client loads
    snaps = customer_snapshots(lk)
    newest = snaps.agg(F.max("loaded_at")).scalar()
    before = snaps.where(F.col("loaded_at") < newest).agg(F.max("loaded_at")).scalar()
    a, b = (snaps.where(F.col("loaded_at") == x).drop("loaded_at") for x in (before, newest))
    return GV.differences(a, b, ["cliente_id"], ["cliente_id", "num_pedidos", "total_pedidos"])


@query("b17_service_names")
def _b17(lk: Lake) -> DataFrame:
    # billed under the long names of the services
    long_name = F.create_map(*[F.lit(x) for full, short in B.SERVICE_NAME_REPLACEMENTS for x in (short, full)])
    svc = M.usage_from_events(lk).select(long_name[F.col("service")].alias("servicio"))
    return B.normalize_names(svc, "servicio").groupBy("servicio").agg(F.count(F.lit(1)).alias("n"))


@query("b22_governed_tables")
def _b22(lk: Lake) -> DataFrame:
    return B.governed_tables(M.table_tags(lk)).select("tabla_id", "tabla", "sensitivity")


@query("l_models")
def _lm(lk: Lake) -> DataFrame:
    # maps as JSON text, which SQL engines compare alike
    m = LS.models(M.models(lk))
    return m.withColumns({c: F.to_json(c) for c in ("features", "metricas")})


@query("a17_table_counts")
def _a17(lk: Lake) -> DataFrame:
    return CAT.table_counts({("core", "tipo_energia"): lk.dim_tipo_energia(), ("core", "ciudad"): lk.dim_ciudad(),
                             ("core", "proveedor"): lk.dim_proveedor(), ("core", "cliente"): lk.dim_cliente(),
                             ("core", "transaccion"): lk.raw("lineitem"),
                             ("divisas", "par_divisa"): lk.dim_par(), ("divisas", "tipo_cambio_tick"): lk.raw("events"),
                             ("divisas", "usuario_portafolio"): lk.raw("customer"),
                             ("divisas", "notificacion"): lk.raw("events")})


@query("l1_suppliers_page")
def _l1(lk: Lake) -> DataFrame:
    return LS.suppliers(lk.dim_proveedor(), lk.dim_tipo_energia(), limit=1000, offset=0)


@query("l4_clients_page")
def _l4c(lk: Lake) -> DataFrame:
    return LS.clients(lk.dim_cliente(), lk.dim_ciudad(), limit=2000, offset=20)


@query("l4_transactions_page")
def _l4t(lk: Lake) -> DataFrame:
    return LS.transactions(lk.fact(), lk.dim_tipo_energia(), limit=2000, offset=100)


@query("l_cities")
def _lc(lk: Lake) -> DataFrame:
    return LS.cities(lk.dim_ciudad())


@query("l_energy_types")
def _le(lk: Lake) -> DataFrame:
    return LS.energy_types(lk.dim_tipo_energia())


@query("l_fx_pairs")
def _lp(lk: Lake) -> DataFrame:
    return LS.fx_pairs(lk.dim_par())


@query("l5_fx_ticks_latest")
def _lt(lk: Lake) -> DataFrame:
    return LS.fx_ticks(lk.ticks(), lk.dim_par(), label=None, hours=24, limit=1000)


@query("l5_fx_ticks_pair")
def _ltp(lk: Lake) -> DataFrame:
    return LS.fx_ticks(lk.ticks(), lk.dim_par(), label="click/USD", hours=720, limit=1000)


@query("l5_notifications_latest")
def _ln(lk: Lake) -> DataFrame:
    return LS.notifications(lk.notifications(), lk.dim_par(), limit=200)


@query("l6_sample_clients")
def _l6(lk: Lake) -> DataFrame:
    return LS.sample_n(lk.dim_cliente().select("cliente_id", "nombre"), "cliente_id", 100, seed=42)


# ---------------------------------------------------------------- window features W1-W10, C9
from solera.operators import features as W  # noqa: E402


def _r9(c: str) -> F.Column:
    return F.round(F.col(c), 9).alias(c)


@query("w1_date_gaps")
def _w1(lk: Lake) -> DataFrame:
    return Q.date_gaps(lk.fact(with_customer=False, with_price=False).select("fecha"), "fecha", 7)


@query("w1_client_gaps")
def _w1c(lk: Lake) -> DataFrame:
    # clients that went a year without an order
    o = lk.raw("orders").select(F.col("o_custkey").alias("cliente_id"), F.to_date("o_orderdate").alias("fecha"))
    return Q.date_gaps(o, "fecha", 365, by=("cliente_id",))


@query("w2_ranked_loads")
def _w2(lk: Lake) -> DataFrame:
    return W.rank_latest(customer_snapshots(lk), "cliente_id", "loaded_at").select("cliente_id", "loaded_at", "num_pedidos", "rn")


@query("w4_rolling_volatility")
def _w4(lk: Lake) -> DataFrame:
    v = W.rolling_volatility(lk.ticks())
    return v.select("tick_id", "par_id", "capturado_en", _r9("ret"), _r9("volatilidad"))


@query("w5_trailing_return")
def _w5(lk: Lake) -> DataFrame:
    r = W.trailing_return(lk.ticks())
    return r.select("tick_id", "par_id", _r9("mid_ref"), _r9("retorno"))


@query("w6_ema_distance")
def _w6(lk: Lake) -> DataFrame:
    e = W.ema_distance(lk.ticks())
    return e.select("tick_id", "par_id", F.round("ema", 6).alias("ema"), F.round("distancia_ema", 6).alias("distancia_ema"))


@query("w7_market_features")
def _w7(lk: Lake) -> DataFrame:
    m = W.market_features(lk.ticks())
    return m.select("tick_id", "par_id", _r9("spread_bps"), "n_5m", "n_1h", _r9("volumen_relativo"))


@query("w8_portfolio_features")
def _w8(lk: Lake) -> DataFrame:
    return W.portfolio_features(lk.portfolios(), lk.ticks(), rate_pair=0)


@query("w9_user_features")
def _w9(lk: Lake) -> DataFrame:
    purchases = lk.raw("events").where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    u = W.user_features(purchases, "user_id", "ts", "value", days=30)
    return u.select("event_id", "user_id", "frecuencia_tx", "ticket_promedio")


@query("w10_multi_window")
def _w10(lk: Lake) -> DataFrame:
    m = W.multi_window(lk.ticks())
    return m.select("tick_id", "par_id", *[c for c in m.columns if c not in ("tick_id", "par_id")])


@query("c9_enrich_asof")
def _c9(lk: Lake) -> DataFrame:
    prices = W.tick_frame(lk.ticks()).select("par_id", F.col("capturado_en").alias("ts"), "mid")
    notif = lk.notifications().select("notificacion_id", "par_id", F.col("enviada_en").alias("ts"))
    res = W.enrich_asof(notif, prices, "par_id", "ts", ["mid"])
    return res.select("notificacion_id", "par_id", "ts", _r9("asof_mid"))


# ---------------------------------------------------------------- FX analytics G24-G30, C8, rules S4-S10
from solera.operators import fx as FX  # noqa: E402
from solera.operators import rules as R  # noqa: E402


def _with_arm(n: DataFrame) -> DataFrame:
    # A/B arm by client parity (deterministic assignment, reproducible in SQL)
    return n.withColumn("brazo", F.when(F.col("cliente_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")))


@query("g24_ctr_by_channel")
def _g24(lk: Lake) -> DataFrame:
    return FX.ctr_by_channel(lk.notifications())


@query("g24_recommendation_mix")
def _g24m(lk: Lake) -> DataFrame:
    return FX.recommendation_mix(lk.notifications())


@query("g25_score_percentiles")
def _g25(lk: Lake) -> DataFrame:
    return FX.score_percentiles(lk.notifications())


@query("g25_score_drift")
def _g25d(lk: Lake) -> DataFrame:
    return FX.distribution_drift(lk.notifications(), "score_confianza", "enviada_en", 0.0, 1.0)


@query("g25_price_drift")
def _g25p(lk: Lake) -> DataFrame:
    return FX.distribution_drift(lk.ticks(), "precio_compra", "capturado_en", 0.0, 100.0, bins=50)


@query("g25_sketched_percentiles")
def _g25s(lk: Lake) -> DataFrame:
    days = FX.daily_sketches(lk.notifications(), "score_confianza", "enviada_en")
    return FX.sketched_percentiles(days).unionByName(FX.sketched_percentiles(days, unit="month"))


@query("g26_active_users")
def _g26(lk: Lake) -> DataFrame:
    return FX.active_users(lk.raw("events"))


@query("g26_active_users_sketch")
def _g26s(lk: Lake) -> DataFrame:
    return FX.active_users_from_sketches(FX.daily_user_sketches(lk.raw("events")))


@query("g27_ab_uplift")
def _g27(lk: Lake) -> DataFrame:
    return FX.ab_uplift(_with_arm(lk.notifications()))


@query("g28_pnl_change")
def _g28(lk: Lake) -> DataFrame:
    return FX.pnl_change(lk.portfolios(), lk.ticks(), rate_pair=0)


@query("g29_eval_scores")
def _g29(lk: Lake) -> DataFrame:
    return FX.eval_scores(lk.notifications(), holdout_days=14, k=100)


@query("g30_slo_report")
def _g30(lk: Lake) -> DataFrame:
    return FX.slo_report(R.decide(lk.notifications(), lk.portfolios()))


@query("c8_attribute_conversions")
def _c8(lk: Lake) -> DataFrame:
    ev = lk.raw("events")
    clicks = ev.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    txs = ev.where(F.col("event_type") == "purchase").select("user_id", "ts")
    a = FX.attribute_conversions(clicks, txs, "user_id", "ts", minutes=30)
    return a.select("event_id", "user_id", F.round("segundos_a_conversion", 6).alias("segundos_a_conversion"), "convertida")


@query("s4_trigger_every")
def _s4(lk: Lake) -> DataFrame:
    return R.trigger_every(lk.ticks(), n=5).select("tick_id", "par_id", "posicion", "evalua")


@query("s4_evaluation_triggers")
def _s4e(lk: Lake) -> DataFrame:
    t = R.evaluation_triggers(lk.ticks(), portfolio_updates(lk))
    return t.withColumn("instante", F.col("instante").cast("timestamp_ntz"))


@query("s5_rule_score")
def _s5(lk: Lake) -> DataFrame:
    return R.rule_score(lk.notifications()).select("notificacion_id", "cliente_id", "score_confianza")


@query("s6_rule_daily_cap")
def _s6(lk: Lake) -> DataFrame:
    return R.rule_daily_cap(R.rule_score(lk.notifications())).select("notificacion_id", "cliente_id", "enviada_en")


@query("s7_rule_quiet_hours")
def _s7(lk: Lake) -> DataFrame:
    return R.rule_quiet_hours(lk.notifications()).select("notificacion_id", "enviada_en", "deliver_at", "encolada")


@query("s8_rule_contradiction")
def _s8(lk: Lake) -> DataFrame:
    return R.rule_contradiction(lk.notifications()).select("notificacion_id", "cliente_id", "par_id", "tipo", "contradictoria")


@query("s9_rule_opt_in")
def _s9(lk: Lake) -> DataFrame:
    return R.rule_opt_in(lk.notifications(), lk.portfolios()).select("notificacion_id", "cliente_id", "canal")


@query("s10_decide")
def _s10(lk: Lake) -> DataFrame:
    return R.decide(lk.notifications(), lk.portfolios()).select("notificacion_id", "cliente_id", "deliver_at", "decision")


@query("s10_decision_counts")
def _s10c(lk: Lake) -> DataFrame:
    return R.decide(lk.notifications(), lk.portfolios()).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- streaming batch twins S2, S3, S12
from solera.streaming import ticks as ST  # noqa: E402


def _r9w(df: DataFrame) -> DataFrame:
    return df.select("inicio", "fin", "par_id", "ticks", F.round("mid_medio", 6).alias("mid_medio"),
                     _r9("mid_min"), _r9("mid_max"))


@query("s2_window_tumbling_5m")
def _s2t(lk: Lake) -> DataFrame:
    return _r9w(ST.window_features(lk.ticks(), "5 minutes", None, watermark=None))


@query("s2_window_sliding_10m_5m")
def _s2s(lk: Lake) -> DataFrame:
    return _r9w(ST.window_features(lk.ticks(), "10 minutes", "5 minutes", watermark=None))


@query("s3_latest_price_per_pair")
def _s3(lk: Lake) -> DataFrame:
    return ST.latest_by_key(lk.ticks(), "par_id", "capturado_en", ["tick_id", "precio_compra"])


@query("s12_throughput_alarms")
def _s12(lk: Lake) -> DataFrame:
    return ST.throughput_alarms_batch(lk.ticks())


from solera.streaming import keyed as SK  # noqa: E402
from solera.streaming import replay as RP  # noqa: E402


@query("s4_triggers_stream")
def _s4s(lk: Lake) -> DataFrame:
    # one file a table: its rows come in one micro-batch, in any order
    live = RP.StreamLake(lk, "events")
    out = RP.replayed(lk, "triggers", lambda: SK.triggers_stream(live.ticks(), portfolio_updates(RP.StreamLake(lk, "orders"))))
    return RP.as_ntz(out, "instante")


@query("s10_decide_stream")
def _s10s(lk: Lake) -> DataFrame:
    out = RP.replayed(lk, "decide", lambda: SK.decide_stream(RP.StreamLake(lk, "events").notifications(), lk.portfolios()))
    return RP.as_ntz(out, "deliver_at")


@query("s12_silence_stream")
def _s12s(lk: Lake) -> DataFrame:
    ticks = lambda: ST.as_event_time(RP.StreamLake(lk, "events").ticks(), "capturado_en")
    out = RP.replayed(lk, "silence", lambda: SK.silence_stream(ticks(), clock=False))
    return RP.as_ntz(out, "inicio").select("fuente", "inicio", "ticks", "alarma")


# ---------------------------------------------------------------- cost metering G17-G21
from solera.mapping import usage_from_events  # noqa: E402
from solera.operators import cost as C  # noqa: E402

STARTING_CREDITS = "100.00"
PLAN_ENDS_ON = "2024-12-31"


@query("g17_cost_by_service")
def _g17(lk: Lake) -> DataFrame:
    daily = C.daily_costs(usage_from_events(lk), C.price_table(lk.spark))
    return C.cost_by_service(daily, daily.agg(F.min("day")).scalar(), daily.agg(F.date_add(F.max("day"), 1)).scalar())


@query("g18_metered_cost")
def _g18(lk: Lake) -> DataFrame:
    return C.metered_cost(usage_from_events(lk), C.price_table(lk.spark))


@query("g19_month_fraction")
def _g19(lk: Lake) -> DataFrame:
    days = usage_from_events(lk).select("day").distinct()
    return days.select("day", C.month_fraction("day").alias("fraccion_mes"))


@query("g20_credit_view")
def _g20(lk: Lake) -> DataFrame:
    return C.credit_view(C.metered_cost(usage_from_events(lk), C.price_table(lk.spark)), STARTING_CREDITS)


@query("g21_plan_status")
def _g21(lk: Lake) -> DataFrame:
    usage = usage_from_events(lk)
    credits = C.credit_view(C.metered_cost(usage, C.price_table(lk.spark)), STARTING_CREDITS)
    return C.plan_status(credits, usage.agg(F.max("day")).scalar(), PLAN_ENDS_ON)


@query("g22_job_cost")
def _g22(lk: Lake) -> DataFrame:
    return C.job_cost(M.job_runs(lk)).select("job", "runs", F.col("dpu_hours").cast("decimal(38,6)").alias("dpu_hours"),
                                             F.col("cost_usd").cast("decimal(38,4)").alias("cost_usd"))


@query("g22_pipeline_status")
def _g22p(lk: Lake) -> DataFrame:
    return C.pipeline_status(M.stage_runs(lk))


@query("g23_scan_cost")
def _g23(lk: Lake) -> DataFrame:
    return C.scan_cost(M.scan_log(lk))[0].select("bytes", "queries", *[F.col(c).cast("double").alias(c) for c in ("tb", "cost_usd")])


@query("g23_scan_overruns")
def _g23o(lk: Lake) -> DataFrame:
    return C.scan_cost(M.scan_log(lk))[1]


@query("g30_unit_cost")
def _g30u(lk: Lake) -> DataFrame:
    cost = C.metered_cost(usage_from_events(lk), C.price_table(lk.spark))
    return FX.unit_cost(cost, "charged_usd", lk.notifications()).select(
        F.col("costo_total").cast("decimal(38,4)").alias("costo_total"), "notificaciones",
        F.round(F.col("costo_unitario"), 6).cast("decimal(38,6)").alias("costo_unitario"))


# ---------------------------------------------------------------- governance A18, A20, scalar 2.H
from solera.functions.scalar import seasonality  # noqa: E402
from solera.operators import governance as GV  # noqa: E402

FACT_RETENTION = [(365, "archivo"), (3 * 365, "borrar")]
CHECKSUM_COLS = ["transaccion_id", "fecha", "tipo", "cantidad_mwh", "precio_usd", "monto_usd"]


@query("a18_retention_ticks")
def _a18t(lk: Lake) -> DataFrame:
    return GV.apply_retention(lk.ticks(), "capturado_en", "ticks")[1]


@query("a18_retention_fact")
def _a18f(lk: Lake) -> DataFrame:
    return GV.apply_retention(lk.fact(with_customer=False, with_price=False), "fecha", FACT_RETENTION)[1]


@query("a20_checksum_fact")
def _a20(lk: Lake) -> DataFrame:
    return GV.checksum(lk.fact(with_customer=False), CHECKSUM_COLS)


@query("h_seasonality")
def _hs(lk: Lake) -> DataFrame:
    days = lk.fact(with_customer=False, with_price=False).select("fecha").distinct()
    return days.select("fecha", F.round(seasonality("fecha"), 9).alias("estacionalidad"))


@query("s13_sessions")
def _s13(lk: Lake) -> DataFrame:
    return W.sessionize(lk.raw("events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 1800)

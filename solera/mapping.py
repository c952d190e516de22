"""Canonical tables derived from the driver tables.

The reference works on an energy-trading ledger (energy types, cities, suppliers, clients,
purchase/sale transactions) and an FX alert domain (currency pairs, price ticks, portfolios,
notifications).  The test data is a TPC-H-like schema plus an ``events`` table, so every
canonical table below is a DataFrame *derived* from those tables by a fixed rule; its size
grows with theirs.  The rules (one place, used by every operator and mirrored by the SQL
twins in ``solera.plans.oracle``):

==================  ===========================  ==============================================
canonical           from                         rule
==================  ===========================  ==============================================
dim_tipo_energia    part                         distinct p_type; id = dense rank of the name
dim_ciudad          nation left join region      id n_nationkey, nombre n_name, pais r_name
dim_proveedor       supplier left join nation    capacidad_mw = s_acctbal, activo = acctbal > 0,
                                                 tipo_energia_id = 1 + s_suppkey mod #types
dim_cliente         customer                     segmento = c_mktsegment, ciudad_id = c_nationkey
fact                lineitem, orders, part       tipo compra when l_returnflag = 'R' else venta
dim_par             events                       distinct event_type; par_id = dense rank - 1
ticks               events                       precio_compra = value, venta = value * 1.002
notifications       events                       see ``notifications`` below
portfolios          customer                     balances from c_acctbal, profile from the key
==================  ===========================  ==============================================

Scale notes: the only windows without a partition key run over ``distinct p_type`` and
``distinct event_type`` -- domains whose size does not grow with the data.  Every join of a
big table is left to the planner (AQE turns it into a broadcast when the measured side is
small and splits skewed partitions otherwise).  ``(l_orderkey, l_linenumber)`` is not unique
in the driver data, so ``transaccion_id`` is not a key (check E5 reports it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values of the mapping (FIXTURES.md §3) ---------------------------------------
# notification type per event type
NOTIF_TYPE_BY_EVENT = {"click": "comprar", "view": "comprar",
                       "purchase": "vender", "signup": "vender",
                       "error": "observar"}
# channel by event_id % 3
CHANNELS = ["push", "email", "sms"]
# risk profile by c_custkey % 3
RISK_PROFILES = ["conservador", "moderado", "agresivo"]
SELL_MARKUP = 1.002          # precio_venta = precio_compra * 1.002
# metered service of each event kind (usage table for the cost operators)
SERVICE_BY_EVENT = {"click": "EC2", "view": "S3", "purchase": "RDS",
                    "signup": "Secrets Manager", "error": "Glue"}
QUOTE_CURRENCY = "USD"
# ------------------------------------------------------------------------------------------

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Lake:
    """Lazy access to the driver tables and the canonical tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def input_bytes(self, name: str) -> int:
        """On-disk size of a driver table (file-system metadata, no data read)."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return int(fs.getContentSummary(path).getLength())

    # ---------------- energy star schema ----------------
    def dim_tipo_energia(self) -> DataFrame:
        types = self.raw("part").select("p_type").where(F.col("p_type").isNotNull()).distinct()
        # bounded domain (a few hundred product types at most): a global dense rank is fine.
        w = Window.orderBy("p_type")
        return types.select(
            F.dense_rank().over(w).cast("short").alias("tipo_energia_id"),
            F.col("p_type").alias("codigo"),
            F.col("p_type").alias("nombre"),
            F.lit(None).cast("decimal(8,2)").alias("factor_co2_kg_mwh"),
            F.lit(None).cast("boolean").alias("renovable"),
        )

    def dim_ciudad(self) -> DataFrame:
        n = self.raw("nation")
        r = self.raw("region")
        return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
            F.col("n_nationkey").cast("int").alias("ciudad_id"),
            F.col("n_name").alias("nombre"),
            F.col("r_name").alias("pais"),
            F.lit(None).cast("decimal(9,6)").alias("lat"),
            F.lit(None).cast("decimal(9,6)").alias("lon"),
            F.lit(None).cast("int").alias("poblacion"),
        )

    def dim_proveedor(self) -> DataFrame:
        s = self.raw("supplier")
        n = self.raw("nation").select("n_nationkey", "n_name")
        n_types = self.dim_tipo_energia().agg(F.count(F.lit(1))).scalar()
        return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
            F.col("s_suppkey").alias("proveedor_id"),
            F.col("s_name").alias("nombre"),
            (F.pmod(F.col("s_suppkey"), n_types) + 1).cast("short").alias("tipo_energia_id"),
            F.col("n_name").alias("pais"),
            F.col("s_acctbal").cast("decimal(10,2)").alias("capacidad_mw"),
            (F.col("s_acctbal") > 0).alias("activo"),
            F.lit(None).cast("date").alias("fecha_alta"),
        )

    def dim_cliente(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("cliente_id"),
            F.col("c_name").alias("nombre"),
            F.col("c_mktsegment").alias("segmento"),
            F.col("c_nationkey").cast("int").alias("ciudad_id"),
            F.lit("CC").alias("tipo_id"),
            F.concat(F.lit("CC-"), F.col("c_custkey").cast("string")).alias("id_externo"),
            (F.col("c_acctbal") >= 0).alias("activo"),
            F.lit(None).cast("date").alias("fecha_alta"),
        )

    def fact(self, with_customer: bool = True, with_price: bool = True) -> DataFrame:
        """Transaction fact at line-item grain.

        ``with_customer=False`` skips the orders join; it is the same fact minus ``cliente_id``
        because ``o_orderkey`` is the key of ``orders`` (a left join on a key neither adds nor
        drops rows).  Queries that do not need the client use it and save a full shuffle of the
        line items.  ``with_price=False`` skips ``part`` (its key is ``p_partkey``) in the same way:
        no energy type, price or amount.
        """
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                         "l_quantity", "l_returnflag", "l_shipdate")
        df = li
        if with_price:
            part = self.raw("part").select("p_partkey", "p_type", "p_retailprice")
            types = self.dim_tipo_energia().select("tipo_energia_id", F.col("codigo").alias("p_type"))
            part_t = part.join(types, "p_type", "left")
            df = li.join(part_t, li.l_partkey == part_t.p_partkey, "left")
        is_buy = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
        if with_customer:
            o = self.raw("orders").select("o_orderkey", "o_custkey")
            df = df.join(o, df.l_orderkey == o.o_orderkey, "left")
        fecha = F.to_date("l_shipdate")
        qty = F.col("l_quantity").cast("decimal(12,3)")
        price = F.col("p_retailprice").cast("decimal(10,2)")
        cols = [
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("long").alias("transaccion_id"),
            fecha.alias("fecha"),
            F.date_format(fecha, "yyyyMMdd").cast("int").alias("fecha_id"),
            *([F.col("tipo_energia_id")] if with_price else []),
            F.when(is_buy, F.col("l_suppkey")).alias("proveedor_id"),
        ]
        if with_customer:
            cols.append(F.when(~is_buy, F.col("o_custkey")).alias("cliente_id"))
        cols += [
            F.when(is_buy, F.lit("compra")).otherwise(F.lit("venta")).alias("tipo"),
            qty.alias("cantidad_mwh"),
            *([price.alias("precio_usd"), (qty * price).alias("monto_usd")] if with_price else []),
            F.year(fecha).alias("anio"),
            F.month(fecha).alias("mes"),
        ]
        return df.select(*cols)

    def part_totals(self) -> DataFrame:
        """The fact summed per part: type, price, rows per side and quantity, for reports without
        dates (price and type depend on the part alone).  The line items meet ``part`` as one row
        per part and cross the one shuffle of that join, summed before it, so a part with a
        third of the line items is a row per map task."""
        is_buy = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
        per_part = self.raw("lineitem").groupBy("l_partkey").agg(
            F.count_if(is_buy).alias("n_compra"), F.count_if(~is_buy).alias("n_venta"),
            F.sum(F.col("l_quantity").cast("decimal(12,3)")).alias("cantidad_mwh"))
        part = self.raw("part").select("p_partkey", "p_type", F.col("p_retailprice").cast("decimal(10,2)").alias("precio_usd"))
        types = self.dim_tipo_energia().select("tipo_energia_id", F.col("codigo").alias("p_type"))
        return (per_part.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(types, "p_type", "left")
                .select("tipo_energia_id", "precio_usd", "n_compra", "n_venta", "cantidad_mwh"))

    # ---------------- FX domain ----------------
    def dim_par(self) -> DataFrame:
        kinds = self.raw("events").select("event_type").where(F.col("event_type").isNotNull()).distinct()
        w = Window.orderBy("event_type")  # bounded domain (event kinds)
        return kinds.select(
            (F.dense_rank().over(w) - 1).cast("int").alias("par_id"),
            F.col("event_type").alias("base"),
            F.lit(QUOTE_CURRENCY).alias("cotizada"),
            F.concat(F.col("event_type"), F.lit("/"), F.lit(QUOTE_CURRENCY)).alias("descripcion"),
            F.lit(True).alias("activo"),
        )

    def ticks(self) -> DataFrame:
        ev = self.raw("events").select("event_id", "event_type", "value", "ts")
        pairs = self.dim_par().select("par_id", F.col("base").alias("event_type"))
        return ev.join(pairs, "event_type", "left").select(
            F.col("event_id").alias("tick_id"),
            F.col("par_id"),
            F.col("value").alias("precio_compra"),
            (F.col("value") * F.lit(SELL_MARKUP)).alias("precio_venta"),
            F.lit("feed").alias("fuente"),
            F.col("ts").alias("capturado_en"),
        )

    def notifications(self) -> DataFrame:
        ev = self.raw("events").select("event_id", "event_type", "user_id", "value", "ts")
        type_map = F.create_map(*[F.lit(x) for kv in NOTIF_TYPE_BY_EVENT.items() for x in kv])
        tipo = type_map[F.col("event_type")]
        read_mark = (F.col("event_id") * 53) % 100
        channel = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]),
                               (F.col("event_id") % len(CHANNELS)).cast("int") + 1)
        return ev.select(
            F.col("event_id").alias("notificacion_id"),
            F.col("user_id").alias("cliente_id"),
            tipo.alias("tipo"),
            (F.col("event_id") % 3).cast("int").alias("par_id"),
            F.col("value").alias("precio_referencia"),
            (((F.col("event_id") * 37) % 100) / F.lit(100.0)).alias("score_confianza"),
            channel.alias("canal"),
            F.concat_ws(" ", tipo, F.col("event_type")).alias("mensaje"),
            F.col("ts").alias("enviada_en"),
            (read_mark < 45).alias("leida"),
            (read_mark < 8).alias("convertida"),
        )

    def portfolios(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_acctbal", "c_nationkey")
        profile = F.element_at(F.array(*[F.lit(p) for p in RISK_PROFILES]),
                               (F.col("c_custkey") % len(RISK_PROFILES)).cast("int") + 1)
        prefs = F.to_json(F.struct(
            ((F.col("c_custkey") % 2) == 0).alias("push"),
            ((F.col("c_custkey") % 3) != 0).alias("email"),
            ((F.col("c_custkey") % 5) == 0).alias("sms"),
        ))
        return c.select(
            F.col("c_custkey").alias("cliente_id"),
            F.abs("c_acctbal").alias("saldo_usd"),
            (F.abs("c_acctbal") * (F.col("c_nationkey") + 1) * 100).alias("saldo_cop"),
            profile.alias("perfil_riesgo"),
            prefs.alias("preferencias_notif"),
        )


def customer_snapshots(lk: Lake) -> DataFrame:
    """Yearly client snapshots derived from ``orders``: one load per order year holding the
    clients that ordered that year and their yearly totals.  Stamp ``<year>-12-31T00``.
    A client absent from the newest load is the "vanished key" case of B8 vs B9."""
    o = lk.raw("orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return (o.groupBy(F.col("o_custkey").alias("cliente_id"),
                      F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31T00")).alias("loaded_at"))
            .agg(F.count(F.lit(1)).alias("num_pedidos"),
                 F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total_pedidos")))


def portfolio_updates(lk: Lake) -> DataFrame:
    """Portfolio versions derived from ``orders``: every order is an update of its client's
    portfolio, whose risk profile follows the order's priority (its first digit modulo the number
    of profiles); two orders of equal profile are an update without a change."""
    o = lk.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    nth = F.substring("o_orderpriority", 1, 1).cast("int") % len(RISK_PROFILES)
    return o.select(F.col("o_custkey").alias("cliente_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("actualizado_en"),
                    F.element_at(F.array(*[F.lit(p) for p in RISK_PROFILES]), nth + 1).alias("perfil_riesgo"))


def usage_from_events(lk: Lake) -> DataFrame:
    """Usage records for the cost operators: every event is a metered quantity (``value``)
    of the service its kind maps to, billed to its user."""
    svc = F.create_map(*[F.lit(x) for kv in SERVICE_BY_EVENT.items() for x in kv])[F.col("event_type")]
    return lk.raw("events").select(F.col("user_id").alias("account"), svc.alias("service"),
                                   F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,6)").alias("quantity"))


# ---------------- run logs and registries derived for the operators that need them ----------------
JOB_STATES = {"F": "SUCCEEDED", "O": "FAILED", "P": "RUNNING"}        # by order status
SENSITIVITIES = ["Public", "Internal", "Confidential", "Restricted"]  # by part size


def models(lk: Lake) -> DataFrame:
    """Recommendation models: one is trained on each month's notifications and named after it;
    its metrics are that month's counts; the newest is active.  One row per month."""
    n = lk.notifications()
    month = F.trunc("enviada_en", "month")
    per_month = n.groupBy(month.alias("_m")).agg(
        F.max("enviada_en").alias("entrenado_en"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("leida")).alias("leidas"), F.count_if(F.col("convertida")).alias("convertidas")).where("_m IS NOT NULL")
    w = Window.orderBy("_m")  # one row per month
    features = F.lit('{"ventana":"mes","entrada":"score_confianza"}')
    return per_month.select(
        F.row_number().over(w).alias("modelo_id"), F.date_format("_m", "yyyy.MM").alias("version"),
        F.lit("tasa_por_canal").alias("algoritmo"), features.alias("features"),
        F.to_json(F.struct("n", "leidas", "convertidas")).alias("metricas"),
        (F.lead("_m").over(w).isNull()).alias("activo"), "entrenado_en")


def job_runs(lk: Lake) -> DataFrame:
    """Job runs: every order is a run of its priority's job, its total the DPU seconds."""
    state = F.create_map(*[F.lit(x) for kv in JOB_STATES.items() for x in kv])[F.col("o_orderstatus")]
    return lk.raw("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("job"),
                                   state.alias("state"), F.col("o_totalprice").cast("decimal(18,6)").alias("dpu_seconds"))


def stage_runs(lk: Lake) -> DataFrame:
    """Stages of pipeline runs: an order's line numbers; a stage failed when a line of it was
    returned."""
    return (lk.raw("lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage_order"))
            .agg(F.when(F.count_if(F.col("l_returnflag") == "R") > 0, F.lit("FAILED")).otherwise(F.lit("SUCCEEDED")).alias("state")))


def scan_log(lk: Lake) -> DataFrame:
    """Query log: every event is a query that scanned ``value`` x 2^24 bytes."""
    return lk.raw("events").select(F.col("event_id").alias("query_id"),
                                   F.floor(F.col("value").cast("decimal(12,2)") * F.lit(2 ** 24)).cast("bigint").alias("scanned_bytes"))


def table_tags(lk: Lake) -> DataFrame:
    """Catalogue tags: a part is a table, its size gives the sensitivity, every seventh holds
    personal data."""
    level = F.element_at(F.array(*[F.lit(x) for x in SENSITIVITIES]), (F.col("p_size") % len(SENSITIVITIES)).cast("int") + 1)
    return lk.raw("part").select(F.col("p_partkey").alias("tabla_id"), F.col("p_name").alias("tabla"), level.alias("sensitivity"),
                                 (F.col("p_partkey") % 7 == 0).alias("pii"))

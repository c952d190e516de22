"""Data-quality metrics of the transactions as states that add up.

``fact_states`` turns transactions into rows ``(medida, clave, n, compras, ventas, no_positivas,
fuera_de_rango)``, all of them counts and sums.  States of two disjoint sets of transactions are
merged by adding rows of equal ``(medida, clave)``, so seven of the fifteen checks (E5-E7, E12-E15)
follow from the states of old and new partitions without reading the old transactions again:

=============== ========================= ==================================================
medida          clave                     serves
=============== ========================= ==================================================
id              transaccion_id            E5: keys with more than one row over all partitions
proveedor       supplier of a purchase    E6, held against the suppliers of today
cliente         client of a sale          E6
tipo_energia    energy type               E7
dia             days since 1970           E14
mes             months since year 0       E12, E13, E15 and the number of rows
=============== ========================= ==================================================

Volumes are in thousandths (the contract's three decimals) as long: 9.2e15 MWh a month fit, beyond
that Spark raises an overflow.

One pass: a row of the fact becomes five state rows which are summed before the shuffle; the
fact is read once for all seven checks.  A key held by a third of the rows is one state row per
map task.  References are counted per key, not as orphans, because the dimensions may change
between two runs.  NULL keys are kept (a NULL reference is an orphan, NULL ids form one group).

``refresh`` keeps the states of a partitioned fact in a folder with the same partitions.  A
partition is read again only when its files changed (their names and lengths are stored with the
state); partitions that left the fact no longer count.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solera.operators import quality as Q

KEY = ["medida", "clave"]
SUMS = ["n", "compras", "ventas", "no_positivas", "fuera_de_rango"]


def merge(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add up state rows of equal key (per ``by``, else over all partitions)."""
    return states.groupBy(*by, *KEY).agg(*[F.sum(c).alias(c) for c in SUMS])


def state_rows(tx: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The five state rows of every transaction, not yet added up."""
    buy, sale = F.col("tipo") == "compra", F.col("tipo") == "venta"
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    qty, price = F.col("cantidad_mwh"), F.col("precio_usd")
    milli = F.coalesce((qty.cast("decimal(12,3)") * 1000).cast("long"), zero)

    def flag(cond):
        return F.coalesce(cond, F.lit(False)).cast("long")

    def row(medida, clave, compras=zero, ventas=zero, bad_qty=zero, bad_price=zero):
        return F.struct(medida.alias("medida"), clave.cast("long").alias("clave"), one.alias("n"),
                        compras.alias("compras"), ventas.alias("ventas"),
                        bad_qty.alias("no_positivas"), bad_price.alias("fuera_de_rango"))

    rows = F.array(
        row(F.lit("id"), F.col("transaccion_id")),
        row(F.when(buy, F.lit("proveedor")).when(sale, F.lit("cliente")),
            F.when(buy, F.col("proveedor_id")).when(sale, F.col("cliente_id"))),
        row(F.lit("tipo_energia"), F.col("tipo_energia_id")),
        row(F.lit("dia"), F.unix_date("fecha")),
        row(F.lit("mes"), F.year("fecha") * 12 + F.month("fecha") - 1,
            F.when(buy, milli).otherwise(zero), F.when(sale, milli).otherwise(zero),
            flag(qty <= 0), flag((price < Q.PRICE_MIN) | (price > Q.PRICE_MAX))))
    return tx.select(*by, F.inline(rows)).where(F.col("medida").isNotNull())


def fact_states(tx: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """States of ``tx``, one set per value of the partition columns ``by``."""
    return merge(state_rows(tx, by), by)


def references(t: Q.Tables) -> DataFrame:
    """The keys a transaction may refer to."""
    def keys(df, col, medida):
        return df.where(F.col(col).isNotNull()).select(F.lit(medida).alias("medida"), F.col(col).cast("long").alias("clave"))
    return (keys(t.proveedor, "proveedor_id", "proveedor")
            .unionByName(keys(t.cliente, "cliente_id", "cliente"))
            .unionByName(keys(t.tipo_energia, "tipo_energia_id", "tipo_energia")))


def fact_counts(states: DataFrame, t: Q.Tables) -> DataFrame:
    """Rows ``(id, actual, total)`` of E5-E7 and E12-E15 from states, added up or not.

    The references come in as rows that count nothing, so one aggregation both adds the states
    up and finds the keys without a reference (no join).  The only list gathered is the set of
    days, bounded by the covered time span."""
    known = references(t).select("medida", "clave", *[F.lit(0).cast("long").alias(c) for c in SUMS], F.lit(1).alias("ref"))
    keys = (states.select("medida", "clave", *SUMS, F.lit(0).alias("ref")).unionByName(known)
            .groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("ref").alias("ref")))
    m, orphan = F.col("medida"), F.col("ref") == 0
    one = keys.agg(
        F.count_if((m == "id") & (F.col("n") > 1)).alias("e5"),
        F.sum(F.when(m.isin("proveedor", "cliente") & orphan, F.col("n"))).alias("e6"),
        F.sum(F.when((m == "tipo_energia") & orphan, F.col("n"))).alias("e7"),
        F.sum("no_positivas").alias("e12"), F.sum("fuera_de_rango").alias("e13"),
        F.sum(F.when(m == "mes", F.col("n"))).alias("filas"),
        F.array_sort(F.collect_list(F.when(m == "dia", F.col("clave")))).alias("dias"),
        F.count_if((m == "mes") & (F.col("ventas") > F.col("compras"))).alias("e15"))
    gaps = F.size(F.filter("dias", lambda d, i: (i > 0) & (d - F.get("dias", i - 1) > Q.MAX_GAP_DAYS)))

    def check(i, actual, total=None):
        return F.struct(F.lit(i).alias("id"), F.coalesce(actual, F.lit(0)).cast("long").alias("actual"),
                        (F.lit(None) if total is None else F.coalesce(total, F.lit(0))).cast("long").alias("total"))
    return one.select(F.inline(F.array(
        check(5, F.col("e5")), check(6, F.col("e6")), check(7, F.col("e7")), check(12, F.col("e12")),
        check(13, F.col("e13"), F.col("filas")), check(14, gaps), check(15, F.col("e15")))))


def dim_counts(t: Q.Tables) -> DataFrame:
    """Rows of the checks on dimensions: E1 with E11 and E2 with E9 share a pass."""
    def check(i, c):
        return F.struct(F.lit(i).alias("id"), F.col(c).cast("long").alias("actual"), F.lit(None).cast("long").alias("total"))
    cap = F.col("capacidad_mw")
    prov = t.proveedor.agg(Q._count_if(F.col("nombre").isNull()).alias("a"),
                           Q._count_if((cap <= 0) | (cap > Q.CAPACITY_MAX)).alias("b"))
    cli = t.cliente.agg(Q._count_if(F.col("id_externo").isNull()).alias("a"),
                        Q._count_if(~F.col("segmento").isin(Q.SEGMENTS)).alias("b"))
    out = prov.select(F.inline(F.array(check(1, "a"), check(11, "b"))))
    for part in (cli.select(F.inline(F.array(check(2, "a"), check(9, "b")))),
                 Q.check_3(t), Q.check_4(t), Q.check_8(t), Q.check_10(t)):
        out = out.unionByName(part)
    return out


def run_checks(t: Q.Tables, states: DataFrame | None = None) -> DataFrame:
    """All 15 checks; ``states`` replace the pass over the fact."""
    s = state_rows(t.transaccion) if states is None else states
    return Q.evaluate(dim_counts(t).unionByName(fact_counts(s, t)))


# ---------------------------------------------------------------- the store
def _partitions(spark: SparkSession, root: str, by: tuple[str, ...]) -> dict[str, str]:
    """Partition folder (relative) -> digest of its data files' names and lengths, from the
    file system's metadata alone."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return {}
    pattern = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "".join(f"/{c}=*" for c in by))
    out = {}
    for st in fs.globStatus(pattern) or []:
        files = sorted(f"{f.getPath().getName()}:{f.getLen()}" for f in fs.listStatus(st.getPath())
                       if not f.getPath().getName().startswith(("_", ".")))
        if files:
            parts = st.getPath().toString().rstrip("/").split("/")[-len(by):]
            out["/".join(parts)] = hashlib.sha256("\n".join(files).encode()).hexdigest()[:16]
    return out


def _folder(by: tuple[str, ...]):
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
                              for c in by])


def refresh(spark: SparkSession, fact_root: str, store: str, by: tuple[str, ...] = ("anio", "mes")) -> list[str]:
    """Bring the store up to date: read the partitions whose files are new or changed, replace
    their states (other partitions' stay untouched; the same run again reads nothing).  Returns
    the partitions read.  A run that was stopped leaves a partition's old digest, so the next
    one reads it again."""
    fact_root, store = fact_root.rstrip("/"), store.rstrip("/")
    now = _partitions(spark, fact_root, by)
    known: dict[str, str] = {}
    if _partitions(spark, store, by):
        # one row per partition
        rows = spark.read.parquet(store).groupBy(_folder(by).alias("p")).agg(F.min("huella").alias("a"), F.max("huella").alias("b")).collect()
        known = {r.p: r.a for r in rows if r.a == r.b}
    todo = sorted(p for p, h in now.items() if known.get(p) != h)
    if todo:
        tx = spark.read.option("basePath", fact_root).parquet(*[f"{fact_root}/{p}" for p in todo])
        digests = spark.createDataFrame([(p, now[p]) for p in todo], "p string, huella string")
        new = fact_states(tx, by).withColumn("p", _folder(by)).join(F.broadcast(digests), "p").drop("p")
        (new.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*by).parquet(store))
    return todo


def stored_states(spark: SparkSession, fact_root: str, store: str, by: tuple[str, ...] = ("anio", "mes")) -> DataFrame:
    """States of the partitions the fact has now.  Raises when one of them is not in the
    store (``refresh`` first)."""
    present, stored = _partitions(spark, fact_root, by), _partitions(spark, store, by)
    missing = sorted(set(present) - set(stored))
    if missing:
        raise ValueError(f"states of {missing} are missing: refresh the store first")
    store = store.rstrip("/")
    return spark.read.option("basePath", store).parquet(*[f"{store}/{p}" for p in sorted(present)])

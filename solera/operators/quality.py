"""Data-quality suite: 15 checks over the source tables, a summary and a severity gate.

Each check returns one row ``(id, actual, total)`` where ``actual`` is the violation count.
``run_checks`` runs the whole suite with one pass over the fact (``quality_states``); a choice
of checks is a union of their one-row aggregates.

Semantics kept from the original SQL:

* E3/E4/E5 count duplicated *groups*, not rows; several NULLs form one group.
* E6: a ``compra`` without an existing supplier or a ``venta`` without an existing client is
  an orphan -- a NULL id is an orphan too.  Two anti joins, one per side.
* E9/E10 use three-valued ``NOT IN``: NULL is *not* a violation.
* E13 passes while at most 1 % of prices are outside [10, 500]; an empty table passes.
* E14 counts interior gaps > 7 days between consecutive distinct dates.
* E15 counts months where sold volume exceeds purchased volume.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values (the check catalogue) -----------------------------------------------------
SEGMENTS = ["residencial", "comercial", "industrial"]
ENERGY_CODES = ["eolica", "hidroelectrica", "solar", "biomasa", "nuclear"]
CAPACITY_MAX = 5000
PRICE_MIN, PRICE_MAX, PRICE_TOLERANCE = 10, 500, 0.01
MAX_GAP_DAYS = 7
SEVERITIES = ["critical", "high", "medium", "low"]
# --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CheckSpec:
    id: int
    category: str
    name: str
    expected: str
    severity: str


CHECKS = [
    CheckSpec(1, "completitud", "proveedor.nombre not null", "0 nulls", "critical"),
    CheckSpec(2, "completitud", "cliente.id_externo not null", "0 nulls", "critical"),
    CheckSpec(3, "unicidad", "proveedor.nombre unique", "0 duplicates", "high"),
    CheckSpec(4, "unicidad", "cliente.id_externo unique", "0 duplicates", "critical"),
    CheckSpec(5, "unicidad", "transaccion.transaccion_id unique", "0 duplicates", "critical"),
    CheckSpec(6, "integridad", "transaccion has supplier (compra) or client (venta)", "0 orphans", "critical"),
    CheckSpec(7, "integridad", "transaccion.tipo_energia_id exists", "0 invalid", "critical"),
    CheckSpec(8, "integridad", "cliente.ciudad_id exists", "0 invalid", "critical"),
    CheckSpec(9, "dominio", "cliente.segmento in domain", "100% valid", "high"),
    CheckSpec(10, "dominio", "tipo_energia.codigo in catalogue", "100% valid", "high"),
    CheckSpec(11, "rango", "proveedor.capacidad_mw in (0, 5000]", "100% in range", "medium"),
    CheckSpec(12, "rango", "transaccion.cantidad_mwh > 0", "100% positive", "high"),
    CheckSpec(13, "rango", "transaccion.precio_usd in [10, 500]", ">= 99% in range", "medium"),
    CheckSpec(14, "cobertura", "no gap > 7 days between transaction dates", "0 gaps > 7 days", "medium"),
    CheckSpec(15, "sanidad_logica", "purchases >= sales per month", "0 invalid months", "high"),
]
SPEC = {c.id: c for c in CHECKS}

DESCRIPTIONS = {
    1: "every supplier has a name", 2: "every client has an external id", 3: "no two suppliers share a name",
    4: "no two clients share an external id", 5: "no two transactions share an id",
    6: "a purchase names an existing supplier, a sale an existing client", 7: "the energy type of a transaction exists",
    8: "the city of a client exists", 9: "a segment is one of the three known ones", 10: "an energy code is in the catalogue",
    11: "a supplier's capacity is above 0 and at most 5000 MW", 12: "a transaction moves more than 0 MWh",
    13: "prices lie between 10 and 500 USD, one in a hundred may not", 14: "transaction dates have no hole of more than 7 days",
    15: "no month sells more than it buys",
}


@dataclass
class Tables:
    """The source tables the checks read (any DataFrames with the canonical columns)."""
    proveedor: DataFrame
    cliente: DataFrame
    transaccion: DataFrame
    tipo_energia: DataFrame
    ciudad: DataFrame


def _row(check_id: int, actual: Column, total: Column | None = None) -> list[Column]:
    return [F.lit(check_id).alias("id"), actual.cast("long").alias("actual"),
            (total if total is not None else F.lit(None)).cast("long").alias("total")]


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _dup_groups(df: DataFrame, key: str, check_id: int) -> DataFrame:
    """Number of key values occurring more than once (NULLs form one group)."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(*_row(check_id, _count_if(F.col("_n") > 1)))


def check_1(t: Tables) -> DataFrame:
    return t.proveedor.agg(*_row(1, _count_if(F.col("nombre").isNull())))


def check_2(t: Tables) -> DataFrame:
    return t.cliente.agg(*_row(2, _count_if(F.col("id_externo").isNull())))


def check_3(t: Tables) -> DataFrame:
    return _dup_groups(t.proveedor, "nombre", 3)


def check_4(t: Tables) -> DataFrame:
    return _dup_groups(t.cliente, "id_externo", 4)


def check_5(t: Tables) -> DataFrame:
    return _dup_groups(t.transaccion, "transaccion_id", 5)


def check_6(t: Tables) -> DataFrame:
    tx = t.transaccion.select("tipo", "proveedor_id", "cliente_id")
    buy = (tx.where(F.col("tipo") == "compra")
           .join(t.proveedor.select(F.col("proveedor_id")), "proveedor_id", "left_anti"))
    sell = (tx.where(F.col("tipo") == "venta")
            .join(t.cliente.select(F.col("cliente_id")), "cliente_id", "left_anti"))
    orphans = buy.select(F.lit(1).alias("o")).unionByName(sell.select(F.lit(1).alias("o")))
    return orphans.agg(*_row(6, F.count(F.lit(1))))


def check_7(t: Tables) -> DataFrame:
    orphans = (t.transaccion.select("tipo_energia_id")
               .join(t.tipo_energia.select("tipo_energia_id"), "tipo_energia_id", "left_anti"))
    return orphans.agg(*_row(7, F.count(F.lit(1))))


def check_8(t: Tables) -> DataFrame:
    orphans = (t.cliente.select("ciudad_id")
               .join(t.ciudad.select("ciudad_id"), "ciudad_id", "left_anti"))
    return orphans.agg(*_row(8, F.count(F.lit(1))))


def check_9(t: Tables) -> DataFrame:
    return t.cliente.agg(*_row(9, _count_if(~F.col("segmento").isin(SEGMENTS))))


def check_10(t: Tables) -> DataFrame:
    return t.tipo_energia.agg(*_row(10, _count_if(~F.col("codigo").isin(ENERGY_CODES))))


def check_11(t: Tables) -> DataFrame:
    c = F.col("capacidad_mw")
    return t.proveedor.agg(*_row(11, _count_if((c <= 0) | (c > CAPACITY_MAX))))


def check_12(t: Tables) -> DataFrame:
    return t.transaccion.agg(*_row(12, _count_if(F.col("cantidad_mwh") <= 0)))


def check_13(t: Tables) -> DataFrame:
    p = F.col("precio_usd")
    return t.transaccion.agg(*_row(13, _count_if((p < PRICE_MIN) | (p > PRICE_MAX)), F.count(F.lit(1))))


def daily_volumes(tx: DataFrame) -> DataFrame:
    """Per transaction date, purchased and sold volume -- shared input of E14 and E15."""
    return (tx.groupBy("fecha")
            .agg(F.sum(F.when(F.col("tipo") == "compra", F.col("cantidad_mwh")).otherwise(0)).alias("compras"),
                 F.sum(F.when(F.col("tipo") == "venta", F.col("cantidad_mwh")).otherwise(0)).alias("ventas")))


def date_gaps(dates: DataFrame, date_col: str = "fecha", max_days: int = MAX_GAP_DAYS, by: tuple[str, ...] = ()) -> DataFrame:
    """``LAG(date) OVER (ORDER BY date)`` and the day difference, gaps > ``max_days``, over all dates
    or per ``by``.  The window runs over *distinct dates* (one row per calendar day, of a key where
    there is one), a set whose size is bounded by the covered time span, not by the data volume."""
    w = Window.partitionBy(*by).orderBy(date_col)
    d = dates.select(*by, date_col).where(F.col(date_col).isNotNull()).distinct()
    g = d.select(*by, date_col, F.lag(date_col).over(w).alias("prev"))
    g = g.select(*by, date_col, "prev", F.datediff(F.col(date_col), F.col("prev")).alias("gap_dias"))
    return g.where(F.col("gap_dias") > max_days)


def check_14(t: Tables, daily: DataFrame | None = None) -> DataFrame:
    daily = daily if daily is not None else daily_volumes(t.transaccion)
    return date_gaps(daily).agg(*_row(14, F.count(F.lit(1))))


def check_15(t: Tables, daily: DataFrame | None = None) -> DataFrame:
    daily = daily if daily is not None else daily_volumes(t.transaccion)
    monthly = (daily.groupBy(F.trunc("fecha", "month").alias("mes"))
               .agg(F.sum("compras").alias("compras"), F.sum("ventas").alias("ventas")))
    return monthly.agg(*_row(15, _count_if(F.col("ventas") > F.col("compras"))))


CHECK_FUNCS = {1: check_1, 2: check_2, 3: check_3, 4: check_4, 5: check_5, 6: check_6,
               7: check_7, 8: check_8, 9: check_9, 10: check_10, 11: check_11, 12: check_12,
               13: check_13, 14: check_14, 15: check_15}


def evaluate(counts: DataFrame) -> DataFrame:
    """Attach the catalogue and the pass rule: E13 passes at <= 1 % outside (empty passes),
    every other check passes at 0."""
    spark = counts.sparkSession
    meta = spark.createDataFrame([(c.id, c.category, c.name, c.expected, c.severity) for c in CHECKS],
                                 "id int, category string, name string, expected string, severity string")
    ratio_ok = F.coalesce(F.col("actual") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)) <= PRICE_TOLERANCE
    passed = F.when(F.col("id") == 13, ratio_ok).otherwise(F.col("actual") == 0)
    return (meta.join(counts, "id")
            .select("id", "category", "name", "expected", "severity", "actual", "total",
                    passed.alias("passed")))


def run_checks(t: Tables, ids: list[int] | None = None) -> DataFrame:
    """E1-E15 as one DataFrame.  The whole suite reads the fact once, through the metric states
    of ``quality_states``; a choice of ``ids`` runs each check on its own."""
    if ids is None:
        from solera.operators import quality_states
        return quality_states.run_checks(t)
    daily = daily_volumes(t.transaccion)
    parts = []
    for i in ids:
        if i in (14, 15):
            parts.append(CHECK_FUNCS[i](t, daily))
        else:
            parts.append(CHECK_FUNCS[i](t))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return evaluate(counts)


def report(checks: DataFrame) -> DataFrame:
    """The checks with the rule in words and a message: how many rows break it, of how many
    where the check counts them."""
    rules = checks.sparkSession.createDataFrame(sorted(DESCRIPTIONS.items()), "id int, description string")
    n = F.col("actual").cast("string")
    message = (F.when(F.col("passed") & (F.col("actual") == 0), F.lit("ok"))
               .when(F.col("total").isNotNull(), F.concat(n, F.lit(" of "), F.col("total").cast("string"), F.lit(" rows outside")))
               .otherwise(F.concat(n, F.lit(" violations, expected "), F.col("expected"))))
    return checks.join(rules, "id").select("id", "category", "name", "description", "expected", "actual", "severity",
                                           "passed", message.alias("message"))


def timed_report(t: Tables, path: str) -> dict:
    """Run the suite once into ``path`` (JSON lines, one per check) and return its summary with
    the runtime in seconds: total, passed, failed, pass rate."""
    import time
    t0 = time.time()
    report(run_checks(t)).write.mode("overwrite").json(path)
    seconds = time.time() - t0
    row = dq_summary(t.transaccion.sparkSession.read.json(path)).first()
    return {**row.asDict(), "runtime_sec": round(seconds, 3)}


def dq_summary(checks: DataFrame) -> DataFrame:
    """Total, passed, failed, pass rate (percent, 2 decimals)."""
    return checks.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if(F.col("passed")).alias("passed"),
                      F.count_if(~F.col("passed")).alias("failed"),
                      F.round(F.count_if(F.col("passed")) * 100.0 / F.count(F.lit(1)), 2).alias("pass_rate"))


class QualityGateError(RuntimeError):
    pass


def dq_gate(checks: DataFrame, block_on: tuple[str, ...] = ()) -> DataFrame:
    """Optional severity gate.  With the default (no blocking severities) it only
    returns the checks, like the original script; otherwise it raises when a failed check has
    a blocking severity.  Collects at most the 15 check rows."""
    if block_on:
        failing = (checks.where(~F.col("passed") & F.col("severity").isin(list(block_on)))
                   .select("id", "name", "severity").collect())
        if failing:
            raise QualityGateError("blocking data-quality failures: " +
                                   ", ".join(f"#{r.id} {r.name} ({r.severity})" for r in failing))
    return checks


def tables_from_lake(lk) -> Tables:
    """Source tables from the canonical mapping (one plan at every size)."""
    return Tables(proveedor=lk.dim_proveedor(), cliente=lk.dim_cliente(), transaccion=lk.fact(),
                  tipo_energia=lk.dim_tipo_energia(), ciudad=lk.dim_ciudad())

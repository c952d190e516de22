"""Cost metering (G17-G23), re-aimed from per-account API replies to distributed aggregates
over a usage table ``(account, service, day, quantity)`` joined to a price table.

All money is exact decimal; rounding is HALF_UP at the scale the original reports use
(4 dp for cost lines, 6 dp for proration, 12 dp for TB scanned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values: list prices and monthly free allowances ------------------------------------
# service, unit, unit price (USD), free quantity per month, monthly (prorated) item
PRICE_LIST = [
    ("EC2", "hour", "0.0104", "750", False),
    ("RDS", "hour", "0.016", "750", False),
    ("RDS storage", "GB-month", "0.115", "20", True),
    ("EBS", "GB-month", "0.08", "30", True),
    ("S3", "GB-month", "0.023", "5", True),
    ("Glue", "DPU-hour", "0.44", "0", False),
    ("Athena", "TB", "5.00", "0", False),
    ("Secrets Manager", "secret-month", "0.40", "0", True),
]
ATHENA_USD_PER_TB = "5.00"
GLUE_USD_PER_DPU_HOUR = "0.44"
SCAN_CAP_BYTES = 1024 ** 3          # 1 GB per query
BYTES_PER_TB = 1024 ** 4
# ----------------------------------------------------------------------------------------------

def price_table(spark: SparkSession, rows=PRICE_LIST) -> DataFrame:
    return spark.createDataFrame(
        [(s, u, p, f, m) for s, u, p, f, m in rows],
        "service string, unit string, unit_price string, free_per_month string, monthly boolean",
    ).select("service", "unit", F.col("unit_price").cast("decimal(12,6)").alias("unit_price"),
             F.col("free_per_month").cast("decimal(18,6)").alias("free_per_month"), "monthly")


def month_fraction(date_col) -> Column:
    """Day of month / days in month, 6 decimals HALF_UP."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.round(F.dayofmonth(d).cast("decimal(10,0)") / F.dayofmonth(F.last_day(d)).cast("decimal(10,0)"), 6).cast("decimal(10,6)")


def daily_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage priced per (service, day): amount = quantity x unit price (exact decimal)."""
    # a service without a price stays, its amount NULL
    return (usage.join(prices.select("service", "unit_price"), "service", "left")
            .groupBy("service", "day")
            .agg(F.sum(F.col("quantity").cast("decimal(18,6)") * F.col("unit_price").cast("decimal(12,6)")).alias("amount")))


def cost_by_service(daily: DataFrame, start, end, amount: str = "amount") -> DataFrame:
    """Sum daily amounts per service over the half-open range [start, end), plus a
    grand-total row (``rollup``, service 'TOTAL'), 4 decimals HALF_UP.  ``start``/``end`` are
    literals or columns (e.g. scalar subqueries)."""
    s = start if isinstance(start, Column) else F.lit(start).cast("date")
    e = end if isinstance(end, Column) else F.lit(end).cast("date")
    rng = daily.where((F.col("day") >= s) & (F.col("day") < e))
    return (rng.rollup("service").agg(F.round(F.sum(amount), 4).cast("decimal(38,4)").alias("total"))
            .select(F.coalesce("service", F.lit("TOTAL")).alias("service"), "total"))


def metered_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Per (account, month, service): list = quantity x unit price; free-tier allowance
    = min(quantity, monthly free quantity) x unit price; monthly (storage-like) items are
    prorated by the month fraction of the last usage day; charged = max(list - free, 0).
    Exact decimals (every intermediate fits decimal(38)), 4 dp HALF_UP at the end."""
    monthly = (usage.groupBy("account", F.trunc("day", "month").alias("month"), "service")
               .agg(F.sum(F.col("quantity").cast("decimal(18,6)")).cast("decimal(20,6)").alias("quantity"),
                    F.max("day").alias("last_day")))
    j = monthly.join(prices, "service", "left")     # a service without a price stays, its amounts NULL
    frac = F.when(F.col("monthly"), month_fraction("last_day")).otherwise(F.lit(1)).cast("decimal(8,6)")
    price = F.col("unit_price").cast("decimal(10,6)")
    list_price = (F.col("quantity") * price).cast("decimal(25,12)") * frac
    free_qty = F.least(F.col("quantity"), F.col("free_per_month").cast("decimal(20,6)"))
    free = (free_qty * price).cast("decimal(25,12)") * frac
    return j.select("account", "month", "service", "quantity",
                    F.round(list_price, 4).cast("decimal(38,4)").alias("list_usd"),
                    F.round(free, 4).cast("decimal(38,4)").alias("free_tier_usd"),
                    F.round(F.when(list_price.isNotNull(), F.greatest(list_price - free, F.lit(0))), 4).cast("decimal(38,4)").alias("charged_usd"))


def credit_view(costs: DataFrame, starting_credits: str) -> DataFrame:
    """Per account and month (running): charged, free tier saved, list = charged +
    saved, credits applied = min(cumulative charged, starting), credits remaining =
    max(starting - cumulative charged, 0), out of pocket = max(cumulative charged - starting, 0).
    The window runs per account over its monthly rows (one row per month)."""
    start = F.lit(starting_credits).cast("decimal(18,2)")
    m = costs.groupBy("account", "month").agg(F.sum("charged_usd").cast("decimal(38,4)").alias("charged"),
                                              F.sum("free_tier_usd").cast("decimal(38,4)").alias("saved"))
    w = Window.partitionBy("account").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("charged").over(w).cast("decimal(38,4)")
    zero = F.lit(0).cast("decimal(38,4)")
    return m.select("account", "month", "charged", "saved",
                    (F.col("charged") + F.col("saved")).cast("decimal(38,4)").alias("list_total"),
                    F.least(cum, start).cast("decimal(38,4)").alias("credits_applied"),
                    F.greatest(start - cum, zero).cast("decimal(38,4)").alias("credits_remaining"),
                    F.greatest(cum - start, zero).cast("decimal(38,4)").alias("out_of_pocket"))


def plan_status(credits: DataFrame, as_of, ends_on: str) -> DataFrame:
    """Days remaining in the plan (inclusive of today, never negative) next to the credit
    view of the newest month of each account.  ``as_of`` is a date literal or a column."""
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    days_left = F.greatest(F.lit(0), F.datediff(F.lit(ends_on).cast("date"), ref) + 1)
    w = Window.partitionBy("account").orderBy(F.col("month").desc())
    newest = credits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return newest.select("account", "credits_applied", "credits_remaining", "out_of_pocket", days_left.alias("days_remaining"))


def job_cost(runs: DataFrame, usd_per_dpu_hour: str = GLUE_USD_PER_DPU_HOUR) -> DataFrame:
    """Succeeded runs per job, DPU-hours = sum(dpu_seconds)/3600, cost 4 dp HALF_UP."""
    ok = runs.where(F.col("state") == "SUCCEEDED")
    dpu_h = (F.sum(F.col("dpu_seconds").cast("decimal(38,6)")) / 3600)
    return ok.groupBy("job").agg(F.count(F.lit(1)).alias("runs"), F.round(dpu_h, 6).alias("dpu_hours"),
                                 F.round(dpu_h * F.lit(usd_per_dpu_hour).cast("decimal(10,4)"), 4).alias("cost_usd"))


def pipeline_status(stage_runs: DataFrame) -> DataFrame:
    """Stages of one pipeline run execute in order and the first failure stops the rest:
    stages after a failed one are ``skipped``.  Window per run over its few stages."""
    w = Window.partitionBy("run_id").orderBy("stage_order").rowsBetween(Window.unboundedPreceding, -1)
    failed_before = F.coalesce(F.max((F.col("state") != "SUCCEEDED").cast("int")).over(w), F.lit(0)) == 1
    return stage_runs.withColumn("effective_state", F.when(failed_before, F.lit("skipped")).otherwise(F.col("state")))


def scan_cost(queries: DataFrame, usd_per_tb: str = ATHENA_USD_PER_TB, cap_bytes: int = SCAN_CAP_BYTES):
    """Total bytes scanned, query count, TB (12 dp), cost (6 dp) and the queries over
    the per-query scan cap.  Returns (summary, overruns)."""
    # operand widths chosen so the quotient keeps 15 decimals before rounding to 12
    tb = F.round(F.sum(F.col("scanned_bytes")).cast("decimal(20,0)") / F.lit(BYTES_PER_TB).cast("decimal(14,0)"), 12)
    summary = queries.agg(F.sum("scanned_bytes").alias("bytes"), F.count(F.lit(1)).alias("queries"),
                          tb.alias("tb")).withColumn("cost_usd", F.round(F.col("tb") * F.lit(usd_per_tb).cast("decimal(10,2)"), 6))
    overruns = queries.where(F.col("scanned_bytes") > cap_bytes)
    return summary, overruns

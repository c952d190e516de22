"""Cost metering on hand-checkable rows."""

import datetime as dt
from decimal import Decimal as D

from solera.operators import cost as C


def test_metered_free_tier_and_proration(spark):
    usage = spark.createDataFrame([
        (1, "EC2", dt.date(2024, 1, 10), D("700")), (1, "EC2", dt.date(2024, 1, 20), D("100")),   # 800 h > 750 free
        (1, "S3", dt.date(2024, 1, 15), D("10")),                                                  # 10 GB, 5 free, prorated
        (2, "Glue", dt.date(2024, 2, 29), D("2")),                                                 # no free tier
    ], "account long, service string, day date, quantity decimal(18,6)")
    rows = {(r.account, r.service): r for r in C.metered_cost(usage, C.price_table(spark)).collect()}
    ec2 = rows[(1, "EC2")]
    assert ec2.list_usd == D("8.3200") and ec2.free_tier_usd == D("7.8000") and ec2.charged_usd == D("0.5200")
    s3 = rows[(1, "S3")]           # fraction 15/31 = 0.483871
    assert s3.list_usd == D("0.1113") and s3.free_tier_usd == D("0.0556") and s3.charged_usd == D("0.0556")
    assert rows[(2, "Glue")].charged_usd == D("0.8800")


def test_credit_waterfall_running(spark):
    costs = spark.createDataFrame([(1, dt.date(2024, 1, 1), D("60"), D("1")), (1, dt.date(2024, 2, 1), D("70"), D("0"))],
                                  "account long, month date, charged_usd decimal(38,4), free_tier_usd decimal(38,4)")
    rows = sorted(C.credit_view(costs, "100.00").collect(), key=lambda r: r.month)
    assert (rows[0].credits_applied, rows[0].credits_remaining, rows[0].out_of_pocket) == (D("60"), D("40"), D("0"))
    assert (rows[1].credits_applied, rows[1].credits_remaining, rows[1].out_of_pocket) == (D("100"), D("0"), D("30"))
    st = C.plan_status(C.credit_view(costs, "100.00"), "2024-12-31", "2024-12-30").first()
    assert st.days_remaining == 0


def test_cost_by_service_half_open_range(spark):
    daily = spark.createDataFrame([("S3", dt.date(2024, 1, 1), D("1.00005")), ("S3", dt.date(2024, 1, 2), D("2")),
                                   ("EC2", dt.date(2024, 1, 1), D("3"))], "service string, day date, amount decimal(20,6)")
    got = {r.service: r.total for r in C.cost_by_service(daily, "2024-01-01", "2024-01-02").collect()}
    assert got == {"S3": D("1.0001"), "EC2": D("3.0000"), "TOTAL": D("4.0001")}


def test_jobs_pipeline_and_scans(spark):
    runs = spark.createDataFrame([("fact", "SUCCEEDED", 3600.0), ("fact", "FAILED", 100.0), ("dims", "SUCCEEDED", 1800.0)],
                                 "job string, state string, dpu_seconds double")
    got = {r.job: (r.runs, r.cost_usd) for r in C.job_cost(runs).collect()}
    assert got == {"fact": (1, D("0.4400")), "dims": (1, D("0.2200"))}
    stages = spark.createDataFrame([(1, 1, "SUCCEEDED"), (1, 2, "FAILED"), (1, 3, "SUCCEEDED"), (2, 1, "SUCCEEDED")],
                                   "run_id int, stage_order int, state string")
    eff = {(r.run_id, r.stage_order): r.effective_state for r in C.pipeline_status(stages).collect()}
    assert eff[(1, 3)] == "skipped" and eff[(1, 2)] == "FAILED" and eff[(2, 1)] == "SUCCEEDED"
    q = spark.createDataFrame([("a", 1024 ** 4), ("b", 2 * 1024 ** 3)], "query_id string, scanned_bytes long")
    summary, over = C.scan_cost(q)
    s = summary.first()
    assert s.queries == 2 and s.cost_usd == D("5.009766")
    assert {r.query_id for r in over.collect()} == {"a", "b"}

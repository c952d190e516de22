"""Quantile sketches against exact ranks, drift against a count by hand."""

import bisect
import datetime as dt

from pyspark.sql import functions as F

from paths import SF01
from solera.mapping import Lake
from solera.operators import fx as FX


def test_sketched_percentiles_by_rank(spark, tmp_path):
    ticks = Lake(spark, SF01).ticks().withColumn("x", F.col("precio_compra") + F.col("tick_id") / 1e6)  # no ties
    FX.daily_sketches(ticks, "x", "capturado_en", k=64).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    rows = sorted(r.x for r in ticks.select("x").collect())
    got = FX.sketched_percentiles(days, unit="year").collect()
    assert {r.filas for r in got} == {len(rows)} and len(got) == 5
    for r in got:     # k = 64: about 4 % at 99 % confidence
        assert abs(bisect.bisect_right(rows, r.valor) / len(rows) - r.p) <= 0.06
    for r in FX.sketched_percentiles(FX.daily_sketches(ticks, "x", "capturado_en"), unit="year").collect():
        assert abs(bisect.bisect_right(rows, r.valor) / len(rows) - r.p) <= 0.008


def test_small_days_are_exact_and_nulls_left_out(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), v) for v in (1.0, 2.0, 3.0, None, float("nan"))], "ts timestamp_ntz, v double")
    got = FX.sketched_percentiles(FX.daily_sketches(df, "v", "ts"), probs=(0.0, 0.5, 1.0)).collect()
    assert [(r.filas, r.p, r.valor) for r in got] == [(3, 0.0, 1.0), (3, 0.5, 2.0), (3, 1.0, 3.0)]


def test_drift_between_neighbouring_days(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(day(1), 0.1), (day(1), 0.9), (day(2), 0.1), (day(2), 0.2), (day(2), 0.9), (day(5), 5.0), (day(5), -1.0), (day(6), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = [(r.dia.day, r.dia_anterior.day, r.filas, r.distancia) for r in FX.distribution_drift(df, "v", "ts", 0.0, 1.0, 10).orderBy("dia").collect()]
    assert got == [(2, 1, 3, 0.166667), (5, 2, 2, 0.5)]
    assert FX.distribution_drift(df.where("false"), "v", "ts", 0.0, 1.0).count() == 0

"""Digest tree: planted differences located, equal zones stop at the root; sketches within their bound."""

import pytest
from pyspark.sql import functions as F

from paths import SF001, SF01
from solera.operators import fx as FX
from solera.operators import governance as GV

COLS = ["k", "v", "w"]


@pytest.fixture(scope="module")
def zone(spark):
    return spark.range(20000).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).alias("v"),
                                     F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("w"))


def stored(spark, df, path):
    GV.digests(df, ["k"], COLS).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_equal_zones_stop_at_the_root(spark, zone, tmp_path):
    a, b = stored(spark, zone, tmp_path / "a"), stored(spark, zone.repartition(7), tmp_path / "b")
    assert GV.locate(a, b) is None
    assert GV.differences(zone, zone.repartition(5), ["k"], COLS).count() == 0
    root = GV.level(a, GV.TREE_BITS, 0).first()
    assert (root.nodo, root.filas, root.suma_hash) == (0, *GV.checksum(zone, COLS).first())


def test_single_rows_are_located(spark, zone, tmp_path):
    other = (zone.where("k <> 77")                                                       # gone
             .withColumn("v", F.when(F.col("k") == 1234, F.lit(99)).otherwise(F.col("v")))  # changed
             .withColumn("w", F.when(F.col("k") == 4321, F.lit(None)).otherwise(F.col("w")))  # NULL now
             .unionByName(zone.where("k = 555"))                                          # twice
             .unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 1L AS v, 'x' AS w")))  # NULL key
    want = {77: ("solo_a", 1, 0), 1234: ("distinta", 1, 1), 4321: ("distinta", 1, 1), 555: ("distinta", 1, 2),
            None: ("solo_b", 0, 1)}
    a, b = stored(spark, zone, tmp_path / "a"), stored(spark, other, tmp_path / "b")
    ranges = GV.locate(a, b)
    assert 1 <= ranges.count() <= len(want)
    for r in (ranges, None):
        got = {x.k: (x.diferencia, x.filas_a, x.filas_b) for x in GV.differences(zone, other, ["k"], COLS, r).collect()}
        assert got == want


def test_empty_zone(spark, zone, tmp_path):
    none = zone.where("false")
    assert GV.differences(none, none, ["k"], COLS).count() == 0
    assert GV.differences(none, zone.limit(9), ["k"], COLS).count() == 9
    a, b = stored(spark, none, tmp_path / "a"), stored(spark, zone, tmp_path / "b")
    assert GV.locate(a, a) is None and GV.locate(a, b).count() == b.count()


def test_sketched_active_users_stay_within_the_bound(spark, tmp_path):
    for sf in (SF001, SF01):
        ev = spark.read.parquet(f"{sf}/events.parquet")
        FX.daily_user_sketches(ev).write.parquet(f"{tmp_path}/{sf[-4:]}")
        est = FX.active_users_from_sketches(spark.read.parquet(f"{tmp_path}/{sf[-4:]}"))
        exact = {(r[0], r[1]): r[2] for r in FX.active_users(ev).collect()}
        got = {(r[0], r[1]): r[2] for r in est.collect()}
        assert got.keys() == exact.keys()
        # five standard errors, or one user for small counts
        assert all(abs(got[k] - n) <= max(1, 5 * 0.0065 * n) for k, n in exact.items())

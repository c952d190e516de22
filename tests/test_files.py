"""Erasure and retention by file: what is not touched keeps name and bytes, stopped runs are resumed."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from solera.sources import files as FL


def snapshot(root):
    out = {}
    for d, _, names in os.walk(root):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(d, n), "rb") as f:
                    out[os.path.relpath(os.path.join(d, n), root)] = hashlib.sha256(f.read()).hexdigest()
    return out


@pytest.fixture()
def table(spark, tmp_path):
    root = str(tmp_path / "t able")   # a space is encoded in file URIs
    df = spark.range(600).select(F.col("id"), (F.col("id") % 50).alias("cliente"), (2020 + F.floor(F.col("id") / 100)).cast("int").alias("anio"),
                                 (1 + F.floor(F.col("id") / 50) % 2).cast("int").alias("mes"))
    df = df.withColumn("cliente", F.when(F.col("id") % 100 != 99, F.col("cliente") + 1000 * F.col("anio")))
    df.repartition(1).write.partitionBy("anio", "mes").parquet(root)
    return root, df


def test_only_files_with_a_subject_are_rewritten(spark, table):
    root, df = table
    before = snapshot(root)
    subjects = spark.createDataFrame([(2021 * 1000 + 3,), (2024 * 1000 + 7,), (2024 * 1000 + 8,), (5,), (None,)], "c long")
    rep = FL.erase_in_files(spark, root, "cliente", subjects, "c", ("anio", "mes")).collect()
    after = snapshot(root)
    assert sorted(r.filas_borradas for r in rep) == [1, 1, 2, 2]
    assert {r.archivo for r in rep} == set(before) - set(after)
    assert all(after[f] == h for f, h in before.items() if f in after)
    want = df.where("cliente IS NULL OR cliente NOT IN (2021003, 2024007, 2024008)")
    got = spark.read.parquet(root).select(*df.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert FL.erase_in_files(spark, root, "cliente", subjects, "c", ("anio", "mes")).count() == 0
    assert snapshot(root) == after and FL.STAGING in os.listdir(root)


@pytest.mark.parametrize("moved", [0, 1])
def test_a_stopped_erasure_is_finished(spark, table, monkeypatch, moved):
    root, df = table
    subjects = spark.createDataFrame([(2021 * 1000 + 3,)], "c long")
    real, calls = FL._Files.move, []

    def stop(self, a, b):
        if len(calls) >= moved:
            raise KeyboardInterrupt
        calls.append(a)
        real(self, a, b)
    monkeypatch.setattr(FL._Files, "move", stop)
    with pytest.raises(KeyboardInterrupt):
        FL.erase_in_files(spark, root, "cliente", subjects, "c", ("anio", "mes"))
    monkeypatch.setattr(FL._Files, "move", real)
    assert FL.erase_in_files(spark, root, "cliente", subjects, "c", ("anio", "mes")).count() == 0
    assert spark.read.parquet(root).count() == df.where("cliente IS NULL OR cliente <> 2021003").count()


def test_whole_file_and_empty_table(spark, tmp_path):
    root = str(tmp_path / "one")
    spark.range(5).write.parquet(root)
    assert FL.erase_in_files(spark, str(tmp_path / "none"), "id", spark.range(3), "id").count() == 0
    assert sum(r.filas_borradas for r in FL.erase_in_files(spark, root, "id", spark.range(9), "id").collect()) == 5
    assert spark.read.schema("id long").parquet(root).count() == 0


def test_retention_moves_and_drops_whole_months(spark, table, tmp_path, monkeypatch):
    root, _ = table
    archive, tiers = str(tmp_path / "archive"), [(365, "archivo"), (3 * 365, "borrar")]
    before = snapshot(root)
    as_of = dt.date(2024, 1, 31)      # exactly 3 years after 2021-01, 1 year after 2023-01 (both stay one day more)
    real, n = FL._Files.move, []

    def stop(self, a, b):
        if n:
            raise KeyboardInterrupt
        n.append(a)
        real(self, a, b)
    monkeypatch.setattr(FL._Files, "move", stop)
    with pytest.raises(KeyboardInterrupt):
        FL.retire_partitions(spark, root, tiers, as_of, archive)
    monkeypatch.setattr(FL._Files, "move", real)
    FL.retire_partitions(spark, root, tiers, as_of, archive)
    kept, moved = snapshot(root), snapshot(archive)
    month = lambda f: tuple(int(p.split("=")[1]) for p in f.split("/")[:2])
    assert {f: h for f, h in before.items() if month(f) >= (2023, 1)} == kept
    assert {f: h for f, h in before.items() if (2021, 1) <= month(f) < (2023, 1)} == moved
    assert FL.retire_partitions(spark, root, tiers, as_of, archive) == []
    assert {p for p, lb, _ in FL.retire_partitions(spark, root, tiers, dt.date(2024, 2, 1), archive) if lb == "borrar"} == {"anio=2021/mes=1"}

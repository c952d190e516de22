"""Smaller sources, sinks and transforms on hand-checkable rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solera.operators import governance as GV
from solera.operators import transform as B
from solera.sources import export as X
from solera.sources import snapshots as S


def test_load_tsv_null_marker(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("1\tsolar\t12.5\n2\t\\N\t\\N\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("codigo", T.StringType()),
                           T.StructField("precio", T.DecimalType(10, 2))])
    rows = S.load_tsv(spark, str(p), schema).orderBy("id").collect()
    assert rows[0].codigo == "solar" and rows[1].codigo is None and rows[1].precio is None


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else f"n{i}") for i in range(300)], "id int, nombre string")
    assert json.loads(X.as_json_lines(df.where("id = 2")).first().json) == {"id": 2, "nombre": "n2"}
    X.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 300
    n = X.export_csv({"cliente": df}, "cliente", str(tmp_path / "c"), max_rows=5, allowed={"cliente"}, order_by=["id"])
    assert n == 100                                          # cap clamped to [100, 100000]
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    lines = text.strip().split("\n")
    assert lines[0] == "id,nombre" and len(lines) == 101 and lines[2] == "1,"   # NULL written as empty
    with pytest.raises(X.NotAllowed):
        X.export_csv({"secreto": df}, "secreto", str(tmp_path / "s"), 100, allowed={"cliente"})


def test_checksum_order_free_and_sensitive(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = a.orderBy(F.desc("id")).repartition(3)
    assert GV.compare_checksums(a, b, ["id", "v"]).first().iguales
    c = a.withColumn("v", F.when(F.col("id") == 2, F.lit("z")).otherwise(F.col("v")))
    assert not GV.compare_checksums(a, c, ["id", "v"]).first().iguales


def test_retention_tiers(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(d,), (d - dt.timedelta(days=91),), (d - dt.timedelta(days=2000),)], "f date")
    kept, counts = GV.apply_retention(df, "f", "ticks")
    assert {r.retencion: r.filas for r in counts.collect()} == {"activo": 1, "archivo": 1, "borrar": 1}
    assert kept.count() == 2


def test_opt_filter_and_normalize(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert B.opt_filter(df, "x", None).count() == 2           # COALESCE(:p, x): NULL x never matches
    assert B.opt_filter(df, "x", "a").count() == 1
    s = spark.createDataFrame([("Amazon Simple Storage Service",), ("AWS Glue",), (None,)], "service string")
    assert [r.service for r in B.normalize_names(s, "service").collect()] == ["S3", "Glue", "?"]


def test_date_dim_with_holidays(spark):
    hol = spark.createDataFrame([(dt.date(2024, 1, 1),)], "fecha date")
    cal = {r.fecha: r for r in B.date_dim("2023-12-30", "2024-01-02", hol).collect()}
    assert len(cal) == 4 and cal[dt.date(2024, 1, 1)].es_feriado and not cal[dt.date(2024, 1, 2)].es_feriado
    assert cal[dt.date(2023, 12, 30)].es_finde and cal[dt.date(2024, 1, 1)].fecha_id == 20240101
    assert cal[dt.date(2024, 1, 1)].nombre_mes == "enero" and cal[dt.date(2023, 12, 31)].trimestre == 4


def test_erasure_and_pii(spark):
    cli = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cliente_id long, nombre string")
    tx = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (None, 13)], "cliente_id long, monto int")
    subj = spark.createDataFrame([(1,)], "cliente_id long")
    kept, report = B.erase_subjects({"cliente": (cli, "cliente_id"), "tx": (tx, "cliente_id")}, subj, "cliente_id")
    rep = {r.tabla: (r.filas_antes, r.filas_despues, r.filas_borradas) for r in report.collect()}
    assert rep == {"cliente": (3, 2, 1), "tx": (4, 2, 2)}
    docs = spark.createDataFrame([(1, "write to ana.perez@mail.example.com or 300 123 4567 now")], "doc_id long, text string")
    scan = B.pii_scan(docs, "text", "doc_id").first()
    assert (scan.n_email, scan.n_numero) == (1, 1)
    tok = B.pii_tokenize(docs, "text", "salt").first().text
    assert "ana.perez" not in tok and "4567" not in tok and tok.count("tok_") == 2


def test_governed_tables(spark):
    tags = spark.createDataFrame([("dim_cliente", "Internal", True), ("agg", "Public", False), ("raw", "Confidential", False),
                                  ("dim_tipo", "Internal", False)], "table string, sensitivity string, pii boolean")
    assert {r.table for r in B.governed_tables(tags).collect()} == {"agg", "dim_tipo"}


def test_loaded_at_from_path_and_projection(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "id string, nombre string")
    S.write_snapshot(df, str(tmp_path), "t", "2024-02-03T04")
    raw = spark.read.option("header", True).csv(str(tmp_path / "t" / "loaded_at=2024-02-03T04"))
    assert S.with_loaded_at_from_path(raw).first().loaded_at == "2024-02-03T04"
    p = B.project(raw, {"cliente_id": "CAST(id AS BIGINT)", "nombre_upper": "upper(nombre)"})
    assert p.columns == ["cliente_id", "nombre_upper"] and p.first().nombre_upper == "A"


def test_listing_helpers(spark):
    from solera.operators import listings as L
    from solera.operators import features as W
    df = spark.createDataFrame([(1, None, 5), (2, "b", 7), (3, "a", 7), (4, "c", 1)], "id int, nombre string, v int")
    assert [r.id for r in L.order_by(df, [("v", "desc"), ("nombre", "asc_nulls_last")]).collect()] == [3, 2, 1, 4]
    assert [r.id for r in L.keyset_page(df, "id", after=2, limit=1).collect()] == [3]
    assert [r.id for r in L.keyset_page(df, "id", after=3, limit=5, descending=True).collect()] == [2, 1]
    assert [r.id for r in L.latest_n(df, "v", 2, tiebreak="id").collect()] == [3, 2]
    assert [r.id for r in L.page(df, ["id"], limit=10, offset=1, cap=2).collect()] == [2, 3]
    ranked = {r.id: r.rn for r in W.rank_latest(df, "v", "id").collect()}
    assert ranked[3] == 1 and ranked[2] == 2


def test_recommended_conf_scales_with_input():
    from solera.session import recommended_conf
    small = recommended_conf(40 * 1024 ** 2, 8)
    big = recommended_conf(100 * 1024 ** 4, 8000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert big["spark.sql.shuffle.partitions"] == "50000"
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 ** 2)

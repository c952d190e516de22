"""Schema drift carried out: widening, merge on read, the rescue column, partitions from folder names."""

import itertools
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solera.sources import catalog as C

TYPES = [T.NullType(), T.ByteType(), T.IntegerType(), T.LongType(), T.DecimalType(5, 2), T.DecimalType(38, 0), T.FloatType(),
         T.DoubleType(), T.DateType(), T.TimestampType(), T.TimestampNTZType(), T.BooleanType(), T.StringType()]


def test_widening_does_not_depend_on_order():
    for a, b, c in itertools.product(TYPES, repeat=3):
        assert C.wider(a, b) == C.wider(b, a)
        assert C.wider(a, C.wider(b, c)) == C.wider(C.wider(a, b), c), (a, b, c)
    assert C.wider(T.IntegerType(), T.DecimalType(5, 2)) == T.DecimalType(12, 2)
    assert C.wider(T.LongType(), T.DoubleType()) == T.StringType()


def test_loads_of_several_versions_read_as_one(spark, tmp_path):
    loads = [spark.createDataFrame([(1, "a", 10)], "k int, gone string, v int"),
             spark.createDataFrame([(2, D("3.25"), True)], "k long, v decimal(5,2), new boolean"),
             spark.createDataFrame([(3, D("4.50"), False)], "k long, v decimal(5,2), new boolean")]
    paths = [f"{tmp_path}/l{i}" for i in range(3)]
    for df, p in zip(loads, paths):
        df.write.parquet(p)
    m = C.read_merged(spark, paths)
    assert m.drop(C.RESCUE).schema.simpleString() == "struct<k:bigint,gone:string,v:decimal(12,2),new:boolean>"
    assert sorted(map(tuple, m.drop(C.RESCUE).collect())) == [(1, "a", D("10.00"), None), (2, None, D("3.25"), True), (3, None, D("4.50"), False)]
    assert m.where(F.col(C.RESCUE).isNotNull()).count() == 0
    assert str(m._jdf.queryExecution().optimizedPlan()).count("Relation") == 2      # two versions, three loads


def test_what_does_not_fit_is_rescued(spark, tmp_path):
    p = str(tmp_path / "l")
    spark.createDataFrame([(1, "7", D("1.50")), (2, "x", D("2.00")), (3, None, D("900.00"))], "k int, n string, b decimal(8,2)").write.parquet(p)
    schema = T.StructType.fromDDL("k int, n int, b tinyint, z date")
    rows = {r.k: (r.n, r.b, r.z, r[C.RESCUE]) for r in C.read_merged(spark, [p], schema=schema).collect()}
    assert rows == {1: (7, None, None, {"b": "1.50"}), 2: (None, 2, None, {"n": "x"}), 3: (None, None, None, {"b": "900.00"})}
    narrow = C.read_merged(spark, [p], schema=T.StructType.fromDDL("k int"))
    assert narrow.where("k = 3").first()[C.RESCUE] == {"b": "900.00"}
    assert C.read_merged(spark, [], schema=schema).columns == ["k", "n", "b", "z", C.RESCUE]


def test_policies():
    a, b = T.StructType.fromDDL("k int, v int"), T.StructType.fromDDL("k bigint, w string")
    assert C.evolve(a, b).simpleString() == "struct<k:bigint,v:int,w:string>"
    with pytest.raises(C.SchemaDriftError):
        C.evolve(a, b, "fail")
    assert C.evolve(a, a, "fail") == a


def test_partitions_come_from_folder_names(spark, tmp_path):
    root = str(tmp_path / "zone")
    spark.range(6).selectExpr("id", "2020 + id % 2 AS anio", "id % 3 AS mes").write.partitionBy("anio", "mes").parquet(f"{root}/fact")
    spark.range(3).write.parquet(f"{root}/dim")
    assert C.partition_columns(spark, f"{root}/fact") == ["anio", "mes"] and C.partition_columns(spark, f"{root}/dim") == []
    found = {r.table: r.partitions for r in C.discover(spark, root, "parquet", "drift_t").collect()}
    assert found == {"dim": "", "fact": "anio,mes"}
    assert spark.table("drift_t.fact").where("anio = 2021 AND mes = 1").count() == 1
    (tmp_path / "zone" / "fact" / "other").mkdir()
    with pytest.raises(ValueError):
        C.partition_columns(spark, f"{root}/fact")

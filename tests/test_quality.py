"""Each data-quality check seen passing on clean rows and failing on injected dirty rows."""

import datetime as dt
from decimal import Decimal as D

import pytest

from solera.operators import quality as Q

PROV = "proveedor_id long, nombre string, capacidad_mw decimal(10,2)"
CLI = "cliente_id long, id_externo string, segmento string, ciudad_id int"
TX = ("transaccion_id long, fecha date, tipo string, proveedor_id long, cliente_id long, "
      "tipo_energia_id short, cantidad_mwh decimal(12,3), precio_usd decimal(10,2)")
TE = "tipo_energia_id short, codigo string"
CIU = "ciudad_id int"


def d(s):
    return dt.date.fromisoformat(s)


def clean_rows():
    prov = [(1, "a", D("10.00")), (2, "b", D("5000.00"))]
    cli = [(1, "CC-1", "residencial", 1), (2, "CC-2", None, 1)]          # NULL segment passes E9
    tx = [(1, d("2024-01-01"), "compra", 1, None, 1, D("10"), D("10.00")),
          (2, d("2024-01-08"), "venta", None, 1, 1, D("5"), D("500.00")),   # 7-day gap is fine
          (3, d("2024-01-09"), "compra", 2, None, 1, D("1"), D("20.00"))]
    te = [(1, "solar")]
    ciu = [(1,)]
    return prov, cli, tx, te, ciu


def tables(spark, prov, cli, tx, te, ciu):
    return Q.Tables(proveedor=spark.createDataFrame(prov, PROV), cliente=spark.createDataFrame(cli, CLI),
                    transaccion=spark.createDataFrame(tx, TX), tipo_energia=spark.createDataFrame(te, TE),
                    ciudad=spark.createDataFrame(ciu, CIU))


def results(spark, *rows):
    return {r.id: r for r in Q.run_checks(tables(spark, *rows)).collect()}


def test_all_checks_pass_on_clean_rows(spark):
    res = results(spark, *clean_rows())
    assert len(res) == 15
    assert all(r.passed for r in res.values()), {i: r.actual for i, r in res.items() if not r.passed}


def _dirty(kind):
    prov, cli, tx, te, ciu = clean_rows()
    if kind == 1:
        prov.append((3, None, D("1")))
    elif kind == 2:
        cli.append((3, None, "comercial", 1))
    elif kind == 3:
        prov += [(3, None, D("1")), (4, None, D("1")), (5, "a", D("1"))]   # NULL group + "a" group
    elif kind == 4:
        cli.append((3, "CC-1", "comercial", 1))
    elif kind == 5:
        tx.append(tx[0])
    elif kind == 6:
        tx.append((9, d("2024-01-09"), "compra", None, None, 1, D("1"), D("20.00")))  # NULL supplier on compra
    elif kind == 7:
        tx.append((9, d("2024-01-09"), "compra", 1, None, 7, D("1"), D("20.00")))
    elif kind == 8:
        cli.append((3, "CC-3", "comercial", 99))
    elif kind == 9:
        cli.append((3, "CC-3", "gobierno", 1))
    elif kind == 10:
        te.append((2, "carbon"))
    elif kind == 11:
        prov.append((3, "c", D("5000.01")))
    elif kind == 12:
        tx.append((9, d("2024-01-09"), "compra", 1, None, 1, D("0"), D("20.00")))
    elif kind == 13:
        tx.append((9, d("2024-01-09"), "compra", 1, None, 1, D("1"), D("500.01")))   # 1 of 4 outside
    elif kind == 14:
        tx.append((9, d("2024-01-18"), "compra", 1, None, 1, D("1"), D("20.00")))   # 9-day gap
    elif kind == 15:
        tx.append((9, d("2024-02-01"), "venta", None, 1, 1, D("1"), D("20.00")))    # month with sales only
    return prov, cli, tx, te, ciu


@pytest.mark.parametrize("kind", range(1, 16))
def test_each_check_fails_on_injected_rows(spark, kind):
    res = results(spark, *_dirty(kind))
    assert not res[kind].passed, res[kind]
    if kind == 3:
        assert res[3].actual == 2    # duplicated groups, not rows


def test_price_tolerance_and_empty_table(spark):
    prov, cli, tx, te, ciu = clean_rows()
    many = [(100 + i, d("2024-01-09"), "compra", 1, None, 1, D("1"), D("20.00")) for i in range(200)]
    res = results(spark, prov, cli, tx + many + [(999, d("2024-01-09"), "compra", 1, None, 1, D("1"), D("9.99"))], te, ciu)
    assert res[13].actual == 1 and res[13].passed           # 1 of 204 outside: within 1 %
    res = results(spark, prov, cli, [], te, ciu)
    assert res[13].passed and res[13].total == 0             # empty table passes


def test_summary_and_gate(spark):
    checks = Q.run_checks(tables(spark, *_dirty(6)))
    s = Q.dq_summary(checks).first()
    assert (s.total, s.passed, s.failed) == (15, 14, 1)
    Q.dq_gate(checks)                                        # default: never blocks
    with pytest.raises(Q.QualityGateError):
        Q.dq_gate(checks, block_on=("critical",))
    Q.dq_gate(checks, block_on=("low",))


def _counts(df):
    return sorted((r.id, r.actual, r.total, r.passed) for r in df.collect())


@pytest.mark.parametrize("kind", [None, 5, 6, 14, 15])
def test_suite_from_states_equals_each_check(spark, kind):
    t = tables(spark, *(clean_rows() if kind is None else _dirty(kind)))
    assert _counts(Q.run_checks(t)) == _counts(Q.run_checks(t, [c.id for c in Q.CHECKS]))


def test_null_keys_sides_and_dates_count_alike(spark):
    prov, cli, tx, te, ciu = clean_rows()
    tx += [(None, None, None, None, None, None, None, None)] * 2 + [(7, None, "venta", None, 1, 1, D("3"), None)]
    t = tables(spark, prov, cli, tx, te, ciu)
    assert _counts(Q.run_checks(t)) == _counts(Q.run_checks(t, [c.id for c in Q.CHECKS]))


def test_state_store_reads_changed_partitions_only(spark, tmp_path):
    from solera.operators import quality_states as QS
    from solera.sources import lake as L
    prov, cli, tx, te, ciu = clean_rows()
    tx += [(50, d("2024-02-01"), "compra", 1, None, 1, D("9"), D("20.00")), (51, d("2024-03-05"), "venta", None, 5, 1, D("9"), D("1.00"))]
    root, store = str(tmp_path / "fact"), str(tmp_path / "states")

    def write(rows):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, TX)
        L.write_partitioned(df.withColumn("anio", F.year("fecha")).withColumn("mes", F.month("fecha")), str(tmp_path), "fact", ["anio", "mes"])

    def full(rows):
        return _counts(Q.run_checks(tables(spark, prov, cli, rows, te, ciu), [c.id for c in Q.CHECKS]))

    write(tx)
    with pytest.raises(ValueError):
        QS.stored_states(spark, root, store)
    assert len(QS.refresh(spark, root, store)) == 3
    dims = tables(spark, prov, cli, tx, te, ciu)
    assert _counts(QS.run_checks(dims, QS.stored_states(spark, root, store))) == full(tx)
    assert QS.refresh(spark, root, store) == []
    # a row more in one month (its id is one of another month), appended as a file of its own
    extra = [(1, d("2024-02-09"), "venta", None, None, 3, D("0"), D("20.00"))]
    (spark.createDataFrame(extra, TX).write.parquet(root + "/anio=2024/mes=2", mode="append"))
    assert QS.refresh(spark, root, store) == ["anio=2024/mes=2"]
    got = _counts(QS.run_checks(dims, QS.stored_states(spark, root, store)))
    assert got == full(tx + extra) and dict((i, a) for i, a, _, _ in got)[5] == 1
    # a month that leaves the fact no longer counts
    write(tx[:-1])
    QS.refresh(spark, root, store)
    assert _counts(QS.run_checks(dims, QS.stored_states(spark, root, store))) == full(tx[:-1])


def test_report_words_and_runtime(spark, tmp_path):
    t = tables(spark, *_dirty(13))
    rows = {r.id: r for r in Q.report(Q.run_checks(t)).collect()}
    assert rows[1].message == "ok" and rows[13].message == "1 of 4 rows outside" and rows[13].description
    s = Q.timed_report(t, str(tmp_path / "dq"))
    assert (s["total"], s["failed"]) == (15, 1) and s["runtime_sec"] > 0

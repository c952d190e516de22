"""Every registered query against its DuckDB twin (the driver's gate), on sf0.001 here;
``python tests/oracle_check.py`` runs the same at sf0.01."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paths import SF001  # noqa: E402
import oracle_check  # noqa: E402


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["anio", "mes", "tipo_energia", "mwh_total", "monto_usd_total"]


def test_every_twin_matches(spark):
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    bad = oracle_check.check(spark, SF001, verbose=False)
    assert bad == []

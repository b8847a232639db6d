"""Every query with a SQL twin against DuckDB on the smallest tables; every other one must run."""

import datetime
import math
import os

import pytest

from tidewatch import catalog

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return "null" if value is None else str(int(value))
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    expected = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert canonical(found.columns, found.collect()) == canonical(columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).collect()


def test_entry(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_contract_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_residuals_are_robust(spark):
    from tidewatch.operators import rolling
    from tidewatch.plans import series

    robust = series.rounded(rolling.stl_residual(series.s2(spark, SF), ["k"], 52, robust=True).select("k", "t", "resid"))
    assert sorted(map(tuple, catalog.queries()["stl_residual"](spark, SF).collect())) == sorted(map(tuple, robust.collect()))
    signals = rolling.early_warning(series._shipments(spark, SF), ["k"], 53, freq="W", how="sum", period=52, robust=True).signals()
    found = catalog.queries()["early_warning_job"](spark, SF)
    assert canonical(found.columns, found.collect()) == canonical(signals.columns, series.rounded(signals).collect())


def test_sup_f_uses_the_default_simulations(spark, monkeypatch):
    from tidewatch.functions import stats

    asked, null = [], stats.sup_f_null
    monkeypatch.setattr(stats, "sup_f_null", lambda spark, **given: asked.append(given) or null(spark, **given))
    for name in ("sup_f_p_value", "all_break_tests"):
        catalog.queries()[name](spark, SF)
    assert asked == [{}, {}]

"""All break tests in one guarded pass, against the single operators."""

import numpy as np
import pytest

from tidewatch.functions import stats
from tidewatch.operators import changepoint as cp


def table(spark, series):
    rows = [(k, t, None if v is None or np.isnan(v) else float(v)) for k, y in series.items() for t, v in enumerate(y)]
    return spark.createDataFrame(rows, "k string, t int, value double").repartition(3)


@pytest.fixture(scope="module")
def null(spark):
    return spark.createDataFrame([(q / 100, q / 5) for q in range(101)], "q double, stat double")


def some(seed=0):
    rng = np.random.default_rng(seed)
    out = {f"s{k}": rng.normal(10, 1, 120) + (np.arange(120) > 20 + 10 * k) * k for k in range(6)}
    out["wide"] = np.concatenate((rng.normal(0, 0.3, 60), rng.normal(0, 3, 60)))
    out["gaps"] = np.where(rng.random(120) < 0.2, np.nan, rng.normal(5, 1, 120).cumsum())
    out["ties"] = rng.integers(0, 3, 120).astype(float)
    return out


def test_one_pass_equals_the_single_operators(spark, null):
    df = table(spark, some())
    found = {r["k"]: r for r in cp.all_tests(df, ["k"], null).collect()}
    ready = cp.fill_spline(cp.testable(df, ["k"]), ["k"])
    p, s, v = cp.pettitt(ready, ["k"]), stats.sup_f_p(cp.sup_f(ready, ["k"]), null), cp.variance_break(ready, ["k"])
    parts = [p.drop("k_stat"), cp.around(ready, p, ["k"], "pettitt_cp", "pettitt"), s, cp.around(ready, s, ["k"], "sc_bp", "stc"), v, cp.variance_ratio(ready, v, ["k"], "bp_var")]
    want = ready.select("k").distinct()
    for part in parts:
        want = want.join(part, "k", "left")
    rows = want.collect()
    assert len(rows) == len(found) == 9 and all(r["error"] is None for r in found.values())
    for r in rows:
        for c in want.columns:
            if c != "k":
                assert (found[r["k"]][c] is None) == (r[c] is None) and (r[c] is None or found[r["k"]][c] == pytest.approx(r[c], rel=1e-8, abs=1e-9)), (r["k"], c)
    assert set(found["s0"].asDict()) - {"error"} == set(want.columns)


def test_it_is_one_exchange(spark, null, capsys):
    cp.all_tests(table(spark, some()), ["k"], null).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(k") == 1 and plan.count("MapInArrow") == 1


def test_a_series_that_breaks_a_test_harms_no_other(spark, null):
    good = some()
    bad = good | {"huge": np.concatenate((np.full(60, 1e200), np.full(60, -1e200))), "flat": np.full(120, 3.0), "none": [None] * 120, "empty": np.where(np.arange(120) < 60, np.nan, 1.0 * np.arange(120)), "short": [1.0, 2.0], "single": [1.0]}
    found = {r["k"]: r for r in cp.all_tests(table(spark, bad), ["k"], null).collect()}
    alone = {r["k"]: r for r in cp.all_tests(table(spark, good), ["k"], null).collect()}
    assert {k: found[k] for k in good} == alone
    assert "sup F: FloatingPointError" in found["huge"]["error"] and found["huge"]["sc_bp"] is None and found["huge"]["pettitt_cp"] == 59
    assert {found[k]["error"] for k in ("flat", "none", "empty", "single")} == {"too many gaps or no variance"}
    assert found["short"]["sc_bp"] is None and found["short"]["pettitt_pval"] is not None
    assert cp.all_tests(table(spark, good).limit(0), ["k"], null).collect() == []

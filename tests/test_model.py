"""Attributions along tree paths against full enumeration, and flags of missing values."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import model


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        x = rng.normal(size=5)
        c = str(rng.choice(["clay", "sand", "silt"]))
        y = bool(x[0] + x[1] * x[2] + (0.8 if c == "sand" else 0) + rng.normal(0, 0.3) > 0)
        rows.append((i, *(None if k == 3 and rng.random() < 0.3 else float(v) for k, v in enumerate(x)), c, y))
    return spark.createDataFrame(rows, "key int, x0 double, x1 double, x2 double, x3 double, x4 double, soil string, target boolean")


X, ALL = ["x0", "x1", "x2", "x3", "x4"], ["x0", "x1", "x2", "x3", "x4", "soil"]


@pytest.fixture(scope="module")
def fitted(data):
    return model.fit(data, X, ["soil"], trees=6, depth=4)


def expectation(node, x, known):
    """Value of a tree for a row of which only some columns are known; others go either way as the training rows did."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    left, right, split = node.leftChild(), node.rightChild(), node.split()
    f = split.featureIndex()
    if f in known:
        goes = x[f] <= split.threshold() if split.getClass().getSimpleName() == "ContinuousSplit" else x[f] in list(split.leftCategories())
        return expectation(left if goes else right, x, known)
    n = node.impurityStats().count()
    return sum(side.impurityStats().count() / n * expectation(side, x, known) for side in (left, right))


def test_paths_give_the_values_of_full_enumeration(data, fitted):
    """Shapley values of the columns by all their subsets, summed to features."""
    trees = fitted.stages[-1]
    roots = list(zip(trees.treeWeights, [t.rootNode() for t in trees._java_obj.trees()], strict=True))
    of_column = model._feature_of_columns(fitted, data)
    sample = fitted.transform(data.where("key < 3")).collect()
    found = {(r["key"], r["feature"]): r["phi"] for r in model.attribution(data.where("key < 3"), fitted, ALL, ["key"]).collect()}
    base = model.base_value(fitted).first()
    assert len(found) == 3 * 6
    used = sorted({f for _, root in roots for f in columns_of(root)})
    for row in sample:
        x = row["features"].toArray()
        value = {s: 2 * sum(w * expectation(root, x, set(s)) for w, root in roots) for n in range(len(used) + 1) for s in combinations(used, n)}
        phi = dict.fromkeys(ALL, 0.0)
        for f in used:
            others = [u for u in used if u != f]
            for n in range(len(others) + 1):
                share = math.factorial(n) * math.factorial(len(used) - n - 1) / math.factorial(len(used))
                phi[of_column[f]] += share * sum(value[tuple(sorted((*s, f)))] - value[s] for s in combinations(others, n))
        for f in ALL:
            assert found[row["key"], f] == pytest.approx(phi[f], abs=1e-9)
        assert base["base_log_odds"] == pytest.approx(value[()])
        p = float(row["probability"][1])
        assert sum(phi.values()) + value[()] == pytest.approx(math.log(p / (1 - p)), abs=1e-6)


def columns_of(node):
    if node.subtreeDepth() == 0:
        return set()
    return {node.split().featureIndex()} | columns_of(node.leftChild()) | columns_of(node.rightChild())


def test_values_sum_to_log_odds_less_base(data, fitted):
    phi = model.attribution(data, fitted, ALL, ["key"])
    z = F.col("p")
    scored = model._scored(fitted, data).select("key", F.log(z / (1 - z)).alias("z"))
    base = model.base_value(fitted).first()
    worst = phi.groupBy("key").agg(F.sum("phi").alias("s")).join(scored, "key").agg(F.max(F.abs(F.col("s") + base["base_log_odds"] - F.col("z"))), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == 400
    assert base["base_p"] == pytest.approx(1 / (1 + math.exp(-base["base_log_odds"])))
    summary = {r["feature"]: r["mean_abs"] for r in model.attribution_summary(phi, []).collect()}
    assert summary["x0"] == max(summary.values()) and set(summary) == set(ALL)
    assert model.attribution(data, fitted, ["x0", "x1"], ["key"]).select("feature").distinct().count() == 2
    assert model.attribution(data.limit(0), fitted, ALL, ["key"]).collect() == []


def test_hundreds_of_deep_trees_and_many_columns_take_little():
    """As many paths as 300 trees of depth 8 have, over 64 columns: a part of the rows in seconds; the values sum up."""
    import time

    rng = np.random.default_rng(2)
    n, width = 300 * 256, 8
    feature = np.argsort(rng.random((n, 64)), axis=1)[:, :width]
    low, high = np.where(rng.random((n, width)) < 0.5, -np.inf, -0.5), np.where(rng.random((n, width)) < 0.5, np.inf, 0.5)
    paths = {"feature": feature, "low": low, "high": high, "share": rng.uniform(0.2, 0.9, (n, width)), "value": rng.normal(size=n)}
    x = rng.normal(size=(32, 64))
    began = time.time()
    phi = model.path_contributions(x, paths)
    assert time.time() - began < 60
    known = ((low < x[:, feature]) & (x[:, feature] <= high)).all(axis=2)
    assert np.allclose(phi.sum(axis=1), known @ paths["value"] - (paths["share"].prod(axis=1) * paths["value"]).sum())


def test_flags_stand_beside_columns_with_gaps(data, fitted):
    kinds = fitted.transform(data.limit(0)).schema["features"].metadata["ml_attr"]["attrs"].values()
    columns = [name for _, name in sorted((c["idx"], c["name"]) for kind in kinds for c in kind)]
    assert [c for c in columns if c.endswith("__missing")] == ["x3__missing"]
    rows = fitted.transform(data.where("x3 is null").limit(2)).collect()
    place = columns.index("x3__missing")
    assert all(r["features"][place] == 1.0 for r in rows)
    plain = model.fit(data, X, ["soil"], trees=2, depth=2, flags=False)
    assert len(plain.transform(data.limit(1)).first()["features"]) == len(columns) - 1
    assert set(model._feature_of_columns(fitted, data)) == set(ALL)

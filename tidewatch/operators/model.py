"""Group K: classifier, cross-validation, scores and attribution. Folds and settings are few; every fit and transform is a Spark job."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import TOP, draw
from ..functions.percentiles import exact_percentiles
from ..sources.storage import shared_folder


def balanced_sample(df: DataFrame, key: list[str], per_class: int, label: str = "target", seed: int = 42) -> DataFrame:
    """K1, K2: at most `per_class` rows of each label (or group), chosen by a hash of the key.

    A cut on the hash that keeps somewhat more than asked for comes before the exact ranking, so the window sees few rows.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    marked = df.join(sizes, label).withColumn("_h", draw(seed, *key))
    near = marked.where(F.col("_h") < F.lit(float(TOP)) * (per_class + 10 * F.sqrt(F.lit(float(per_class))) + 50) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", *key))
    return near.withColumn("_r", rank).where(F.col("_r") <= per_class).select(*df.columns)


def spatial_folds(df: DataFrame, folds: int = 5, block: float = 10.0, seed: int | None = 42) -> DataFrame:
    """K3: `fold` by blocks of latitude and longitude in hashed order (or, without a seed, in order of place)."""
    at = lambda c: F.floor(F.col(c) / block).cast("long")
    d = df.withColumn("_bi", at("lat")).withColumn("_bj", at("lon"))
    blocks = d.select("_bi", "_bj").distinct()
    order = [draw(seed, "_bi", "_bj"), "_bi", "_bj"] if seed is not None else ["_bi", "_bj"]
    numbered = blocks.withColumn("fold", ((F.row_number().over(Window.orderBy(*order)) - 1) % folds).cast("int"))  # at most 648 blocks of ten degrees
    return d.join(F.broadcast(numbered), ["_bi", "_bj"]).drop("_bi", "_bj")


def stratified_folds(df: DataFrame, key: list[str], label: str = "target", folds: int = 5, seed: int = 42) -> DataFrame:
    """K4: folds that share out each label evenly: rows are ranked by hash inside slices of the hash, not all in one window."""
    d = df.withColumn("_h", draw(seed, *key)).withColumn("_slice", F.pmod(F.shiftright("_h", 20), F.lit(64)))
    w = Window.partitionBy(label, "_slice").orderBy("_h", *key)
    return d.withColumn("fold", F.pmod(F.row_number().over(w) - 1 + F.col("_slice"), F.lit(folds)).cast("int")).drop("_slice", "_h")


def class_weight(df: DataFrame, label: str = "target") -> DataFrame:
    """K5: `weight` of negatives over positives for positive rows, 1 for the others."""
    n = df.agg(F.try_divide(F.sum((~F.col(label)).cast("int")).cast("double"), F.sum(F.col(label).cast("int"))).alias("_w"))
    return df.join(F.broadcast(n)).withColumn("weight", F.when(F.col(label), F.coalesce("_w", F.lit(1.0))).otherwise(F.lit(1.0))).drop("_w")


def pipeline(numeric: list[str], categorical: list[str], label: str = "label", trees: int = 300, depth: int = 8, seed: int = 42, flagged: list[str] | None = None):
    """K6, K7: medians for gaps, a flag beside each `flagged` column that says where it had none, one-hot categories, boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler

    filled, flags = [f"{c}__filled" for c in numeric], [f"{c}__missing" for c in flagged or []]
    stages = [SQLTransformer(statement="select *, " + ", ".join(f"cast(`{c}` is null or isnan(`{c}`) as double) `{c}__missing`" for c in flagged) + " from __THIS__")] if flagged else []
    stages += [Imputer(strategy="median", inputCols=numeric, outputCols=filled)] if numeric else []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}__index", outputCol=f"{c}__hot", handleInvalid="keep", dropLast=False))
    stages.append(VectorAssembler(inputCols=[*filled, *flags, *(f"{c}__hot" for c in categorical)], outputCol="features", handleInvalid="keep"))
    stages.append(GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, minInstancesPerNode=10, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed))
    return Pipeline(stages=stages)


def _scored(model, df: DataFrame, out: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def fit(df: DataFrame, numeric: list[str], categorical: list[str], target: str = "target", flags: bool = True, **settings):
    """K5-K7: one fitted model of all rows. With `flags`, numeric columns that have gaps in these rows get a flag of them beside their medians."""
    gaps = df.agg(*(F.max(F.col(c).isNull() | F.isnan(c)).alias(c) for c in numeric)).first() if flags and numeric else {}
    ready = class_weight(df, target).withColumn("label", F.col(target).cast("double"))
    return pipeline(numeric, categorical, flagged=[c for c in numeric if gaps and gaps[c]], **settings).fit(ready)


def out_of_fold(df: DataFrame, numeric: list[str], categorical: list[str], target: str = "target", folds: int = 5, **settings) -> DataFrame:
    """K8: `p` of every row from the model fitted on the other folds."""
    parts = [_scored(fit(df.where(F.col("fold") != k), numeric, categorical, target, **settings), df.where(F.col("fold") == k)) for k in range(folds)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def curve(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Cumulative hits and false alarms at each distinct score, highest first, with precision, recall and fpr.

    Rows are counted by score before the window, which so sees distinct scores only.
    """
    ones = F.sum((F.col(y) == 1).cast("long"))
    counts = df.groupBy(*group, p).agg(ones.alias("_pos"), (F.count(F.lit(1)) - ones).alias("_neg"))
    run, whole = Window.partitionBy(*group).orderBy(F.desc(p)), Window.partitionBy(*group)
    c = counts.select(*group, F.col(p).alias("threshold"), F.sum("_pos").over(run).alias("tp"), F.sum("_neg").over(run).alias("fp"), F.sum("_pos").over(whole).alias("positives"), F.sum("_neg").over(whole).alias("negatives"))
    d = F.try_divide
    return c.select("*", d(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"), d(F.col("tp").cast("double"), F.col("positives")).alias("recall"), d(F.col("fp").cast("double"), F.col("negatives")).alias("fpr"))


def average_precision(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """K9: sum of precision over the steps of recall, ties in one step."""
    c = curve(df, group, y, p)
    before = F.lag("recall", 1, 0.0).over(Window.partitionBy(*group).orderBy(F.desc("threshold")))
    return c.withColumn("_step", (F.col("recall") - before) * F.col("precision")).groupBy(*group).agg(F.sum("_step").alias("average_precision"))


def roc_auc(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties by half, from counts by score."""
    ones = F.sum((F.col(y) == 1).cast("long"))
    counts = df.groupBy(*group, p).agg(ones.alias("_pos"), (F.count(F.lit(1)) - ones).alias("_neg"))
    below = F.coalesce(F.sum("_neg").over(Window.partitionBy(*group).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = counts.withColumn("_w", F.col("_pos") * (below + F.col("_neg") / 2.0))
    return c.groupBy(*group).agg(F.try_divide(F.sum("_w"), F.sum("_pos").cast("double") * F.sum("_neg")).alias("roc_auc"))


def fold_summary(folds: DataFrame, metric: str) -> DataFrame:
    """Macro, size-weighted and positive-weighted means of a fold metric, the base rate, lift and normalised gain. Columns n, positives."""
    weighted = lambda w: F.try_divide(F.sum(F.col(metric) * F.col(w)), F.sum(F.when(F.col(metric).isNotNull(), F.col(w)).cast("double")))
    base = F.try_divide(F.sum("positives").cast("double"), F.sum("n"))
    g = folds.agg(F.avg(metric).alias("macro"), weighted("n").alias("by_size"), weighted("positives").alias("by_positives"), base.alias("base"))
    return g.select("*", F.try_divide(F.col("macro"), F.col("base")).alias("lift"), F.try_divide(F.col("macro") - F.col("base"), 1 - F.col("base")).alias("gain"))


def calibration(df: DataFrame, group: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Mean score and observed share in equal bins, closed on the right; empty bins are absent."""
    b = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(*group, b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg((F.col(y) == 1).cast("int")).alias("observed"), F.count(F.lit(1)).alias("n"))


def importance(model, df: DataFrame, names: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Features by importance, of those named only if `names` is given. Columns of the assembled vector are named by its
    metadata; those of a category count for their feature together."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    found: dict[str, float] = {}
    for feature, value in zip(_feature_of_columns(model, df), values, strict=True):
        found[feature] = found.get(feature, 0.0) + value
    rows = [(f, v) for f, v in found.items() if names is None or f in names]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return table.limit(top) if top else table


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns, of rows where both are known, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs))
    return df.agg(row.alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def quantile_grid(df: DataFrame, feature: str, points: int = 30, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Distinct quantiles of a feature, `points` at most."""
    qs = [low + (high - low) * i / (points - 1) for i in range(points)]
    found = exact_percentiles(df, [], {feature: F.col(feature)}, qs)
    return found.agg(F.array_sort(F.collect_set("value")).alias("_g")).select(F.posexplode("_g").alias("k", "at"))


def expectations(df: DataFrame, model, feature: str, key: list[str], points: int = 30) -> DataFrame:
    """Score of each row with the feature set to each grid value, centred at the row's value nearest the grid's middle."""
    grid = quantile_grid(df, feature, points)
    spread = df.crossJoin(F.broadcast(grid)).withColumn(feature, F.col("at"))  # a grid of `points` values at most
    scored = _scored(model, spread).select(*key, "k", "at", "p")
    middle = F.max("k").over(Window.partitionBy(*key))
    with_ref = scored.withColumn("_m", F.floor(middle / 2)).withColumn("_ref", F.max(F.when(F.col("k") == F.col("_m"), F.col("p"))).over(Window.partitionBy(*key)))
    return with_ref.select(*key, "k", "at", "p", (F.col("p") - F.col("_ref")).alias("centred"))


def partial_dependence(df: DataFrame, model, feature: str, key: list[str], points: int = 30) -> DataFrame:
    """Mean score at each grid value, and its change from the lowest."""
    g = expectations(df, model, feature, key, points).groupBy("k", "at").agg(F.avg("p").alias("mean_p"))
    return g.withColumn("change", F.col("mean_p") - F.first("mean_p").over(Window.orderBy("k"))).withColumn("feature", F.lit(feature))  # one row for each grid value


def _feature_of_columns(model, df: DataFrame) -> list[str]:
    """The feature that each column of the assembled vector comes from: its own, a category's, or the one it flags as missing."""
    kinds = model.transform(df.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    columns = {c["idx"]: c["name"].split("__", 1)[0] for kind in kinds.values() for c in kind}
    return [columns[i] for i in range(len(columns))]


def tree_paths(model) -> DataFrame:
    """The boosted trees of a fitted pipeline as a table, one row for each leaf: tree, value (its part of the log odds), and arrays with
    an entry for each feature on the leaf's path: feature (column of the assembled vector), low and high (rows come this way
    if low < x <= high) and share (of the training rows at a split on the feature, those that went this way; the product over its splits).

    Trees are read from where the model is saved, in the shared folder. A tree has at most 2^(depth + 1) nodes.
    """
    import uuid

    trees = model.stages[-1]
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    trees.save(path)
    weights = [float(w) for w in trees.treeWeights]

    def leaves(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["treeID"].iloc[0])
        nodes = {int(n["id"]): n for n in part["nodeData"]}
        out, todo = [], [(0, {})]
        while todo:
            at, way = todo.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                feature = sorted(way)
                out.append((tree, 2.0 * weights[tree] * node["prediction"], feature, *([way[f][k] for f in feature] for k in range(3))))
                continue
            split = node["split"]
            f, left = int(split["featureIndex"]), [float(v) for v in split["leftCategoriesOrThreshold"]]
            low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
            if split["numCategories"] == -1:
                sides = ((low, min(high, left[0])), (max(low, left[0]), high))
            else:  # a flag: one of its two values goes left
                sides = ((low, 0.5), (0.5, high)) if left == [0.0] else ((0.5, high), (low, 0.5))
            for child, (a, b) in zip((int(node["leftChild"]), int(node["rightChild"])), sides, strict=True):
                todo.append((child, way | {f: (a, b, share * nodes[child]["impurityStats"][0] / node["impurityStats"][0])}))
        return pd.DataFrame(out, columns=["tree", "value", "feature", "low", "high", "share"])

    return spark.read.parquet(f"{path}/data").groupBy("treeID").applyInPandas(leaves, "tree int, value double, feature array<int>, low array<double>, high array<double>, share array<double>")


def path_contributions(x: np.ndarray, paths: dict[str, np.ndarray], rows: int = 16, at_once: int = 4096) -> np.ndarray:
    """Shapley values of each row of `x` (rows x columns) for the sum of all leaves, when a feature that is not known goes either way in the
    proportion that training rows did.

    A leaf's value is reached by the product over its features of 1 or 0 (known) or the share (not known). The sum over all orders of
    features is the integral over t in [0, 1] of a product of linear terms, a polynomial of a degree below the number of
    features on the path, so half as many points of a Gauss rule give it exactly.
    """
    out = np.zeros(x.shape)
    feature, low, high, share, value = (paths[k] for k in ("feature", "low", "high", "share", "value"))
    if not len(value):
        return out
    nodes, weights = np.polynomial.legendre.leggauss((feature.shape[1] + 1) // 2 or 1)
    nodes, weights = (nodes + 1) / 2, weights / 2
    for p in range(0, len(value), at_once):
        part = slice(p, p + at_once)
        columns = feature[part].ravel()
        order = np.argsort(columns, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(columns[order]) != 0])
        z = share[part]
        for r in range(0, len(x), rows):
            seen = x[r : r + rows][:, feature[part]]
            known = ((low[part] < seen) & (seen <= high[part])).astype(float)
            total = np.zeros(known.shape)
            for t, w in zip(nodes, weights, strict=True):
                terms = z * (1 - t) + known * t
                total += w * terms.prod(axis=2, keepdims=True) / terms
            total *= (known - z) * value[part, None]
            out[r : r + rows, columns[order][begins]] += np.add.reduceat(total.reshape(len(seen), -1)[:, order], begins, axis=1)
    return out


def attribution(df: DataFrame, model, features: list[str], key: list[str]) -> DataFrame:
    """Key, feature, phi in log odds: Shapley values along the paths of the trees (Lundberg et al. 2020), exact, with no rows but those asked for.

    The columns of a category or a flag count for their feature together. The values of a row sum to its log odds less the base
    (`base_value`). The table of paths goes to every task; it has trees x 2^depth rows at most, whatever the data.
    """
    of_column = _feature_of_columns(model, df)
    names = [f for f in features if f in of_column]
    index = np.array([names.index(f) if f in names else -1 for f in of_column])
    table = tree_paths(model).toPandas()  # trees x 2^depth rows at most
    width = max((len(f) for f in table["feature"]), default=1) or 1
    pad = lambda c, fill: np.array([[*v, *[fill] * (width - len(v))] for v in table[c]], float).reshape(-1, width)
    paths = {"feature": pad("feature", 0).astype(int), "low": pad("low", -np.inf), "high": pad("high", np.inf), "share": pad("share", 1.0), "value": table["value"].to_numpy(float)}
    sent = df.sparkSession.sparkContext.broadcast(paths)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*key).dtypes) + ", feature string, phi double"

    def task(batches):
        for batch in batches:
            x = np.array(batch["_x"].tolist(), float).reshape(len(batch), len(of_column))
            by_column, phi = path_contributions(x, sent.value), np.zeros((len(x), len(names)))
            for column, k in enumerate(index):
                if k >= 0:
                    phi[:, k] += by_column[:, column]
            rows = batch[key].loc[batch.index.repeat(len(names))].reset_index(drop=True)
            yield rows.assign(feature=np.tile(np.array(names, object), len(x)), phi=phi.ravel())

    from pyspark.ml.functions import vector_to_array

    ready = model.transform(df).select(*key, vector_to_array("features").alias("_x"))
    return ready.mapInPandas(task, schema)


def base_value(model) -> DataFrame:
    """One row with the mean log odds over the training rows as they went through the trees, from which attributions start, and its sigmoid."""
    base = F.sum(F.col("value") * F.aggregate("share", F.lit(1.0).cast("double"), lambda a, s: a * s))
    return tree_paths(model).agg(base.alias("base_log_odds")).withColumn("base_p", 1 / (1 + F.exp(-F.col("base_log_odds"))))


def attribution_summary(phi: DataFrame, group: list[str], top: int | None = None, available: DataFrame | None = None) -> DataFrame:
    """Mean size and mean of the attributions by feature (and class), with how many rows were used, and with
    `n_available`: how many rows of `available` (all rows with the columns of `group`) there were to use."""
    g = phi.groupBy(*group, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"), F.count(F.lit(1)).alias("n_used"))
    if available is not None:
        counts = available.groupBy(*group).agg(F.count(F.lit(1)).alias("n_available"))
        g = g.join(counts, group) if group else g.join(F.broadcast(counts))  # one row
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("mean_abs"), "feature"))
    return g.withColumn("rank", rank).where(F.col("rank") <= top) if top else g.withColumn("rank", rank)


def dependence(df: DataFrame, x: str, phi: str, bins: int = 10, least: int = 20) -> DataFrame:
    """Median and 5-95 % range of the attribution in quantile bins of a feature that hold `least` rows."""
    edges = exact_percentiles(df, [], {x: F.col(x)}, [i / bins for i in range(1, bins)]).agg(F.sort_array(F.collect_list("value")).alias("_e"))
    binned = df.where(F.col(x).isNotNull()).join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col(x))))
    q = lambda v: F.percentile(phi, F.lit(v))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.median(x).alias("x_median"), q(0.5).alias("median"), q(0.05).alias("p05"), q(0.95).alias("p95")).where(F.col("n") >= least)


def ablations(df: DataFrame, sets: dict[str, tuple[list[str], list[str]]], target: str = "target", folds: int = 5, **settings) -> DataFrame:
    """Average precision and ROC AUC, out of fold, of each named set of (numeric, categorical) features."""
    parts = [out_of_fold(df, num, cat, target, folds, **settings).select(F.lit(name).alias("features"), F.col(target).cast("int").alias("y"), "p") for name, (num, cat) in sets.items()]
    scored = reduce(lambda a, b: a.unionByName(b), parts)
    return average_precision(scored, ["features"]).join(roc_auc(scored, ["features"]), "features")

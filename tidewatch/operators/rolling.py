"""Group D: rolling early-warning indicators per series.

All windows of a series share one partitioning and one order, so they cost one shuffle. The frame is
centred: [t - half, t + half] with half = window // 2, so an even window counts one point more, and only whole frames count.
`strict` keeps windows without a gap and moments divided by their number. `tolerant` needs three values: the variance is the
sample's, lagged products are divided by it and the frame's length less one, moments are of deviations in units of the sample's, and
differences are divided by the pairs that a full frame has, whatever is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as numeric
from ..functions.blocks import INDICATORS
from ..functions.stats import normal_two_sided
from . import blocks, calendar


def odd_window(years: float, steps: float, n: int | None = None) -> int:
    """An odd number of points; of a series of n points no longer than that, four fifths of it are taken, but n - 1 at most (made odd)."""
    odd = lambda w: w if w % 2 else w + 1
    w = odd(round(years * steps))
    return w if n is None or w < n else odd(min(n - 1, round(0.8 * n)))


def indicators(df: DataFrame, key: list[str], window: int, mode: str = "strict", time: str = "t", value: str = "value") -> DataFrame:
    """`df` with std, ac1, skew, kurt, fd of the centred window around each point; NULL where it is not valid.

    The frame is gone through for each point: for short windows. `indicators_by_prefix` costs the same whatever the window.
    """
    half = window // 2
    n = 2 * half + 1
    order = Window.partitionBy(*key).orderBy(time)
    frame = order.rowsBetween(-half, half)
    inner = lambda lag: order.rowsBetween(-half + lag, half)  # noqa: E731  pairs that lie in the frame whole
    df = df.withColumn("_p", F.lag(value, 1).over(order)).withColumn("_q", F.lag(value, 2).over(order))
    x = F.col(value)
    count, mean, whole = F.count(value).over(frame), F.avg(value).over(frame), F.count(F.lit(1)).over(frame) == n
    # sum((x1 - m)(x0 - m)) over pairs = sum(x1 x0) - m sum(x1) - m sum(x0) + pairs m^2, of pairs without a gap
    pair = F.when(x.isNotNull() & F.col("_p").isNotNull(), x * F.col("_p"))
    pairs = F.count(pair).over(inner(1))
    lag_sum = F.sum(pair).over(inner(1)) - mean * F.sum(F.when(pair.isNotNull(), x + F.col("_p"))).over(inner(1)) + pairs * mean * mean
    lag_sum = F.coalesce(lag_sum, F.lit(0.0))  # without any pair
    strict = mode == "strict"
    variance = F.var_pop(value).over(frame) if strict else F.var_samp(value).over(frame)
    valid = whole & (count == n if strict else count > 2)
    spread = variance > 0
    size = F.lit(1.0) if strict else (count - 1) / count  # of the population's variance in the sample's
    ac1 = F.when(spread, F.try_divide(lag_sum, F.lit(float(n if strict else n - 1)) * variance))
    skew = F.when(spread, F.skewness(value).over(frame) * F.pow(size, F.lit(1.5)))
    kurt = F.when(spread, (F.kurtosis(value).over(frame) + 3) * size * size)
    madogram = lambda lagged, lag: F.sum(F.abs(x - F.col(lagged))).over(inner(lag)) / float(2 * (n - lag))
    g1, g2 = F.log(madogram("_p", 1)), F.log(madogram("_q", 2))
    fd = F.greatest(F.lit(1.0), F.least(F.lit(2.0), 2 - (g2 - g1) / F.lit(float(np.log(2)))))
    fd = F.when(g1.isNotNull() & g2.isNotNull(), fd)
    found = {"std": F.sqrt(variance), "ac1": ac1, "skew": skew, "kurt": kurt, "fd": fd}
    return df.withColumns({n: F.when(valid, c) for n, c in found.items()}).drop("_p", "_q")


def indicators_by_prefix(df: DataFrame, key: list[str], window: int, mode: str = "strict", time: str = "t", value: str = "value") -> DataFrame:
    """D4-D8, D11 by differences of running sums, O(n) whatever the window: of values, their powers, lagged products and absolute
    differences, each with its count, over values less the series mean in units of its deviation, or cancellation would
    spoil the fourth moment. A window without a change of value is known by counting changes, so its variance is 0 and no rounding error.
    """
    half = window // 2
    n = 2 * half + 1
    strict = mode == "strict"
    order, whole = Window.partitionBy(*key).orderBy(time), Window.partitionBy(*key)
    run, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    unit = F.coalesce(F.nullif(F.stddev_pop(value).over(whole), F.lit(0.0)), F.lit(1.0))
    d = df.withColumns({"_m": F.avg(value).over(whole), "_d": unit, "_i": F.row_number().over(order), "_was": F.last(value, True).over(before)})
    d = d.withColumn("_c", (F.col(value) - F.col("_m")) / F.col("_d"))
    d = d.withColumns({"_p": F.lag("_c", 1).over(order), "_q": F.lag("_c", 2).over(order)})
    c, p, q = F.col("_c"), F.col("_p"), F.col("_q")
    change = F.col(value).isNotNull() & (F.col("_was").isNull() | (F.col(value) != F.col("_was")))
    terms = {
        "0": F.when(c.isNotNull(), F.lit(1.0)), "1": c, "2": c * c, "3": c * c * c, "4": c * c * c * c,
        "pairs": F.when((c * p).isNotNull(), F.lit(1.0)), "both": c * p, "sums": c + p, "near": F.abs(c - p), "far": F.abs(c - q), "changes": F.when(change, F.lit(1.0)),
    }
    d = d.withColumns({f"_s{k}": F.coalesce(F.sum(v).over(run), F.lit(0.0)) for k, v in terms.items()})
    d = d.withColumn("_latest", F.max(F.when(change, F.col("_s0"))).over(run))
    ahead = lambda k: F.lead(k, half).over(order)
    behind = lambda k, by: F.coalesce(F.lag(k, by).over(order), F.lit(0.0))
    first = {"pairs": half, "both": half, "sums": half, "near": half, "far": half - 1}  # pairs inside the window begin after its first point, or second
    ends = {f"_w{k}": ahead(f"_s{k}") - (behind(f"_s{k}", first.get(k, half + 1)) if first.get(k, 1) >= 0 else F.lit(0.0)) for k in terms}
    d = d.withColumns(ends | {"_end": ahead("_latest"), "_start": behind("_s0", half + 1)})
    k, s1, s2, s3, s4, pairs, both, sums, near, far, changes = (F.col(f"_w{name}") for name in terms)
    m = s1 / k
    constant = (changes == 0) | ((changes == 1) & (F.col("_end") == F.col("_start") + 1))
    v2 = F.when(constant, F.lit(0.0)).otherwise(F.greatest(s2 / k - m * m, F.lit(0.0)))
    v3, v4 = s3 / k - 3 * m * s2 / k + 2 * m * m * m, s4 / k - 4 * m * s3 / k + 6 * m * m * s2 / k - 3 * m * m * m * m
    variance = v2 if strict else v2 * k / (k - 1)
    valid = (F.col("_i") > half) & (k == n if strict else k > 2)  # after the last whole window there is nothing ahead
    spread = valid & (variance > 0)
    found = {
        "std": F.when(valid, F.sqrt(variance) * F.col("_d")),
        "ac1": F.when(spread, (both - m * sums + pairs * m * m) / (variance * F.lit(float(n if strict else n - 1)))),
        "skew": F.when(spread, v3 / F.pow(variance, F.lit(1.5))),
        "kurt": F.when(spread, v4 / (variance * variance)),
        "fd": F.when(valid & (near > 0) & (far > 0), F.greatest(F.lit(1.0), F.least(F.lit(2.0), 2 - F.log2((far / max(n - 2, 1)) / (near / max(n - 1, 1)))))),
    }
    return d.select(*df.columns, *(v.alias(name) for name, v in found.items()))


def deltas(df: DataFrame, key: list[str], columns: list[str], time: str = "t") -> DataFrame:
    """Max - min of each column, negative if the first minimum comes later than the first maximum."""
    out = []
    for c in columns:
        there = F.col(c).isNotNull()
        last_max = F.max_by(time, F.when(there, F.struct(F.col(c), -F.col(time))))
        first_min = F.min_by(time, F.when(there, F.struct(F.col(c), F.col(time))))
        size = F.max(c) - F.min(c)
        out.append(F.when(first_min > last_max, -size).otherwise(size).alias(f"delta_{c}"))
    return df.groupBy(*key).agg(*out)


def with_data(df: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Rows of the series that have any value."""
    return df.join(df.where(F.col(value).isNotNull()).select(*key).distinct(), key, "left_semi")


def fill_mean(key: list[str], value: str = "value") -> Column:
    """Gaps take the series mean."""
    return F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(*key)))


def fill_linear(df: DataFrame, key: list[str], time: str = "t", value: str = "value", out: str = "filled") -> DataFrame:
    """Gaps between two values are interpolated along time; before the first and after the last the series mean."""
    # both frames grow, one in either order: a frame that shrinks is gone through anew for every row
    before, after = (Window.partitionBy(*key).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (time, F.desc(time)))
    at = F.when(F.col(value).isNotNull(), F.col(time))
    df = df.withColumns({"_v0": F.last(value, True).over(before), "_t0": F.last(at, True).over(before), "_v1": F.last(value, True).over(after), "_t1": F.last(at, True).over(after)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide((F.col(time) - F.col("_t0")).cast("double"), (F.col("_t1") - F.col("_t0")).cast("double"))
    filled = F.coalesce(F.col(value), line, F.avg(value).over(Window.partitionBy(*key)))
    return df.withColumn(out, filled).drop("_v0", "_t0", "_v1", "_t1")


def interpolate_onto(df: DataFrame, axis: DataFrame, key: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """Each series of `df` (one if `key` is empty) at the times of `axis` (key, time), on the line between the known values before and after; NULL outside them.

    Both are put in one order, so that a series costs one sort; `axis` has a time once for each key.
    """
    known = df.where(F.col(value).isNotNull()).select(*key, time, F.col(value).cast("double").alias("_v"), F.lit(False).alias("_asked"))
    both = known.unionByName(axis.select(*key, time, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_asked")))
    before, after = (Window.partitionBy(*key).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col(time), F.desc(time)))
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    both = both.withColumns({"_a": F.last(point, True).over(before), "_b": F.last(point, True).over(after)}).where("_asked")
    kind = dict(df.dtypes)[time]
    number = lambda c: (F.unix_date(c) if kind == "date" else F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c).cast("double")
    share = F.coalesce(F.try_divide(number(F.col(time)) - number(F.col("_a.t")), number(F.col("_b.t")) - number(F.col("_a.t"))), F.lit(0.0))
    return both.select(*key, time, (F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share).alias(value))


def stl_residual(df: DataFrame, key: list[str], period: int, robust: bool = True, fill: str = "mean", time: str = "t", value: str = "value") -> DataFrame:
    """`df` with `resid`: what STL leaves of each series. Gaps are filled first and are gaps again afterwards.

    A series has as many rows as its calendar has steps; series of one length are smoothed together.
    """
    columns = [c for c in df.columns if c != "resid"]

    def rest(table, starts):
        import pyarrow as pa

        y, sizes = blocks.numbers(table, value), np.diff(np.append(starts, table.num_rows))
        out = np.full(len(y), np.nan)
        for size in np.unique(sizes).tolist():
            places = starts[sizes == size][:, None] + np.arange(size)
            out[places] = numeric.residual(y[places], period, robust, fill)
        return table.append_column("resid", pa.array(out, from_pandas=True))

    return blocks.map_series(df, key, time, columns, f"{blocks.ddl(df, columns)}, resid double", rest)


@dataclass(frozen=True)
class EarlyWarning:
    """`series`, one row for each key: key, value, detrended and the indicators (arrays by step), and for each indicator
    its delta, the number n of its values, tau and pval. `first` is the date of step 0 (or its number), `freq` the length of a step."""

    series: DataFrame
    key: list[str]
    first: object
    freq: str | None

    def signals(self) -> DataFrame:
        """key, t, time (where steps have dates), value, detrended and the indicators: a row for each step."""
        names = ["value", "detrended", *INDICATORS]
        found = self.series.select(*self.key, F.posexplode(F.arrays_zip(*names)).alias("t", "_s")).select(*self.key, "t", *(F.col(f"_s.{n}").alias(n) for n in names))
        if self.freq is None:
            return found.withColumn("t", F.col("t") + F.lit(self.first))
        start = F.lit(self.first).cast("date")
        date = F.add_months(start, F.col("t")) if self.freq == "MS" else F.date_add(start, F.col("t") * (7 if self.freq == "W" else 1))
        return found.withColumn("time", date)

    def deltas(self) -> DataFrame:
        """key and delta_<indicator>."""
        return self.series.select(*self.key, *(f"delta_{n}" for n in INDICATORS))

    def trends(self) -> DataFrame:
        """key, indicator, n, tau, pval."""
        rows = F.explode(F.array(*(F.struct(F.lit(n).alias("indicator"), *(F.col(f"{c}_{n}").alias(c) for c in ("n", "tau", "pval"))) for n in INDICATORS)))
        return self.series.select(*self.key, rows.alias("_r")).select(*self.key, "_r.*")


def steps_of(df: DataFrame, key: list[str], freq: str | None, how: str = "mean", span: tuple | None = None, time: str = "time", value: str = "value") -> tuple[DataFrame, object, int]:
    """(key, t, value) partitioned by the key, what step 0 is, and the number of steps from the first to the last of all (or of `span`).

    With a frequency ("D", "W", "MS") values of a step are put together by `how`, after the one exchange by key; else `time` numbers the steps already.
    """
    if freq is None:
        label = F.col(time)
    else:
        label = {"D": F.col(time).cast("date"), "W": calendar.week_label(F.col(time)), "MS": F.trunc(time, "month")}[freq]
    first, last = span or df.agg(F.min(label), F.max(label)).first()
    dealt = df.select(*key, label.alias("_label"), F.col(value).cast("double").alias("value")).repartition(*key)
    if first is None:
        return dealt.select(*key, F.lit(0).alias("t"), "value").limit(0), None, 0
    if freq is None:
        return dealt.select(*key, (F.col("_label") - F.lit(first)).cast("int").alias("t"), "value").where(F.col("t").between(0, int(last - first))), first, int(last - first) + 1
    start = F.lit(first).cast("date")
    months = lambda c: F.year(c) * 12 + F.month(c)
    place = months(F.col("_label")) - months(start) if freq == "MS" else F.floor(F.datediff("_label", start) / (7 if freq == "W" else 1))
    steps = (last.year - first.year) * 12 + last.month - first.month + 1 if freq == "MS" else (last - first).days // (7 if freq == "W" else 1) + 1
    agg = F.coalesce(F.sum("value"), F.lit(0.0)) if how == "sum" else F.avg("value")
    return dealt.where(F.col("_label").between(start, F.lit(last).cast("date"))).groupBy(*key, place.cast("int").alias("t")).agg(agg.alias("value")), first, steps


def early_warning(df: DataFrame, key: list[str], window: int | None = None, *, years: float | None = None, freq: str | None = None, how: str = "mean", span: tuple | None = None, period: int | None = None, difference: bool = True, mode: str = "strict", robust: bool = True, fill: str = "mean", least: int = 2, time: str | None = None, value: str = "value") -> EarlyWarning:
    """The whole job, from raw rows (key, time, value) to indicators, deltas and trends, in one exchange by key.

    Values are put on steps of `freq` (or numbered by `time` already), freed of season and trend (if a `period` is given), differenced, and
    the indicators of windows of `window` steps (or so many `years`) give deltas and tau, with p exact up to 33 values without
    ties. Series are stacked in blocks, so that Python is called once for dozens of them.
    """
    from .trend import exact_p

    ready, first, steps = steps_of(df, key, freq, how, span, time or ("t" if freq is None else "time"), value)
    if window is None:
        window = odd_window(years, {"W": 52, "MS": 12, "D": 365.25}[freq], steps)
    half, names = window // 2, ["value", "detrended", *INDICATORS]
    schema = ", ".join([blocks.ddl(df, key), *(f"{n} array<double>" for n in names), *(f"delta_{n} double, n_{n} int, tau_{n} double, z_{n} double, exact_{n} double" for n in INDICATORS)])

    def job(table, starts):
        import pyarrow as pa

        made, at_once = [], max(1, (1 << 22) // max(1, steps))
        bounds = np.append(starts, table.num_rows)
        for i in range(0, len(starts), at_once):
            some = bounds[i : i + at_once + 1]
            part = table.slice(int(some[0]), int(some[-1] - some[0]))
            begins = some[:-1] - some[0]
            y = blocks.grid(part, begins, "value", part.column("t").to_numpy(), steps)
            detrended = numeric.residual(y, period, robust, fill) if period else y
            if difference:
                detrended = np.concatenate((np.full((len(y), 1), np.nan), np.diff(detrended, axis=1)), axis=1)
            found = numeric.indicators(detrended, half, mode == "strict")
            columns = {k: part.column(k).take(pa.array(begins)) for k in key}
            columns |= {n: blocks.lists(a) for n, a in {"value": y, "detrended": detrended, **found}.items()}
            for n, a in found.items():
                trend = numeric.kendall(a)
                few = trend["n"] < max(2, least)
                columns[f"delta_{n}"] = pa.array(numeric.deltas(a), from_pandas=True)
                columns[f"n_{n}"] = pa.array(trend["n"])
                columns[f"tau_{n}"] = pa.array(np.where(few, np.nan, trend["tau"]), from_pandas=True)
                columns[f"z_{n}"] = pa.array(np.where(few, np.nan, trend["z"]), from_pandas=True)
                columns[f"exact_{n}"] = pa.array(exact_p(trend), from_pandas=True)
            made.append(pa.table(columns))
        return pa.concat_tables(made)

    found = blocks.map_series(ready, key, "t", ["value"], schema, job, dealt=True)
    rest = (c for n in INDICATORS for c in (F.col(f"delta_{n}"), F.col(f"n_{n}"), F.col(f"tau_{n}"), F.coalesce(F.when(F.col(f"tau_{n}").isNotNull(), F.col(f"exact_{n}")), normal_two_sided(F.col(f"z_{n}"))).alias(f"pval_{n}")))
    return EarlyWarning(found.select(*key, *names, *rest), key, first, freq)

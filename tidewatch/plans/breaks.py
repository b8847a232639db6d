"""Queries over change points and masks: groups F and G."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import calendar as cal
from ..operators import changepoint as cp
from ..operators import masking
from .inputs import S1, S2, query, rounded, s1, s2, draw_sql

_DENSE1 = f"""{S1}, ends as (select min(time) a, max(time) b from s1), axis as (select unnest(generate_series(a, b, interval 7 day))::date as time from ends),
dense as (select k, time, s1.value from (select distinct k from s1) cross join axis left join s1 using (k, time))"""


@query(f"with {_DENSE1}, g as (select k from dense group by 1 having sum((value is null)::int) <= 60 and var_samp(value) > 0) select k, count(*) n from dense where k in (select k from g) group by 1")
def testable_series(spark, d):
    dense = cal.densify(s1(spark, d), ["k"], "7 days")
    return cp.testable(dense, ["k"], 60).groupBy("k").agg(F.count("*").alias("n"))


_PETTITT = f"""{S2}, r as (select k, t, value, rank() over (partition by k order by value) + (count(*) over (partition by k, value) - 1) / 2.0::double r, count(*) over (partition by k) n from s2),
u as (select *, abs(2 * sum(r) over (partition by k order by t) - (t + 1) * (n + 1)) u from r),
b as (select k, min(t) cp, max(u) kk, max(n) n from (select *, max(u) over (partition by k) top from u) where u = top group by 1)"""


@query(f"""with {_PETTITT}, m as (select b.k, cp, kk, n, avg(value) filter (t < cp) m1, avg(value) filter (t > cp) m2 from b join s2 on s2.k = b.k group by all)
select k, cp pettitt_cp, kk k_stat, round(least(1, 2 * exp(-6 * kk * kk / (cast(n as double) ** 3 + cast(n as double) ** 2))), 6) pettitt_pval, round(m1, 6) m1_pettitt, round(m2, 6) m2_pettitt, round(m2 / m1, 6) prop_pettitt, round(m2 - m1, 6) diff_pettitt from m""")
def pettitt(spark, d):
    s = s2(spark, d)
    found = cp.pettitt(s, ["k"])
    return rounded(found.join(cp.around(s, found, ["k"], "pettitt_cp", "pettitt"), "k"))


_SUPF = f"""{S2}, c as (select k, t, value - avg(value) over (partition by k) y from s2), x as (select k, t, y, lag(y) over (partition by k order by t) x from c),
i as (select *, row_number() over (partition by k order by t) i, count(*) over (partition by k) n from x where x is not null),
a as (select k, t, i, n, sum(x) over w ax, sum(y) over w ay, sum(x * x) over w axx, sum(x * y) over w axy, sum(y * y) over w ayy, sum(x) over v tx, sum(y) over v ty, sum(x * x) over v txx, sum(x * y) over v txy, sum(y * y) over v tyy
  from i window w as (partition by k order by t), v as (partition by k)),
f as (select k, t, i, n,
  tyy - ty * ty / n - (txy - tx * ty / n) ** 2 / (txx - tx * tx / n) r0,
  ayy - ay * ay / i - (axy - ax * ay / i) ** 2 / (axx - ax * ax / i) r1,
  (tyy - ayy) - (ty - ay) ** 2 / (n - i) - ((txy - axy) - (tx - ax) * (ty - ay) / (n - i)) ** 2 / ((txx - axx) - (tx - ax) ** 2 / (n - i)) r2
  from a where i >= greatest(floor(n * 0.15::double), 3) and i <= least(floor(n * 0.85::double), n - 3)),
g as (select *, (r0 - r1 - r2) / ((r1 + r2) / (n - 4)) fs from f),
s as (select k, min(t) sc_bp, max(fs) f_stat from (select *, max(fs) over (partition by k) top from g) where fs = top group by 1)"""


@query(f"""with {_SUPF} select s.k, sc_bp, round(f_stat, 6) f_stat, round(avg(value) filter (t < sc_bp), 6) m1_stc, round(avg(value) filter (t > sc_bp), 6) m2_stc, round(avg(value) filter (t > sc_bp) / avg(value) filter (t < sc_bp), 6) prop_stc,
round(avg(value) filter (t > sc_bp) - avg(value) filter (t < sc_bp), 6) diff_stc from s join s2 on s2.k = s.k group by s.k, sc_bp, f_stat""")
def sup_f_break(spark, d):
    s = s2(spark, d)
    found = cp.sup_f(s, ["k"])
    return rounded(found.join(cp.around(s, found, ["k"], "sc_bp", "stc"), "k"))


_SPLIT = f"""{S2}, v as (select k, t, value, (value - avg(value) over (partition by k)) ** 2 c from s2), a as (select k, t, row_number() over (partition by k order by t) i, count(*) over (partition by k) n, sum(c) over (partition by k order by t) a, sum(c) over (partition by k) s from v),
c as (select k, t, i * ln(greatest(a / i, 1e-8)) + (n - i) * ln(greatest((s - a) / (n - i), 1e-8)) cost from a where i >= 2 and n - i >= 2), sp as (select k, min(t) split, min(cost) cost from (select *, min(cost) over (partition by k) m from c) where cost = m group by 1)"""


@query(f"with {_SPLIT} select k, split, round(cost, 6) cost from sp")
def variance_split(spark, d):
    return rounded(cp.single_variance_split(s2(spark, d), ["k"]))


@query(f"""with {_SPLIT}, g as (select sp.k, split, count(*) n, var_samp(value) filter (t < split) v1, var_samp(value) filter (t > split) v2 from sp join s2 on s2.k = sp.k group by 1, 2)
select k, round(v1 / 1000, 6) v1, round(v2 / 1000, 6) v2, round(v2 / v1, 6) prop_var, round((v2 - v1) / 1000, 6) diff_var, round(case when split > 1 and split < n - 2 then v1 / v2 end, 6) f_var from g""")
def variance_ratio(spark, d):
    s = s2(spark, d)
    r = cp.variance_ratio(s, cp.single_variance_split(s, ["k"]), ["k"], "split", with_p=False)
    return rounded(r.withColumns({c: F.col(c) / 1000 for c in ("v1", "v2", "diff_var")}))


@query()
def variance_break(spark, d):
    return cp.variance_break(s2(spark, d), ["k"])


@query()
def variance_test(spark, d):
    s = s2(spark, d)
    return rounded(cp.variance_ratio(s, cp.single_variance_split(s, ["k"]), ["k"], "split"))


@query()
def spline_gaps(spark, d):
    dense = cal.densify(s1(spark, d), ["k"], "7 days").withColumn("t", cal.position(["k"]))
    return rounded(cp.fill_spline(dense, ["k"]))


@query()
def all_break_tests(spark, d):
    dense = cal.densify(s2(spark, d).select("k", "time", "value"), ["k"], "7 days").withColumn("t", cal.position(["k"]))
    return rounded(cp.all_tests(dense, ["k"], stats.sup_f_null(spark)))


@query()
def sup_f_p_value(spark, d):
    """Null quantiles are simulated; the statistics they are held against come from the tables."""
    return rounded(stats.sup_f_p(cp.sup_f(s2(spark, d), ["k"]), stats.sup_f_null(spark)))


def _break_table(spark, d):
    """k, t0, t1, dates of two tests and whether each is significant; the second test is the widest swing of the series."""
    s = s2(spark, d)
    p = cp.pettitt(s, ["k"])
    axis = s.select("k", "t", "time")
    ends = s.groupBy("k").agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.max_by("t", F.struct("value", -F.col("t"))).alias("peak"))
    b = cal.time_of_index(p.join(ends, "k"), axis, "pettitt_cp", "a_date", ["k"])
    b = cal.time_of_index(b, axis, "peak", "b_date", ["k"])
    late = lambda c: masking.late_enough(F.col(c), F.col("t0"), 1)
    a_pos = cp.significant(F.col("pettitt_pval"), F.col("pettitt_cp"), 0.9) & late("a_date")
    return b.select("k", "t0", "t1", "a_date", "b_date", a_pos.alias("a_pos"), ((F.col("k") % 3 == 0) & late("b_date")).alias("b_pos"))


_BREAKS = f"""{_PETTITT}, peak as (select k, min(t) peak from (select *, max(value) over (partition by k) m from s2) where value = m group by 1), ends as (select k, min(time) t0, max(time) t1 from s2 group by 1),
bt as (select b.k, t0, t1, x.time a_date, y.time b_date, coalesce(least(1, 2 * exp(-6 * kk * kk / (cast(n as double) ** 3 + cast(n as double) ** 2))) < 0.9 and cp >= 0, false) and x.time >= t0 + interval 12 month a_pos, b.k % 3 = 0 and y.time >= t0 + interval 12 month b_pos
  from b join peak using (k) join ends using (k) join s2 x on x.k = b.k and x.t = cp join s2 y on y.k = b.k and y.t = peak),
cuts as (select k, 'a' test, a_date cut_date from bt where a_pos union all select k, 'b', b_date from bt where b_pos union all select k, 'all', least(a_date, b_date) from bt where a_pos or b_pos)"""


@query(f"with {_BREAKS} select s2.k, test, cut_date, count(*) n, round(sum(value), 5) total from s2 join cuts on cuts.k = s2.k where time <= cut_date group by 1, 2, 3")
def mask_positives(spark, d):
    cuts = masking.positive_cuts(_break_table(spark, d), ["k"], ["a", "b"])
    return masking.cut(s2(spark, d), cuts, ["k"]).groupBy("k", "test", "cut_date").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


@query(f"with {_BREAKS} select distinct k from s2 where k not in (select k from cuts)")
def negatives_anti(spark, d):
    return masking.negatives(s2(spark, d), masking.positive_cuts(_break_table(spark, d), ["k"], ["a", "b"]), ["k"])


@query(f"with {_BREAKS} select k, least(case when a_pos then a_date end, case when b_pos then b_date end) cut_date from bt where a_pos or b_pos")
def negative_pool(spark, d):
    return masking.combined_negative_pool(_break_table(spark, d), ["k"], ["a", "b"])


@query(f"""with {_BREAKS}, pool as (select a_date cut_date from bt where a_pos), c as (select cut_date, count(*) n from pool group by 1), ra as (select cut_date, sum(n) over (order by cut_date) hi, sum(n) over (order by cut_date) - n lo from c),
ke as (select k, t0, t1, {draw_sql(42, "bt.k")} % nullif((select count(*) from pool), 0) dr from bt where not coalesce(a_pos, false) and k in (select k from s2 where value is not null))
select k, t0, t1, coalesce(cut_date, greatest(t0 + interval 12 month, t0 + cast(floor(date_diff('day', t0, t1) * 0.7::double) as integer)))::date cut_date from ke left join ra on dr >= lo and dr < hi""")
def pseudo_breaks(spark, d):
    b = _break_table(spark, d)
    keys = masking.negatives(s2(spark, d), masking.positive_cuts(b, ["k"], ["a"]), ["k"]).join(b.select("k", "t0", "t1"), "k")
    pool = masking.positive_cuts(b, ["k"], ["a"]).where("test = 'a'")
    return masking.pseudo_breaks(keys, pool, ["k"], masking.fallback_date(F.col("t0"), F.col("t1"), 1))


@query(f"with {_BREAKS}, passes as (select k, value, 'full' run from s2 union all select s2.k, value, 'pos_' || test from s2 join cuts on cuts.k = s2.k where time <= cut_date union all select s2.k, value, 'neg_fixed' from s2 where time <= date '1998-06-30' and k not in (select k from cuts)) select run, k, count(*) n, round(avg(value), 8) mean from passes group by 1, 2")
def three_passes(spark, d):
    s = s2(spark, d).select("k", "time", "value")
    positive = masking.positive_cuts(_break_table(spark, d), ["k"], ["a", "b"])
    negative = masking.negatives(s, positive, ["k"]).withColumn("test", F.lit("fixed")).withColumn("cut_date", F.lit("1998-06-30").cast("date"))
    return rounded(masking.runs(s, positive, negative, ["k"]).groupBy("run", "k").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 8)


@query(f"""with {_PETTITT}, c as (select k, kk from b where least(1, 2 * exp(-6 * kk * kk / (cast(n as double) ** 3 + cast(n as double) ** 2))) < 0.9 and cp >= 0), within as (select exists (select 1 from c where kk <= 4000) a)
select k, kk k_stat from c, within where kk <= 4000 or not a order by kk desc, k limit 5""")
def top_examples(spark, d):
    found = cp.pettitt(s2(spark, d), ["k"])
    return cp.top_examples(found, 5, "k_stat", 4000.0, ["k"], cp.significant(F.col("pettitt_pval"), F.col("pettitt_cp"), 0.9)).select("k", "k_stat")


@query(f"with {_SUPF}, b as (select k from s order by f_stat desc, k limit 3) select k, t, value from s2 where k in (select k from b)")
def example_series(spark, d):
    s = s2(spark, d)
    chosen = cp.top_examples(cp.sup_f(s, ["k"]), 3, "f_stat", 1e18, ["k"])
    return cp.examples(s, chosen, ["k"]).select("k", "t", "value")


@query(f"""with {_PETTITT}, a as (select b.k, cp, cast(floor(1995 + cp / cast(52.1775 as double)) as integer) y, count(s_suppkey) area from b join supplier on s_nationkey = b.k group by 1, 2, 3), t as (select sum(area) s from a)
select cast(year as integer) as year, round(100 * coalesce((select sum(area) from a where y <= year), 0) / s, 6) percent from generate_series(1994, 2003) g(year), t""")
def cumulative_break_area(spark, d):
    from .inputs import table

    p = cp.pettitt(s2(spark, d), ["k"]).toDF("k", "cp", "k_stat", "p").select("k", "cp", cal.year_of_index(F.col("cp"), 1995).alias("y"))
    area = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").cast("double").alias("area"))
    return rounded(cp.cumulative_area(p.join(area, "k"), "y", "cp", "area", 2003, 1994))


_RUNS = f"""{_BREAKS}, passes as (select k, t, value, 'full' run from s2 union all select s2.k, t, value, 'pos_' || test from s2 join cuts on cuts.k = s2.k where time <= cut_date union all select s2.k, t, value, 'neg_fixed' from s2 where time <= date '1998-06-30' and k not in (select k from cuts)),
lagged as (select *, lag(value) over (partition by run, k order by t) p from passes),
rolled as (select run, k, t, count(value) over f n, avg(value) over f m, stddev_pop(value) over f sd, var_pop(value) over f vp, sum(value * p) over f1 sxy, sum(value + p) over f1 sx, count(value * p) over f1 c1
  from lagged window f as (partition by run, k order by t rows between 6 preceding and 6 following), f1 as (partition by run, k order by t rows between 5 preceding and 6 following)),
signals as (select run, k, t, 'std' indicator, case when n = 13 then round(sd, 9) end v from rolled union all select run, k, t, 'ac1', case when n = 13 and vp > 0 then round((sxy - m * sx + c1 * m * m) / (13 * vp), 9) end from rolled),
valid as (select * from signals where v is not null), sizes as (select run, k, indicator, count(v) n from signals group by all),
sums as (select a.run, a.k, a.indicator, sum(sign(b.v - a.v)) s, cast(count(*) as double) * sum((b.v <> a.v)::int) u from valid a join valid b on a.run = b.run and a.k = b.k and a.indicator = b.indicator and a.t < b.t group by all)
select run, k, indicator, cast(n as integer) n, round(s / sqrt(nullif(u, 0)), 6) tau from sizes left join sums using (run, k, indicator)"""


@query(f"with {_RUNS}")
def three_passes_trends(spark, d):
    """Indicators and their trends again on the full, the cut and the borrowed series."""
    s = s2(spark, d).select("k", "time", "t", "value")
    positive = masking.positive_cuts(_break_table(spark, d), ["k"], ["a", "b"])
    negative = masking.negatives(s, positive, ["k"]).withColumn("test", F.lit("fixed")).withColumn("cut_date", F.lit("1998-06-30").cast("date"))
    found = masking.trends_by_run(masking.runs(s, positive, negative, ["k"]), ["k"], 13, digits=9, names=("std", "ac1"))
    return rounded(found.select("run", "k", "indicator", "n", "tau"))

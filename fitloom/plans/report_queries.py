"""Queries of the report tables, each with its SQL: nations stand for tasks, customers' balances for what was measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.functions.scalars import rounded
from fitloom.operators import report
from fitloom.plans.registry import query, r, rounded_all, table

# Customers by task: R2 of one condition a market segment, failed below a balance; a structural score.
_TASKS = """with t as (select 'P' || lpad((c_custkey % 59 + 1)::VARCHAR, 2, '0') as "ID", c_mktsegment as s, case when min(c_acctbal) > -990 then 1 - (c_custkey % 59) * (case c_mktsegment when 'AUTOMOBILE' then 0.01::DOUBLE when 'BUILDING' then 0.02::DOUBLE when 'FURNITURE' then 0.003::DOUBLE else 0.03::DOUBLE end) end as r2 from customer group by c_custkey % 59, c_mktsegment)"""
SEGMENTS = {0.0: "AUTOMOBILE", 0.01: "BUILDING", 0.03: "FURNITURE"}


def tasks(spark, sf_dir):
    """One row a task, a column a condition; failed ones hold the sentinel."""
    place = F.col("c_custkey") % 59
    step = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 0.01).when(F.col("c_mktsegment") == "BUILDING", 0.02).when(F.col("c_mktsegment") == "FURNITURE", 0.003).otherwise(0.03)
    long = table(spark, sf_dir, "customer").groupBy(place.alias("place"), F.col("c_mktsegment").alias("s"), step.alias("step")).agg(F.min("c_acctbal").alias("least"))
    r2 = F.when(F.col("least") > -990, 1 - F.col("place") * F.col("step")).otherwise(-1e100)
    return long.groupBy(F.concat(F.lit("P"), F.lpad((F.col("place") + 1).cast("string"), 2, "0")).alias("ID")).agg(*(F.max(F.when(F.col("s") == s, r2)).alias(s) for s in SEGMENTS.values()))


_WIDE = _TASKS + """, w as (select "ID", max(r2) filter (s = 'AUTOMOBILE') as a, max(r2) filter (s = 'BUILDING') as b, max(r2) filter (s = 'FURNITURE') as c from t group by 1)"""
_LONG = _WIDE + """, l as (select "ID", 0.0::DOUBLE as test_noise, a as r2 from w union all select "ID", 0.01, b from w union all select "ID", 0.03, c from w)"""


def quantile(q: float) -> str:
    return r(f"quantile_cont(r2::DOUBLE, {q})", 6)


@query(_LONG + f""", g as (select * from l where "ID" not in (select "ID" from w where coalesce(a < 0, false) and coalesce(b < 0, false) and coalesce(c < 0, false)))
select test_noise, {quantile(0.5)} as median_r2, {quantile(0.1)} as q10_r2, {quantile(0.25)} as q25_r2, {quantile(0.75)} as q75_r2, {r('count(*) filter (r2 >= 0.9) / count(*)::DOUBLE', 8)} as high_accuracy_rate, {r('count(*) filter (r2 > 0) / count(*)::DOUBLE', 8)} as positive_r2_rate from g group by 1""")
def q_perfect_summary(spark, sf_dir):
    out = report.perfect_summary(tasks(spark, sf_dir), SEGMENTS)
    return rounded_all(rounded_all(out, 6, "median_r2", "q10_r2", "q25_r2", "q75_r2"), 8, "high_accuracy_rate", "positive_r2_rate")


def trainings(spark, sf_dir):
    """Three trainings, the noisy ones a little worse, the last one without some tasks."""
    clean = tasks(spark, sf_dir)
    worse = lambda by: clean.select("ID", *(F.when(F.col(c) > -1, F.col(c) - by).otherwise(F.col(c)).alias(c) for c in SEGMENTS.values()))
    return report.long_robustness({0.0: clean, 0.01: worse(0.05), 0.03: worse(0.125).filter("ID <> 'P07'")}, SEGMENTS)


_TRAINED = _LONG + """, n as (select "ID", train_noise, test_noise, case when r2 > -1 then r2 - case train_noise when 0 then 0.0::DOUBLE when 0.01 then 0.05::DOUBLE else 0.125::DOUBLE end else r2 end as r2 from l, (values (0.0::DOUBLE), (0.01), (0.03)) x(train_noise) where "ID" <> 'P07')"""


@query(_TRAINED + f"""select train_noise, test_noise, {quantile(0.5)} as median_r2, {quantile(0.25)} as q25_r2, {quantile(0.75)} as q75_r2, {r('count(*) filter (r2 >= 0.9) / 59.0::DOUBLE', 8)} as high_accuracy_rate, {r('count(*) filter (r2 > 0) / 59.0::DOUBLE', 8)} as positive_r2_rate from n group by all""")
def q_profile(spark, sf_dir):
    out = report.profile(report.robustness_summary(trainings(spark, sf_dir)))
    return rounded_all(rounded_all(out, 6, "median_r2", "q25_r2", "q75_r2"), 8, "high_accuracy_rate", "positive_r2_rate")


_PAIRS = _TRAINED + """, d as (select n."ID", n.train_noise, n.test_noise, n.r2 as noisy, c.r2 as clean, n.r2 - c.r2 as delta from n join n c on c."ID" = n."ID" and c.test_noise = n.test_noise and c.train_noise = 0 where n.train_noise > 0)"""


@query(_PAIRS + f"""select train_noise, test_noise, count(delta) as valid_pair_count, count(*) - count(noisy) as noisy_invalid_count, {r('quantile_cont(delta::DOUBLE, 0.5)', 6)} as median_delta_r2, {r('quantile_cont(delta::DOUBLE, 0.1)', 6)} as q10_delta_r2,
{r('quantile_cont(delta::DOUBLE, 0.9)', 6)} as q90_delta_r2, avg(case when delta > 0 then 1.0::DOUBLE when delta <= 0 then 0.0 end) as fraction_delta_positive from d group by all""")
def q_paired_summary(spark, sf_dir):
    return rounded_all(report.paired_summary(trainings(spark, sf_dir)), 6, "median_delta_r2", "q10_delta_r2", "q90_delta_r2")


@query(_PAIRS + f"""select "ID", train_noise, test_noise, {r('noisy', 8)} as noisy, {r('clean', 8)} as clean, {r('delta', 8)} as delta, noisy is null as failed from d""")
def q_paired_points(spark, sf_dir):
    return rounded_all(report.paired_points(trainings(spark, sf_dir)), 8, "noisy", "clean", "delta")


@query(_TRAINED + f""", m as (select train_noise, "ID", min(coalesce(r2, '-inf'::DOUBLE)) as worst from n group by all)
select train_noise, step, {r('step / 400.0::DOUBLE', 6)} as threshold, {r('avg(case when worst >= step / 400.0::DOUBLE then 1.0::DOUBLE else 0.0 end)', 8)} as share from m, range(0, 401) x(step) group by all""")
def q_worst_case_survival(spark, sf_dir):
    out = report.worst_case_survival(trainings(spark, sf_dir))
    return out.select("train_noise", "step", rounded(F.col("threshold"), 6).alias("threshold"), rounded(F.col("share"), 8).alias("share"))


_SCORES = """with v as (select 'P' || p_partkey as "ID", case when p_partkey % 13 = 0 then null else p_size * 2.0 end as score, 1 - p_retailprice / 2100.0 * (p_partkey % 10) / 10 as r2 from part)"""


def scores(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("ID"), F.when(k % 13 == 0, -1.0).otherwise(F.col("p_size") * 2.0).alias("score"), (1 - F.col("p_retailprice") / 2100.0 * (k % 10) / 10).alias("r2"))


@query(_SCORES + """, b as (select case when score is null then 0 when score < 45 then 1 when score < 75 then 2 when score < 90 then 3 else 4 end as bin from v) select x.bin, count(b.bin) as n from range(0, 5) x(bin) left join b on b.bin = x.bin group by 1""")
def q_structure_levels(spark, sf_dir):
    return report.structure_levels(scores(spark, sf_dir), "score")


_R2_BIN = "case when r2 is null then 0 when r2 < 0 then 1 when r2 < 0.9 then 2 when r2 < 0.99 then 3 when r2 < 0.9999 then 4 when r2 < 1 then 5 else 6 end"


@query(_WIDE + f""", b as (select {_R2_BIN.replace('r2', 'c')} as bin from w) select x.bin, count(b.bin) as n from range(0, 7) x(bin) left join b on b.bin = x.bin group by 1""")
def q_r2_levels(spark, sf_dir):
    return report.r2_levels(tasks(spark, sf_dir), "FURNITURE")


@query(_LONG + f""", b as (select test_noise as method, {_R2_BIN} as bin from l) select m.method, x.bin, count(b.bin) as n from range(0, 7) x(bin) cross join (select distinct test_noise as method from l) m left join b on b.bin = x.bin and b.method = m.method group by all""")
def q_distribution_comparison(spark, sf_dir):
    """The same bins for several methods."""
    from functools import reduce

    from pyspark.sql import DataFrame

    wide = tasks(spark, sf_dir)
    return reduce(DataFrame.unionByName, [report.r2_levels(wide, c).withColumn("method", F.lit(level)) for level, c in SEGMENTS.items()])


@query(_WIDE + f""", g as (select * from w where not (coalesce(a < 0, false) and coalesce(b < 0, false) and coalesce(c < 0, false))) select {', '.join(f"{r(f'1 - avg(greatest(1 - least({x}, 1), 1e-15::DOUBLE))', 8)} as {s.lower()}" for x, s in zip('abc', SEGMENTS.values()))} from g""")
def q_column_means(spark, sf_dir):
    out = report.column_means(tasks(spark, sf_dir), list(SEGMENTS.values()))
    return out.select(*(rounded(F.col(c), 8).alias(c.lower()) for c in SEGMENTS.values()))


@query(_LONG + f"select test_noise, count(r2) as valid, count(*) as tasks, {quantile(0.25)} as q25, {quantile(0.5)} as median, {quantile(0.75)} as q75 from l group by 1")
def q_noise_profile(spark, sf_dir):
    return rounded_all(report.coverage(tasks(spark, sf_dir), SEGMENTS), 6, "q25", "median", "q75")


@query(_LONG + f""", x as (select test_noise as method, r2 from l) select method::VARCHAR as method, count(*) as n_all, count(r2) as n_valid, count(*) - count(r2) as n_invalid, count(*) filter (r2 >= 0.9) as n_ge_0_9, {r('count(*) filter (r2 >= 0.9) / 59.0::DOUBLE', 8)} as rate_tasks_ge_0_9, {r('count(*) filter (r2 >= 0.9) / count(r2)::DOUBLE', 8)} as rate_valid_ge_0_9 from x group by 1""")
def q_success_comparison(spark, sf_dir):
    wide = tasks(spark, sf_dir)
    tables = {str(level): wide.select("ID", F.col(c).alias("r2")) for level, c in SEGMENTS.items()}
    out = report.success_comparison(tables, "r2").select("method", "n_all", "n_valid", "n_invalid", "n_ge_0_9", "rate_tasks_ge_0_9", "rate_valid_ge_0_9")
    return rounded_all(out, 8, "rate_tasks_ge_0_9", "rate_valid_ge_0_9")


@query(_WIDE + f""", l as (select 'AUTOMOBILE' as series, "ID", greatest(a, 0) as r2 from w where a is not null union all select 'AUTOMOBILE', "ID", 0 from w where a is null union all select 'FURNITURE', "ID", greatest(c, 0) from w where c is not null union all select 'FURNITURE', "ID", 0 from w where c is null)
select series, "ID", {r('r2', 8)} as r2, {r('least(-log10(greatest(1 - least(r2, 1), 1e-15::DOUBLE)), 10)', 6)} as strength, {r('avg(r2) over (partition by series)', 8)} as mean_r2 from l""")
def q_dot_plot(spark, sf_dir):
    out = report.dot_plot(tasks(spark, sf_dir), ["AUTOMOBILE", "FURNITURE"])
    return rounded_all(rounded_all(out, 8, "r2", "mean_r2"), 6, "strength")


@query(_WIDE + f"""select "ID", right("ID", 2)::INT as complexity, {r('b', 8)} as r2, coalesce(b < 0, false) as outlier from w""")
def q_complexity_points(spark, sf_dir):
    rows = tasks(spark, sf_dir).withColumn("complexity", F.substring("ID", 2, 2).cast("int"))
    return rounded_all(report.complexity_points(rows, "BUILDING"), 8, "r2")


@query(_WIDE + f"select {r('min(b)', 8)} as least, count(*) filter (b < 0) as negative from w")
def q_least_r2(spark, sf_dir):
    return rounded_all(report.least_r2(tasks(spark, sf_dir), "BUILDING"), 8, "least")


@query("""with v as (select c_custkey, c_custkey % 100 as s, 1 - (c_custkey % 7 + 1) * 0.13 as r2 from customer), p as (select *, log10(greatest(1 - least(r2, 1), 1e-15::DOUBLE)) as y, greatest(1 - least(r2, 1), 1e-15::DOUBLE) as nmse from v)
select a.c_custkey, a.s::DOUBLE as s, floor(a.nmse * 1e8::DOUBLE + 0.5) / 1e8::DOUBLE as nmse, count(*) - 1 as near from p a join p b on abs(a.s - b.s) <= 5 and abs(a.y - b.y) <= 1 group by all""")
def q_density(spark, sf_dir):
    """The reference band: 5 of score and a decade of NMSE."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (k % 100).cast("double").alias("s"), (1 - (k % 7 + 1) * 0.13).alias("r2"))
    return rounded_all(report.density(rows, "c_custkey", "s", "r2"), 8, "nmse")


_BEST = """with v as (select l_suppkey, avg(1 - l_tax) as r2, avg(l_quantity) * 2 as s from lineitem group by 1), b as (select * from v where r2 >= 0)"""


def best(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg(1 - F.col("l_tax")).alias("r2"), (F.avg("l_quantity") * 2).alias("s"))


@query(_BEST + f"select {r('median(s)', 6)} as s, {r('median(r2)', 6)} as r2 from b")
def q_metric_medians(spark, sf_dir):
    return rounded_all(report.metric_report(best(spark, sf_dir), "l_suppkey", "s", "r2")["medians"], 6, "s", "r2")


@query(_BEST + f"select l_suppkey, {r('r2', 8)} as r2, {r('s', 8)} as s from b")
def q_metric_rows(spark, sf_dir):
    return rounded_all(report.metric_report(best(spark, sf_dir), "l_suppkey", "s", "r2")["rows"], 8, "r2", "s")


@query(_BEST + """, h as (select least(floor(s / 5.0::DOUBLE), 19)::BIGINT + 1 as bin from b) select x.bin, count(h.bin) as n from range(1, 21) x(bin) left join h on h.bin = x.bin group by 1""")
def q_score_histogram(spark, sf_dir):
    return report.metric_report(best(spark, sf_dir), "l_suppkey", "s", "r2")["score_histogram"]


@query("""with v as (select l_orderkey, max(1 - l_tax) as r2 from lineitem group by 1), n as (select ln(r2 - 0.9) as x from v where r2 > 0.9 and r2 <= 1), e as (select min(x) as lo, max(x) as hi from n)
select b.bin, count(n.x) as n from range(1, 11) b(bin) cross join e left join n on least(floor((n.x - e.lo) / ((e.hi - e.lo) / 10)), 9)::BIGINT + 1 = b.bin group by 1""")
def q_log_histogram(spark, sf_dir):
    """The part near 1 on a log scale, in ten bins of its own range."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(1 - F.col("l_tax")).alias("r2"), F.max("l_quantity").alias("s"))
    return report.metric_report(rows, "l_orderkey", "s", "r2")["log_histogram"]


@query(_WIDE + f""", s as (select "ID", case when right("ID", 2)::INT % 9 = 0 then null else right("ID", 2)::INT * 1.5 end as score from w)
select 'tasks' as statistic, '' as level, 59.0::DOUBLE as value union all select 'similarity of 80 or more', '', (select count(*)::DOUBLE from s where score >= 80) union all select 'median similarity', '', (select {r('median(score)::DOUBLE', 6)} from s)
union all select 'noise median R2', '0', (select {r('median(a)::DOUBLE', 6)} from w) union all select 'noise success percent', '0', (select {r("100.0::DOUBLE * count(*) filter (a >= 0.9) / count(*)", 6)} from w)
union all select 'shift median R2', '025', (select {r('median(c)::DOUBLE', 6)} from w) union all select 'shift success percent', '025', (select {r("100.0::DOUBLE * count(*) filter (c >= 0.9) / count(*)", 6)} from w)""")
def q_overview(spark, sf_dir):
    place = F.substring("ID", 2, 2).cast("int")
    rows = tasks(spark, sf_dir).withColumn("score", F.when(place % 9 == 0, -1.0).otherwise(place * 1.5))
    return rounded_all(report.overview(rows, "score", {"0": "AUTOMOBILE"}, {"025": "FURNITURE"}), 6, "value")

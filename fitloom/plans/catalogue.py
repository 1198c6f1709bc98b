"""The registered queries of the formula engine, each with its SQL. Both sides round by the floor helper where engines differ in last bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions import cells, compile as comp, counters, program, scalars
from fitloom.functions.expr import generalise, parse, show
from fitloom.functions.scalars import rounded
from fitloom.operators import dedup, fitting, generate, metrics, ranking, relational, report, search
from fitloom.operators.ordering import running
from fitloom.plans.registry import QUERIES, SQL, Query, query, r, rounded_all, table


def queries() -> dict[str, Query]:
    from fitloom.plans import cell_queries, fit_queries, report_queries, source_queries  # noqa: F401  (they register theirs)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


LINE = ["l_returnflag", "l_linestatus"]


def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity, fitted and scored for each flag and status."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_extendedprice")
    fits = fitting.linear_fit(rows, LINE, "p0*x + p1", ["p0", "p1"], {"x": F.col("l_quantity")}, "l_extendedprice").drop("n")
    scored = rows.join(F.broadcast(fits), LINE)  # a row for each flag and status
    return metrics.fit_metrics(scored.withColumn("fitted", F.col("p0") * F.col("l_quantity") + F.col("p1")), LINE, "l_extendedprice").join(fits, LINE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit each group, score it, aggregate the groups of a flag all or nothing, rank the flags."""
    fits = line_fits(spark, sf_dir).withColumn("retry_used", F.lit(False))
    shared = metrics.all_or_nothing(fits, ["l_returnflag"], "l_linestatus")
    return shared.withColumn("one_", F.lit(0)).transform(lambda d: ranking.top_n(d, ["one_"], "mse", 10, ["l_returnflag"])).drop("one_")


# Fits and their metrics


@query(f"select l_returnflag, l_linestatus, {r('regr_slope(l_extendedprice, l_quantity)')} as slope, {r('regr_intercept(l_extendedprice, l_quantity)', 2)} as intercept, {r('regr_r2(l_extendedprice, l_quantity)', 6)} as r2 from lineitem group by all")
def q_linear_fit_by_group(spark, sf_dir):
    fits = line_fits(spark, sf_dir)
    return fits.select(*LINE, rounded(F.col("p0")).alias("slope"), rounded(F.col("p1"), 2).alias("intercept"), rounded(F.col("r2"), 6).alias("r2"))


@query(f"""with s as (select l_returnflag, sum(l_quantity*l_quantity) as a, sum(l_quantity*l_discount) as b, sum(l_discount*l_discount) as c, sum(l_quantity*l_extendedprice) as d, sum(l_discount*l_extendedprice) as e from lineitem group by 1)
select l_returnflag, {r('(d*c - b*e) / (a*c - b*b)', 3)} as p0, {r('(a*e - b*d) / (a*c - b*b)', 2)} as p1 from s""")
def q_normal_equations_2var(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    fits = fitting.linear_fit(rows, ["l_returnflag"], "p0*x + p1*z", ["p0", "p1"], {"x": F.col("l_quantity"), "z": F.col("l_discount")}, "l_extendedprice")
    return fits.select("l_returnflag", rounded(F.col("p0"), 3).alias("p0"), rounded(F.col("p1"), 2).alias("p1"))


@query(f"""with s as (select l_shipdate::DATE as d, count(*) as n, sum((l_extendedprice - 1500*l_quantity)*(l_extendedprice - 1500*l_quantity)) as sse, var_pop(l_extendedprice)*count(*) as sst from lineitem group by 1)
select d, n, {r('sse/n', 2)} as mse, {r('sse/sst', 6)} as nmse, {r('1 - sse/sst', 6)} as r2 from s where sst > 0""")
def q_fit_metrics(spark, sf_dir):
    rows = fitting.score_with(table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate")), "1500*q", {"q": F.col("l_quantity")})
    out = metrics.fit_metrics(rows, ["d"], "l_extendedprice").filter(F.col("nmse").isNotNull())
    return out.select("d", "n", rounded(F.col("mse"), 2).alias("mse"), rounded(F.col("nmse"), 6).alias("nmse"), rounded(F.col("r2"), 6).alias("r2"))


@query("""select p_size, count(*) as n, case when p_size % 2 = 0 then 1.0::DOUBLE else -1e100::DOUBLE end as r2, case when p_size % 2 = 0 then 0.0::DOUBLE end as nmse from part group by all""")
def q_degenerate_sst(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_size", F.col("p_size").cast("double").alias("y"), (F.col("p_size") + F.col("p_size") % 2).cast("double").alias("fitted"))
    return metrics.fit_metrics(rows, ["p_size"]).select("p_size", "n", "r2", "nmse")


@query(f"select o_orderstatus, {r('avg(o_totalprice)', 2)} as mean, {r('count(*)/sum(1.0::DOUBLE/o_totalprice)', 2)} as hmean, {r('sqrt(avg(o_totalprice*o_totalprice))', 2)} as rms from orders group by 1")
def q_metric_aggregates(spark, sf_dir):
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(rounded(metrics.mean(x), 2).alias("mean"), rounded(metrics.harmonic(x), 2).alias("hmean"), rounded(metrics.rms(x), 2).alias("rms"))


_GROUPS = "select o_custkey, o_orderpriority as grp, avg(o_totalprice) as m, min(o_totalprice) > 20000 as ok from orders group by all"


def customer_groups(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("grp")).agg(F.avg("o_totalprice").alias("mse"), (F.min("o_totalprice") > 20000).alias("ok")).withColumn("r2", F.col("mse") / 1e6).withColumn("retry_used", F.lit(False))


@query(f"""with g as ({_GROUPS}) select o_custkey, case when bool_and(ok) then {r('avg(m)', 7)} else 1e100::DOUBLE end as mse, case when bool_and(ok) then {r('count(*)/sum(1.0::DOUBLE/m)', 3)} else 1e100::DOUBLE end as mse_hmean,
case when bool_and(ok) then {r('sqrt(avg(m*m))', 3)} else 1e100::DOUBLE end as mse_rms from g group by 1""")
def q_all_or_nothing(spark, sf_dir):
    out = metrics.all_or_nothing(customer_groups(spark, sf_dir), ["o_custkey"])
    keep = lambda c, places: F.when(F.col(c) < scalars.FAILED, rounded(F.col(c), places)).otherwise(F.col(c)).alias(c)
    return out.select("o_custkey", keep("mse", 7), keep("mse_hmean", 3), keep("mse_rms", 3))


@query(f"""with g as ({_GROUPS}) select o_custkey, coalesce(string_agg(grp, ',' order by grp) filter (ok), '') as success_groups, coalesce(string_agg(grp, ',' order by grp) filter (not ok), '') as failed_groups from g group by 1""")
def q_success_failed_lists(spark, sf_dir):
    out = metrics.all_or_nothing(customer_groups(spark, sf_dir), ["o_custkey"])
    return out.select("o_custkey", F.array_join("success_groups", ",").alias("success_groups"), F.array_join("failed_groups", ",").alias("failed_groups"))


_V = "case when l_discount > 0.02 then 1 - l_tax * 2 end"


@query(f"""with v as (select l_shipdate::DATE as d, {_V} as v from lineitem) select d, count(*) as n_all, count(v) as n_valid, count(*) - count(v) as n_invalid, count(*) filter (v >= 0.9) as n_ge_0_9,
count(*) filter (v >= 0.9) / 59.0::DOUBLE as rate_tasks_ge_0_9, case when count(v) > 0 then count(*) filter (v >= 0.9)::DOUBLE / count(v) end as rate_valid_ge_0_9, count(*) filter (v >= 0.9)::DOUBLE / count(*) as rate_rows_ge_0_9 from v group by 1""")
def q_threshold_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.when(F.col("l_discount") > 0.02, 1 - F.col("l_tax") * 2).alias("v"))
    return rows.groupBy("d").agg(*metrics.rates(F.col("v"), 59, (0.9,)))


@query("select event_type, " + ", ".join(f"{r(f'quantile_cont(value::DOUBLE, {s})', 6)} as q{round(100 * s):02d}" for s in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from events group by 1")
def q_exact_quantiles(spark, sf_dir):
    out = metrics.exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rounded_all(out, 6, *[c for c in out.columns if c.startswith("q")])


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def q_argmax_per_group(spark, sf_dir):
    return metrics.arg_max(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("select p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 1")
def q_argmin_global(spark, sf_dir):
    return metrics.arg_min(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


@query(f"select l_returnflag, {r('corr(l_quantity, l_extendedprice)', 8)} as r from lineitem group by 1")
def q_pearson(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(rounded(metrics.correlation("l_quantity", "l_extendedprice"), 8).alias("r"))


@query(f"""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0::DOUBLE as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0::DOUBLE as b, l_quantity as x, l_extendedprice as y from lineitem)
select count(*) as n, {r('corr(x, y)', 8)} as pearson, {r('corr(a, b)', 8)} as spearman from r""")
def q_spearman(spark, sf_dir):
    return rounded_all(metrics.association(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").drop("pearson_p", "spearman_p"), 8, "pearson", "spearman")


def _p(rho: str) -> str:
    """Student's two-sided probability in SQL, by its finite sums for even and odd degrees of freedom."""
    even = f"1 - abs({rho}) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2)) * pow(1 - {rho} * {rho}, k)))"
    odd = f"1 - 2 / pi() * (asin(abs({rho})) + abs({rho}) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(1 - {rho} * {rho}, k + 0.5::DOUBLE))), 0))"
    return f"case when n % 2 = 0 then {even} else {odd} end"


@query(f"""with v as (select c_nationkey, c_acctbal as x, (c_custkey % 17)::DOUBLE as y from customer),
r as (select *, rank() over (partition by c_nationkey order by x) + (count(*) over (partition by c_nationkey, x) - 1) / 2.0::DOUBLE as a, rank() over (partition by c_nationkey order by y) + (count(*) over (partition by c_nationkey, y) - 1) / 2.0::DOUBLE as b from v),
s as (select c_nationkey, count(*) as n, corr(x, y) as pearson, corr(a, b) as spearman from r group by 1 having count(*) > 3)
select c_nationkey, n, {r('pearson', 8)} as pearson, {r('spearman', 8)} as spearman, {r(_p('pearson'), 7)} as pearson_p, {r(_p('spearman'), 7)} as spearman_p from s""")
def q_association_by_group(spark, sf_dir):
    """Both correlations of each nation's customers, with their probabilities."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 17).cast("double").alias("y"))
    found = metrics.association(rows, "x", "y", ("c_nationkey",)).filter("n > 3")
    return rounded_all(rounded_all(found, 8, "pearson", "spearman"), 7, "pearson_p", "spearman_p")


@query(f"""with d as (select l_quantity * 2 as s, 1 - l_discount * 2 as r from lineitem), m as (select avg(s) as ms, avg(r) as mr from d)
select count(*) as n, count(*) filter (r < mr and s >= 80) as low_r2_high_score, count(*) filter (r >= 0.9 and s < ms) as high_r2_low_score, {r('100.0 * count(*) filter (r >= 0.9 and s < ms) / count(*)', 6)} as percent_of_rows,
{r('100.0 * count(*) filter (r >= 0.9 and s < ms) / count(*) filter (r >= 0.9)', 6)} as percent_of_high_r2 from d, m""")
def q_contingency(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 2).alias("s"), (1 - F.col("l_discount") * 2).alias("r"))
    return rounded_all(metrics.contingency(rows, "s", "r"), 6, "percent_of_rows", "percent_of_high_r2")


@query("""with b as (select case when value >= 0 and value < 10 then 1 when value >= 10 and value < 50 then 2 when value >= 50 and value <= 100 then 3 else 0 end as bin from events)
select s.bin, count(b.bin) as n from (select unnest(range(0, 4)) as bin) s left join b on b.bin = s.bin group by 1""")
def q_histogram_edges(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "value", [0.0, 10.0, 50.0, 100.0])


@query("""with b as (select least(floor((o_totalprice - 0.0::DOUBLE) / (500000.0::DOUBLE / 20)), 19)::BIGINT + 1 as bin from orders where o_totalprice between 0 and 500000)
select s.bin, count(b.bin) as n from (select unnest(range(1, 21)) as bin) s left join b on b.bin = s.bin group by 1""")
def q_histogram_equal(spark, sf_dir):
    return metrics.equal_width(table(spark, sf_dir, "orders"), "o_totalprice", 20, 0.0, 500000.0)


@query(f"""with w as (select l_returnflag, case when l_discount = 0 then '-inf'::DOUBLE else least(1 - l_discount * 5, 1 - l_tax * 9) end as v from lineitem), t as (select i as step, i / 400.0::DOUBLE as threshold from range(0, 401) x(i))
select l_returnflag, step, {r('threshold', 6)} as threshold, {r('avg(case when v >= threshold then 1.0::DOUBLE else 0.0 end)', 8)} as share from w, t group by all""")
def q_survival_curve(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_discount") != 0, 1 - F.col("l_discount") * 5).alias("a"), (1 - F.col("l_tax") * 9).alias("b"))
    return metrics.survival(rows, ["a", "b"], 400, ("l_returnflag",)).select("l_returnflag", "step", rounded(F.col("threshold"), 6).alias("threshold"), rounded(F.col("share"), 8).alias("share"))


@query(f"""with a as (select o_custkey, avg(o_totalprice) filter (o_orderstatus = 'F') as clean, avg(o_totalprice) filter (o_orderstatus = 'O') as noisy, o_custkey % 5 as g from orders group by 1)
select g, count(noisy - clean) as valid_pair_count, count(*) - count(noisy) as noisy_invalid_count, {r('quantile_cont((noisy - clean)::DOUBLE, 0.5)', 2)} as median_delta_r2, {r('quantile_cont((noisy - clean)::DOUBLE, 0.1)', 2)} as q10_delta_r2,
{r('quantile_cont((noisy - clean)::DOUBLE, 0.9)', 2)} as q90_delta_r2, {r('avg(case when noisy - clean > 0 then 1.0::DOUBLE when noisy - clean <= 0 then 0.0 end)', 6)} as fraction_delta_positive from a group by 1""")
def q_paired_delta(spark, sf_dir):
    price = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(price("F").alias("clean"), price("O").alias("noisy")).withColumn("g", F.col("o_custkey") % 5)
    out = metrics.paired_delta(rows, "clean", "noisy", ("g",))
    return rounded_all(rounded_all(out, 2, "median_delta_r2", "q10_delta_r2", "q90_delta_r2"), 6, "fraction_delta_positive")


@query(f"select l_linenumber, {r('stddev_pop(l_extendedprice)', 3)} as std from lineitem group by 1")
def q_population_std(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(rounded(F.stddev_pop("l_extendedprice"), 3).alias("std"))


@query("select lang, source, n_chars, count(*) as n from documents group by all having count(*) > 1")
def q_duplicates(spark, sf_dir):
    return metrics.duplicates(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


@query(f"select l_linestatus, {r('sum(l_quantity * (1 - l_discount)) / sum(l_quantity)', 8)} as rate, {r('min((l_quantity * (1 - l_discount)) / l_quantity)', 8)} as least, {r('max((l_quantity * (1 - l_discount)) / l_quantity)', 8)} as most from lineitem group by 1")
def q_acceptance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("accepted", F.col("l_quantity") * (1 - F.col("l_discount"))).withColumn("proposed", F.col("l_quantity"))
    return rounded_all(metrics.acceptance(rows, ["l_linestatus"]), 8, "rate", "least", "most")


# Ranking and ordered semantics


@query("select o_custkey, o_orderkey, o_totalprice, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as rank from orders) where rank <= 3")
def q_topn_stable(spark, sf_dir):
    return ranking.top_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 3, ["o_orderkey"])


@query("""with f as (select p_brand, p_partkey, p_retailprice, p_size between 48 and 49 as inside, bool_or(p_size between 48 and 49) over (partition by p_brand) as found from part)
select p_brand, p_partkey, p_retailprice, rank from (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as rank from f where inside or not found) where rank <= 5""")
def q_nsmallest_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("complexity"), F.col("p_retailprice").alias("loss"))
    return ranking.lowest_loss(rows, ["p_brand"], 5, 48, 49, "p_partkey").select("p_brand", "p_partkey", F.col("loss").alias("p_retailprice"), "rank")


_FRONT = "with e as (select p_brand, p_size, min(p_retailprice) as loss from part group by all)"


def part_front(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("complexity")).agg(F.min("p_retailprice").alias("loss"))
    return ranking.scored_front(rows, ["p_brand"])


@query(_FRONT + " select p_brand, p_size from (select *, min(loss) over (partition by p_brand order by p_size rows between unbounded preceding and 1 preceding) as best from e) where best is null or loss < best")
def q_pareto_front(spark, sf_dir):
    return part_front(spark, sf_dir).filter("on_front").select("p_brand", F.col("complexity").alias("p_size"))


@query(_FRONT + f", l as (select *, lag(loss) over w as l0, lag(p_size) over w as s0 from e window w as (partition by p_brand order by p_size)) select p_brand, p_size, {r('coalesce(-(ln(loss) - ln(l0)) / (p_size - s0), 0)', 8)} as score from l")
def q_pareto_score(spark, sf_dir):
    return part_front(spark, sf_dir).select("p_brand", F.col("complexity").alias("p_size"), rounded(F.col("score"), 8).alias("score"))


@query("""with m as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as dataset, value > 20 as done from events), p as (select *, min(case when done then 1 else 0 end) over (partition by user_id order by dataset) as whole from m)
select user_id, count(*) as finished from p where whole = 1 group by 1""")
def q_completed_prefix(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("dataset"), (F.col("value") > 20).alias("done"))
    return ranking.completed_prefix(marks, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("finished"))


@query("""select p_partkey, 'P' || p_partkey as id, row_number() over (order by regexp_extract('P' || p_partkey, '^(\\D*)', 1), regexp_extract('P' || p_partkey, '(\\d+)', 1)::BIGINT) as n from part""")
def q_natural_sort(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    keys = ids.withColumns({"a": F.regexp_extract("id", r"^(\D*)", 1), "b": F.regexp_extract("id", r"(\d+)", 1).cast("long")})
    return running(keys, ["a", "b"], "n").select("p_partkey", "id", "n")


@query("select n_nationkey, (ntile(4) over (order by n_nationkey) - 1)::INT as chunk from nation")
def q_balanced_chunks(spark, sf_dir):
    return ranking.chunks(table(spark, sf_dir, "nation").select("n_nationkey"), 4, ["n_nationkey"])


@query("select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_custkey) as n from customer where c_acctbal > 0) where n <= 4")
def q_first_accepted(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") > 0).alias("accepted"))
    return ranking.first_accepted(rows, ["c_nationkey"], 4, "c_custkey").drop("accepted")


# Joins and sets


@query("select c_custkey, c_nationkey, c_name, n_name from nation right join customer on n_nationkey = c_nationkey and n_regionkey <> 3")
def q_right_join_validated(spark, sf_dir):
    master = table(spark, sf_dir, "nation").filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("k"), "n_name")
    return relational.attach_master(table(spark, sf_dir, "customer").withColumn("k", F.col("c_nationkey")), master, "k").select("c_custkey", "c_nationkey", "c_name", "n_name")


@query("select distinct c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def q_unmatched(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.unmatched(table(spark, sf_dir, "customer"), urgent, "c_custkey")


@query(f"select n_nationkey, {r('coalesce(b, -1e9)', 2)} as best, b is null as filled from nation left join (select s_nationkey, max(s_acctbal) as b from supplier where s_acctbal > 5000 group by 1) on n_nationkey = s_nationkey")
def q_spine_reindex(spark, sf_dir):
    spine = table(spark, sf_dir, "nation").select("n_nationkey")
    best = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("best"))
    out = relational.on_spine(best, spine, "n_nationkey", {"best": -1e9})
    return out.select("n_nationkey", rounded(F.col("best"), 2).alias("best"), (F.col("best") == -1e9).alias("filled"))


@query("select o_orderkey as k from orders intersect select l_orderkey from lineitem where l_discount > 0.05 intersect select l_orderkey from lineitem where l_tax > 0.04")
def q_key_intersection(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    tables = [table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), lines.filter("l_discount > 0.05").select(F.col("l_orderkey").alias("k")), lines.filter("l_tax > 0.04").select(F.col("l_orderkey").alias("k"))]
    return relational.common_keys(tables, "k")


@query("""with p as (select p_partkey, p_size::DOUBLE as x, log10(p_retailprice) as y from part) select a.p_partkey, count(*) - 1 as near from p a join p b on abs(a.x - b.x) <= 5 and abs(a.y - b.y) <= 1 group by 1""")
def q_band_self_join(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.log10("p_retailprice").alias("y"))
    return relational.band_counts(points, "p_partkey", "x", "y")


@query("""with p as (select c_custkey, c_nationkey::DOUBLE as x, c_acctbal / 100.0::DOUBLE as y from customer) select a.c_custkey, count(*) - 1 as near from p a join p b on abs(a.x - b.x) <= 2 and b.y between a.y - 0.5 and a.y + 0.5 group by 1""")
def q_band_dense(spark, sf_dir):
    """A narrower band over points that fill it."""
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 100.0).alias("y"))
    return relational.band_counts(points, "c_custkey", "x", "y", 2.0, 0.5)


@query("select s_nationkey as n_nationkey, s_suppkey, c_custkey from supplier join customer on c_nationkey = s_nationkey")
def q_formula_group_cross(spark, sf_dir):
    formulas = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    groups = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return fitting.formula_groups(formulas, groups, ["n_nationkey"], "c_custkey")


@query("select o_orderkey as k, o_totalprice as a, null::DOUBLE as b from orders where o_orderstatus = 'F' union all by name select l_orderkey as k, l_tax as b, null::DOUBLE as a from lineitem where l_tax > 0.07")
def q_union_all(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"))
    b = table(spark, sf_dir, "lineitem").filter("l_tax > 0.07").select(F.col("l_tax").alias("b"), F.col("l_orderkey").alias("k"))
    return relational.union_all([a, b])


@query("select o_custkey as k from orders where o_totalprice > 1000 except select o_custkey from orders where o_totalprice > 250000")
def q_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return relational.difference(orders.filter("o_totalprice > 1000"), orders.filter("o_totalprice > 250000"), "k")


@query("select l_orderkey, 'l_tax' as condition, l_tax as r2 from lineitem union all select l_orderkey, 'l_discount', l_discount from lineitem")
def q_unpivot(spark, sf_dir):
    return relational.unpivot(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_tax", "l_discount"], "condition", "r2")


@query("select l_suppkey, " + ", ".join(f"max(l_{v}) filter (l_returnflag = '{f}') as \"{f}_{v.upper()}\"" for f in "ANR" for v in ("tax", "discount")) + " from lineitem group by 1")
def q_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return relational.widen(rows, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], ["tax", "discount"])


# Filters and columns


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('coalesce(least(greatest(case when l_tax > 0.01 then 1 - l_discount * 20 end, 0), 1), 0)', 6)} as a from lineitem")
def q_heatmap_clip(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_tax") > 0.01, 1 - F.col("l_discount") * 20).otherwise(-1e100)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(scalars.clipped(value, 0.0, 1.0), 6).alias("a"))


@query("select l_returnflag, count(*) as n from lineitem where l_discount <> 0.05 and l_tax <> 0 group by 1")
def q_finite_filter(spark, sf_dir):
    x, y = comp.divide(F.col("l_quantity"), F.col("l_discount") - 0.05), comp.divide(F.col("l_tax") * 0.0, F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").withColumns({"x": x, "y": y})
    return rows.filter(scalars.finite(F.col("x")) & scalars.finite(F.col("y"))).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("select o_orderkey from orders where o_totalprice between 100000 - 1e-10 * 200000 and 200000 + 1e-10 * 200000")
def q_range_accept(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(relational.in_range(F.col("o_totalprice"), F.lit(1e5), F.lit(2e5))).select("o_orderkey")


@query("select c_custkey, case when c_acctbal >= 0 then c_acctbal end as r2 from customer")
def q_sentinel_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, -1e100).otherwise(F.col("c_acctbal")).alias("r2"))
    return relational.without_sentinels(rows, ["r2"])


@query("select c_custkey, c_acctbal < 0 and b < 0 as outlier from customer join (select s_nationkey, min(s_acctbal) as b from supplier group by 1) on s_nationkey = c_nationkey")
def q_outlier_all_negative(spark, sf_dir):
    low = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_acctbal").alias("b"))
    return table(spark, sf_dir, "customer").join(low, "c_nationkey").select("c_custkey", relational.all_negative(["c_acctbal", "b"]).alias("outlier"))


# The formula language

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_VARIABLES = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}


def line_variables() -> dict:
    return {k: F.col(c) for k, c in _VARIABLES.items()}


@query(f"select {_KEY}, {r('l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity - 2.5::DOUBLE * sqrt(l_quantity)')} as y from lineitem")
def q_formula_eval(spark, sf_dir):
    tree = parse("y = p*(1 - d)*(1 + t)/q - 2.5*sqrt(q)", "fit", set(_VARIABLES))
    return table(spark, sf_dir, "lineitem").select(*KEY, rounded(comp.to_column(tree, line_variables())).alias("y"))


_OF_PART = """case p_partkey % 6 when 0 then l_quantity * p_size + l_discount when 1 then sqrt(l_quantity) * p_size - l_extendedprice / 1000.0::DOUBLE when 2 then l_extendedprice / (l_quantity + p_size) when 3 then ln(l_quantity + p_size) * (1 - l_discount)
  when 4 then atan(l_tax * p_size) + l_quantity ** 2 when 5 then null end"""


@query(f"select {_KEY}, p_partkey, {r(_OF_PART)} as y from lineitem join part on p_partkey = l_partkey")
def q_formula_programs(spark, sf_dir):
    """Each part has a formula of its own, as text; all lines are put into their parts' formulas by one plan. Every sixth is no formula."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(F.lit("y = q*"), n, F.lit(" + d"))).when(k == 1, F.concat(F.lit("sqrt(q)*"), n, F.lit(" - p/1000"))).when(k == 2, F.concat(F.lit("p/(q + "), n, F.lit(")")))
    text = text.when(k == 3, F.concat(F.lit("ln(q + "), n, F.lit(")*(1 - d)"))).when(k == 4, F.concat(F.lit("arctan(t*"), n, F.lit(") + q^2"))).otherwise("q*(")
    parts = program.programs(table(spark, sf_dir, "part").select("p_partkey", text.alias("formula")), list(_VARIABLES))
    lines = table(spark, sf_dir, "lineitem").select(*KEY, "l_partkey", F.array(*(F.col(c).cast("double") for c in _VARIABLES.values())).alias("values"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(*KEY, "p_partkey", rounded(program.value(F.col("program"), F.col("values"))).alias("y"))


_FUNCTIONS = {
    "sqrt": "sqrt(q)", "exp": "exp(q/50)", "log": "log(q)", "log10": "log10(p)", "sin": "sin(q)", "cos": "cos(q)", "tan": "tan(t)", "asin": "asin(d)", "acos": "acos(d)", "atan": "atan(q)", "sinh": "sinh(q/10)",
    "cosh": "cosh(q/10)", "tanh": "tanh(q/10)", "asinh": "asinh(q)", "acosh": "acosh(q)", "atanh": "atanh(d)", "abs": "abs(q - 25)", "sign": "sign(q - 25)",
}


def _as_sql(text: str) -> str:
    import re

    return re.sub(r"\b([qpdt])\b", lambda m: _VARIABLES[m[1]], text.replace("log(q)", "ln(q)")).replace("/50", "/50.0::DOUBLE").replace("/10", "/10.0::DOUBLE")


@query(f"select {_KEY}, " + ", ".join(f"{r(_as_sql(t), 6)} as f_{n}" for n, t in _FUNCTIONS.items()) + " from lineitem")
def q_formula_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*KEY, *(rounded(comp.to_column(parse(t), line_variables()), 6).alias(f"f_{n}") for n, t in _FUNCTIONS.items()))


@query(f"""select c_custkey, {r("case when c_acctbal < 0 then -pow(abs(c_acctbal), 1/3.0::DOUBLE) else pow(abs(c_acctbal), 1/3.0::DOUBLE) end", 6)} as third, {r('pow(abs(c_acctbal), 2)', 2)} as square, {r('pow(abs(c_acctbal), 1.5)', 2)} as other,
{r("case when c_acctbal < 0 then -pow(abs(c_acctbal), 3) else pow(abs(c_acctbal), 3) end / 1e9::DOUBLE", 4)} as cube from customer""")
def q_protected_power(spark, sf_dir):
    power = lambda e: scalars.protected_power(F.col("c_acctbal"), F.lit(e))
    return table(spark, sf_dir, "customer").select("c_custkey", rounded(power(1 / 3), 6).alias("third"), rounded(power(2.0), 2).alias("square"), rounded(power(1.5), 2).alias("other"), rounded(power(3.0) / 1e9, 4).alias("cube"))


@query(f"select c_custkey, {r('c_acctbal - floor(c_acctbal / 7.0::DOUBLE) * 7.0::DOUBLE', 5)} as a, {r('c_acctbal - floor(c_acctbal / -7.0::DOUBLE) * -7.0::DOUBLE', 5)} as b from customer")
def q_floor_mod(spark, sf_dir):
    mod = lambda b: rounded(scalars.floor_mod(F.col("c_acctbal"), F.lit(b)), 5)
    return table(spark, sf_dir, "customer").select("c_custkey", mod(7.0).alias("a"), mod(-7.0).alias("b"))


@query(f"select {_KEY}, {r('least(-log10(greatest(1 - least(1 - l_discount, 1), 1e-15)), 10)', 6)} as strength, {r('greatest(1 - least(1 - l_discount, 1), 1e-15)', 8)} as nmse from lineitem")
def q_r2_strength(spark, sf_dir):
    r2 = 1 - F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(*KEY, rounded(scalars.strength(r2), 6).alias("strength"), rounded(scalars.nmse_of(r2), 8).alias("nmse"))


@query("select c_custkey, case when c_custkey % 702 < 26 then chr((97 + c_custkey % 702)::INT) else chr((96 + (c_custkey % 702) // 26)::INT) || chr((97 + (c_custkey % 702) % 26)::INT) end as name from customer")
def q_alpha_index(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.alphabetic(F.col("c_custkey") % 702).alias("name"))


@query("""select p_partkey, replace(regexp_replace(regexp_replace('y = ' || p_size || ' * x ^ ' || p_name, '^[^=]*=', ''), '\\s+', '', 'g'), '^', '**') as key from part""")
def q_text_key(spark, sf_dir):
    text = F.concat(F.lit("y = "), F.col("p_size").cast("string"), F.lit(" * x ^ "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", cells.text_key(text).alias("key"))


@query("select r_regionkey, array_to_string(list_filter(list_transform(regexp_split_to_array(r_name || ', a ;b,, c', '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') as names from region")
def q_name_parse(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.array_join(cells.names(F.concat("r_name", F.lit(", a ;b,, c"))), "|").alias("names"))


@query("select n_nationkey, 'a' as name, n_nationkey::DOUBLE as lo, (n_nationkey + 2.5)::DOUBLE as hi from nation union all select n_nationkey, 'b', -1.5::DOUBLE, (n_regionkey + 1e3)::DOUBLE from nation")
def q_range_parse(spark, sf_dir):
    text = F.concat(F.lit("a=["), F.col("n_nationkey").cast("string"), F.lit(", "), (F.col("n_nationkey") + 2.5).cast("string"), F.lit("], b in [-1.5,"), F.col("n_regionkey").cast("string"), F.lit(".0e0], ignored"))
    found = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(cells.ranges(text, strict=False)).alias("x")).select("n_nationkey", "x.*")
    return found.withColumn("hi", F.when(F.col("name") == "b", F.col("hi") + 1000).otherwise(F.col("hi")))


@query("select n_nationkey, 'c' as k, n_regionkey::DOUBLE as v from nation union all select n_nationkey, 'g', 9.81::DOUBLE from nation")
def q_constant_parse(spark, sf_dir):
    text = F.concat(F.lit("c="), F.col("n_regionkey").cast("string"), F.lit("; g = 9.81 m/s^2; odd"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(cells.constants(text)).alias("k", "v"))


@query("select n_nationkey, (n_regionkey + 1.5 + n_nationkey)::DOUBLE as total from nation")
def q_list_parse(spark, sf_dir):
    text = F.concat(F.lit("[["), F.col("n_regionkey").cast("string"), F.lit(", 1.5], ["), F.col("n_nationkey").cast("string"), F.lit(", ], ]"))
    values = F.flatten(cells.literal_list(text))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first from events")
def q_json_props(spark, sf_dir):
    m = cells.json_cell(F.col("props"), "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.get(F.map_values(m), F.lit(0)).alias("first"))


@query("select p_partkey, case when p_partkey % 3 = 0 then p_partkey::VARCHAR when p_partkey % 3 = 1 then '00' || p_partkey else '' end as id from part")
def q_id_normalise(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("double").cast("string"))).when(k % 3 == 1, F.concat(F.lit("00"), k.cast("string"), F.lit(" "))).otherwise("NaN")
    return table(spark, sf_dir, "part").select("p_partkey", cells.normal_id(raw).alias("id"))


@query("select event_type, count(*) as n, count(try_cast(left(event_id::VARCHAR, 2) || 'x' as DOUBLE)) as parsed from events group by 1")
def q_to_number(spark, sf_dir):
    text = F.concat(F.substring(F.col("event_id").cast("string"), 1, 2), F.lit("x"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(cells.to_number(text)).alias("parsed"))


# Equivalence, resume, noise


@query("""with t as (select doc_id, replace(regexp_replace(regexp_replace(coalesce(text, ''), '^[^=]*=', ''), '\\s+', '', 'g'), '^', '**') as k, row_number() over (order by doc_id) as eq_id from documents)
select doc_id, eq_id, case when k = '' or min(eq_id) over (partition by k) = eq_id then 0 else min(eq_id) over (partition by k) end as redundant from t""")
def q_dedup_pointer(spark, sf_dir):
    return dedup.exact_pointers(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 40)")
def q_resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("select o_orderkey, o_orderpriority from orders where o_totalprice > 400000 or o_custkey % 7 = 0")
def q_incomplete_rows(spark, sf_dir):
    a, b = F.when(F.col("o_totalprice") <= 4e5, F.col("o_totalprice")), F.when(F.col("o_custkey") % 7 == 0, float("nan")).otherwise(1.0)
    return relational.incomplete(table(spark, sf_dir, "orders").withColumns({"a": a, "b": b}), ["a", "b"]).select("o_orderkey", "o_orderpriority")


def _uniform(k: int, key: str) -> str:
    return f"(('0x' || substr(md5('{k}|' || {key}), 1, 8))::BIGINT % 65536)::DOUBLE / 65536.0"


@query(f"select o_orderkey, {r('o_totalprice * (1.0 + 0.01::DOUBLE * (' + ' + '.join(_uniform(k, 'o_orderkey') for k in range(12)) + ' - 6.0))', 3)} as noisy from orders")
def q_noise_deterministic(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", rounded(generate.hashed_noise(F.col("o_totalprice"), 0.01, F.col("o_orderkey").cast("string")), 3).alias("noisy"))


@query("select c_custkey, ('0x' || reverse_bytes_hex)::UBIGINT::DECIMAL(20,0) as seed from (select c_custkey, array_to_string(list_transform(range(8, 0, -1), lambda k: substr(h, 2 * k::INT - 1, 2)), '') as reverse_bytes_hex from (select c_custkey, sha256('BASE|' || c_name || '|' || c_nationkey) as h from customer))")
def q_seed_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.seed64(F.lit("BASE"), F.col("c_name"), F.col("c_nationkey").cast("string")).alias("seed"))


# Report tables


@query(f"""with v as (select l_linenumber / 100.0::DOUBLE as train_noise, l_suppkey % 5 / 100.0::DOUBLE as test_noise, case when l_discount > 0.01 then 1 - l_tax * 4 end as r2 from lineitem)
select train_noise, test_noise, count(*) as common_id_count, count(r2) as valid_count, count(*) - count(r2) as invalid_count, {r('quantile_cont(r2::DOUBLE, 0.5)', 6)} as median_r2, {r('quantile_cont(r2::DOUBLE, 0.1)', 6)} as q10_r2, {r('quantile_cont(r2::DOUBLE, 0.25)', 6)} as q25_r2,
{r('quantile_cont(r2::DOUBLE, 0.75)', 6)} as q75_r2, count(*) filter (r2 >= 0.9) as high_accuracy_count, {r('count(*) filter (r2 >= 0.9) / 59.0::DOUBLE', 8)} as high_accuracy_rate, count(*) filter (r2 > 0) as positive_r2_count, {r('count(*) filter (r2 > 0) / 59.0::DOUBLE', 8)} as positive_r2_rate from v group by all""")
def q_robustness_summary(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") / 100.0).alias("train_noise"), (F.col("l_suppkey") % 5 / 100.0).alias("test_noise"), F.when(F.col("l_discount") > 0.01, 1 - F.col("l_tax") * 4).alias("r2"))
    out = report.robustness_summary(long)
    return rounded_all(rounded_all(out, 6, "median_r2", "q10_r2", "q25_r2", "q75_r2"), 8, "high_accuracy_rate", "positive_r2_rate")


@query(f"""with t as (select 'P' || lpad((c_nationkey + 10)::VARCHAR, 2, '0') as "ID", case when min(c_acctbal) > -950 then max(c_acctbal) / 10000.0::DOUBLE else -1e100::DOUBLE end as v from customer group by 1)
select 'P' || lpad(i::VARCHAR, 2, '0') as "ID", {r('coalesce(case when v > -1e50 then least(greatest(v, 0), 1) end, 0)', 6)} as r2 from range(1, 60) x(i) left join t on t."ID" = 'P' || lpad(i::VARCHAR, 2, '0')""")
def q_heatmap_spine(spark, sf_dir):
    task = F.concat(F.lit("P"), F.lpad((F.col("c_nationkey") + 10).cast("string"), 2, "0")).alias("ID")
    rows = table(spark, sf_dir, "customer").groupBy(task).agg(F.when(F.min("c_acctbal") > -950, F.max("c_acctbal") / 10000.0).otherwise(-1e100).alias("r2"))
    return rounded_all(report.heatmap(rows, ["r2"]), 6, "r2")


@query(f"""with v as (select 'a' as level, 1 - l_tax * 3 as r2 from lineitem union all select 'b', case when l_discount > 0 then 1 - l_discount end from lineitem)
select level, {r('quantile_cont(r2::DOUBLE, 0.5)', 6)} as median, {r('quantile_cont(r2::DOUBLE, 0.25)', 6)} as q25, {r('quantile_cont(r2::DOUBLE, 0.75)', 6)} as q75, count(r2) as valid, """ + ", ".join(f"{r(f'100.0 * count(*) filter (r2 >= {t}) / count(*)', 6)} as success_{round(100 * t)}" for t in (0.9, 0.95, 0.99)) + " from v group by 1")
def q_level_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ID"), (1 - F.col("l_tax") * 3).alias("ra"), F.when(F.col("l_discount") > 0, 1 - F.col("l_discount")).otherwise(-1e100).alias("rb"))
    out = report.level_statistics(rows, {"a": "ra", "b": "rb"})
    return rounded_all(out, 6, "median", "q25", "q75", "success_90", "success_95", "success_99")


@query(f"""with v as (select l_suppkey, avg(1 - l_tax) as r2, avg(l_quantity) * 2 as s from lineitem group by 1) select count(*) as n, {r('corr(s, r2)', 6)} as pearson from v where r2 >= 0""")
def q_metric_report(spark, sf_dir):
    best = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg(1 - F.col("l_tax")).alias("r2"), (F.avg("l_quantity") * 2).alias("s"))
    out = report.metric_report(best, "l_suppkey", "s", "r2")["association"]
    return out.select("n", rounded(F.col("pearson"), 6).alias("pearson"))


# Not expressible in SQL: checked by tests


def _samples(spark: SparkSession, sf_dir: str, number: Column | None = None) -> DataFrame:
    """Lines as datasets of one problem: a group for each flag and status."""
    rows = table(spark, sf_dir, "lineitem")
    grp = F.dense_rank().over(W.orderBy(*LINE)) - 1
    groups = rows.select(*LINE).distinct().withColumn("grp", grp.cast("int"))
    return rows.join(F.broadcast(groups), LINE).select(F.lit("P01").alias("id"), "grp", (F.xxhash64(*KEY) if number is None else number).alias("row_idx"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), (F.col("l_extendedprice") / 1000.0).alias("y"))


def _formulas(spark: SparkSession) -> DataFrame:
    rows = [("P01", "line", "p0*q + p1", ["p0", "p1"], [1.0, 0.0]), ("P01", "power", "p0*q**p1", ["p0", "p1"], [1.0, 1.0]), ("P01", "bent", "p0*q/(1 + p1*d) + p2", ["p0", "p1", "p2"], [1.0, 0.1, 0.0]), ("P01", "lost", "p0*z", ["p0"], [1.0])]
    return spark.createDataFrame(rows, "id string, formula_id string, formula string, para_list array<string>, orgpara_list array<double>")


@query()
def q_nonlinear_fit(spark, sf_dir):
    return fitting.fit_groups(_samples(spark, sf_dir), _formulas(spark), ["q", "d"], order="row_idx")


@query()
def q_fit_by_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000.0).alias("y"))
    return fitting.fit_by_sums(rows, LINE, "p0*q**p1", {"p0": 1.0, "p1": 1.0}, {"q": F.col("q")}, "y", tolerance=1e-8)


@query()
def q_multistart(spark, sf_dir):
    bad = spark.createDataFrame([("P01", "log", "p0*log(p1*q)", ["p0", "p1"], [1.0, -1.0])], "id string, formula_id string, formula string, para_list array<string>, orgpara_list array<double>")
    return fitting.fit_groups(_samples(spark, sf_dir), bad, ["q", "d"], retries=8, order="row_idx")


@query()
def q_bounded_fit(spark, sf_dir):
    free = spark.createDataFrame([("P01", "free", "k*q**m", [], [])], "id string, formula_id string, formula string, para_list array<string>, orgpara_list array<double>")
    return fitting.fit_groups(_samples(spark, sf_dir), free, ["q", "d"], ranges={"k": (0.1, 5.0), "m": (0.5, 1.5)}, bounded=True, protected=True, retries=0, order="row_idx", strict=False)


@query("""with p as (select p_brand as file, p_partkey as row_idx, p_partkey % 4 as k, p_size::VARCHAR as n from part),
t as (select file, row_idx, k, n, case k when 0 then n || '*x + x*y' when 1 then 'x*(y + ' || n || ')' when 2 then 'sin(x)*cos(y)*2 + 0*' || n else 'sin(x + y) + sin(x - y)' end as para_eq, row_number() over (partition by file order by row_idx) as eq_id from p),
f as (select *, min(eq_id) over (partition by file, case when k < 2 then n else 'wave' end) as first from t)
select file, row_idx, para_eq, eq_id, case when first = eq_id then 0 else first end as redundant from f""")
def q_canonical_equiv(spark, sf_dir):
    n = F.col("p_size").cast("string")
    shapes = F.element_at(F.array(F.concat(n, F.lit("*x + x*y")), F.concat(F.lit("x*(y + "), n, F.lit(")")), F.concat(F.lit("sin(x)*cos(y)*2 + 0*"), n), F.lit("sin(x + y) + sin(x - y)")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("row_idx"), shapes.alias("para_eq"))
    return dedup.mark(rows, "para_eq")


@query(f"""select p_partkey, p_size || '*x**2 - ' || p_retailprice || '*sin(x) + ' || p_size as equation, case when p_size = 2 then 'p0*x**p0 + p1*(p2*sin(x)) + p0' else 'p0*x**p1 + p2*(p3*sin(x)) + p0' end as para_eq,
case when p_size = 2 then 'p0,p1,p2' else 'p0,p1,p2,p3' end as para_list, {r('p_size + case when p_size = 2 then 0 else 2 end - 1 + p_retailprice', 3)} as total from part""")
def q_generalise(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("*x**2 - "), F.col("p_retailprice").cast("string"), F.lit("*sin(x) + "), F.col("p_size").cast("string")).alias("equation"))
    out = search.generalised(rows)
    total = F.aggregate("orgpara_list", F.lit(0.0), lambda a, x: a + x)
    return out.select("p_partkey", "equation", "para_eq", F.array_join("para_list", ",").alias("para_list"), rounded(total, 3).alias("total"))


@query()
def q_search(spark, sf_dir):
    """Each flag and status is a problem of its own."""
    rows = _samples(spark, sf_dir).withColumn("id", F.concat("id", F.lit("-"), F.col("grp").cast("string")))
    return search.front(search.search_dataset(rows, ["q", "d"], 0, search.Settings(iterations=1, islands=2, population=20)))


_NOISE = "select l_returnflag, l_linestatus, l_orderkey * 8 + l_linenumber as row_idx, l_extendedprice / 1000.0::DOUBLE as y, (dense_rank() over (order by l_returnflag, l_linestatus) - 1)::INT as grp from lineitem"


@query(f"""with z as ({counters.sql_normals(_NOISE, "'7|0.03|P01|' || grp", 'row_idx', 'draw')})
select 'noise_0.03' as variant, 'P01' as id, grp, row_idx, {r('y + 0.03::DOUBLE * stddev_pop(y) over (partition by grp) * draw', 5)} as y from z""")
def q_noise_streams(spark, sf_dir):
    """Noise of a part of each group's deviation, each row's draw from its own counter."""
    rows = _samples(spark, sf_dir, F.col("l_orderkey") * 8 + F.col("l_linenumber")).select(F.lit("base").alias("variant"), "id", "grp", "row_idx", F.create_map(F.lit("q"), "q").alias("x"), "y")
    return generate.add_noise(rows, "0.03", "dataset-std", 7).select("variant", "id", "grp", "row_idx", rounded(F.col("y"), 5).alias("y"))


def spec_rows(spark: SparkSession) -> DataFrame:
    """Two small problems, for the tests."""
    from fitloom.schemas import PROBLEMS

    line = ("P01", "line", "y = a*x + b", "y = a*x + b", "a*x + b", "y", ["x"], [("a", 1.0, 4.0), ("b", 0.5, 2.0)], {}, [], [[2.0, 1.0], [3.0, 0.5]], [[(0.0, 5.0)]] * 2, [(-100.0, 100.0)] * 2)
    root = ("P02", "root", "y = c*sqrt(x - a)", "y = c*sqrt(x - a)", "", "y", ["x"], [("a", 0.0, 2.0)], {"c": 1.5}, ["c"], [[1.0], [1.5]], [[(0.0, 5.0)]] * 2, [(0.0, 10.0)] * 2)
    return spark.createDataFrame([line, root], PROBLEMS)


def generalise_text(text: str) -> str:
    return show(generalise(parse(text))[0])

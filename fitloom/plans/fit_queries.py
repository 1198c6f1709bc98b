"""Queries of fits, rankings, equivalence and generation whose results are known in closed form, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.functions import sql
from fitloom.functions.scalars import ERROR_R2, rounded
from fitloom.operators import dedup, fitting, generate, metrics, ranking, sums
from fitloom.plans.cell_queries import text
from fitloom.plans.registry import query, r, rounded_all, table
from fitloom.schemas import PROBLEMS
from fitloom.sources import sinks

FORMULA = "id string, formula_id string, formula string, para_list array<string>, orgpara_list array<double>"


def exact_samples(spark, sf_dir):
    """Parts as datasets of two problems and two groups, with targets that a formula meets exactly."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 2).cast("int").alias("grp"))
    a = rows.select(F.lit("A").alias("id"), "grp", F.col("p_partkey").alias("row_idx"), "x", F.lit(None).cast("double").alias("z"), ((F.col("grp") + 2) * F.pow("x", F.lit(1.5)) + 3).alias("y"))
    b = rows.select(F.lit("B").alias("id"), "grp", F.col("p_partkey").alias("row_idx"), F.lit(None).cast("double").alias("x"), F.col("x").alias("z"), (5 * F.exp(-F.col("x") / (F.col("grp") + 10)) + 9.5).alias("y"))
    return a.unionByName(b)


_RECOVERED = """select f.id, f.formula_id, g.grp::INT as grp, f.ok, case when f.formula_id = 'true' then (case f.id when 'A' then (g.grp + 2)::DOUBLE when 'B' then 5.0::DOUBLE end) end as p0, case when f.formula_id = 'true' then (case f.id when 'A' then 1.5::DOUBLE else round(-1.0::DOUBLE / (g.grp + 10), 4) end) end as p1,
case when f.ok then 1.0::DOUBLE else -1e100::DOUBLE end as r2, f.error from (values ('A', 'true', true, ''), ('A', 'lost', false, 'unknown name z'), ('A', 'unused', false, 'parameters that don''t occur: p1'), ('B', 'true', true, ''), ('B', 'bad', false, 'a parenthesis is not closed')) f(id, formula_id, ok, error), (values (0), (1)) g(grp)"""


def recovered(spark, sf_dir, fit):
    """Formulas of two problems, each with its own variables and constants, some of which can't be prepared."""
    formulas = spark.createDataFrame(
        [
            ("A", "true", "p0*x**p1 + k", ["p0", "p1"], [1.0, 1.0]), ("A", "lost", "p0*z", ["p0"], [1.0]), ("A", "unused", "p0*x", ["p0", "p1"], [1.0, 1.0]),
            ("B", "true", "p0*exp(p1*z) + k", ["p0", "p1"], [1.0, -0.05]), ("B", "bad", "p0*(z", ["p0"], [1.0]),
        ], FORMULA,
    )
    own = F.when(F.col("id") == "A", F.array(F.lit("x"))).otherwise(F.array(F.lit("z")))
    constants = F.create_map(F.lit("k"), F.when(F.col("id") == "A", 3.0).otherwise(9.5))
    out = fit(exact_samples(spark, sf_dir), formulas.withColumn("variables", own).withColumn("constants", constants), ["x", "z"])
    parameter = lambda i: F.when(F.col("ok"), rounded(F.get("params", F.lit(i)), 4)).alias(f"p{i}")
    return out.select("id", "formula_id", "grp", "ok", parameter(0), parameter(1), F.when(F.col("ok"), rounded(F.col("r2"), 6)).otherwise(F.col("r2")).alias("r2"), "error")


@query(_RECOVERED)
def q_fit_recovers(spark, sf_dir):
    """Nonlinear fits find the parameters that made the targets; formulas that can't be prepared fail alone."""
    return recovered(spark, sf_dir, lambda *a: fitting.fit_groups(*a, order="row_idx"))


@query(_RECOVERED)
def q_sums_recover(spark, sf_dir):
    """The same by rounds of sums."""
    return recovered(spark, sf_dir, sums.fit_sums)


def line_samples(spark, sf_dir):
    """All lines, each flag and status a problem of one dataset."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("id"), F.lit(0).alias("grp"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"), (F.col("l_extendedprice") / 1000.0).alias("y"))


def for_all(spark, samples, formulas):
    """``formulas`` (formula_id, formula, names, initial values) of each problem of ``samples``."""
    return samples.select("id").distinct().join(F.broadcast(spark.createDataFrame(formulas, "formula_id string, formula string, para_list array<string>, orgpara_list array<double>")))  # a row a formula


@query(f"""with s as (select l_returnflag || '-' || l_linestatus as id, l_quantity as q, l_extendedprice / 1000.0::DOUBLE as y from lineitem),
f as (select id, 'line' as formula_id, regr_slope(y, q) as p0, regr_intercept(y, q) as p1, regr_r2(y, q) as r2 from s group by id
  union all select id, 'root', sum(sqrt(q) * y) / sum(q), null, 1 - (sum(y * y) - sum(sqrt(q) * y) * sum(sqrt(q) * y) / sum(q)) / (var_pop(y) * count(*)) from s group by id
  union all select id, 'mean', avg(y), null, 0 from s group by id)
select id, formula_id, 0 as grp, {r('p0', 4)} as p0, {r('p1', 4)} as p1, {r('r2', 5)} as r2, true as ok from f""")
def q_sums_of_all_lines(spark, sf_dir):
    """Three formulas on all lines of each problem by the same scans; closed forms are known."""
    rows = line_samples(spark, sf_dir)
    out = sums.fit_sums(rows, for_all(spark, rows, [("line", "p0*q + p1", ["p0", "p1"], [1.0, 0.0]), ("root", "p0*sqrt(q)", ["p0"], [1.0]), ("mean", "p0 + 0*q", ["p0"], [1.0])]), ["q"])
    return out.select("id", "formula_id", "grp", *(rounded(F.get("params", F.lit(i)), 4).alias(f"p{i}") for i in (0, 1)), rounded(F.col("r2"), 5).alias("r2"), "ok")


@query(f"""with s as (select l_returnflag || '-' || l_linestatus as id, l_quantity as q, l_discount * 100 as d, l_extendedprice / 1000.0::DOUBLE as y from lineitem),
f as (select id, 'corner' as formula_id, 1.0::DOUBLE as k, 50.0::DOUBLE as m, avg(y - q - 50 * d) as c from s group by id
  union all select id, 'edge', 1.0::DOUBLE, regr_slope(y - q, d), regr_intercept(y - q, d) from s group by id)
select id, formula_id, {r('k', 4)} as k, {r('m', 4)} as m, {r('c', 3)} as c from f""")
def q_fit_box(spark, sf_dir):
    """Least squares whose optimum is a corner of the box, and one whose optimum lies along a face: the free parameters are those of the
    problem with the others held at their bounds."""
    rows = line_samples(spark, sf_dir)
    box = lambda *x: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, lo, hi in x))
    corner, edge = box(("c", -500, 500), ("k", 1, 5), ("m", 50, 60)), box(("c", -500, 500), ("k", 1, 5), ("m", -50, 50))
    formulas = for_all(spark, rows, [("corner", "k*q + m*d + c", [], []), ("edge", "k*q + m*d + c", [], [])])
    out = sums.fit_sums(rows, formulas.withColumn("ranges", F.when(F.col("formula_id") == "corner", corner).otherwise(edge)), ["q", "d"], bounded=True, retries=1, strict=False)
    c, k, m = (F.get("params", F.lit(i)) for i in range(3))
    return out.select("id", "formula_id", rounded(k, 4).alias("k"), rounded(m, 4).alias("m"), rounded(c, 3).alias("c"))


@query("""select 'A' as id, grp::INT as grp, least(grp + 2, 2.5)::DOUBLE as k, grp = 0 as exact from (values (0), (1)) g(grp)""")
def q_fit_bounds(spark, sf_dir):
    """Names without a value become parameters within their ranges; where the best value lies outside, the bound is taken."""
    ranges = F.array(F.struct(F.lit("k").alias("name"), F.lit(0.5).alias("lo"), F.lit(2.5).alias("hi")))
    formulas = spark.createDataFrame([("A", "f", "k*x**1.5 + 3", [], [])], FORMULA).withColumn("ranges", ranges)
    out = fitting.fit_groups(exact_samples(spark, sf_dir), formulas, ["x"], bounded=True, protected=True, retries=0, order="row_idx", strict=False)
    return out.select("id", "grp", rounded(F.get("params", F.lit(0)), 5).alias("k"), (F.col("r2") > 1 - 1e-9).alias("exact"))


@query(f"""with s as (select (p_partkey % 2)::INT as grp, p_size::DOUBLE as x from part), t as (select grp, x, (grp + 2) * pow(x, 1.5) + 3 as y from s)
select 'A' as id, grp, {r('avg((y - 2 * x) * (y - 2 * x))', 2)} as mse, {r('1 - sum((y - 2 * x) * (y - 2 * x)) / (var_pop(y) * count(*))', 6)} as r2 from t group by grp""")
def q_fit_without_parameters(spark, sf_dir):
    formulas = spark.createDataFrame([("A", "f", "2*x", [], [])], FORMULA)
    out = fitting.fit_groups(exact_samples(spark, sf_dir), formulas, ["x"], order="row_idx")
    return out.select("id", "grp", rounded(F.col("mse"), 2).alias("mse"), rounded(F.col("r2"), 6).alias("r2"))


def problems(spark, sf_dir, lo: float, hi: float):
    """A problem of two groups for each nation: lines for even ones, products with a constant variable for odd ones."""
    k, even = F.col("n_nationkey"), F.col("n_nationkey") % 2 == 0
    pair = lambda a, b: F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
    formula, own = F.when(even, "y = a*x + c").otherwise("y = a*x*z"), F.when(even, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(2, 2)))
    columns = {
        "id": text("N", k), "model_name": F.col("n_name"), "original_formula": formula, "generation_formula": formula, "simp_formula": F.lit(""), "target": F.lit("y"),
        "variables": F.when(even, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("z"))), "params": F.array(F.struct(F.lit("a").alias("name"), F.lit(1.0).alias("lo"), F.lit(40.0).alias("hi"))),
        "constants": F.map_filter(F.create_map(F.lit("c"), k * 0.5), lambda name, value: even), "constant_order": F.when(even, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")),
        "para_values": F.array(F.array(k + F.lit(2.0)), F.array(k + F.lit(3.0))), "var_ranges": F.array(own, own), "target_ranges": F.array(pair(-1e6, 1e6), pair(-1e6, 1e6)),
    }
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(PROBLEMS).fields}
    return table(spark, sf_dir, "nation").select(*(c.cast(kinds[n]).alias(n) for n, c in columns.items()))


def true_value():
    """What a nation's formula makes of its samples."""
    k = F.substring("id", 2, 9).cast("int")
    x = F.col("x")["x"]
    return F.when(k % 2 == 0, (k + 2.0 + F.col("grp")) * x + k * 0.5).otherwise((k + 2.0 + F.col("grp")) * x * 2)


_GROUPS = "(select 'N' || n_nationkey as id, n_nationkey as k from nation) n, (values (0), (1)) g(grp)"


@query(f"select id, grp::INT as grp, 40::BIGINT as n, 1.0::DOUBLE as r2, true as exact from {_GROUPS}")
def q_baseline(spark, sf_dir):
    """The true formulas fit the data that they generate."""
    specs = problems(spark, sf_dir, 0.5, 3.0)
    rows = sinks.between(generate.generate(specs, 40))
    wide = rows.select("id", "grp", "row_idx", F.try_element_at("x", F.lit("x")).alias("x"), F.try_element_at("x", F.lit("z")).alias("z"), "y")
    out = fitting.baseline(wide, specs, ["x", "z"], retries=0, order="row_idx")
    return out.join(rows.groupBy("id", "grp").agg(F.count("*").alias("n")), ["id", "grp"]).select("id", "grp", "n", rounded(F.col("r2"), 6).alias("r2"), F.col("ok").alias("exact"))


@query(f"select 'base' as variant, id, grp::INT as grp, i as row_idx, 1.25::DOUBLE as x, (case when k % 2 = 0 then (k + 2 + grp) * 1.25 + k * 0.5 else (k + 2 + grp) * 1.25 * 2 end)::DOUBLE as y from {_GROUPS}, range(0, 25) x(i)")
def q_generate_constant(spark, sf_dir):
    """Ranges of one value give constant columns, for all problems and groups."""
    return generate.generate(problems(spark, sf_dir, 1.25, 1.25), 25).select("variant", "id", "grp", "row_idx", F.col("x")["x"].alias("x"), "y")


@query(f"select id, grp::INT as grp, 200::BIGINT as n, true as inside, true as fits from {_GROUPS}")
def q_generate_checked(spark, sf_dir):
    """What rejection sampling draws lies in its ranges and fits its formula."""
    rows = generate.generate(problems(spark, sf_dir, 0.5, 3.0), 200)
    return rows.groupBy("id", "grp").agg(F.count("*").alias("n"), F.bool_and(F.col("x")["x"].between(0.5, 3.0)).alias("inside"), F.bool_and(F.abs(true_value() - F.col("y")) < 1e-9).alias("fits"))


@query(f"select id, grp::INT as grp, 50::BIGINT as n, true as inside, true as fits from {_GROUPS}")
def q_generate_shift_checked(spark, sf_dir):
    rows = generate.generate(problems(spark, sf_dir, 3.0, 5.0), 50, "shift", 7, variant="wass_04")
    return rows.groupBy("id", "grp").agg(F.count("*").alias("n"), F.bool_and(F.col("x")["x"].between(3.0, 5.0)).alias("inside"), F.bool_and(F.abs(true_value() - F.col("y")) < 1e-9).alias("fits"))


@query(f"select n_nationkey, 300::BIGINT as n, true as inside, true as fits, (case when n_nationkey = 0 then {ERROR_R2!r} else 1 end)::DOUBLE as r2 from nation")
def q_sql_sampler(spark, sf_dir):
    """Samples and their scores by SQL alone: a table function beside each nation, and the rules of the fits over aggregates."""
    sql.register(spark)
    rows = table(spark, sf_dir, "nation")
    return spark.sql("""
        WITH s AS (SELECT n.n_nationkey AS k, t.* FROM {nations} n, LATERAL sample_formula(n.n_name, concat(n.n_nationkey, '*x + sqrt(x - 1)*0 + 2'), 0.5D, 3D, 300) t)
        SELECT k AS n_nationkey, count(*) AS n, bool_and(x BETWEEN 1 AND 3) AS inside, bool_and(abs(y - (k * x + 2)) < 1e-9) AS fits,
          r2_of(round(sum(pow(y - (k * x + if(k = 0, 1, 2)), 2)), 6), round(var_pop(y) * count(*), 6)) AS r2 FROM s GROUP BY k""", nations=rows)


@query()
def q_generate(spark, sf_dir):
    return generate.generate(problems(spark, sf_dir, 0.5, 3.0), 500)


@query()
def q_generate_shifted(spark, sf_dir):
    return generate.generate(problems(spark, sf_dir, 3.0, 5.0), 500, "shift", 42, variant="wass_025")


@query("select 'N' || c_nationkey as id, (c_custkey % 4 - 1)::INT as grp, c_custkey as row_idx, case when c_custkey % 3 > 0 then c_acctbal end as y from customer where c_custkey % 4 between 1 and 2")
def q_noise_of_nothing(spark, sf_dir):
    """Level 0 leaves targets as they are, blank ones too; groups of a range are numbered from 0."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.lit("base").alias("variant"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("id"), (k % 4).cast("int").alias("grp"), k.alias("row_idx"), F.create_map(F.lit("x"), k.cast("double")).alias("x"), F.when(k % 3 > 0, F.col("c_acctbal")).alias("y"))
    return generate.add_noise(rows, "0", "absolute", 3, 1, 2).select("id", "grp", "row_idx", "y")


@query("select (p_partkey % 2)::VARCHAR as variant, 'P' as id, 0 as grp, count(*) as rows, min(p_retailprice) as least, max(p_retailprice) as most from part group by 1")
def q_sample_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2).cast("string").alias("variant"), F.lit("P").alias("id"), F.lit(0).alias("grp"), F.col("p_retailprice").alias("y"))
    return generate.summary(rows)


# Candidates and leaders


@query("select c_nationkey, c_custkey, rank from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as rank from customer where c_custkey % 50 between 7 and 35) where rank <= 4")
def q_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 50).alias("complexity"), F.col("c_acctbal").alias("loss"))
    return ranking.candidates(rows, ["c_nationkey"], 4, first="c_custkey").select("c_nationkey", "c_custkey", "rank")


@query("select c_custkey, 0::BIGINT as redundant from customer where c_custkey % 4 = 0")
def q_leaders(spark, sf_dir):
    return ranking.leaders(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).cast("double").alias("redundant")))


_TOP = """select 'P' || o_custkey as "ID", o_orderkey as src_row, "TopRank" from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as "TopRank" from orders where o_orderkey % 3 <> 0 and o_orderkey % 7 <> 1 and o_orderkey % 7 <> 2) where "TopRank" <= 3"""


def top_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    mse = F.when(k % 7 == 1, 1e100).when(k % 7 == 2, float("nan")).otherwise(F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("ID"), k.alias("src_row"), F.when(k % 3 == 0, 5).otherwise(0).alias("redundant"), mse.alias("shared_fit_mse_0_7"))
    return ranking.top_formulas(rows, 3)


@query(_TOP)
def q_top_formulas(spark, sf_dir):
    return ranking.by_id_and_rank(top_orders(spark, sf_dir)).select("ID", "src_row", "TopRank")


@query(f'select "ID", src_row from ({_TOP}) where "TopRank" = 2')
def q_ranked_rows(spark, sf_dir):
    return ranking.ranked_rows(top_orders(spark, sf_dir), 2).select("ID", "src_row")


# Equivalence


_SHAPES = """with p as (select p_brand as file, p_partkey as row_idx, p_size as n, p_partkey % 5 as k from part),
t as (select *, row_number() over (partition by file order by row_idx) as eq_id, case k when 0 then 'sum' || n when 1 then 'sum' || n when 2 then 'root' when 3 then 'plain' else 'none' || row_idx end as class from p)"""


def shapes(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    formula = F.when(k == 0, F.concat(F.lit("y = x + "), n)).when(k == 1, F.concat(n, F.lit(" + x"))).when(k == 2, "sqrt(x^2)").when(k == 3, "x").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("row_idx"), formula.alias("para_eq"))


@query(_SHAPES + ", f as (select *, min(eq_id) over (partition by file, class) as first from t) select file, row_idx, eq_id, case when first = eq_id then 0 else first end as redundant from f")
def q_mark_exact(spark, sf_dir):
    """By exact keys: the root of a square is not the number itself; rows without a formula stand for themselves."""
    return dedup.mark(shapes(spark, sf_dir), "para_eq", compare=False).select("file", "row_idx", "eq_id", "redundant")


@query("""with t as (select p_brand as file, p_partkey as row_idx, case p_partkey % 7 when 3 then 'n' || (p_size + 1) when 4 then 'n' || (p_size + 1) when 5 then 'exp' when 6 then 'exp' else 'x' end as class, row_number() over (partition by p_brand order by p_partkey) as eq_id from part),
f as (select *, min(eq_id) over (partition by file, class) as first from t) select file, row_idx, eq_id, case when first = eq_id then 0 else first end as redundant from f""")
def q_mark_rewritten(spark, sf_dir):
    """Formulas that are one after names cancel, squares of sines and cosines add up, roots and exponentials multiply."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    text = F.when(k == 0, "x + y - y").when(k == 1, F.concat(n, F.lit("*x/"), n)).when(k == 2, "sqrt(x)*sqrt(x)").when(k == 3, F.concat(F.lit("sin(y)^2 + cos(y)^2 + "), n)).when(k == 4, (F.col("p_size") + 1).cast("string")).when(k == 5, "exp(y)*exp(x)*exp(-y)").otherwise("exp(x)")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("row_idx"), text.alias("para_eq"))
    return dedup.mark(rows, "para_eq").select("file", "row_idx", "eq_id", "redundant")


@query(_SHAPES + ", f as (select *, min(eq_id) over (partition by file, class) as first from t where row_idx % 11 <> 0) select file, row_idx, (case when row_idx % 11 = 0 then 1 else 0 end)::BIGINT as redundant from t where row_idx % 11 = 0 union all select file, row_idx, (case when first = eq_id then 0 else 1 end)::BIGINT from f")
def q_mark_candidates(spark, sf_dir):
    """The flag inside a candidate set: rows that are marked already stay so and stand for nobody."""
    rows = shapes(spark, sf_dir).withColumn("redundant", F.when(F.col("row_idx") % 11 == 0, 1).otherwise(0).cast("long"))
    return dedup.mark_candidates(rows, "para_eq", ["file"], "row_idx").select("file", "row_idx", "redundant")


@query(_SHAPES + ", f as (select *, min(eq_id) over (partition by file, class) as first from t) select count(*) as rows, count(*) filter (first = eq_id) as representatives, count(*) filter (first <> eq_id) as redundant from f")
def q_mark_statistics(spark, sf_dir):
    return dedup.statistics(dedup.mark(shapes(spark, sf_dir), "para_eq"))


@query(_SHAPES + ", f as (select *, min(eq_id) over (partition by file, class) as first from t) select file, eq_id, 'points to no representative' as problem from f where first % 2 = 0 union all select file, eq_id, 'points to no smaller id' from f where first = eq_id and eq_id % 2 = 0")
def q_check_marks(spark, sf_dir):
    """Marks that are broken on purpose: every second representative points to itself."""
    marked = dedup.mark(shapes(spark, sf_dir), "para_eq")
    broken = F.when((F.col("redundant") == 0) & (F.col("eq_id") % 2 == 0), F.col("eq_id")).otherwise(F.col("redundant"))
    return dedup.check_marks(marked.withColumn("redundant", broken)).select("file", "eq_id", "problem")


@query("select count(*) as formulas, count(*) filter (parsed) as parsed from (select distinct case p_partkey % 5 when 0 then 'x+' || p_size when 1 then p_size || '+x' when 2 then 'sqrt(x**2)' when 3 then 'x' end as t, true as parsed from part) where t is not null")
def q_formula_keys(spark, sf_dir):
    """Each distinct text of all files is brought to its keys once."""
    return dedup.formula_keys(shapes(spark, sf_dir), "para_eq").agg(F.count("*").alias("formulas"), F.count_if("parsed").alias("parsed"))


@query("select c_nationkey, case when bool_and(c_acctbal > -900) then floor(avg(c_acctbal) * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE else 1e100::DOUBLE end as mse from customer group by 1")
def q_undiluted(spark, sf_dir):
    """A mean that one failure turns into exactly the marker."""
    out = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(metrics.undiluted(F.col("c_acctbal"), F.col("c_acctbal") > -900, 1e100).alias("mse"))
    return out.select("c_nationkey", F.when(F.col("mse") < 1e99, rounded(F.col("mse"), 4)).otherwise(F.col("mse")).alias("mse"))


@query(f"select count(*) as n, {r('corr(a, b)', 8)} as pearson from (select l_quantity as a, case when l_discount > 0.03 then l_extendedprice end as b from lineitem) where b is not null")
def q_paired_rows(spark, sf_dir):
    """Rows of which either value is missing or not finite are left out."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice")).when(F.col("l_tax") > 0.02, float("nan")).alias("b"))
    return rounded_all(metrics.association(rows, "a", "b").select("n", "pearson"), 8, "pearson")

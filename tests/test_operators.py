import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.operators import dedup, fitting, generate, metrics, ranking, relational, report, search
from fitloom.plans.catalogue import spec_rows


def test_all_or_nothing_and_lists(spark):
    rows = [("a", 0, True, 1.0, 0.5, False), ("a", 1, True, 4.0, 0.7, True), ("b", 0, True, 1.0, 0.9, False), ("b", 1, False, None, None, True)]
    out = {r["f"]: r for r in metrics.all_or_nothing(spark.createDataFrame(rows, "f string, grp int, ok boolean, mse double, r2 double, retry_used boolean"), ["f"]).collect()}
    assert out["a"]["mse"] == 2.5 and out["a"]["mse_hmean"] == 1.6 and math.isclose(out["a"]["mse_rms"], math.sqrt(8.5)) and out["a"]["retry_groups"] == [1]
    assert out["b"]["mse"] == 1e100 and out["b"]["r2"] == -1e100 and out["b"]["failed_groups"] == [1] and out["b"]["success_groups"] == [0]


def test_harmonic_mean_needs_positive_values(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert df.agg(metrics.harmonic(F.col("x"))).first()[0] == 1e100


def test_constant_target(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0)], "k string, y double, fitted double")
    out = {r["k"]: r for r in metrics.fit_metrics(df, ["k"]).collect()}
    assert out["a"]["r2"] == 1.0 and out["a"]["nmse"] == 0.0 and out["b"]["r2"] == -1e100 and out["b"]["nmse"] is None
    strict = {r["k"]: r for r in metrics.fit_metrics(df, ["k"], constant_target="strict").collect()}
    assert strict["a"]["ok"] and not strict["b"]["ok"]


def test_failed_prediction_fails_the_group(spark):
    df = spark.createDataFrame([("a", 1.0, float("nan")), ("a", 2.0, 2.0)], "k string, y double, fitted double")
    assert not metrics.fit_metrics(df, ["k"]).first()["ok"]


def exact_p(r, n):
    """Student's two-sided probability by its finite sums."""
    v, r = n - 2, abs(r)
    rest, term = 1 - r * r, 1.0
    if v % 2 == 0:
        total = 0.0
        for k in range(v // 2):
            total += term
            term *= (2 * k + 1) / (2 * k + 2) * rest
        return 1 - r * total
    total, term = 0.0, math.sqrt(rest)
    for k in range((v - 1) // 2):
        total += term
        term *= (2 * k + 2) / (2 * k + 3) * rest
    return 1 - 2 / math.pi * (math.asin(r) + r * total)


def test_p_of_correlations(spark):
    from fitloom.functions.special import correlation_p

    rows = [(r, n) for r in (0.0, 0.01, -0.2, 0.5, 0.73, -0.9, 0.999) for n in (3, 4, 5, 8, 20, 101, 1000, 20_000)]
    out = spark.createDataFrame(rows, "r double, n long").select("r", "n", correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert all(math.isclose(x["p"], exact_p(x["r"], x["n"]), rel_tol=1e-7, abs_tol=1e-11) for x in out), [(x, exact_p(x["r"], x["n"])) for x in out if not math.isclose(x["p"], exact_p(x["r"], x["n"]), rel_tol=1e-7, abs_tol=1e-11)]
    known = {(0.5, 20): 0.0247689}
    assert all(math.isclose(x["p"], known[x["r"], x["n"]], rel_tol=1e-4) for x in out if (x["r"], x["n"]) in known)
    odd = spark.createDataFrame([(1.0, 9), (-1.0, 4), (0.3, 2), (None, 9)], "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert [x["p"] for x in odd[:2]] == [0.0, 0.0] and math.isnan(odd[2]["p"]) and odd[3]["p"] is None
    small = spark.createDataFrame([(0.9, 100)], "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert 0 < small < 1e-30


def test_association_by_group(spark):
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][i % 3], float(rng.integers(0, 9)), float(rng.normal()) if i % 7 else None) for i in range(200)] + [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    out = {r["k"]: r for r in metrics.association(spark.createDataFrame(rows, "k string, a double, b double"), "a", "b", ("k",)).collect()}
    for k in ("a", "b", None):
        x, y = np.array([r[1:] for r in rows if r[0] == k and r[2] is not None]).T
        rank = lambda v: np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])
        r, rho = np.corrcoef(x, y)[0, 1], np.corrcoef(rank(x), rank(y))[0, 1]
        got = out[k]
        assert got["n"] == len(x) and math.isclose(got["pearson"], r, rel_tol=1e-9) and math.isclose(got["spearman"], rho, rel_tol=1e-9)
        assert math.isclose(got["pearson_p"], exact_p(r, len(x)), rel_tol=1e-7) and math.isclose(got["spearman_p"], exact_p(rho, len(x)), rel_tol=1e-7)
    assert out["flat"]["pearson"] is None and out["flat"]["pearson_p"] is None and out["one"]["n"] == 1


def test_threefry_gives_the_published_words(spark):
    from fitloom.functions.counters import threefry

    known = [((0, 0), (0, 0), (0x6B200159, 0x99BA4EFE)), ((0xFFFFFFFF,) * 2, (0xFFFFFFFF,) * 2, (0x1CB996FC, 0xBB002BE7)), ((0x13198A2E, 0x03707344), (0x243F6A88, 0x85A308D3), (0xC4923A9C, 0x483DF7A0))]
    df = spark.createDataFrame([(i, *k, *c) for i, (k, c, _) in enumerate(known)], "i int, a long, b long, c long, d long")
    out = df.select("i", threefry((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias("w")).orderBy("i").collect()
    assert [tuple(r["w"]) for r in out] == [w for _, _, w in known]


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from fitloom.functions.counters import normal_quantile, uniform

    us = [1e-300, 1e-16, 1e-9, 1e-4, 0.01, 0.0749999, 0.075, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-9]
    out = spark.createDataFrame([(u,) for u in us], "u double").select("u", normal_quantile(F.col("u")).alias("z")).collect()
    assert all(math.isclose(r["z"], NormalDist().inv_cdf(r["u"]), rel_tol=1e-9, abs_tol=1e-12) for r in out)
    ends = spark.createDataFrame([(0, 0), (0xFFFFFFFF, 0xFFFFFFFF)], "a long, b long").select(uniform(F.col("a"), F.col("b")).alias("u")).collect()
    assert 0 < ends[0]["u"] and ends[1]["u"] < 1


def test_counter_draws_are_normal_in_the_tails(spark):
    from statistics import NormalDist

    from fitloom.functions.counters import normals

    n = 1_500_000
    z = normals(spark.range(n), F.lit("stream"), F.col("id"), "z")
    got = z.agg(F.avg("z"), F.stddev_pop("z"), F.count_if(F.col("z") > 4), F.count_if(F.col("z") < -4), F.count_if(F.abs("z") > 4.5), F.countDistinct("z")).first()
    tail = NormalDist().cdf(-4) * n
    assert abs(got[0]) < 0.004 and abs(got[1] - 1) < 0.003 and abs(got[2] - tail) < 5 * tail**0.5 and abs(got[3] - tail) < 5 * tail**0.5 and got[4] >= 1 and got[5] > n - 20


def test_noise_knows_no_partitions(spark):
    base = spark.range(5000).select(F.lit("base").alias("variant"), F.lit("P01").alias("id"), (F.col("id") % 3).cast("int").alias("grp"), F.col("id").alias("row_idx"), F.create_map(F.lit("x"), F.lit(1.0)).alias("x"), (F.col("id") / 7).alias("y"))
    for mode in ("relative", "absolute", "dataset-std"):
        four, many = (sorted(map(tuple, generate.add_noise(base.repartition(p, "row_idx"), "0.05", mode, 9).select("grp", "row_idx", "y").collect())) for p in (4, 200))
        assert four == many if mode != "dataset-std" else all(math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(four, many))
        assert {r[1]: r[2] for r in four if r[1] < 100} != {r[1]: r[1] / 7 for r in four if r[1] < 100}
        plan = generate.add_noise(base, "0.05", mode, 9)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_histogram_has_empty_bins_and_a_failed_one(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (None,), (float("nan"),)], "v double")
    assert sorted((r["bin"], r["n"]) for r in metrics.histogram(df, "v", [0.0, 0.5, 0.9, 1.0]).collect()) == [(0, 2), (1, 0), (2, 1), (3, 1)]


def test_survival_counts_missing_as_worst(spark):
    df = spark.createDataFrame([(0.5, 1.0), (None, 1.0), (1.0, 1.0)], "a double, b double")
    out = {r["step"]: r["share"] for r in metrics.survival(df, ["a", "b"], 10).collect()}
    assert len(out) == 11 and math.isclose(out[0], 2 / 3) and math.isclose(out[5], 2 / 3) and math.isclose(out[6], 1 / 3) and math.isclose(out[10], 1 / 3)


def test_front_and_prefix(spark):
    eq = spark.createDataFrame([("P", 1, 4.0), ("P", 3, 1.0), ("P", 5, 2.0), ("P", 7, 0.5)], "id string, complexity int, loss double")
    out = {r["complexity"]: r for r in ranking.scored_front(eq, ["id"]).collect()}
    assert out[1]["score"] == 0 and math.isclose(out[3]["score"], math.log(4) / 2) and [c for c in sorted(out) if out[c]["on_front"]] == [1, 3, 7]
    marks = spark.createDataFrame([("a", 0, True), ("a", 1, True), ("a", 3, True), ("b", 0, False), ("b", 1, True)], "id string, dataset int, done boolean")
    assert sorted((r["id"], r["dataset"]) for r in ranking.completed_prefix(marks, ["id"]).collect()) == [("a", 0), ("a", 1)]


def test_golden_scores_of_a_published_front(spark):
    rows = [("P06", 1, 0.33603996), ("P06", 3, 0.01357379)]
    out = {r["complexity"]: r["score"] for r in ranking.scored_front(spark.createDataFrame(rows, "id string, complexity int, loss double"), ["id"]).collect()}
    assert math.isclose(out[3], 1.6045446770271037, rel_tol=1e-14)


def test_top_formulas(spark):
    rows = [("P1", 1, 0.0, 0.5), ("P1", 2, 0.0, 0.1), ("P1", 3, 1.0, 0.0), ("P1", 4, 0.0, 1e100), ("P1", 5, 0.0, float("nan")), ("P1", 6, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "ID string, src_row long, redundant double, shared_fit_mse_0_7 double")
    assert [(r["src_row"], r["TopRank"]) for r in ranking.top_formulas(df, 2).orderBy("TopRank").collect()] == [(2, 1), (6, 2)]
    with pytest.raises(Exception, match="redundant"):
        ranking.leaders(df.withColumn("redundant", F.lit(0.5))).collect()


def test_joins_report_bad_keys(spark):
    left, twice = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int")
    with pytest.raises(Exception, match="repeated key"):
        relational.attach_master(left, twice, "k").collect()
    with pytest.raises(Exception, match="unexpected key"):
        relational.on_spine(left, spark.createDataFrame([("b",)], "k string"), "k").collect()
    assert relational.on_spine(left, spark.createDataFrame([("a",), ("b",)], "k string"), "k", {"v": 0}).count() == 2


def test_band_counts_are_brute_force(spark):
    rng = np.random.default_rng(0)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.integers(0, 40, 200), rng.integers(-3, 3, 200) / 2))]
    got = {r["k"]: r["near"] for r in relational.band_counts(spark.createDataFrame(points, "k int, x double, y double"), "k", "x", "y").collect()}
    assert got == {k: sum(abs(x - a) <= 5 and abs(y - b) <= 1 for _, a, b in points) - 1 for k, x, y in points}


def samples(spark, n=200):
    rng = np.random.default_rng(1)
    rows = []
    for g, (a, b) in enumerate([(2.0, 0.5), (3.0, -0.25)]):
        for i, x in enumerate(rng.uniform(0.5, 4, n)):
            rows.append(("P", g, i, float(x), float(a * np.exp(b * x) + 1)))
    return spark.createDataFrame(rows, "id string, grp int, row_idx long, x double, y double")


FORMULA = "id string, formula_id string, formula string, para_list array<string>, orgpara_list array<double>"


def test_nonlinear_fit_recovers_parameters(spark):
    formulas = spark.createDataFrame([("P", "f", "p0*exp(p1*x) + p2", ["p0", "p1", "p2"], [1.0, 0.1, 0.0]), ("P", "bad", "p0*nope", ["p0"], [1.0]), ("P", "fixed", "2*x", [], [])], FORMULA)
    out = {(r["formula_id"], r["grp"]): r for r in fitting.fit_groups(samples(spark), formulas, ["x"], order="row_idx").collect()}
    assert np.allclose(out["f", 0]["params"], [2.0, 0.5, 1.0], rtol=1e-5) and np.allclose(out["f", 1]["params"], [3.0, -0.25, 1.0], rtol=1e-4) and out["f", 0]["r2"] > 1 - 1e-10
    assert not out["bad", 0]["ok"] and "nope" in out["bad", 0]["error"] and out["fixed", 0]["ok"] and out["fixed", 0]["params"] == []


def test_retries_only_on_failure(spark):
    formulas = spark.createDataFrame([("P", "log", "p0*log(p1*x)", ["p0", "p1"], [1.0, -0.3])], FORMULA)
    r = fitting.fit_groups(samples(spark), formulas, ["x"], retries=12, order="row_idx").first()
    assert r["ok"] and r["retry_used"] and r["attempts"] > 1


def test_bounded_fit_keeps_its_bounds(spark):
    formulas = spark.createDataFrame([("P", "f", "k*exp(m*x) + 1", [], [])], FORMULA)
    rows = fitting.fit_groups(samples(spark), formulas, ["x"], ranges={"k": (0.1, 2.5), "m": (-1.0, 1.0)}, bounded=True, protected=True, retries=0, strict=False, order="row_idx").collect()
    by = {r["grp"]: r for r in rows}
    assert np.allclose(by[0]["params"], [2.0, 0.5], rtol=1e-5) and by[1]["params"][0] <= 2.5


def test_linear_fit_is_least_squares(spark):
    df = samples(spark).withColumn("z", F.col("x") * F.col("x"))
    got = {r["grp"]: (r["a"], r["b"], r["c"]) for r in fitting.linear_fit(df, ["grp"], "a*x + b*z + c", ["a", "b", "c"], {"x": F.col("x"), "z": F.col("z")}, "y").collect()}
    for g, part in df.toPandas().groupby("grp"):
        m = np.column_stack([part["x"], part["z"], np.ones(len(part))])
        assert np.allclose(got[g], np.linalg.lstsq(m, part["y"], rcond=None)[0], rtol=1e-6)
    with pytest.raises(ValueError):
        fitting.linear_fit(df, ["grp"], "exp(a*x)", ["a"], {"x": F.col("x")}, "y")


def test_fit_by_sums_is_the_grouped_fit(spark):
    rows = samples(spark)
    out = {r["grp"]: r for r in fitting.fit_by_sums(rows, ["grp"], "p0*exp(p1*x) + p2", {"p0": 1.0, "p1": 0.1, "p2": 0.0}, {"x": F.col("x")}, "y").collect()}
    assert np.allclose([out[0][p] for p in ("p0", "p1", "p2")], [2.0, 0.5, 1.0], rtol=1e-4) and np.allclose([out[1][p] for p in ("p0", "p1", "p2")], [3.0, -0.25, 1.0], rtol=1e-3)
    assert all(r["ok"] and r["n"] == 200 and r["r2"] > 1 - 1e-8 for r in out.values())


def test_running_order(spark):
    rng = np.random.default_rng(2)
    values = rng.permutation(500).tolist()
    from fitloom.operators.ordering import running

    out = running(spark.createDataFrame([(v, v % 3) for v in values], "v long, c long"), ["v"], "n", "c").collect()
    total = np.cumsum(np.arange(500) % 3)
    assert all(r["n"] == total[r["v"]] for r in out)


def test_running_order_of_more_rows_than_a_sample_holds(spark):
    """Ranges come from a sample: rows and totals must have the same ones."""
    from fitloom.operators.ordering import running

    n = 60_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("v")).repartition(6)
    out = running(rows, ["v"], "n")
    assert out.filter(F.col("n") != F.col("v") + 1).count() == 0 and out.count() == n


def test_problems_keep_their_own_names_and_rows(spark):
    """Constants of one name differ by problem; one has the name of the other's variable; a row without a value is left out."""
    rows = [("A", 0, i, float(i), None, 2.0 * i + 10) for i in range(1, 20)] + [("A", 0, 99, None, None, 1e6)] + [("B", 0, i, None, float(i), 3.0 * i + 20 + 7) for i in range(1, 20)] + [("B", 0, 99, None, float("nan"), 1.0)]
    samples = spark.createDataFrame(rows, "id string, grp int, row_idx long, x double, z double, y double")
    formulas = spark.createDataFrame([("A", "f", "p0*x + k", ["p0"], [1.0], ["x"], {"k": 10.0}), ("B", "f", "p0*z + k + x", ["p0"], [1.0], ["z"], {"k": 20.0, "x": 7.0})], FORMULA + ", variables array<string>, constants map<string,double>")
    out = {r["id"]: r for r in fitting.fit_groups(samples, formulas, ["x", "z"], order="row_idx").collect()}
    assert math.isclose(out["A"]["params"][0], 2.0, rel_tol=1e-9) and math.isclose(out["B"]["params"][0], 3.0, rel_tol=1e-9) and all(r["r2"] > 1 - 1e-12 for r in out.values())


def test_ranges_of_a_problem(spark):
    ranges = F.array(F.struct(F.lit("k").alias("name"), F.lit(0.1).alias("lo"), F.lit(2.5).alias("hi")), F.struct(F.lit("m").alias("name"), F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi")))
    formulas = spark.createDataFrame([("P", "f", "k*exp(m*x) + 1", [], [])], FORMULA).withColumn("ranges", ranges)
    by = {r["grp"]: r for r in fitting.fit_groups(samples(spark), formulas, ["x"], bounded=True, protected=True, retries=0, strict=False, order="row_idx").collect()}
    assert np.allclose(by[0]["params"], [2.0, 0.5], rtol=1e-5) and by[1]["params"][0] <= 2.5


def test_rank_that_is_not_there(spark):
    df = spark.createDataFrame([("P1", 1)], "ID string, TopRank long")
    assert ranking.ranked_rows(df, 1).count() == 1
    with pytest.raises(ValueError, match="TopRank 2"):
        ranking.ranked_rows(df, 2)


def test_names_that_cancel_keep_no_classes_apart(spark):
    """What is left after simplification decides, as names that cancel are no symbols of a formula."""
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(["x/x", "y/y", "1", "x/x", "x", "x + y - y", "sqrt(x)*sqrt(x)", "y"])], "file string, row_idx int, para_eq string")
    assert [r["redundant"] for r in dedup.mark(df, "para_eq").orderBy("row_idx").collect()] == [0, 1, 1, 1, 0, 5, 5, 0]


def test_marks(spark):
    texts = ["p0*x + p1", "p1 + x*p0", "sin(x)", "y = p0 * x + p1", "", "", "not ( a formula", "not ( a  formula"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, row_idx int, para_eq string")
    out = dedup.mark(df, "para_eq")
    rows = out.orderBy("row_idx").collect()
    assert [r["eq_id"] for r in rows] == list(range(1, 9)) and [r["redundant"] for r in rows] == [0, 1, 0, 1, 0, 0, 0, 7]
    assert dedup.check_marks(out).count() == 0 and dedup.statistics(out).first()["representatives"] == 5
    wrong = out.withColumn("redundant", F.when(F.col("eq_id") == 3, 2).otherwise(F.col("redundant")).cast("long"))
    assert dedup.check_marks(wrong).count() == 1


def test_candidate_marks_keep_old_ones(spark):
    df = spark.createDataFrame([("a", 1, "x + 1", 1), ("a", 2, "x + 1", 0), ("a", 3, "1 + x", 0)], "id string, src_row int, para_eq string, redundant long")
    assert {r["src_row"]: r["redundant"] for r in dedup.mark_candidates(df, "para_eq", ["id"], "src_row").collect()} == {1: 1, 2: 0, 3: 1}


def test_generated_rows_fit_their_formula(spark):
    rows = generate.generate(spec_rows(spark), 300).toPandas()
    assert len(rows) == 2 * 2 * 300
    line = rows[(rows["id"] == "P01") & (rows["grp"] == 1)]
    assert np.allclose([3.0 * dict(x)["x"] + 0.5 for x in line["x"]], line["y"])
    again = generate.generate(spec_rows(spark).repartition(3), 300).toPandas()
    key = ["id", "grp", "row_idx"]
    assert np.array_equal(rows.sort_values(key)["y"], again.sort_values(key)["y"])
    shifted = generate.generate(spec_rows(spark), 50, "shift", 1)
    assert shifted.filter("isnan(y)").count() == 0 and shifted.count() == 200


def test_noise(spark):
    base = generate.generate(spec_rows(spark), 2000)
    key = ["id", "grp", "row_idx"]
    a = base.toPandas().sort_values(key)["y"].to_numpy()
    same = generate.add_noise(base, "0").toPandas().sort_values(key)["y"].to_numpy()
    assert np.array_equal(a, same)
    b = generate.add_noise(base, "0.10", seed=3).toPandas().sort_values(key)["y"].to_numpy()
    assert np.array_equal(b, generate.add_noise(base.repartition(5), 0.1, seed=3).toPandas().sort_values(key)["y"].to_numpy())
    assert abs(np.std((b / a - 1)[np.abs(a) > 1e-9]) - 0.1) < 0.01
    holes = base.withColumn("y", F.when(F.col("row_idx") % 2 == 0, F.col("y")))
    assert generate.add_noise(holes, "0.1").filter("y is null").count() == holes.filter("y is null").count()
    moved = generate.add_noise(base, "0.1", "absolute", start=1, stop=1)
    assert {r["grp"] for r in moved.select("grp").distinct().collect()} == {0}
    with pytest.raises(ValueError):
        generate.add_noise(base, "0.1", "odd")


def test_search_finds_a_line(spark):
    rows = samples(spark).withColumn("y", 2 * F.col("x") + 1).filter("grp = 0")
    found = search.front(search.search_dataset(rows, ["x"], 0, search.Settings(iterations=3, islands=4, population=30))).collect()
    assert min(r["loss"] for r in found) < 1e-6
    by = sorted(found, key=lambda r: r["complexity"])
    assert all(a["loss"] > b["loss"] for a, b in zip(by, by[1:]))


def test_search_rules():
    from fitloom.functions.expr import parse

    s = search.Settings(max_size=20)
    assert search.allowed(parse("sin(x) + exp(x)"), s)
    for bad in ("sin(sin(x))", "sin(cos(x + 1))", "exp(log(x))", "sqrt(sqrt(sqrt(x)))", "x**(x + 1)"):
        assert not search.allowed(parse(bad), s), bad


def test_discover_carries_the_front(spark):
    rows = samples(spark, 80).withColumn("y", F.col("x") * F.col("x"))
    out = search.discover(rows, ["x"], [0, 1], search.Settings(iterations=1, islands=2, population=15), top=3)
    got = out.groupBy("dataset").agg(F.count("*").alias("n")).collect()
    assert {r["dataset"] for r in got} == {0, 1} and all(1 <= r["n"] <= 3 for r in got) and out.filter("para_eq is null").count() == 0


def test_reports(spark):
    table = lambda values: spark.createDataFrame([(f"P{i:02d}", *v) for i, v in enumerate(values, 1)], "ID string, n0 double, n1 double")
    clean, noisy = table([(1.0, 0.9), (0.5, -1e100), (0.8, 0.7)]), table([(0.9, 0.95), (0.4, 0.3)])
    long = report.long_robustness({0.0: clean, 0.01: noisy}, {0.0: "n0", 0.01: "n1"})
    out = {(r["train_noise"], r["test_noise"]): r for r in report.robustness_summary(long).collect()}
    assert out[0.0, 0.01]["valid_count"] == 1 and out[0.0, 0.01]["invalid_count"] == 1 and out[0.0, 0.0]["common_id_count"] == 2 and math.isclose(out[0.0, 0.0]["high_accuracy_rate"], 1 / 59)
    paired = {r["test_noise"]: r for r in report.paired_summary(long).collect()}
    assert paired[0.01]["valid_pair_count"] == 1 and math.isclose(paired[0.0]["median_delta_r2"], -0.1)
    assert report.worst_case_survival(long).count() == 2 * 401 and report.paired_points(long).count() == 4 and report.profile(report.robustness_summary(long)).count() == 4
    assert report.heatmap(clean, ["n0", "n1"]).count() == 59 and report.perfect_summary(clean, {0.0: "n0", 0.01: "n1"}).count() == 2
    assert {r["bin"]: r["n"] for r in report.r2_levels(clean, "n1").collect()} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    with pytest.raises(Exception, match="exceeds"):
        report.r2_levels(table([(1.5, 1.0)]), "n0").collect()
    scored = clean.withColumn("s", F.col("n0") * 90)
    assert report.density(scored, "ID", "s", "n0").count() == 3 and {r["bin"]: r["n"] for r in report.structure_levels(scored, "s").collect()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 1}
    assert report.dot_plot(clean, ["n0", "n1"]).count() == 6 and report.column_means(clean, ["n0"]).count() == 1 and report.success_comparison({"a": clean}, "n0").count() == 1

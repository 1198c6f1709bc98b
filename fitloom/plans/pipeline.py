"""The stages from metadata to report tables: prepare, discover, evaluate, merge, robustness, report. Each is a function of DataFrames that
writes its table under one root; ``python -m fitloom.plans.pipeline STAGE --root DIR`` runs them."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom import schemas
from fitloom.functions import cells
from fitloom.operators import dedup, fitting, generate, metrics, ranking, report, search, sums
from fitloom.operators.relational import attach_master, incomplete, pending, require_columns, widen
from fitloom.sources import files, sinks
from fitloom.sources.specs import spec_errors
from fitloom.streaming.resume import RunState, quarantine, rebuilt

CORE = ("prepare", "discover", "evaluate", "merge")
STAGES = (*CORE, "robustness", "baseline", "report")
WASS = ("0", "025", "04")


@dataclass(frozen=True)
class Config:
    """Paths, budgets and limits of a run. Numbers must be positive.

    ``metadata`` is the sheet of problems; ``master`` (published columns of the ranking), ``shifts`` (shifted ranges) and ``structure``
    (similarity scores) are workbooks of their own, the first two by default the sheet itself. ``trained``: roots of runs on noisy
    training data, as ``0.01=/data/run_001,0.03=/data/run_003``.
    """

    root: str
    metadata: str = ""
    master: str = ""
    shifts: str = ""
    structure: str = ""
    trained: str = ""
    formula_column: str = "GenerationFormula"
    sheet: str = "Sampling design"
    groups: int = 16
    datasets: str = "0-7"
    samples: int = 5000
    ids: str = ""
    with_params: bool = False
    iterations: int = 2
    islands: int = 20
    population: int = 40
    max_size: int = 50
    top: int = 10
    candidates: int = 30
    retries: int = 2
    ranked: int = 5
    top_rank: int = 1
    tasks: int = 59
    wass: str = ",".join(WASS)
    noise: str = "0,0.01,0.03,0.05,0.1"
    noise_mode: str = "relative"
    seed: int = 0
    force: bool = False
    dry_run: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, int) and not isinstance(value, bool) and f.name not in ("seed", "retries") and value < 1:
                raise ValueError(f"{f.name} must be positive")
        if not self.root:
            raise ValueError("root is missing")
        if self.formula_column not in ("GenerationFormula", "OriginalFormula"):
            raise ValueError("formula_column is GenerationFormula or OriginalFormula")

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def summary(self) -> str:
        """Each mode has a summary of its own."""
        return self.path("summary_with_params" if self.with_params else "summary")


def there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def step(spark: SparkSession, config: Config, name: str, make, overwrite: bool = False) -> DataFrame:
    """The table ``name``: kept if it is there (unless forced), else made and written whole."""
    path = config.path(name)
    if overwrite or config.force or not there(spark, path):
        sinks.write_table(make(), path)
    return spark.read.parquet(path)


def problems(spark: SparkSession, config: Config) -> DataFrame:
    out = cells.problem_rows(files.read_table(spark, config.metadata, config.sheet), config.groups)
    return files.in_id_range(out, config.ids) if config.ids else out


def wide(samples: DataFrame, variables: list[str]) -> DataFrame:
    """The map of variables as columns."""
    return samples.select("id", "grp", "row_idx", *(F.try_element_at(F.col("x"), F.lit(v)).alias(v) for v in variables), "y")


def variables_of(specs: DataFrame) -> list[str]:
    return sorted(r["v"] for r in specs.select(F.explode("variables").alias("v")).distinct().collect())  # names of one sheet


def prepare(spark: SparkSession, config: Config) -> DataFrame:
    specs = problems(spark, config)
    return step(spark, config, "samples", lambda: generate.generate(specs, config.samples, groups=config.groups))


def discover(spark: SparkSession, config: Config) -> DataFrame:
    """All problems of one dataset in one job, dataset after dataset, as each starts from the front of the one before.

    Problems are grouped by their variables, which are the columns of a job. The summary of a dataset is written whole before its mark,
    so a run goes on behind the last dataset that is done; what was written without a mark is made again, and what a run that broke off has
    left is moved aside. A front that was found over other features than now asked for counts as not done.
    """
    specs, state = problems(spark, config), RunState(spark, config.path("run_state"))
    quarantine(spark, config.summary)
    datasets = cells.index_spec(config.datasets)
    settings = search.Settings(config.iterations, config.islands, config.population, config.max_size, seed=config.seed)
    samples = spark.read.parquet(config.path("samples"))
    by_variables: dict[tuple[str, ...], list] = {}
    for spec in specs.collect():  # one row a problem
        by_variables.setdefault(tuple(spec["variables"]), []).append(spec)
    for variables, group in sorted(by_variables.items()):
        ids = sorted(s["id"] for s in group)
        parameters = {s["id"]: {d: {p["name"]: v for p, v in zip(s["params"], s["para_values"][d])} for d in datasets} for s in group} if config.with_params else None
        features = "+".join([*variables, *sorted({n for by in (parameters or {}).values() for v in by.values() for n in v})])
        seeds: dict[str, list[str]] = {}
        for d in datasets:
            path = f"{config.summary}/features={sinks.safe_folder(features)}/dataset={d}"
            work = spark.createDataFrame([(f"{i}/{features}", d) for i in ids], "id string, dataset int")
            if config.force or state.remaining(work).take(1) or not there(spark, path):
                rows = files.finite_rows(wide(samples.filter(F.col("id").isin(ids) & (F.col("grp") == d)), list(variables)), [*variables, "y"])
                found = search.discover(rows, list(variables), [d], settings, parameters, top=config.top, seeds=seeds)
                found.withColumn("src_row", F.col("dataset") * 1000 + F.col("complexity")).drop("dataset").write.mode("overwrite").parquet(path)
                state.mark(work)
            seeds = {r["id"]: list(r["e"]) for r in spark.read.parquet(path).groupBy("id").agg(F.sort_array(F.collect_list("equation")).alias("e")).collect()}  # a front a problem
    return rebuilt(spark, config.summary, state)


def with_problem(formulas: DataFrame, specs: DataFrame) -> DataFrame:
    """Each formula with the variables, constants and parameter ranges of its own problem."""
    return formulas.join(specs.select("id", "variables", "constants", F.col("params").alias("ranges")), "id")


def evaluate(spark: SparkSession, config: Config) -> DataFrame:
    """Candidates, without equivalent ones, fitted to all datasets; all-or-nothing metrics."""

    def make() -> DataFrame:
        summary = rebuilt(spark, config.summary, RunState(spark, config.path("run_state"))).withColumn("redundant", F.lit(0).cast("long"))
        chosen = ranking.candidates(summary, ["id"], config.candidates).drop("rank")
        marked = dedup.mark_candidates(chosen, "para_eq", ["id"], "src_row")
        leaders = marked.filter("redundant = 0").select("id", F.concat_ws("-", "dataset", "complexity").alias("formula_id"), F.col("para_eq").alias("formula"), "para_list", "orgpara_list")
        specs = problems(spark, config)
        variables = variables_of(specs)
        samples = spark.read.parquet(config.path("samples")).filter(F.col("grp").isin(cells.index_spec(config.datasets)))
        fits = sums.fit_sums(wide(samples, variables), with_problem(leaders, specs), variables, retries=config.retries, seed=config.seed)
        shared = metrics.all_or_nothing(fits, ["id", "formula_id"])
        named = shared.withColumnsRenamed({"mse": "shared_fit_mse_0_7", "r2": "shared_fit_r2_0_7", "mse_hmean": "shared_fit_mse_hmean_0_7", "mse_rms": "shared_fit_mse_rms_0_7", "r2_hmean": "shared_fit_r2_hmean_0_7", "r2_rms": "shared_fit_r2_rms_0_7"})
        return marked.withColumn("formula_id", F.concat_ws("-", "dataset", "complexity")).join(named, ["id", "formula_id"], "left")

    return step(spark, config, "evaluated", make)


def merge(spark: SparkSession, config: Config) -> DataFrame:
    def make() -> DataFrame:
        rows = spark.read.parquet(config.path("evaluated")).withColumnRenamed("id", "ID").withColumn("fromdataset", F.col("dataset"))
        top = ranking.top_formulas(rows, config.ranked)
        sheet = files.read_table(spark, config.master or config.metadata, config.sheet)
        published = {"ModelName", "OriginalFormula", "GenerationFormula", "Target", "IndependentVars", "ParameterRange", "FixedConstantValues", "simpFormula"}
        master = sheet.select(cells.normal_id(F.col("ID")).alias("ID"), *(c for c in sheet.columns if c in published))
        if config.formula_column == "OriginalFormula":
            master = master.drop("GenerationFormula")
        out = attach_master(top, master, "ID")
        return out.select(*(c for c in schemas.RANKING if c in out.columns))

    return step(spark, config, "top_formulas", make)


def refit(rows: DataFrame, formulas: DataFrame, variables: list[str], config: Config, level: str) -> DataFrame:
    """Bounded fits of formulas to one condition; one failed group marks the whole."""
    fits = sums.fit_sums(rows, formulas, variables, bounded=True, protected=True, retries=0, seed=config.seed, strict=False)
    means = (metrics.undiluted(F.col(m), F.col("ok"), e).alias(m) for m, e in (("mse", 1e100), ("nmse", 1e100), ("r2", -1e100)))
    return fits.groupBy("id").agg(*means).withColumn("level", F.lit(level))


def conditions(spark: SparkSession, config: Config) -> list[tuple[str, DataFrame]]:
    """(level, samples) of each condition: shifted ranges, where the sheet has them, and noisy targets, level 0 included."""
    base = spark.read.parquet(config.path("samples"))
    last = max(cells.index_spec(config.datasets))
    out = []
    sheet = files.read_table(spark, config.shifts or config.metadata, config.sheet)
    for label in filter(None, config.wass.split(",")):
        if f"paraValue_WASS_{label}" in sheet.columns:
            out.append((f"WASS_{label}", generate.generate(cells.shifted_rows(sheet, label, last + 1), config.samples, "shift", config.seed, variant=f"wass_{label}")))
    for level in cells.noise_levels(config.noise):
        noisy = generate.add_noise(base, level, config.noise_mode, config.seed, last + 1, 2 * last + 1) if config.groups > last + 1 else generate.add_noise(base, level, config.noise_mode, config.seed)
        out.append((f"noise_{cells.noise_folder(level)}", noisy))
    return out


def robustness(spark: SparkSession, config: Config) -> DataFrame:
    """(id, level, mse, nmse, r2): the formula of the rank asked for, of each problem, refitted to every condition."""

    def make() -> DataFrame:
        specs = problems(spark, config)
        variables = variables_of(specs)
        top = ranking.ranked_rows(spark.read.parquet(config.path("top_formulas")), config.top_rank)
        chosen = with_problem(top.select(F.col("ID").alias("id"), F.lit("1").alias("formula_id"), F.col("para_eq").alias("formula"), "para_list", "orgpara_list"), specs)
        return reduce(DataFrame.unionByName, [refit(wide(rows, variables), chosen, variables, config, level) for level, rows in conditions(spark, config)])

    return step(spark, config, "robustness", make)


def baseline(spark: SparkSession, config: Config) -> DataFrame:
    """The same table for the true formulas: what a perfect search could reach."""

    def make() -> DataFrame:
        specs = problems(spark, config).withColumn("generation_formula", F.col("original_formula" if config.formula_column == "OriginalFormula" else "generation_formula"))
        variables = variables_of(specs)
        parts = []
        for level, rows in conditions(spark, config):
            fits = fitting.baseline(wide(rows, variables), specs, variables, sums.fit_sums, retries=0, seed=config.seed)
            parts.append(fits.groupBy("id").agg(metrics.undiluted(F.col("mse"), F.col("ok"), 1e100).alias("mse"), metrics.undiluted(F.col("nmse"), F.col("ok"), 1e100).alias("nmse"), metrics.undiluted(F.col("r2"), F.col("ok"), -1e100).alias("r2")).withColumn("level", F.lit(level)))
        return reduce(DataFrame.unionByName, parts)

    return step(spark, config, "baseline", make)


def by_level(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A table of conditions as one row a problem, with the columns LEVEL_MSE, LEVEL_NMSE and LEVEL_R2; and its levels."""
    rows = spark.read.parquet(path)
    levels = sorted(r["level"] for r in rows.select("level").distinct().collect())  # a label a condition
    return widen(rows.withColumnRenamed("id", "ID"), ["ID"], "level", levels, ["mse", "nmse", "r2"]), levels


def noise_columns(levels: list[str]) -> dict[float, str]:
    """Test level to column, of the levels of noise."""
    value = lambda lv: float(f"{lv[0]}.{lv[1:]}") if len(lv) > 1 else float(lv)
    return {value(lv.removeprefix("noise_")): f"{lv}_R2" for lv in levels if lv.startswith("noise_")}


def figure_tables(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """All tables that figures and reports are made of, by name; those whose inputs aren't there are left out."""
    table, levels = by_level(spark, config.path("robustness"))
    columns, noise = {lv: f"{lv}_R2" for lv in levels}, noise_columns(levels)
    shifts = {lv: c for lv, c in columns.items() if lv.startswith("WASS_")}
    best = spark.read.parquet(config.path("top_formulas")).filter(F.col("TopRank") == config.top_rank)
    shared = best.select("ID", F.col("shared_fit_r2_0_7").cast("double").alias("shared_r2"), F.col("complexity").cast("double").alias("complexity"))
    whole = table.join(shared, "ID", "full")
    out = {
        "level_statistics": report.level_statistics(table, columns), "column_means": report.column_means(table, list(columns.values())), "noise_profile": report.coverage(table, noise),
        "heatmap": report.heatmap(whole, [*columns.values(), "shared_r2"], config.tasks), "dot_plot": report.dot_plot(table, list((shifts or columns).values())), "r2_levels": report.r2_levels(whole, "shared_r2"),
        "complexity_points": report.complexity_points(whole, "shared_r2"), "least_r2": report.least_r2(whole, "shared_r2"),
    }
    if noise:
        trained = {0.0: table}
        for part in filter(None, (p.strip() for p in config.trained.split(","))):
            level, _, root = part.partition("=")
            trained[float(level)] = by_level(spark, f"{root.rstrip('/')}/robustness")[0]
        long = report.long_robustness(trained, noise)
        summary = report.robustness_summary(long, config.tasks)
        out |= {"robustness_summary": summary, "profile": report.profile(summary), "worst_case_survival": report.worst_case_survival(long)}
        if len(trained) > 1:
            out |= {"paired_delta_summary": report.paired_summary(long), "paired_points": report.paired_points(long)}
    methods = {"search": whole}
    if there(spark, config.path("baseline")):
        perfect, found = by_level(spark, config.path("baseline"))
        if noise_columns(found):
            out["perfect_summary"] = report.perfect_summary(perfect, noise_columns(found))
        clean = noise_columns(found).get(0.0)
        methods |= {"true formulas": perfect.withColumn("shared_r2", F.col(f"`{clean}`"))} if clean else {}
    out["success_comparison"] = report.success_comparison(methods, "shared_r2", config.tasks)
    out["distribution_comparison"] = reduce(DataFrame.unionByName, [report.r2_levels(df, "shared_r2").withColumn("method", F.lit(name)) for name, df in methods.items()])
    if config.structure:
        names = {"structure_similarity_score": "similarity", "SimilarityScore": "similarity"}
        scores = files.read_table(spark, config.structure, "Sheet1")
        scored = scores.withColumnsRenamed({c: n for c, n in names.items() if c in scores.columns}).select(cells.normal_id(F.col("ID")).alias("ID"), F.col("similarity").try_cast("double").alias("similarity"))
        both = whole.join(scored, "ID", "full")
        reports = report.metric_report(both, "ID", "similarity", "shared_r2")
        out |= {"structure_levels": report.structure_levels(scored, "similarity"), "density": report.density(both, "ID", "similarity", "shared_r2"), "overview": report.overview(both, "similarity", {k: v for k, v in columns.items() if k.startswith("noise_")}, shifts, config.tasks)}
        out |= {f"metric_{name}": df for name, df in reports.items()}
    return out


def report_tables(spark: SparkSession, config: Config) -> DataFrame:
    """Every table under ``report/``; returns the statistics by level."""
    for name, df in figure_tables(spark, config).items():
        step(spark, config, f"report/{name}", lambda df=df: df)
    return spark.read.parquet(config.path("report/level_statistics"))


def validate(spark: SparkSession, config: Config) -> DataFrame:
    """Only look at the sheet: an error names the rows that can't be used, nothing is written."""
    found = spec_errors(files.read_table(spark, config.metadata, config.sheet), min(config.groups, max(cells.index_spec(config.datasets)) + 1))
    rows = found.orderBy("row").limit(50).collect()
    if rows:
        raise ValueError("; ".join(f"row {r['row']}: {r['problem']}" for r in rows))
    return found


RUN = {"validate": validate, "prepare": prepare, "discover": discover, "evaluate": evaluate, "merge": merge, "robustness": robustness, "baseline": baseline, "report": report_tables}


def execute(spark: SparkSession, stage: str, config: Config) -> list[str]:
    """Run one stage, ``core`` or ``all``, in order; returns the stages run. A dry run only names them."""
    names = CORE if stage == "core" else STAGES if stage == "all" else (stage,)
    for name in names:
        if not config.dry_run:
            mark = sinks.made()
            RUN[name](spark, config)
            sinks.clean(spark, mark)  # a stage's table is written whole by now
    return list(names)


def unfinished(spark: SparkSession, config: Config) -> DataFrame:
    """Evaluated leaders of which a metric is missing."""
    rows = require_columns(spark.read.parquet(config.path("evaluated")), ["redundant"])
    return incomplete(rows.filter("redundant = 0"), [c for c in rows.columns if c.startswith("shared_fit_mse") or c.startswith("shared_fit_r2")])


def todo(work: DataFrame, done: DataFrame) -> DataFrame:
    return pending(work, done, ["id"])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fitloom")
    out.add_argument("stage", choices=("validate", *STAGES, "core", "all"))
    for f in fields(Config):
        name = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            out.add_argument(name, action="store_true")
        else:
            out.add_argument(name, type={"int": int}.get(f.type, str), default=f.default if f.name != "root" else None, required=f.name == "root")
    return out


def main(argv: list[str] | None = None) -> int:
    from fitloom.session import session

    args = vars(parser().parse_args(argv))
    stage = args.pop("stage")
    try:
        execute(session(), stage, Config(**args))
    except (ValueError, FileNotFoundError) as e:
        print(f"fitloom: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001
        print(f"fitloom: {stage} failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

import pytest
from pyspark.sql import functions as F

from fitloom.functions import cells
from fitloom.operators import generate
from fitloom.plans import pipeline
from fitloom.session import worker_count
from fitloom.sources import files, sinks, xlsx
from fitloom.sources.specs import spec_errors
from fitloom.streaming.progress import Progress, Reporter, progress
from fitloom.streaming.resume import RunState, arrived, evaluate_arrivals, quarantine, rebuilt

SHEET = [
    ["ID", "ModelName", "OriginalFormula", "GenerationFormula", "simpFormula", "Target", "IndependentVars", "ParameterRange", "FixedConstantValues", "paraValue", "varRange", "targetRange", "paraValue_WASS_025", "varRange_WASS_025"],
    ["P01", "line", "y = a*x + b", "y = a*x + b", "a*x + b", "y", "x", "a=[1,4], b=[0.5,2]", "(none)", "[[2,1],[3,0.5]]", "[[[0.5,5]],[[0.5,5]]]", "[[-100,100],[-100,100]]", "[[2.5,1],[3,1]]", "[[[1,6]],[[1,6]]]"],
    ["P02", "product", "y = c*a*x", "y = c*a*x", "a*x", "y", "x", "a=[1,4]", "c=1.5", "[[2],[3]]", "[[[0.5,5]],[[0.5,5]]]", "[[-100,100],[-100,100]]", "[[2.5],[3]]", "[[[1,6]],[[1,6]]]"],
    [None, "a row without an ID", *[None] * 12],
]


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "meta.xlsx"
    path.write_bytes(xlsx.write(SHEET))
    return str(path)


def test_workbook(spark, book, tmp_path):
    df = xlsx.read(spark, book)
    assert df.count() == 2 and df.columns == SHEET[0]
    rows = {r["id"]: r for r in cells.problem_rows(df, 2).collect()}
    assert rows["P02"]["constants"] == {"c": 1.5} and rows["P01"]["para_values"] == [[2.0, 1.0], [3.0, 0.5]] and rows["P01"]["var_ranges"][0][0]["hi"] == 5.0
    assert {r["ID"]: r["Target"] for r in xlsx.id_targets(df).collect()} == {"P01": "y", "P02": "y"}
    snapshot = str(tmp_path / "snapshot")
    xlsx.read(spark, book, snapshot=snapshot)
    (tmp_path / "meta.xlsx").write_bytes(b"broken")
    assert xlsx.read(spark, book, tries=2, wait=0, snapshot=snapshot).count() == 2
    with pytest.raises(Exception, match="zip|Zip"):
        xlsx.read(spark, book, tries=1)


@pytest.mark.parametrize(("encoding", "sep"), [("utf-8-sig", ","), ("utf-8", ";"), ("gb18030", "\t")])
def test_csv_dialects(spark, tmp_path, encoding, sep):
    path = tmp_path / "0.csv"
    path.write_bytes(f"x{sep} 速度 \n1{sep}2\n3{sep}\n".encode(encoding))
    df = files.read_csv(spark, str(path))
    assert df.columns == ["x", "速度"] and df.count() == 2
    assert files.read_samples(spark, str(path), ["x"], "速度").collect()[0]["速度"] == 2.0 and files.read_samples(spark, str(path), ["x"], "速度").count() == 1


def test_documents(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("ID,para_eq,redundant\nP1,a*x,0\n,,\nP2\n", encoding="utf-8-sig")
    rows = files.read_document(spark, str(path)).orderBy("row_idx").collect()
    assert [(r["ID"], r["para_eq"]) for r in rows] == [("P1", "a*x"), ("P2", None)]
    path.write_text("ID,para_eq\nP1,a*x,extra\n")
    with pytest.raises(Exception, match="more cells"):
        files.read_document(spark, str(path)).collect()
    path.write_text("ID,para_eq,redundant\nP1,a*x,half\n")
    with pytest.raises(Exception, match="whole number"):
        files.read_document(spark, str(path)).collect()


def test_double_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,x\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv"))


def test_group_files(spark, tmp_path):
    for name in ("P01/0.csv", "P01/1.csv", "P01/old/1.csv", "P02/0.csv", ".hidden/P03/0.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x,y\n1,2\n2,3\nnan,4\n")
    (tmp_path / "P01/old/1.csv").unlink()
    found = files.one_file_each(files.dataset_files(spark, str(tmp_path)))
    assert sorted((r["id"], r["grp"]) for r in found.collect()) == [("P01", 0), ("P01", 1), ("P02", 0)]
    rows = files.load_groups(spark, str(tmp_path), ["x"], "y")
    assert rows.count() == 6 and rows.select("id", "grp").distinct().count() == 3
    assert [r["x"] for r in rows.filter("id = 'P01' and grp = 0").orderBy("row_idx").collect()] == [1.0, 2.0]
    assert len(files.summaries(spark, str(tmp_path), "0.CSV")) >= 2


def test_names_and_ranges(spark):
    assert files.target_column(["a", "Target"], "z") == "Target" and files.target_column(["a", "b"]) == "b" and files.bind_variables(["x0", "x1", "y"], ["v10", "v2"]) == {"v2": "x0", "v10": "x1"}
    assert files.bind_variables(["a", "t", "c"], ["v10", "v2"], ["a", "t", "c"], "t") == {"v2": "a", "v10": "c"}
    with pytest.raises(ValueError):
        files.bind_variables(["a"], ["b"])
    with pytest.raises(ValueError):
        files.bind_variables(["a", "y"], ["p", "q"], ["a", "y"], "y")
    ids = spark.createDataFrame([("P2",), ("P10",), ("P21",), ("Q5",)], "id string")
    assert sorted(r["id"] for r in files.in_id_range(ids, "P2-P10").collect()) == ["P10", "P2"]
    assert sinks.safe_folder('a/b: "c"') == "a_b_c" and sinks.compact_name("t.csv", "WASS_0") == "t_WASS_0.csv"


def test_state(spark, tmp_path):
    state = RunState(spark, str(tmp_path / "state"))
    work = spark.createDataFrame([("P1", 0), ("P1", 1), ("P2", 0)], "id string, dataset int")
    assert state.remaining(work).count() == 3
    state.mark(work.filter("id = 'P1'"))
    state.mark(work.filter("id = 'P1'"))
    assert state.read().count() == 2 and [r["id"] for r in state.remaining(work).collect()] == ["P2"]
    assert state.prefix().count() == 2 and [r["id"] for r in state.finished_ids(2).collect()] == ["P1"]


def test_arrivals(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "formula string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("formula string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        evaluate_arrivals(stream, lambda df: df.withColumn("n", F.length("formula")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert arrived(spark, str(tmp_path / "out")).columns == ["formula", "n"] and arrived(spark, str(tmp_path / "out")).count() == 2


def test_a_batch_that_fails_behind_its_write_stands_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a",), ("b",)], "formula string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("formula string").parquet(str(tmp_path / "in"))
    out, writer = str(tmp_path / "out"), type(spark.range(1).write)
    write = writer.parquet

    def lost(self, path, *a, **k):
        write(self, path, *a, **k)
        if "batch=" in path:
            raise OSError("the driver is lost here")

    monkeypatch.setattr(writer, "parquet", lost)
    with pytest.raises(Exception, match="lost here"):
        evaluate_arrivals(stream, lambda df: df, out, str(tmp_path / "cp")).awaitTermination(60)
    monkeypatch.undo()
    assert arrived(spark, out).count() == 2
    spark.createDataFrame([("c",)], "formula string").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        evaluate_arrivals(stream, lambda df: df, out, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["formula"] for r in arrived(spark, out).collect()) == ["a", "b", "c"]


def test_staged_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1).write.parquet(path)
    sinks.promote(spark, sinks.staged(spark.range(3), path), path)
    assert spark.read.parquet(path).count() == 3


def test_all_stages(spark, book, tmp_path):
    config = pipeline.Config(root=str(tmp_path / "run"), metadata=book, groups=2, datasets="0-1", samples=60, iterations=1, islands=2, population=12, candidates=5, ranked=2, noise="0,0.01")
    assert pipeline.execute(spark, "all", config) == list(pipeline.STAGES)
    top = spark.read.parquet(config.path("top_formulas"))
    assert {"ID", "TopRank", "para_eq"} <= set(top.columns) and top.filter("TopRank = 1").count() >= 1
    assert {r["level"] for r in spark.read.parquet(config.path("report/level_statistics")).collect()} == {"WASS_025", "noise_0", "noise_001"}
    assert spark.read.parquet(config.path("baseline")).filter("level in ('noise_0', 'WASS_025') and r2 < 0.999999").count() == 0
    tables = sorted(p.name for p in (tmp_path / "run" / "report").iterdir())
    assert {"robustness_summary", "profile", "worst_case_survival", "perfect_summary", "success_comparison", "distribution_comparison", "heatmap", "dot_plot", "r2_levels", "complexity_points", "noise_profile", "least_r2"} <= set(tables)
    assert spark.read.parquet(config.path("report/heatmap")).count() == 59 and "density" not in tables
    scores = tmp_path / "scores.csv"
    scores.write_text("ID,SimilarityScore\nP01,95\nP02,40\nP03,\n")
    more = pipeline.figure_tables(spark, pipeline.Config(**{**vars(config), "structure": str(scores), "trained": f"0.01={config.root}"}))
    assert {"structure_levels", "density", "overview", "metric_association", "paired_delta_summary", "paired_points"} <= set(more) and all(df.count() >= 0 for df in more.values())
    assert {r["bin"]: r["n"] for r in more["structure_levels"].collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}
    with pytest.raises(ValueError, match="TopRank 9"):
        pipeline.robustness(spark, pipeline.Config(**{**vars(config), "top_rank": 9, "force": True}))
    before = spark.read.parquet(config.path("samples")).count()
    assert pipeline.execute(spark, "core", config) == list(pipeline.CORE) and spark.read.parquet(config.path("samples")).count() == before == 240
    assert pipeline.unfinished(spark, config).count() >= 0


def test_validation(spark, tmp_path, book):
    config = pipeline.Config(root=str(tmp_path / "run"), metadata=book, groups=2, datasets="0-1")
    assert pipeline.validate(spark, config).count() == 0 and not (tmp_path / "run").exists()
    bad = [list(r) for r in SHEET[:3]] + [["P01", *SHEET[1][1:]], ["a/b", *SHEET[1][1:]], [*SHEET[2][:6], "x,x", *SHEET[2][7:]], *([[f"Q{i}", *SHEET[1][1:]] for i in range(5)])]
    bad[5][0], bad[6][3], bad[7][8], bad[8][9], bad[9][10], bad[10][7] = "P05", "y = nope*x", "a=1", "[[1],[2]]", "[[[5,0.5]],[[0.5,5]]]", "a=[4,1], b=[0,1]"
    path = tmp_path / "bad.xlsx"
    path.write_bytes(xlsx.write(bad))
    found = {r["row"]: r["problem"] for r in spec_errors(xlsx.read(spark, str(path)), 2).collect()}
    assert sorted(found) == [4, 5, 6, 7, 8, 9, 10, 11] and "twice" in found[4] and "folder" in found[5] and "distinct" in found[6] and "nope" in found[7] and "two of" in found[8] and "paraValue" in found[9] and "varRange" in found[10] and "empty" in found[11]
    assert pipeline.main(["validate", "--root", str(tmp_path / "run"), "--metadata", str(path), "--groups", "2", "--datasets", "0-1"]) == 2


def test_dataset_folders(spark, tmp_path, book):
    specs = cells.problem_rows(xlsx.read(spark, book), 2)
    rows = generate.generate(specs, 30)
    root = str(tmp_path / "data")
    sinks.write_groups(rows, specs, root)
    head, first = (tmp_path / "data" / "P01" / "0.csv").read_text().splitlines()[:2]
    assert head == "x,y" and len(first.split(",")) == 2
    back = files.load_groups(spark, root, ["x"], "y")
    assert back.count() == 4 * 30
    far = back.join(rows.select("id", "grp", "row_idx", F.col("y").alias("y0")), ["id", "grp"]).groupBy("id", "grp", "y").agg(F.min(F.abs(F.col("y") - F.col("y0"))).alias("d"))
    assert far.filter("d > 1e-8").count() == 0
    with pytest.raises(FileExistsError):
        sinks.write_groups(rows, specs, root)
    sinks.write_groups(rows.limit(0), specs, root, overwrite=True)
    holes = rows.withColumn("y", F.when(F.col("row_idx") > 0, F.col("y")))
    sinks.write_noisy(holes, specs, str(tmp_path / "noisy"), "0.01", sep=";")
    lines = (tmp_path / "noisy" / "001" / "P02" / "1.csv").read_text().splitlines()
    assert lines[0] == "x;y" and lines[1].endswith(";") and len(lines) == 31


def test_files_and_metadata(spark, tmp_path):
    found = spark.createDataFrame([("a", "P1"), ("b", "P2")], "path string, id string")
    told = []
    known = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "id string")
    assert files.with_metadata(found, known, warn=told.append).count() == 2 and "P3" in told[0]
    with pytest.raises(FileNotFoundError):
        files.with_metadata(found, known, strict=True)
    with pytest.raises(ValueError, match="P2"):
        files.with_metadata(found, known.filter("id <> 'P2'"))
    (tmp_path / "m.csv").write_text("ID,Target\n1.0,a\n 1 ,b\n2,c\n")
    told.clear()
    assert {r["ID"] for r in files.read_master(spark, str(tmp_path / "m.csv"), ["Target"], warn=told.append).collect()} == {"1", "2"} and "repeated" in told[0]


def test_progress_and_workers(spark):
    assert worker_count(spark, 100) == 4 and worker_count(spark, 2) == 2 and worker_count(spark, 0) == 1 and worker_count(spark, 9, 3) == 3
    with pytest.raises(ValueError):
        worker_count(spark, 1, 0)
    said = []
    with Reporter(spark, said.append, 0.05):
        spark.range(200_000).repartition(8).selectExpr("sum(sqrt(id))").collect()
    assert progress(spark, 0.0).total == 0 and str(Progress(1, 0, 4, 60.0)) == "1 of 4 tasks, 0 failed, 0:01:00, 0:03:00 to go" and all("tasks" in s for s in said)


def test_resume_goes_on_behind_the_last_mark(spark, book, tmp_path):
    config = pipeline.Config(root=str(tmp_path / "run"), metadata=book, groups=2, datasets="0-1", samples=40, iterations=1, islands=2, population=12, noise="0")
    pipeline.prepare(spark, config)
    pipeline.discover(spark, config)
    files_of = lambda d: sorted(str(p) for p in (tmp_path / "run" / "summary").rglob(f"dataset={d}/part-*"))
    first, second = files_of(0), files_of(1)
    assert first and second
    state = spark.read.parquet(config.path("run_state"))
    kept = state.filter("dataset = 0").collect()
    import shutil

    shutil.rmtree(tmp_path / "run" / "run_state")
    spark.createDataFrame(kept, state.schema).write.parquet(config.path("run_state"))
    pipeline.discover(spark, config)
    assert files_of(0) == first and files_of(1) != second


def test_command_line(tmp_path):
    args = pipeline.parser().parse_args(["core", "--root", "r", "--samples", "7", "--with-params", "--dry-run"])
    assert args.samples == 7 and args.with_params and args.dry_run
    config = pipeline.Config(**{k: v for k, v in vars(pipeline.parser().parse_args(["all", "--root", "/data/run", "--iterations", "400", "--islands", "3", "--formula-column", "OriginalFormula", "--top-rank", "2"])).items() if k != "stage"})
    assert config.iterations == 400 and config.islands == 3 and config.path("summary") == "/data/run/summary" and config.formula_column == "OriginalFormula" and config.top_rank == 2
    with pytest.raises(ValueError):
        pipeline.Config(root="r", formula_column="other")
    with pytest.raises(ValueError):
        pipeline.Config(root="r", samples=0)
    assert pipeline.main(["core", "--root", str(tmp_path), "--top", "0"]) == 2


def put_lines(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
def test_csv_is_read_by_ranges(spark, tmp_path, encoding):
    """More than one task a file, and each row once."""
    n = 30_000
    path = put_lines(tmp_path, "a.csv", "k,名\r\n" + "".join(f"{i},值{i}\r\n" for i in range(n)), encoding)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = files.read_csv(spark, path)
        assert df.columns == ["k", "名"] and df.rdd.getNumPartitions() > 3
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((int(r[0]), r[1]) for r in got) == [(i, f"值{i}") for i in range(n)]


def test_line_breaks_in_cells(spark, tmp_path):
    path = put_lines(tmp_path, "b.csv", 'k,v\n1,"two\nlines"\n2,x\n')
    assert sorted(map(tuple, files.read_csv(spark, path).collect())) == [("1", "two\nlines"), ("2", "x")]
    late = put_lines(tmp_path, "c.csv", "k,v\n" + "1,x\n" * 20_000 + '2,"two\nlines"\n')
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_csv(spark, late).collect()
    assert files.read_csv(spark, late, long_records=True).filter("k = '2'").first()["v"] == "two\nlines"
    assert files.has_long_records(b'a,b\n"x\ny",1\n') and not files.has_long_records(b'a,"b"\n"x",1\n')


def test_the_head_is_all_that_is_read_first(spark, tmp_path):
    path = put_lines(tmp_path, "d.csv", "k,v\n" + "1,x\n" * 100_000)
    assert len(files.first_bytes(spark, path)) == files.HEAD and files.first_bytes(spark, path, 3) == b"k,v"
    assert files.first_bytes(spark, str(tmp_path / "none*.csv")) == b""
    with pytest.raises(Exception, match="cells|wrong|2 columns"):
        files.read_csv(spark, put_lines(tmp_path, "e.csv", "k,v\n1,名,3\n", "gb18030")).collect()


def test_reports_keep_their_dialect(spark, tmp_path):
    source = put_lines(tmp_path, "f.csv", "ID;y\r\n1;2\r\n", "utf-8-sig")
    sinks.rewrite_report(spark, source, files.read_csv(spark, source), str(tmp_path / "out"))
    written = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert written == open(source, "rb").read()


def test_what_operators_leave_is_deleted(spark):
    import os

    from fitloom.operators.ordering import running

    mark = sinks.made()
    out = running(spark.range(20).withColumnRenamed("id", "k"), ["k"], "n")
    assert out.count() == 20
    left = [p for p in sinks._made[mark:]]
    assert left and all(os.path.isdir(p) for p in left)
    assert sinks.clean(spark, mark) == len(left) and not any(os.path.exists(p) for p in left) and sinks.made() == mark


def test_broken_runs_are_moved_aside_and_the_summary_is_of_marks(spark, tmp_path):
    root, state = str(tmp_path / "summary"), RunState(spark, str(tmp_path / "marks"))
    for d in range(3):
        spark.createDataFrame([("P1", d * 1.0), ("P2", d * 2.0)], "id string, loss double").write.parquet(f"{root}/features=x+z/dataset={d}")
    (tmp_path / "summary/features=x+z/dataset=2/_SUCCESS").unlink()
    state.mark(spark.createDataFrame([("P1/x+z", 0), ("P2/x+z", 0), ("P1/x+z", 1), ("P1/x+z", 2), ("P9/x", 0)], "id string, dataset int"))
    moved = quarantine(spark, root)
    assert len(moved) == 1 and "summary.broken/features=x+z/dataset=2-" in moved[0] and quarantine(spark, root) == []
    assert spark.read.parquet(moved[0]).count() == 2 and quarantine(spark, str(tmp_path / "none")) == []
    assert sorted((r["id"], r["dataset"]) for r in rebuilt(spark, root, state).collect()) == [("P1", 0), ("P1", 1), ("P2", 0)]

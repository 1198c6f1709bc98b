"""Queries that write a table in one of the formats and read it back through the sources, each with SQL over the table itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from fitloom.functions import cells, scalars
from fitloom.operators import relational
from fitloom.plans.registry import query, table
from fitloom.sources import files, sinks, specs, xlsx
from fitloom.streaming.resume import RunState

NATION = ["n_nationkey", "n_name", "n_regionkey"]


def nation_book(spark, sf_dir, header=NATION, more=lambda r: []):
    """The 25 nations as a workbook in the shared folder."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return sinks.put(spark, sinks.scratch(spark, "book") + ".xlsx", xlsx.write([header, *([*r, *more(r)] for r in rows)]))


def nation_csv(spark, sf_dir, encoding="utf-8", sep=",", header=NATION, cell=str, mark=b""):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    lines = [sep.join(header), *(sep.join(cell(v) for v in r) for r in rows)]
    return sinks.put(spark, sinks.scratch(spark, "table") + ".csv", mark + "\n".join(lines).encode(encoding))


# Workbooks


@query("select n_nationkey::VARCHAR as n_nationkey, n_name, n_regionkey::VARCHAR as n_regionkey from nation")
def q_xlsx_sheet(spark, sf_dir):
    return xlsx.read(spark, nation_book(spark, sf_dir), "no such sheet")


@query("select n_nationkey::VARCHAR as \"ID\", n_name as \"Target\" from nation")
def q_xlsx_targets(spark, sf_dir):
    return xlsx.id_targets(xlsx.read(spark, nation_book(spark, sf_dir, [" ID ", "Target", "n_regionkey"])))


@query("select n_nationkey::VARCHAR as n_nationkey, n_name, n_regionkey::VARCHAR as n_regionkey from nation")
def q_xlsx_snapshot(spark, sf_dir):
    """A workbook that is read, then damaged: the last good snapshot is taken."""
    path, snapshot = nation_book(spark, sf_dir), sinks.scratch(spark, "snapshot")
    xlsx.read(spark, path, snapshot=snapshot)
    sinks.put(spark, path, b"half a workbook")
    return xlsx.read(spark, path, tries=2, wait=0.0, snapshot=snapshot)


@query("select n_name from nation")
def q_xlsx_columns(spark, sf_dir):
    return files.read_table(spark, nation_book(spark, sf_dir), 0, columns=["n_name"])


@query("select 'P' || n_nationkey as \"ID\", n_name as level from nation where n_nationkey > 2")
def q_task_rows(spark, sf_dir):
    """Rows whose key is a task, with a repaired header."""
    book = nation_book(spark, sf_dir, ["n", " Level ", "r", "ID"], lambda r: [f"P{r[0]}" if r[0] > 2 else f"note {r[0]}"])
    sheet = files.repaired_header(xlsx.read(spark, book), {"Level": "level"})
    return files.task_rows(sheet).select("ID", "level")


# CSV


@query("select n_nationkey::VARCHAR as n_nationkey, n_name, n_regionkey::VARCHAR as n_regionkey from nation")
def q_csv_table(spark, sf_dir):
    return files.read_table(spark, nation_csv(spark, sf_dir, header=[f" {h} " for h in NATION]))


@query("select n_nationkey::VARCHAR as n_nationkey, '速度' || n_name as n_name, n_regionkey::VARCHAR as n_regionkey from nation")
def q_csv_encodings(spark, sf_dir):
    cell = lambda v: f"速度{v}" if isinstance(v, str) else str(v)
    parts = [nation_csv(spark, sf_dir, "gb18030", ";", cell=cell), nation_csv(spark, sf_dir, "utf-8", "\t", cell=cell, mark=b"\xef\xbb\xbf")]
    old, new = (files.read_csv(spark, p) for p in parts)
    return old.join(new, NATION)  # the same rows in both


@query("select n_regionkey::DOUBLE as n_regionkey, n_nationkey::DOUBLE as n_nationkey from nation where n_nationkey % 5 <> 0")
def q_csv_samples(spark, sf_dir):
    """Rows with a cell that is no finite number are left out."""
    bad = iter(["nan", "", "inf", "-inf", "text"])
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    lines = ["n_nationkey,n_regionkey", *(f"{next(bad) if r[0] % 5 == 0 else r[0]},{r[2]}" for r in rows)]
    path = sinks.put(spark, sinks.scratch(spark, "samples") + ".csv", b"\xef\xbb\xbf" + "\n".join(lines).encode())
    return files.read_samples(spark, path, ["n_regionkey"], "n_nationkey")


@query("select 'P' || n_nationkey as \"ID\", n_name as \"GenerationFormula\" from nation")
def q_read_master(spark, sf_dir):
    """The formula under its other name, keys normalised, only the columns asked for."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    lines = [" ID ,TransformedFormula,other", *(f" P{r[0]} ,{r[1]},x" for r in rows)]
    path = sinks.put(spark, sinks.scratch(spark, "master") + ".csv", "\n".join(lines).encode())
    return files.read_master(spark, path, ["GenerationFormula"])


@query("select n_nationkey::VARCHAR as \"ID\", n_name as para_eq, case when n_nationkey % 3 <> 1 then n_regionkey::VARCHAR end as extra from nation")
def q_document(spark, sf_dir):
    """Short rows are padded, blank rows dropped, in the order of the file."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    lines = ["ID,para_eq,extra", *(line for r in rows for line in ((f"{r[0]},{r[1]}" if r[0] % 3 == 1 else f"{r[0]},{r[1]},{r[2]}"), ",,"))]
    path = sinks.put(spark, sinks.scratch(spark, "document") + ".csv", b"\xef\xbb\xbf" + "\n".join(lines).encode())
    return files.read_document(spark, path).drop("row_idx")


@query("select n_nationkey as id, n_name as name, n_regionkey as region, 2.5::DOUBLE as k from nation")
def q_renamed_with_constants(spark, sf_dir):
    out, replaced = files.renamed_by_position(table(spark, sf_dir, "nation"), ["id", "name", "region"])
    return files.with_constants(out, {"k": 2.5}) if replaced else out


@query("select n_nationkey, case n_regionkey when 0 then 'High' when 1 then 'Low' else n_regionkey::VARCHAR end as level from nation")
def q_value_aliases(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" "), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("level"))
    return files.renamed_values(rows, "level", {"0": "High", "1": "Low"})


@query("select n_nationkey, n_regionkey as a, n_nationkey * 10 as b, n_regionkey + 1 as y from nation")
def q_bind_columns(spark, sf_dir):
    """Symbols by their names, by x0, x1, or by the first numeric columns; the target by its customary name."""
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("p"), (key * 10).alias("q"), (F.col("n_regionkey") + 1).alias("Target"))
    target = files.target_column(rows.columns)
    numeric = [c for c in rows.columns if c != "n_nationkey"]
    by_position = files.bind_variables(rows.columns, ["v10", "v2"], numeric, target)
    by_number = files.bind_variables(["x0", "x1", target], ["v10", "v2"])
    named = rows.withColumnsRenamed({by_position[s]: n for s, n in by_number.items()})
    exact = files.bind_variables(named.columns, ["x0", "x1"])
    return named.select("n_nationkey", F.col(exact["x0"]).alias("a"), F.col(exact["x1"]).alias("b"), F.col(target).alias("y"))


# Dataset folders


def datasets(spark, sf_dir):
    """Customers as datasets: a problem a nation, two groups each."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("id"), (k % 2).cast("int").alias("grp"), k.alias("row_idx"), F.create_map(F.lit("a"), "c_acctbal", F.lit("b"), k.cast("double")).alias("x"), (F.col("c_acctbal") * 2 + k).alias("y"))
    specs = rows.select("id").distinct().select("id", F.array(F.lit("a"), F.lit("b")).alias("variables"), F.lit("target").alias("target"))
    return rows, specs


@query("select 'P' || c_nationkey as id, (c_custkey % 2)::INT as grp, c_acctbal as a, c_custkey::DOUBLE as b, floor((c_acctbal * 2 + c_custkey) * 100 + 0.5) / 100 as y from customer")
def q_dataset_folders(spark, sf_dir):
    """One CSV a dataset, written and read again in one scan."""
    rows, specs = datasets(spark, sf_dir)
    path = sinks.scratch(spark, "datasets")
    sinks.write_groups(rows, specs, path)
    return files.load_groups(spark, path, ["a", "b"], "target").select("id", "grp", "a", "b", scalars.rounded(F.col("y"), 2).alias("y"))


@query("select 'P' || c_nationkey as id, (c_custkey % 2)::INT as grp, count(*) as n, sum(c_acctbal * 2 + c_custkey) > 0 as positive from customer group by all")
def q_noisy_folders(spark, sf_dir):
    rows, specs = datasets(spark, sf_dir)
    root = sinks.scratch(spark, "noisy")
    sinks.write_noisy(rows, specs, root, "0.01", sep=",")
    return files.load_groups(spark, f"{root}/001", ["a", "b"], "target", "noise_0.01").groupBy("id", "grp").agg(F.count("*").alias("n"), (F.sum("y") > 0).alias("positive"))


@query("select distinct 'P' || c_nationkey as id, (c_custkey % 2)::INT as grp, n_name as name from customer join nation on n_nationkey = c_nationkey")
def q_dataset_files(spark, sf_dir):
    """The one file of each dataset, with the metadata of its problem."""
    rows, specs = datasets(spark, sf_dir)
    path = sinks.scratch(spark, "datasets")
    sinks.write_groups(rows, specs, path)
    metadata = table(spark, sf_dir, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    return files.with_metadata(files.one_file_each(files.dataset_files(spark, path)), metadata, warn=lambda _: None).select("id", "grp", "name")


@query("select 'P' || n_nationkey as id from nation where n_regionkey < 2")
def q_summary_discovery(spark, sf_dir):
    """Files of one name in any case, sorted without regard to case."""
    root = sinks.scratch(spark, "summaries")
    for r in table(spark, sf_dir, "nation").collect():
        sinks.put(spark, f"{root}/P{r[0]}/{('Summary.csv', 'SUMMARY.CSV')[r[2]] if r[2] < 2 else 'other.csv'}", b"x\n")
    found = files.summaries(spark, root, "summary.csv")
    assert found == sorted(found, key=str.casefold)
    return spark.createDataFrame([(p,) for p in found], "path string").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("id"))


# Sinks


@query("select n_nationkey::VARCHAR as n_nationkey, n_name, n_regionkey::VARCHAR as n_regionkey from nation")
def q_report_file(spark, sf_dir):
    path = sinks.scratch(spark, "report")
    sinks.write_report(table(spark, sf_dir, "nation"), path)
    return spark.read.csv(path, header=True)


@query("select n_nationkey, n_name, (n_regionkey + 1)::INT as n_regionkey from nation")
def q_promoted_table(spark, sf_dir):
    """A table that a staged one takes the place of."""
    rows, path = table(spark, sf_dir, "nation"), sinks.scratch(spark, "promoted")
    sinks.write_table(rows, path)
    sinks.promote(spark, sinks.staged(rows.withColumn("n_regionkey", (F.col("n_regionkey") + 1).cast("int")), path), path)
    return spark.read.parquet(path)


@query("select n_nationkey, n_name, n_regionkey, s.c as suppliers from nation left join (select s_nationkey, count(*) as c from supplier where s_acctbal > 6000 group by 1) s on s_nationkey = n_nationkey")
def q_updated_table(spark, sf_dir):
    """Metric columns brought into a table by key, old ones of the name replaced, unmatched rows kept."""
    path = sinks.scratch(spark, "updated")
    sinks.write_table(table(spark, sf_dir, "nation").withColumn("suppliers", F.lit(-1).cast("long")), path)
    counts = table(spark, sf_dir, "supplier").filter("s_acctbal > 6000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return sinks.update_table(spark, path, counts, ["n_nationkey"])


@query("select n_nationkey, coalesce(case when n_regionkey < 3 then n_regionkey::DOUBLE end, 1e100) as mse, coalesce(case when n_regionkey > 1 then 0.5::DOUBLE end, -1e100) as r2 from nation")
def q_compatible(spark, sf_dir):
    region = F.col("n_regionkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(region < 3, region.cast("double")).alias("mse"), F.when(region > 1, 0.5).alias("r2"))
    return sinks.compatible(rows, ["mse"], ["r2"])


def csv_lines(spark, path):
    """Each line of a report as it stands in its file, mark and line ends included, which a reader of lines would drop."""
    files_ = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files_.select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")).filter("line <> ''")


@query("select chr(65279) || 'n_nationkey;n_name;eq_id;redundant;n_regionkey' || chr(13) as line union all select n_nationkey || ';' || n_name || ';' || (n_nationkey + 1) || ';' || case when n_regionkey = 0 then 0 else n_nationkey end || ';' || n_regionkey || chr(13) from nation")
def q_mark_columns(spark, sf_dir):
    """A summary gets its marks right behind the formula and is written in the dialect that it had: separator, line ends, byte-order mark."""
    rows = table(spark, sf_dir, "nation")
    source, out = sinks.scratch(spark, "summary"), sinks.scratch(spark, "marked")
    sinks.write_report(rows, source, "utf-8-sig", ";", "\r\n")
    back = files.read_csv(spark, source)
    key = F.col("n_nationkey").cast("long")
    marked = back.withColumns({"eq_id": key + 1, "redundant": F.when(F.col("n_regionkey") == "0", 0).otherwise(key)})
    sinks.rewrite_report(spark, source, sinks.with_marks(marked, "n_name"), out)
    return csv_lines(spark, out)


@query("select chr(65279) || 'r_regionkey,r_name' as line union all select r_regionkey || ',' || r_name from region")
def q_report_mark(spark, sf_dir):
    """A ranking file begins with a byte-order mark."""
    path = sinks.scratch(spark, "ranking")
    sinks.write_report(table(spark, sf_dir, "region"), path, "utf-8-sig")
    return csv_lines(spark, path)


@query("select o_orderkey, '漢字 ' || o_orderpriority as o_orderpriority, o_totalprice from orders")
def q_csv_large(spark, sf_dir):
    """A file in another encoding, read by ranges of its lines: all orders, from as many files as the writer has made."""
    names = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    rows = table(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderkey", F.concat(F.lit("漢字 "), "o_orderpriority"), "o_totalprice").alias("line"))

    def put(parts):
        yield pd.DataFrame({"line": [",".join(names).encode()]})  # each task writes a file
        for part in parts:
            yield pd.DataFrame({"line": [line.encode("gb18030") for line in part["line"]]})

    path = sinks.scratch(spark, "large")
    rows.mapInPandas(put, "line binary").select(F.col("line").cast("string").alias("value")).write.text(path)
    out = files.read_csv(spark, path)
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))


# Checks of sheets


_DEFECTS = (
    ("ID", "'a/b' || c_custkey", "'ID is no folder name: ''a/b' || c_custkey || chr(39)"), ("IndependentVars", "'x, x'", "'IndependentVars is no list of distinct names'"), ("Target", "'2y'", "'Target is no name'"),
    ("ParameterRange", "'a=[3,1]'", "'ParameterRange has an empty range'"), ("FixedConstantValues", "'c='", "'FixedConstantValues: ''c='' is no constant'"), ("paraValue", "'[[1.0]]'", "'paraValue is not 2 vectors of 1 numbers'"),
    ("varRange", "'[[[2,1]],[[0,1]]]'", "'varRange has an empty range'"), ("GenerationFormula", "'y = a*z'", "'GenerationFormula: unknown names: z'"),
)
_SOUND = {"ID": "'P' || c_custkey", "GenerationFormula": "'y = a*x + c'", "Target": "'y'", "IndependentVars": "'x'", "ParameterRange": "'a=[1,4]'", "FixedConstantValues": "'c=0.5'", "paraValue": "'[[1.0],[2]]'", "varRange": "'[[[0,1]],[[0,1]]]'"}


@query("select case c_custkey % 9 when 1 then 'a/b' || c_custkey else 'P' || c_custkey end as \"ID\", case c_custkey % 9 " + " ".join(f"when {i} then {said}" for i, (_, _, said) in enumerate(_DEFECTS, 1)) + " end as problem from customer where c_custkey % 9 > 0")
def q_spec_errors(spark, sf_dir):
    """A sheet with a problem for each customer, eight of nine with a defect of one kind each: what is wrong with which."""
    bad = {column: f"case when c_custkey % 9 = {i} then {cell} else {_SOUND[column]} end" for i, (column, cell, _) in enumerate(_DEFECTS, 1)}
    sheet = table(spark, sf_dir, "customer").select(*(F.expr(bad[name]).alias(name) for name in _SOUND))
    return specs.spec_errors(sheet, 2).select("ID", "problem")


# Resume


def marked_state(spark, sf_dir) -> RunState:
    state = RunState(spark, sinks.scratch(spark, "state"))
    done = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").cast("string").alias("id"), (F.col("c_custkey") % 8).cast("int").alias("dataset"))
    state.mark(done.filter("dataset < 5"))
    state.mark(done)
    return state


_DONE = "with d as (select distinct c_nationkey::VARCHAR as id, (c_custkey % 8)::INT as dataset from customer where c_acctbal > 0)"


@query("with w as (select n_nationkey::VARCHAR as id, i::INT as dataset from nation, range(0, 10) x(i)), d as (select distinct c_nationkey::VARCHAR as id, (c_custkey % 8)::INT as dataset from customer where c_acctbal > 0) select id, count(*) as remaining from w where not exists (select 1 from d where d.id = w.id and d.dataset = w.dataset) group by 1")
def q_remaining_work(spark, sf_dir):
    work = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id")).join(F.broadcast(spark.range(10).select(F.col("id").cast("int").alias("dataset"))))
    return marked_state(spark, sf_dir).left(work)


@query(_DONE + " select id, max(dataset) as last from (select *, row_number() over (partition by id order by dataset) - 1 as place from d) where place = dataset group by 1")
def q_run_prefix(spark, sf_dir):
    return marked_state(spark, sf_dir).prefix().groupBy("id").agg(F.max("dataset").alias("last"))


@query(_DONE + " select id from d group by 1 having count(*) >= 8")
def q_finished_ids(spark, sf_dir):
    return marked_state(spark, sf_dir).finished_ids(8)


@query("select n_nationkey, s_suppkey from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 9000")
def q_spine_without_fill(spark, sf_dir):
    spine = table(spark, sf_dir, "nation").select("n_nationkey")
    return relational.on_spine(table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), spine, "n_nationkey")


@query("select c_custkey, coalesce(n_name, '') as name from customer left join nation on n_nationkey = c_nationkey and n_regionkey > 0")
def q_metadata_lookup(spark, sf_dir):
    """Many rows to one of the metadata, by a normalised key."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", cells.normal_id(F.col("c_nationkey").cast("double").cast("string")).alias("k"))
    master = table(spark, sf_dir, "nation").filter("n_regionkey > 0").select(cells.normal_id(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"))).alias("k"), "n_name")
    return relational.attach_master(rows, master, "k").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("name"))

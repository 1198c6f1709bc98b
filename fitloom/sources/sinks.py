"""Writers. Spark's committer makes a job's output appear whole; names and layouts follow the dataset folders."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.functions.cells import noise_folder


def write_groups(samples: DataFrame, specs: DataFrame, path: str, overwrite: bool = False, digits: int = 12, sep: str = ",") -> None:
    """``<id>/<grp>.csv``: a header of the problem's variables and its target, then the rows, with ``digits`` significant digits. A null
    target is an empty cell. Without ``overwrite`` it is an error if ``path`` exists.

    ``samples``: id, grp, row_idx, x (map), y; ``specs``: id, variables, target. Lines are made as columns, as problems differ in their
    variables; each file is written whole by one task, under ``path`` + ``.lines``, and moved to its name at the end.
    """
    spark = samples.sparkSession
    shown = lambda c: F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c).cast("double").cast("string")).otherwise("")
    named = samples.join(F.broadcast(specs.select("id", "variables", "target")), "id")  # a row a problem
    line = F.concat_ws(sep, F.transform("variables", lambda v: shown(F.col("x")[v])), shown(F.col("y")))
    head = samples.select("id", "grp").distinct().join(F.broadcast(specs.select("id", "variables", "target")), "id")
    rows = head.select("id", "grp", F.lit(-1).cast("long").alias("row_idx"), F.concat_ws(sep, "variables", "target").alias("line")).unionByName(named.select("id", "grp", "row_idx", line.alias("line")))
    lines = f"{path.rstrip('/')}.lines"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to_path = jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(conf)
    if fs.exists(to_path(path)) and not overwrite:
        raise FileExistsError(path)
    rows.repartition("id", "grp").sortWithinPartitions("id", "grp", "row_idx").select("id", "grp", "line").write.mode("overwrite").partitionBy("id", "grp").text(lines)
    fs.delete(to_path(path), True)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(lines).select("path")
    for r in files.collect():  # one file a dataset
        problem, grp = re.search(r"/id=([^/]*)/grp=([^/]*)/", r["path"]).groups()
        target = to_path(f"{path.rstrip('/')}/{unquote(problem)}/{grp}.csv")
        fs.mkdirs(target.getParent())
        if not fs.rename(to_path(r["path"]), target):
            raise OSError(f"cannot write {target}")
    fs.delete(to_path(lines), True)


def write_noisy(samples: DataFrame, specs: DataFrame, root: str, level: str, overwrite: bool = False, sep: str = ",") -> None:
    """With all digits, under the folder of the level."""
    write_groups(samples, specs, f"{root}/{noise_folder(level)}", overwrite, 17, sep)


def write_table(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


MARK = "\ufeff"


def write_report(df: DataFrame, path: str, encoding: str = "utf-8", sep: str = ",", newline: str = "\n") -> None:
    """One CSV part; for summaries of some hundred rows. ``utf-8-sig`` puts a byte-order mark in front, as spreadsheets want it."""
    marked = encoding == "utf-8-sig"
    rows = df.withColumnRenamed(df.columns[0], MARK + df.columns[0]) if marked else df
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, encoding="utf-8" if marked else encoding, sep=sep, lineSep=newline, escape='"')


def rewrite_report(spark, source: str, df: DataFrame, path: str) -> None:
    """``df`` as a report in the dialect of the CSV at ``source``: its separator, its line ends, and a mark where it has one."""
    from fitloom.sources.files import dialect

    head, encoding, sep, _ = dialect(spark, source)
    if encoding not in ("utf-8", "utf-8-sig"):
        raise ValueError(f"reports are written in UTF-8; {source} is {encoding}")
    write_report(df, path, "utf-8-sig" if head.startswith(MARK.encode()) else "utf-8", sep, "\r\n" if b"\r\n" in head else "\n")


def staged(df: DataFrame, path: str) -> str:
    """Write beside ``path``, to be promoted; returns the staging path."""
    to = f"{path.rstrip('/')}.pending-{uuid.uuid4().hex[:8]}"
    df.write.parquet(to)
    return to


def promote(spark, staging: str, path: str) -> None:
    """The staged table takes the place of ``path``: the old one goes aside first, so that a move that fails can be taken back."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"cannot move {staging} to {path}")
    if had:
        fs.delete(aside, True)


def with_marks(df: DataFrame, formula: str) -> DataFrame:
    """``eq_id`` and ``redundant`` right behind the formula."""
    rest = [c for c in df.columns if c not in ("eq_id", "redundant")]
    at = rest.index(formula) + 1
    return df.select(*rest[:at], "eq_id", "redundant", *rest[at:])


def with_metrics(table: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metric columns by key, replacing those of the same name."""
    new = [c for c in metrics.columns if c not in keys]
    return table.drop(*new).join(metrics, keys, "left")


def update_table(spark, path: str, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The table at ``path`` with the metric columns, written beside it and moved into its place."""
    promote(spark, staged(with_metrics(spark.read.parquet(path), metrics, keys), path), path)
    return spark.read.parquet(path)


def safe_folder(name: str) -> str:
    return re.sub(r'[<>:"/\\|?*\s]+', "_", name).strip("._") or "_"


def compact_name(path: str, what: str) -> str:
    return re.sub(r"(\.\w+)?$", lambda m: f"_{what}{m[1] or ''}", path, count=1)


def compatible(df: DataFrame, mse: list[str], r2: list[str]) -> DataFrame:
    """Nulls as the sentinels that older readers expect."""
    from fitloom.functions.scalars import ERROR_MSE, ERROR_R2

    return df.fillna({**{c: ERROR_MSE for c in mse}, **{c: ERROR_R2 for c in r2}})


_made: list[str] = []


def scratch(spark, name: str) -> str:
    """A new path beside the checkpoints, which all executors share; ``clean`` deletes it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fitloom-")
        spark.sparkContext.setCheckpointDir(folder)
    _made.append(f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many paths there are so far: a mark for ``clean``."""
    return len(_made)


def clean(spark, since: int = 0) -> int:
    """Delete what operators have left beside the checkpoints since the mark. Results that aren't saved yet may read it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, _made[since:] = _made[since:], []
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in found]
    return sum(bool(p.getFileSystem(conf).delete(p, True)) for p in paths)


def put(spark, path: str, data: bytes) -> str:
    """A small file of the driver's, such as a workbook; returns its path."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    out.write(data)
    out.close()
    return path


def between(df: DataFrame) -> DataFrame:
    """``df`` written beside the checkpoints and read again: a short lineage between rounds of an iteration, and no loss with an executor."""
    path = scratch(df.sparkSession, "between")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

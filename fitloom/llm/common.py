"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

#: One character of white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def reader(spark: SparkSession) -> DataFrameReader:
    """Without vectored I/O: its threads each keep a buffer as large as a column chunk outside the heap."""
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reader(spark).parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new temporary one where it is unset (local tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="fitloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clean`` deletes."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many paths there are so far: a mark for ``clean``."""
    return len(_made)


def clean(spark: SparkSession, since: int = 0, keep: Collection[str] = ()) -> int:
    """Delete what this driver's operators have left in the shared folder since the mark. Results that aren't saved yet may read it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for name in [p for p in _made[since:] if p not in keep]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
        _made.remove(name)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: computed once, safe against lost executors, with a short lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return reader(spark).schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def text_key(text: Column, seed: int | None = None) -> Column:
    """Beside the document's id it tells rows apart that share an id; rows alike in both are one document."""
    return F.xxhash64(*([] if seed is None else [F.lit(seed)]), F.coalesce(text, F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters are in it."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

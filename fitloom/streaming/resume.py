"""What is done and what is left: completion marks as a table, so that a run goes on where it stopped; and formulas evaluated as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitloom.operators.ranking import completed_prefix
from fitloom.operators.relational import pending

STATE = "id string, dataset int, done boolean, completed_at timestamp"


class RunState:
    """Completion marks of (id, dataset), appended as Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(STATE).parquet(self.path)
        except Exception as e:  # no mark yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], STATE)

    def mark(self, finished: DataFrame) -> None:
        rows = finished.select(F.col("id").cast("string").alias("id"), F.col("dataset").cast("int").alias("dataset"), F.lit(True).alias("done"), F.current_timestamp().alias("completed_at")).distinct()
        pending(rows, self.read().select("id", "dataset"), ["id", "dataset"]).write.mode("append").parquet(self.path)

    def remaining(self, work: DataFrame) -> DataFrame:
        """Work (id, dataset) without a mark."""
        return pending(work, self.read().filter("done").select("id", "dataset"), ["id", "dataset"])

    def prefix(self) -> DataFrame:
        """Marks up to the first gap of each id: what a serial warm start may build on."""
        return completed_prefix(self.read().groupBy("id", "dataset").agg(F.max("done").alias("done")), ["id"])

    def finished_ids(self, datasets: int) -> DataFrame:
        return self.read().filter("done").groupBy("id").agg(F.countDistinct("dataset").alias("n")).filter(F.col("n") >= datasets).select("id")

    def left(self, work: DataFrame) -> DataFrame:
        return self.remaining(work).groupBy("id").agg(F.count("*").alias("remaining"))


def evaluate_arrivals(formulas: DataFrame, evaluate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of a stream of formulas is evaluated and written, then the query ends; a restart takes what has come since.

    A batch has a folder of its own, ``out/batch=N``, which is overwritten: a batch that is run again after a failure, even one that came
    behind the write, stands once. ``arrived`` reads them all. ``out`` belongs to one ``checkpoint``, which numbers the batches.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        evaluate(df).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={epoch}")

    return formulas.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark: SparkSession, out: str) -> DataFrame:
    """What ``evaluate_arrivals`` has written; a folder without the mark of a whole write is left out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    whole = [name for s in fs.listStatus(path) if (name := s.getPath().toString()).rsplit("/", 1)[-1].startswith("batch=") and fs.exists(at(f"{name}/_SUCCESS"))]
    return spark.read.option("basePath", out).parquet(*whole).drop("batch")


def quarantine(spark: SparkSession, root: str) -> list[str]:
    """Move aside the tables under ``root`` (``features=F/dataset=D``) that were not written to their end, to ``root.broken``; returns where they are now.

    A run that broke off leaves files without the mark of a whole write. They are kept for a look, and no reader meets them.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs, out = path(root).getFileSystem(conf), []
    for s in fs.globStatus(path(f"{root.rstrip('/')}/features=*/dataset=*")) or []:  # a folder a dataset
        at = s.getPath()
        if not fs.exists(path(at, "_SUCCESS")):
            to = path(f"{root.rstrip('/')}.broken/{at.getParent().getName()}/{at.getName()}-{uuid.uuid4().hex[:8]}")
            fs.mkdirs(to.getParent())
            if not fs.rename(at, to):
                raise OSError(f"cannot move {at} aside")
            out.append(to.toString())
    return out


def rebuilt(spark: SparkSession, root: str, state: RunState) -> DataFrame:
    """The summary of all tables under ``root`` from the marks: rows of problems and datasets that are marked as done, and no others."""
    rows = spark.read.parquet(root)
    done = state.read().filter("done").select(F.col("id").alias("mark_"), F.col("dataset").alias("dataset_")).distinct()
    own = F.concat_ws("/", F.col("id"), F.col("features").cast("string"))
    return rows.join(done, (own == F.col("mark_")) & (F.col("dataset") == F.col("dataset_")), "left_semi")

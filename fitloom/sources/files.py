"""Tables from CSV, XLSX, JSON and Parquet, and the conventions of dataset folders."""

from __future__ import annotations

import csv
import io
import re
import warnings
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.functions.cells import normal_id
from fitloom.functions.expr import natural_key
from fitloom.functions.scalars import finite
from fitloom.operators.relational import require_columns
from fitloom.sources import xlsx

# Encodings in the order they are tried, separators, and names that a target column may have.
ENCODINGS, SEPARATORS, TARGETS = ("utf-8-sig", "utf-8", "gb18030"), (",", ";", "\t", "|"), ("y", "Y", "target", "Target", "TARGET")


HEAD = 1 << 16


def first_bytes(spark: SparkSession, path: str, n: int = HEAD) -> bytes:
    """The head of a file, or of the first file of a folder or pattern that has any bytes; no more is read."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    fs = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(name) or []
    files = [f for s in found for f in (sorted(fs.listStatus(s.getPath()), key=lambda x: x.getPath().toString()) if s.isDirectory() else [s])]
    for f in files:
        if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            stream = fs.open(f.getPath())
            try:
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
            finally:
                stream.close()
    return b""


def has_long_records(head: bytes) -> bool:
    """Whether a quoted cell of the head goes on behind a line's end: some line has an odd number of quotes."""
    lines = head.split(b"\n")
    return any(line.count(b'"') % 2 for line in (lines[:-1] if len(head) >= HEAD else lines))


def sniff(head: bytes) -> tuple[str, str, list[str]]:
    """(encoding, separator, header) of a CSV's first bytes."""
    for encoding in ENCODINGS:
        try:
            text = head.decode(encoding)
            break
        except UnicodeDecodeError as e:
            if e.start > len(head) - 4 and len(head) >= HEAD:  # a character cut at the end
                text = head[: e.start].decode(encoding)
                break
    else:
        raise ValueError("the encoding is none of " + ", ".join(ENCODINGS))
    line = text.split("\n", 1)[0].rstrip("\r")
    sep = max(SEPARATORS, key=line.count)
    header = [h.strip() for h in next(csv.reader(io.StringIO(line), delimiter=sep))]
    if len(set(header)) < len(header):
        raise ValueError("a column name occurs twice")
    return encoding, sep, header


def dialect(spark: SparkSession, path: str) -> tuple[bytes, str, str, list[str]]:
    """(head, encoding, separator, header) of all that is at ``path``. The head of the first file may be a header only, or have no character
    that tells the encodings apart, so UTF-8 holds only if all lines are valid in it; the last of the encodings takes what isn't."""
    head = first_bytes(spark, path)
    encoding, sep, header = sniff(head)
    if encoding != ENCODINGS[-1] and spark.read.text(path).filter(~F.is_valid_utf8("value")).take(1):
        encoding = ENCODINGS[-1]
        header = [h.strip() for h in next(csv.reader(io.StringIO(head.split(b"\n", 1)[0].decode(encoding).rstrip("\r")), delimiter=sep))]
    return head, encoding, sep, header


def read_csv(spark: SparkSession, path: str, schema: str | None = None, long_records: bool | None = None) -> DataFrame:
    """All columns as text (or by ``schema``), names trimmed, a byte-order mark dropped; rows of the wrong length are an error.

    A file is read by ranges of its lines, in any of the encodings. Where the head shows line breaks inside quotes, or with
    ``long_records``, a file can't be cut at lines and is read by one task; where only a later row has such a break, the job ends with an
    error that says so in the row's wrong length, and ``long_records`` reads it.
    """
    head, encoding, sep, header = dialect(spark, path)
    kinds = schema or ", ".join(f"`{h}` string" for h in header)
    whole = has_long_records(head) if long_records is None else long_records
    if encoding not in ("utf-8", "utf-8-sig"):
        return _decoded(spark, path, encoding, sep, kinds) if whole else _decoded_lines(spark, path, encoding, sep, kinds)
    return spark.read.csv(path, schema=kinds, header=True, sep=sep, encoding="utf-8", mode="FAILFAST", enforceSchema=True, multiLine=whole, escape='"')


def read_document(spark: SparkSession, path: str, formula: str = "para_eq") -> DataFrame:
    """A summary with all its columns as text and ``row_idx``: short rows are padded, blank rows dropped, rows that are too long an error.

    Marks of an earlier run (``eq_id``, ``redundant``), where there are any, must be whole numbers of at least 0.
    """
    head, encoding, sep, header = dialect(spark, path)
    require = [n for n in (formula,) if n not in header]
    if require:
        raise ValueError(f"{path} lacks the column {formula}")
    kinds = ", ".join(f"`{h}` string" for h in [*header, "too_long_"])
    rows = spark.read.csv(path, schema=kinds, header=True, sep=sep, encoding="utf-8" if encoding == "utf-8-sig" else encoding, mode="PERMISSIVE", multiLine=has_long_records(head), escape='"')
    long = F.when(F.col("too_long_").isNotNull(), F.raise_error(F.lit("a row has more cells than the header")).cast("boolean")).otherwise(F.lit(True))
    bad = [F.col(c).isNotNull() & ~F.col(c).rlike(r"^\d+(\.0*)?$") for c in ("eq_id", "redundant") if c in header]
    marks = F.when(reduce(or_, bad), F.raise_error(F.lit("a mark is no whole number")).cast("boolean")).otherwise(F.lit(True)) if bad else F.lit(True)
    numbered = rows.withColumn("row_idx", F.monotonically_increasing_id())
    return numbered.filter(long).filter(marks).filter(F.coalesce(*(F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")) for h in header)).isNotNull()).drop("too_long_")


def _decoded_lines(spark: SparkSession, path: str, encoding: str, sep: str, kinds: str) -> DataFrame:
    """For an encoding that Spark's CSV reader doesn't take: lines are cut by Spark (a line feed is no part of another character in any of the
    encodings) and decoded a batch at a time. The header is the first line of each file's first range."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, seen = None, set()
        for part in parts:
            lines = []
            for data, start, file in zip(part["line"], part["start"], part["file"]):
                if start == 0 and file not in seen:
                    seen.add(file)
                elif data.strip(b"\r"):
                    lines.append(data.decode(encoding).rstrip("\r"))
            names = names or [f.name for f in fields]
            rows = [[c.strip() if c.strip() else None for c in row] for row in csv.reader(lines, delimiter=sep, skipinitialspace=True)]
            if wrong := next((r for r in rows if len(r) != len(names)), None):
                raise ValueError(f"a row has {len(wrong)} cells for {len(names)} columns: {wrong[:3]}")
            yield pd.DataFrame(rows, columns=names, dtype=object)

    fields = T._parse_datatype_string(kinds).fields
    text = ", ".join(f"`{f.name}` string" for f in fields)
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInPandas(parse, text).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields))


def _decoded(spark: SparkSession, path: str, encoding: str, sep: str, kinds: str) -> DataFrame:
    """The same for files with line breaks inside cells, each whole in one task."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                table = pd.read_csv(io.BytesIO(content), sep=sep, encoding=encoding, dtype=str, skipinitialspace=True)
                yield table.rename(columns=str.strip)

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, kinds)
    return text


def read_table(spark: SparkSession, path: str, sheet: str | int | None = None, columns: list[str] | None = None) -> DataFrame:
    """By suffix: csv, xlsx or xlsm, json, parquet. With ``columns`` only these; of a workbook no other cell is kept."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xlsm"):
        return xlsx.read(spark, path, sheet, columns=columns)
    if columns is not None:
        return require_columns(read_table(spark, path, sheet), columns, path).select(*(f"`{c}`" for c in columns))
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "json":
        return spark.read.json(path)
    return spark.read.parquet(path)


def read_master(spark: SparkSession, path: str, columns: list[str], key: str = "ID", warn: Callable[[str], object] = warnings.warn) -> DataFrame:
    """The metadata of all problems: names trimmed, the formula's other name accepted, only the columns asked for. The key is normalised
    for joins; keys that occur twice are named in a warning."""
    df = read_table(spark, path)
    df = df.toDF(*(c.strip() for c in df.columns))
    if "GenerationFormula" not in df.columns and "TransformedFormula" in df.columns:
        df = df.withColumnRenamed("TransformedFormula", "GenerationFormula")
    out = require_columns(df, [key, *columns], path).select(normal_id(F.col(key)).alias(key), *(c for c in columns if c != key))
    twice = [r[key] for r in out.groupBy(key).count().filter("count > 1").orderBy(key).limit(20).collect()]
    if twice:
        warn(f"{path}: repeated keys, such as {', '.join(twice)}")
    return out


def read_samples(spark: SparkSession, path: str, variables: list[str], target: str) -> DataFrame:
    """Rows of a dataset with all variables and the target finite."""
    df = read_csv(spark, path)
    require_columns(df, [*variables, target], path)
    out = df.select(*(F.col(f"`{c}`").try_cast("double").alias(c) for c in [*variables, target]))
    return finite_rows(out, [*variables, target])


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.filter(finite(F.col(f"`{c}`")))
    return df


def renamed_by_position(df: DataFrame, names: list[str]) -> tuple[DataFrame, bool]:
    """Metadata names for the columns; says whether names had to be replaced."""
    if len(df.columns) != len(names):
        raise ValueError(f"{len(df.columns)} columns for {len(names)} names")
    return df.toDF(*names), list(df.columns) != list(names)


def with_constants(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Parameters and constants of a group as constant feature columns."""
    return df.withColumns({n: F.lit(float(v)) for n, v in values.items()})


def target_column(columns: list[str], wanted: str | None = None, numeric: list[str] | None = None) -> str:
    """By name, then by a customary name, then the last numeric column."""
    for name in (wanted, *(("Target",) if wanted else TARGETS)):
        if name in columns:
            return name
    if wanted:
        raise ValueError(f"no column {wanted!r} and none called Target")
    return (numeric or columns)[-1]


def bind_variables(columns: list[str], symbols: list[str], numeric: list[str] | None = None, target: str | None = None) -> dict[str, str]:
    """The column of each symbol: all by their exact names, else all by x0, x1, ... in the symbols' natural order, else the first
    ``numeric`` columns (where they are given) that aren't the target, in the same order."""
    if all(s in columns for s in symbols):
        return {s: s for s in symbols}
    order = sorted(symbols, key=natural_key)
    by_number = [f"x{i}" for i in range(len(symbols))]
    if all(n in columns for n in by_number):
        return dict(zip(order, by_number))
    others = [c for c in numeric or [] if c != target]
    if len(others) >= len(symbols):
        return dict(zip(order, others))
    raise ValueError(f"no columns for {', '.join(s for s in symbols if s not in columns)}")


def dataset_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, id, grp) of every <ID>/<group>.csv under ``root``; hidden folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(\d+)\.csv$", i)
    return files.select("path", part(1).alias("id"), part(2).try_cast("int").alias("grp")).filter(F.col("grp").isNotNull() & ~F.col("path").rlike(r"/\.[^/]*/"))


def with_metadata(found: DataFrame, metadata: DataFrame, key: str = "id", strict: bool = False, warn: Callable[[str], object] = warnings.warn) -> DataFrame:
    """Files of known problems, with their metadata: an id without metadata is an error. Problems without any file are an error if
    ``strict``, else they are named in a warning."""
    strange = [r[key] for r in found.join(metadata, key, "left_anti").select(key).distinct().orderBy(key).limit(20).collect()]
    if strange:
        raise ValueError(f"no metadata for {', '.join(strange)}")
    missing = [r[key] for r in metadata.join(found, key, "left_anti").select(key).distinct().orderBy(key).limit(20).collect()]
    if missing and strict:
        raise FileNotFoundError(f"no files for {', '.join(missing)}")
    if missing:
        warn(f"no files for {', '.join(missing)}")
    return found.join(metadata, key)


def one_file_each(files: DataFrame) -> DataFrame:
    """A group found in several places is an error; a direct child of the id's folder stands before deeper ones by its shorter path."""
    from pyspark.sql import Window as W

    w = W.partitionBy("id", "grp").orderBy(F.length("path"))
    ranked = files.withColumn("n_", F.row_number().over(w)).withColumn("next_", F.lead(F.length("path")).over(w))
    twice = F.col("next_") == F.length("path")
    return ranked.filter("n_ = 1").filter(F.when(F.coalesce(twice, F.lit(False)), F.raise_error(F.concat(F.lit("several files for "), F.col("path"))).cast("boolean")).otherwise(F.lit(True))).drop("n_", "next_")


def load_groups(spark: SparkSession, root: str, variables: list[str], target: str, variant: str = "base") -> DataFrame:
    """All groups of all ids under ``root`` in one scan: variant, id, grp, row_idx, the variables, y."""
    kinds = ", ".join(f"`{v}` double" for v in [*variables, target])
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(root, schema=kinds, header=True, enforceSchema=False)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"([^/]+)/(\d+)\.csv$", i)
    out = df.select(F.lit(variant).alias("variant"), part(1).alias("id"), part(2).cast("int").alias("grp"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("row_idx"), *variables, F.col(target).alias("y"))
    return finite_rows(out, [*variables, "y"])


def summaries(spark: SparkSession, root: str, name: str) -> list[str]:
    """Paths of all files of a name (any case) under ``root``, sorted without regard to case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").filter(F.lower(F.regexp_extract("path", r"([^/]+)$", 1)) == name.lower())
    return sorted((r["path"] for r in found.collect()), key=str.casefold)  # one a problem


def parse_id_range(text: str) -> tuple[str, int, int]:
    """P10-P20, or one ID."""
    m = re.fullmatch(r"\s*([A-Za-z]*)(\d+)\s*(?:-\s*([A-Za-z]*)(\d+)\s*)?", text)
    if not m or m[3] not in (None, "", m[1]):
        raise ValueError(f"not a range of IDs: {text!r}")
    lo, hi = int(m[2]), int(m[4] or m[2])
    return m[1], min(lo, hi), max(lo, hi)


def in_id_range(df: DataFrame, text: str, key: str = "id") -> DataFrame:
    prefix, lo, hi = parse_id_range(text)
    return df.filter((F.regexp_extract(key, r"^(\D*)\d+$", 1) == prefix) & F.regexp_extract(key, r"(\d+)$", 1).try_cast("long").between(lo, hi))


def task_rows(df: DataFrame, key: str = "ID") -> DataFrame:
    """Rows whose key is P and a number; keys must be unique."""
    from fitloom.operators.relational import require_unique

    return require_unique(df.filter(F.col(key).rlike(r"^P\d+$")), [key])


def repaired_header(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({c: aliases.get(c.strip(), c.strip()) for c in df.columns})


def renamed_values(df: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """Values by their aliases, trimmed; all others as they are."""
    value = F.trim(F.col(f"`{column}`"))
    for old, new in aliases.items():
        value = F.when(F.trim(F.col(f"`{column}`")) == old, F.lit(new)).otherwise(value)
    return df.withColumn(column, value)

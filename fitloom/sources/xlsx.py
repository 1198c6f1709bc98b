"""Worksheets of XLSX files as DataFrames of text columns, by the standard library: a sheet is metadata, some hundred rows."""

from __future__ import annotations

import io
import re
import time
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(ref: str) -> int:
    """A1 to 0, AB3 to 27."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | int | None = None) -> list[list[str | None]]:
    """Cells as text; numbers in their shortest form. The named sheet, or the first one."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.testzip():
            raise zipfile.BadZipFile("a part is damaged")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{REL}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        index = sheet if isinstance(sheet, int) else next((i for i, (n, _) in enumerate(sheets) if n == sheet), 0)
        path = sheets[index][1].lstrip("/")
        tree = ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
    out = []
    for row in tree.iter(f"{MAIN}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{MAIN}c"):
            at = column_number(c.get("r")) if c.get("r") else len(cells)
            value, kind = c.find(f"{MAIN}v"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
            cells += [None] * (at + 1 - len(cells))
            cells[at] = text
        out.append(cells)
    return out


def read(spark: SparkSession, path: str, sheet: str | int | None = "Sampling design", required: bool = False, tries: int = 15, wait: float = 2.0, snapshot: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """First row: trimmed headers; rows with a blank first cell are skipped. A file that can't be read whole is tried again, then the last
    good ``snapshot`` (Parquet) is taken. With ``columns`` only their cells are kept."""
    error: Exception | None = None
    for attempt in range(tries):
        try:
            data = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
            rows = sheet_rows(data, sheet)
            break
        except (zipfile.BadZipFile, OSError) as e:
            error = e
            if attempt + 1 < tries:
                time.sleep(wait)
    else:
        if snapshot:
            return spark.read.parquet(snapshot)
        raise error
    if not rows:
        raise ValueError(f"{path}: the sheet is empty")
    header = [(h or "").strip() or f"column{i}" for i, h in enumerate(rows[0])]
    body = [[*r, *[None] * (len(header) - len(r))][: len(header)] for r in rows[1:] if r and (r[0] or "").strip()]
    if columns is not None:
        if missing := [c for c in columns if c not in header]:
            raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
        at = [header.index(c) for c in columns]
        header, body = list(columns), [[r[i] for i in at] for r in body]
    out = spark.createDataFrame(body, ", ".join(f"`{h}` string" for h in header))
    if snapshot:
        out.write.mode("overwrite").parquet(snapshot)
    return out


def id_targets(sheet: DataFrame) -> DataFrame:
    """(ID, Target): IDs unique, targets not blank."""
    from fitloom.operators.relational import require_columns, require_unique

    require_columns(sheet, ["ID", "Target"], "the sheet")
    rows = sheet.select(F.trim("ID").alias("ID"), F.trim("Target").alias("Target")).filter("ID <> ''")
    named = rows.filter(F.when(F.coalesce(F.col("Target"), F.lit("")) == "", F.raise_error(F.concat(F.lit("no target for "), "ID")).cast("boolean")).otherwise(F.lit(True)))
    return require_unique(named, ["ID"])


def write(rows: list[list[object]], sheet: str = "Sampling design") -> bytes:
    """A small workbook of text cells; for tests and exports of metadata."""
    esc = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>' if v is not None else "<c/>" for v in r) + "</row>" for r in rows)
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets><sheet name="{esc(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()

"""Workbooks (.xlsx) and word-processor documents (.docx) as tables.

Spark lists and deals out the files (``binaryFile``, so any store it can read), and each task
walks the zipped XML of its files element by element: rows go out in batches, and nothing
of a sheet or a body is held but the current element. Held whole are the zipped file and a
workbook's table of shared strings.

A file that cannot be read gives one row with ``error`` and no content; what a damaged file
gave before the damage is left out by :func:`readable`. Empty sheets and documents give no
rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import sections
from .shared import materialize
from .tables import linearise_sheets

ROWS, CHARS = 2_000, 2_000_000  # rows of a batch, and characters
DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # built-in number formats that show dates and times
FIRST_DAY, FIRST_DAY_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
DAY_SECONDS = 86_400

_SHEETS = "path string, document_name string, sheet_no int, sheet string, row int, cells array<string>, error string"
_PARAGRAPHS = "path string, document_name string, index int, style string, heading boolean, text string, error string"


def _plain(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    """An attribute by its name, whatever its namespace."""
    return next((v for k, v in element.attrib.items() if _plain(k) == name), None)


def _elements(archive: zipfile.ZipFile, name: str, *wanted: str) -> Iterator[ElementTree.Element]:
    """The outermost elements of the wanted tags, one after another; each is forgotten once used."""
    with archive.open(name) as part:
        depth, path = 0, []
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                path.append(element)
                depth += _plain(element.tag) in wanted
                continue
            path.pop()
            if _plain(element.tag) in wanted:
                depth -= 1
                if not depth:
                    yield element
            if not depth:
                element.clear()
                if path:
                    path[-1].remove(element)


def _targets(archive: zipfile.ZipFile, folder: str, part: str) -> dict[str, str]:
    """Relationship id -> the name of the part it points to."""
    found = {}
    for r in _elements(archive, f"{folder}/_rels/{part}.rels", "Relationship"):
        target = r.get("Target", "")
        found[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
    return found


def _texts(element: ElementTree.Element) -> str:
    """The text of a string item: its runs joined, phonetic hints left out."""
    if _plain(element.tag) == "rPh":
        return ""
    own = element.text or "" if _plain(element.tag) == "t" else ""
    return own + "".join(_texts(child) for child in element)


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether it shows a date or time."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    custom, styles = {}, []
    for e in _elements(archive, "xl/styles.xml", "numFmt", "cellXfs"):
        if _plain(e.tag) == "numFmt":
            # quoted words, escaped signs and colours are no date letters
            letters = re.sub(r'"[^"]*"|\\.|_.|\[(?![hms]+\])[^\]]*\]', "", e.get("formatCode", ""))
            custom[int(e.get("numFmtId", -1))] = bool(re.search("[dmyhs]", letters, re.IGNORECASE)) and "General" not in letters
        else:
            styles = [custom.get(n := int(x.get("numFmtId", 0)), n in DATE_FORMATS) for x in e]
    return styles


def shown_date(serial: float, first: datetime) -> str:
    """A day number as date and time; one below 1 is a time of day."""
    moment = first + timedelta(seconds=round(serial * DAY_SECONDS, 3))
    return str(moment.time()) if 0 <= serial < 1 else str(moment)


def _cell(cell: ElementTree.Element, strings: list[str], dates: list[bool], first: datetime) -> str | None:
    """A cell as text: whole numbers without a point, others as doubles, booleans as True and False."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_texts(x) for x in cell if _plain(x.tag) == "is")
    value = next((x.text for x in cell if _plain(x.tag) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return str(value.strip() not in ("0", ""))
    if kind != "n":
        return value
    number = float(value) if re.search("[.eE]", value) else int(value)
    style = int(cell.get("s", 0))
    return shown_date(number, first) if style < len(dates) and dates[style] else str(number)


def _column(reference: str) -> int:
    """Column number, from 0, of a cell reference such as AB12."""
    n = 0
    for c in re.match("[A-Z]*", reference.upper())[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """``sheet_no, sheet, row, cells`` of all rows that are written, sheet by sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        strings = [_texts(x) for x in _elements(archive, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        dates, targets, first = _date_styles(archive), _targets(archive, "xl", "workbook.xml"), FIRST_DAY
        for number, sheet in enumerate(_elements(archive, "xl/workbook.xml", "workbookPr", "sheet")):
            if _plain(sheet.tag) == "workbookPr":
                first = FIRST_DAY_1904 if sheet.get("date1904") in ("1", "true") else first
                continue
            part, last = targets.get(_attribute(sheet, "id") or "", ""), 0
            if part not in names:
                continue  # a chart sheet, or one without cells
            for row in _elements(archive, part, "row"):
                last = int(row.get("r", last + 1))
                cells: list[str | None] = []
                for cell in row:
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))  # cells left out, or under a merged one
                    cells.append(_cell(cell, strings, dates, first))
                yield number, sheet.get("name", ""), last, cells


def _run_text(run: ElementTree.Element) -> str:
    """A run's text, its tabs and breaks."""
    signs = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    return "".join((x.text or "") if _plain(x.tag) == "t" else signs.get(_plain(x.tag), "") for x in run)


def document_paragraphs(content: bytes) -> Iterator[tuple[int, str | None, bool, str]]:
    """``index, style, heading, text`` of the paragraphs of the body, in order; those in tables are not among them."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles, default = {}, None
        if "word/styles.xml" in archive.namelist():
            for s in _elements(archive, "word/styles.xml", "style"):
                name = next((_attribute(x, "val") for x in s if _plain(x.tag) == "name"), None)
                styles[_attribute(s, "styleId")] = name
                if _attribute(s, "type") == "paragraph" and _attribute(s, "default") in ("1", "true"):
                    default = name
        index = 0
        # outermost elements: a table, or a note inside a text box, swallows its paragraphs
        for p in _elements(archive, "word/document.xml", "p", "tbl", "sdt"):
            if _plain(p.tag) != "p":
                continue
            text, style = "", None
            for x in p:
                tag = _plain(x.tag)
                if tag == "r":
                    text += _run_text(x)
                elif tag == "hyperlink":
                    text += "".join(_run_text(r) for r in x if _plain(r.tag) == "r")
                elif tag == "pPr":
                    style = next((_attribute(s, "val") for s in x if _plain(s.tag) == "pStyle"), None)
            name = styles.get(style, default) if style else default
            yield index, name, (name or "").lower().startswith("heading"), text
            index += 1


def files(spark: SparkSession, path: str | list[str], suffix: str) -> DataFrame:
    """``path, content`` of all files of one kind under ``path``; Spark passes over empty ones."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def parsed(found: DataFrame, rows, schema: str, columns: list[str]) -> DataFrame:
    """What ``rows`` gives for the content of each file, as ``columns`` of ``schema``; an ``error`` row where it fails."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    form = pa.schema([(name, kinds[kind]) for name, kind in (f.strip().split(" ") for f in schema.split(","))])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for place, content in zip(batch.column("path"), batch.column("content"), strict=True):
                place = place.as_py()
                base, own = {"path": place, "document_name": place.rsplit("/", 1)[-1]}, len(held)  # where the file's rows begin
                try:
                    for row in rows(content.as_py()):
                        held.append(base | dict(zip(columns, row, strict=True)))
                        size += sum(len(x) if isinstance(x, str) else sum(len(c or "") for c in x) if isinstance(x, list) else 0 for x in row)
                        if len(held) >= ROWS or size >= CHARS:
                            yield pa.RecordBatch.from_pylist(held, form)
                            held, size, own = [], 0, 0
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file, the others go on
                    held[own:] = [base | {"error": f"{type(e).__name__}: {e}"}]
        if held:
            yield pa.RecordBatch.from_pylist(held, form)

    return found.select("path", "content").mapInArrow(run, schema)


def workbooks(found: DataFrame) -> DataFrame:
    """``path, document_name, sheet_no, sheet, row, cells, error``: the rows of all sheets of .xlsx files (``path, content``)."""
    return parsed(found, workbook_rows, _SHEETS, ["sheet_no", "sheet", "row", "cells"])


def documents(found: DataFrame) -> DataFrame:
    """``path, document_name, index, style, heading, text, error``: the paragraphs of .docx files (``path, content``)."""
    return parsed(found, document_paragraphs, _PARAGRAPHS, ["index", "style", "heading", "text"])


def readable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the files read to their end, and ``path, document_name, error`` of the others. The files are read once."""
    rows = materialize(rows, "file-rows")
    broken = rows.where(F.col("error").isNotNull()).select("path", "document_name", "error")
    return rows.join(broken.select("path"), "path", "left_anti").drop("error"), broken


def workbook_chunks(rows: DataFrame) -> DataFrame:
    """A chunk for each row of workbooks (see :func:`..tables.linearise_sheets`), told apart by path."""
    return linearise_sheets(rows.withColumn("document_name", F.col("path"))).withColumnRenamed("document_name", "path")


def document_chunks(rows: DataFrame) -> DataFrame:
    """``path, document_name, chunk_index, content``: the sections of documents; headings are those by style."""
    parts = F.array_sort(F.collect_list(F.struct("index", "text", "heading")))
    docs = rows.groupBy("path", "document_name").agg(parts.alias("parts"))
    cut = sections(F.transform("parts", lambda p: p["text"]), F.transform("parts", lambda p: p["heading"]))
    return docs.select("path", "document_name", F.posexplode(cut).alias("chunk_index", "content"))

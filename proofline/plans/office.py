"""Queries of office files: workbooks, documents and PDF files that Spark packs from the tables, read back."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import office, pdf
from .ingest import ORACLES as INGEST_ORACLES
from .views import table

QUERIES: dict = {}
ORACLES: dict = {}

PARTS = 500  # parts of a workbook
LINES = 40  # lines of a page
BYTES = 1_000_000  # of packed files in a batch
_MAIN, _OFFICE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_LINKS, _WORD = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def pack_workbook(sheets: dict[str, dict[int, list]]) -> bytes:
    """An .xlsx file of ``sheet -> row -> cells``: texts are shared strings, numbers and booleans plain cells, None no cell."""
    strings: dict[str, int] = {}

    def cell(row: int, column: int, value) -> str:
        if value is None:
            return ""
        at = f'r="{(chr(64 + column // 26) if column > 25 else "") + chr(65 + column % 26)}{row}"'
        if isinstance(value, bool):
            return f'<c {at} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str):
            return f'<c {at} t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return f"<c {at}><v>{value}</v></c>"

    parts, names, links = {}, "", ""
    for n, (name, rows) in enumerate(sheets.items(), 1):
        body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(cells))}</row>' for r, cells in rows.items())
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'
        names += f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>'
        links += f'<Relationship Id="rId{n}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{n}.xml"/>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_LINKS}">{links}</Relationships>'
    items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_MAIN}">{items}</sst>'
    return _zipped(parts)


def pack_document(paragraphs: list[tuple[str, bool]]) -> bytes:
    """A .docx file of paragraphs, each a text and whether it is a heading."""
    style = '<w:pPr><w:pStyle w:val="H1"/></w:pPr>'
    text = lambda t: escape(t, {"\r": "&#13;"})
    body = "".join(f'<w:p>{style if head else ""}<w:r><w:t xml:space="preserve">{text(t)}</w:t></w:r></w:p>' for t, head in paragraphs)
    styles = '<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style>'
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{_WORD}">{styles}</w:styles>'})


def pack_pdf(pages: list[list[str]]) -> bytes:
    """A PDF file of pages of lines, in one font whose codes are numbers of the file's own characters."""
    codes = {c: k for k, c in enumerate(sorted({c for page in pages for line in page for c in line}), 1)}
    marks = {c: f"{k:04x}" for c, k in codes.items()}
    hexed = lambda line: "".join([marks[c] for c in line])
    meanings = [f"<{k:04x}> <{c.encode('utf-16-be').hex()}>" for c, k in codes.items()]
    table = "1 begincodespacerange <0000> <ffff> endcodespacerange\n" + "\n".join(f"{len(b)} beginbfchar {' '.join(b)} endbfchar" for b in (meanings[k : k + 100] for k in range(0, len(meanings), 100)))

    def stream(text: str) -> bytes:
        data = zlib.compress(text.encode())
        return b"<< /Filter /FlateDecode /Length %d >> stream\n%b\nendstream" % (len(data), data)

    kids = " ".join(f"{6 + 2 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] /Resources << /Font << /F1 3 0 R >> >> >>".encode()]
    objects += [b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>", b"<< /Type /Font /Subtype /CIDFontType2 /DW 500 >>", stream(table)]
    for k, page in enumerate(pages):
        shown = "\n".join(f"<{hexed(line)}> Tj T*" if line else "T*" for line in page)
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * k} 0 R >>".encode(), stream(f"BT /F1 10 Tf 12 TL 40 800 Td\n{shown}\nET")]
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.7\n")
    for k, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj %b endobj\n" % (k, body))
    begin = out.tell()
    entries = "".join(f"{p:010d} 00000 n \n" for p in places)
    out.write(f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n{entries}trailer << /Size {len(places) + 1} /Root 1 0 R >>\nstartxref\n{begin}\n%%EOF\n".encode())
    return out.getvalue()


def _spread(documents: DataFrame) -> DataFrame:
    """``documents`` dealt out to all cores: a table in one row group would be packed and parsed by one task."""
    return documents.repartition(4 * documents.sparkSession.sparkContext.defaultParallelism, "doc_id")


def _files(batches: Iterator[pa.RecordBatch], pack: Callable[..., bytes], *columns: str) -> Iterator[pa.RecordBatch]:
    """``path, content`` of a file packed from ``columns`` of each row; no more than ``BYTES`` and one file are held."""
    paths, contents, size = [], [], 0
    for batch in batches:
        for place, *given in zip(batch.column("path"), *[batch.column(c) for c in columns], strict=True):
            paths.append(place.as_py())
            contents.append(pack(*[x.as_py() for x in given]))
            size += len(contents[-1])
            if size >= BYTES:
                yield pa.record_batch([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])
                paths, contents, size = [], [], 0
    if paths:
        yield pa.record_batch([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])


def o_a2_workbook_chunks(spark, sf_dir):
    """Workbooks of two sheets, the second with gaps between its rows, as chunks."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p_partkey")
        parts = {1: ["name", None, "size"]} | {r: [x.p_name, x.p_type, int(x.p_size)] for r, x in enumerate(rows.itertuples(), 2)}
        flags = {1: ["large"]} | {r: [True] for r, x in enumerate(rows.itertuples(), 2) if x.p_size > 25}
        return pd.DataFrame({"path": [f"parts-{key[0]}.xlsx"], "content": [pack_workbook({"parts": parts, "flags": flags})]})

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    packed = part.groupBy(F.floor(F.col("p_partkey") / PARTS).alias("book")).applyInPandas(pack, "path string, content binary")
    whole, _ = office.readable(office.workbooks(packed))
    return office.workbook_chunks(whole)


ORACLES["o_a2_workbook_chunks"] = f"""
WITH p AS (SELECT *, CAST(floor(p_partkey / {PARTS}) AS BIGINT) AS book, row_number() OVER (PARTITION BY floor(p_partkey / {PARTS}) ORDER BY p_partkey) + 1 AS row FROM part),
u AS (SELECT book, 0 AS sheet_no, 'parts' AS sheet, row, concat_ws('; ', 'name: ' || p_name, 'Col1: ' || p_type, 'size: ' || p_size) AS content FROM p
      UNION ALL SELECT book, 1, 'flags', row, 'large: True' FROM p WHERE p_size > 25)
SELECT concat('parts-', book, '.xlsx') AS path, CAST(row_number() OVER (PARTITION BY book ORDER BY sheet_no, row) - 1 AS INT) AS chunk_index, sheet, CAST(row AS INT) AS row, content FROM u"""


def o_a4_document_sections(spark, sf_dir):
    """Each text as a document of paragraphs, read back and cut into sections."""

    def pack(batches):
        yield from _files(batches, lambda text, heads: pack_document(list(zip(text.split("\n"), heads, strict=True))), "text", "heads")

    d = _spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"))
    heads = F.transform(F.split("text", "\n"), lambda x: x.rlike(r"^\s*#{1,6}\s"))
    packed = d.select(F.concat("doc_id", F.lit(".docx")).alias("path"), "text", heads.alias("heads")).mapInArrow(pack, "path string, content binary")
    whole, _ = office.readable(office.documents(packed))
    return office.document_chunks(whole).select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("doc_id"), F.col("chunk_index").cast("int").alias("chunk_index"), F.md5("content").alias("digest"))


ORACLES["o_a4_document_sections"] = INGEST_ORACLES["o_a4_section_chunks"]


def o_a3_pdf_pages(spark, sf_dir):
    """Each text as a PDF file of pages of lines, read back."""

    def pack(batches):
        yield from _files(batches, lambda text: pack_pdf([x[k : k + LINES] for x in [text.split("\n")] for k in range(0, len(x), LINES)]), "text")

    d = _spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"))
    packed = d.select(F.concat("doc_id", F.lit(".pdf")).alias("path"), "text").mapInArrow(pack, "path string, content binary")
    chunks = pdf.page_chunks(pdf.pages(packed))
    return chunks.select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("doc_id"), "page_number", "chunk_index", F.md5("content").alias("digest"))


ORACLES["o_a3_pdf_pages"] = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
p AS (SELECT doc_id, i // {LINES} AS page, regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '^\s+|\s+$', '', 'g') AS content FROM l GROUP BY 1, 2)
SELECT doc_id, CAST(page + 1 AS INT) AS page_number, CAST(page AS INT) AS chunk_index, md5(content) AS digest FROM p WHERE content <> ''"""
QUERIES |= {f.__name__: f for f in (o_a2_workbook_chunks, o_a3_pdf_pages, o_a4_document_sections)}

"""Office files written by hand or by the packer, read back through Spark."""

import zipfile

from proofline.plans.office import _LINKS, _MAIN, _OFFICE, _WORD, pack_document, pack_workbook
from proofline.sources import office


def zipped(path, parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)


def test_workbook_of_many_rows(spark, tmp_path):
    rows = {r: [f"name {r} & <b>", None, r, r / 4, r % 2 == 0] for r in range(2, 100_002)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.xlsx").write_bytes(pack_workbook({"A": {1: ["n", "", "k", "q", "even"]} | rows, "empty": {}, "B": {3: ["x"], 1: ["h"]}}))
    got = office.workbooks(office.files(spark, str(tmp_path), "xlsx")).where("sheet = 'A' and row > 1").collect()
    assert [(r["row"], r["cells"]) for r in got] == [(r, [a, None, str(k), str(q), str(e)]) for r, (a, _, k, q, e) in rows.items()]
    chunks = office.workbook_chunks(office.workbooks(office.files(spark, str(tmp_path), "xlsx"))).orderBy("chunk_index").collect()
    assert len(chunks) == 100_001 and chunks[0]["content"] == "n: name 2 & <b>; k: 2; q: 0.5; even: True"
    assert (chunks[-1]["sheet"], chunks[-1]["row"], chunks[-1]["content"]) == ("B", 3, "h: x")


def test_cells_of_all_kinds(spark, tmp_path):
    """Rich and inline strings, formulas, errors, dates in custom formats, cells left out, a sheet without header."""
    sheet = (
        '<c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c r="D2" t="str"><f>A1</f><v>cached</v></c><c r="E2" t="e"><v>#N/A</v></c>'
        '<c r="F2" s="1"><v>45000</v></c><c r="G2" s="2"><v>45000.75</v></c><c r="H2" s="3"><v>0.5</v></c><c r="AA2"><v>1e3</v></c>'
    )
    formats = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0.0"/></numFmts>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="S" sheetId="1" r:id="a"/><sheet name="chart" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_LINKS}"><Relationship Id="a" Target="/xl/worksheets/one.xml"/></Relationships>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{_MAIN}"><sheetData><row r="2">{sheet}</row></sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}">{formats}<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
    }
    zipped(tmp_path / "a.xlsx", parts)
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    zipped(tmp_path / "cut.xlsx", parts | {"xl/worksheets/one.xml": '<worksheet><row r="1"><c><v>1</v></c></row><row'})
    rows = office.workbooks(office.files(spark, str(tmp_path), "xlsx"))
    got = rows.where("document_name = 'a.xlsx'").first()
    assert got["cells"] == ["rich", None, "inline", "cached", "#N/A", "2023-03-15 00:00:00", "2023-03-15 18:00:00", "0.5"] + [None] * 18 + ["1000.0"] and got["row"] == 2
    whole, broken = office.readable(rows)
    assert {(r["document_name"], r["error"].split(":")[0]) for r in broken.collect()} == {("bad.xlsx", "BadZipFile"), ("cut.xlsx", "ParseError")}
    assert [r["content"] for r in office.workbook_chunks(whole).collect()] == ["Col0: rich; Col2: inline; Col3: cached; Col4: #N/A; Col5: 2023-03-15 00:00:00; Col6: 2023-03-15 18:00:00; Col7: 0.5; Col26: 1000.0"]
    assert office.shown_date(0.25, office.FIRST_DAY) == "06:00:00" and office.shown_date(1, office.FIRST_DAY_1904) == "1904-01-02 00:00:00"


def test_documents(spark, tmp_path):
    run = lambda t: f"<w:r>{t}</w:r>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr>{run("<w:t>Scope</w:t>")}</w:p><w:p>{run("<w:t>a</w:t><w:tab/><w:t>b</w:t>")}<w:hyperlink>{run("<w:t> link</w:t>")}</w:hyperlink><w:del>{run("<w:delText>gone</w:delText>")}</w:del></w:p>'
        f"<w:tbl><w:tr><w:tc><w:p>{run('<w:t>in a table</w:t>')}</w:p></w:tc></w:tr></w:tbl><w:p/><w:p>{run('<w:t>REQ-1: shall</w:t>')}</w:p>"
    )
    styles = '<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style>'
    zipped(tmp_path / "a.docx", {"word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{_WORD}">{styles}</w:styles>'})
    (tmp_path / "many.docx").write_bytes(pack_document([(f"line {k}", k % 1000 == 0) for k in range(30_000)]))
    (tmp_path / "bad.docx").write_bytes(b"PK")
    rows = office.documents(office.files(spark, str(tmp_path), "docx"))
    got = rows.where("document_name = 'a.docx'").orderBy("index").collect()
    assert [(r["style"], r["heading"], r["text"]) for r in got] == [("heading 1", True, "Scope"), ("Normal", False, "a\tb link"), ("Normal", False, ""), ("Normal", False, "REQ-1: shall")]
    whole, broken = office.readable(rows)
    assert [r["document_name"] for r in broken.collect()] == ["bad.docx"]
    chunks = office.document_chunks(whole).orderBy("document_name", "chunk_index").collect()
    assert [r["content"] for r in chunks if r["document_name"] == "a.docx"] == ["Scope\na\tb link", "REQ-1: shall"]
    many = [r["content"] for r in chunks if r["document_name"] == "many.docx"]
    assert "\n".join(many).split("\n") == [f"line {k}" for k in range(30_000)] and all(len(c) <= 1512 for c in many)


def test_packed_files_leave_in_small_batches():
    """However many rows a batch has, only a bounded number of packed bytes is held."""
    import pyarrow as pa

    from proofline.plans import office as plans

    text = "z" * 400_000
    batch = pa.record_batch([pa.array([f"{k}" for k in range(20)]), pa.array([text] * 20)], names=["path", "text"])
    out = list(plans._files(iter([batch, batch]), str.encode, "text"))
    assert [x for b in out for x in b.column("path").to_pylist()] == [f"{k}" for k in range(20)] * 2
    assert max(b.num_rows for b in out) == 3

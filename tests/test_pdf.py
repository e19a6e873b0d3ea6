"""PDF files written by hand or by the packer, read back through Spark."""

import io
import random
import zlib

from proofline.plans.office import pack_pdf
from proofline.sources import office, pdf


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<< /Length %d %b >> stream\r\n%b\nendstream" % (len(data), more, data)


def numbered(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R") -> bytes:
    """A file of plain objects with a table of two sections."""
    out, places = io.BytesIO(), {}
    out.write(b"%PDF-1.4\n%\xe2\xe3\n")
    for k, body in objects.items():
        places[k] = out.tell()
        out.write(b"%d 0 obj\n%b\nendobj\n" % (k, body))
    begin = out.tell()
    out.write(b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in places.items()) + b"trailer << %b >>\nstartxref\n%d\n%%%%EOF" % (trailer, begin))
    return out.getvalue()


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /degree /uni03A9 /A] >> >>"
SHOWN = rb"""BT /F 10 Tf 14 TL 50 700 Td (Supply \(nominal\): ) Tj [(9 V) -50 ( to) -900 (36)] TJ T* (caf\351 20\001 \002\003 \
end) ' 0 0 (octal \101\n) " ET
q 1 0 0 1 0 -400 cm BT /F 10 Tf 1 0 0 1 50 700 Tm <48 65 6C6c 6F> Tj 100 0 Td (far) Tj -100 0 Td (back) Tj ET Q
BI /W 1 /H 1 ID \000\(( EI /X Do % a comment )
"""


def hand_made() -> bytes:
    form = stream(b"BT /F 8 Tf (in a form) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5]")
    return numbered({
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 9 0 R] /Count 3 /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R /I 7 0 R >> >> >>",
        3: b"<< /Type /Page /Contents [4 0 R 8 0 R] >>", 4: stream(SHOWN), 5: FONT, 6: form, 7: stream(b"\0", b"/Subtype /Image"), 8: stream(b"4254202F462039205466202873706C69742920546A204554>", b"/Filter [/ASCIIHexDecode]"),
        9: b"<< /Type /Pages /Kids [10 0 R 11 0 R] >>", 10: b"<< /Type /Page /Contents 12 0 R >>", 11: b"<< /Type /Page >>", 12: stream(b"q 9 0 0 9 0 0 cm /I Do Q"),
    })


def packed_objects() -> bytes:
    """A file whose objects lie in a stream, under a table that is a stream with a predictor."""
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 5 0 R /Resources << /Font << /F << /Type /Font /Subtype /Type1 /FirstChar 97 /Widths [1000 1000] >> >> >> >>"]
    heads, at = [], 0
    for k, x in enumerate(inner, 1):
        heads.append(b"%d %d" % (k, at))
        at += len(x) + 1
    head = b" ".join(heads) + b" "
    out = io.BytesIO()
    out.write(b"%PDF-1.5\n")
    places = {}
    for k, body in ((4, stream(zlib.compress(head + b" ".join(inner)), b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(head))), (5, stream(b"BT /F 10 Tf 0 0 Td (ab) Tj 21 0 Td (a) Tj 20 0 Td (b) Tj ET"))):
        places[k] = out.tell()
        out.write(b"%d 0 obj\n%b\nendobj\n" % (k, body))
    begin = out.tell()
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, places[4], 0), (1, places[5], 0), (1, begin, 0)]
    table, above = b"", bytes(4)
    for a, b, c in rows:
        row = bytes([a]) + b.to_bytes(2) + bytes([c])
        table, above = table + b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)), row
    out.write(b"6 0 obj\n" + stream(zlib.compress(table), b"/Type /XRef /Root 1 0 R /Size 7 /W [1 2 1] /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >>") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % begin)
    return out.getvalue()


def test_hand_made_files(spark, tmp_path):
    good = hand_made()
    cut = good.replace(b"/Kids [10 0 R 11 0 R]", b"/Kids [10 0 R 99 0 R ")
    secret = numbered({1: b"<< /Pages 2 0 R >>"}, b"/Root 1 0 R /Encrypt 9 0 R")
    for name, data in {"good": good, "packed": packed_objects(), "cut": cut, "secret": secret, "none": b"", "other": b"%PDF-1.4 startxref 3"}.items():
        (tmp_path / f"{name}.pdf").write_bytes(data)
    rows = pdf.pages(office.files(spark, str(tmp_path), "pdf"))
    got = {(r["document_name"], r["page_number"]): (r["text"], r["error"]) for r in rows.collect()}
    first = "Supply (nominal): 9 V to 36\ncafé 20° ΩA end\noctal A\n\nHello far\nback\nin a form\nsplit"
    assert got["good.pdf", 1] == (first, None)
    assert got["good.pdf", 2] == (None, "images without a text layer") and got["good.pdf", 3] == ("", None)
    assert got["packed.pdf", 1] == ("aba b", None)
    broken = {r["document_name"] for r in rows.where("page_number is null").collect()}
    assert broken == {"cut.pdf", "secret.pdf", "other.pdf"}  # Spark lists no empty files
    assert "encrypted" in got["secret.pdf", None][1]
    chunks = pdf.page_chunks(rows).collect()
    assert {(r["document_name"], r["page_number"], r["chunk_index"], r["content"]) for r in chunks} == {("good.pdf", 1, 0, first), ("packed.pdf", 1, 0, "aba b")}


def test_later_tables_win(spark):
    """A file changed by appending: the new object stands for the old one."""
    old = numbered({1: b"<< /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] /Resources << /Font << /F 5 0 R >> >> >>", 3: b"<< /Contents 4 0 R >>", 4: stream(b"BT /F 9 Tf (old) Tj ET"), 5: FONT})
    prev, at = old.rindex(b"xref\n0 1"), len(old) + 1
    new = b"\n4 0 obj\n" + stream(b"BT /F 9 Tf (new) Tj ET") + b"\nendobj\n"
    data = old + new + b"xref\n4 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, prev, len(old) + len(new))
    assert list(pdf.pdf_pages(data)) == [(1, "new", None)] and list(pdf.pdf_pages(old)) == [(1, "old", None)]


def test_many_pages_and_scripts(spark, tmp_path):
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("ab ()\\<é中😀Ω\t") for _ in range(rng.randrange(1, 60)))
    pages = [[line() for _ in range(rng.randrange(1, 30))] for _ in range(700)]
    (tmp_path / "many.pdf").write_bytes(pack_pdf(pages))
    got = pdf.pages(office.files(spark, str(tmp_path), "pdf")).orderBy("page_number").collect()
    assert [r["text"] for r in got] == ["\n".join(p) for p in pages]


def test_ranges_of_codes():
    table = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <10> <12> <0041> <20> <21> [<0066 0069> <D83DDE00>] endbfrange"
    font = pdf.Font(pdf.Reader(numbered({1: stream(table)})), {"Subtype": pdf.Name("Type1"), "ToUnicode": pdf.Ref(1)})
    assert [font.text(c) for c in font.codes(b"\x10\x12\x20\x21\x31")] == ["A", "C", "fi", "😀", "1"]
    text, width, letters, blanks = font.shown(b"\x10\x12\x20\x21\x31")
    assert (text, letters, blanks) == ("ACfi😀1", 5, 1) and width == sum(font.widths.get(c, font.width) for c in (16, 18, 32, 33, 49))
    assert font.shown(b"\x10" * 9)[0] == "A" * 9 and len(font.known) == 5  # each letter is looked up once

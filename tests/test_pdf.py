"""PDF files made here, read back: text, spans, outlines, page ranges, and what is refused."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from docloom.sources import pages as P
from docloom.sources.documents import read_files
from docloom.sources.pdf import Pdf


def make(pages, outline=(), packed=False, extra=b""):
    """A file whose pages are content streams; the outline has (level 1 title, page from 0)."""
    n = len(pages)
    obj = {1: b"<</Type /Catalog /Pages 2 0 R /Outlines 4 0 R>>", 2: b"<</Type /Pages /Count %d /MediaBox [0 0 600 800] /Kids [%s]>>" % (n, b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n)))}
    obj[3] = b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /FirstChar 65 /Widths [600 600]>>"
    obj[4] = b"<</Type /Outlines /First 100 0 R>>" if outline else b"<</Type /Outlines>>"
    obj[5] = b"<</Type /Font /Subtype /Type0 /BaseFont /Other /ToUnicode 6 0 R>>"
    cmap = b"2 beginbfchar <0001> <0159> <0002> <D83DDE00> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    obj[6] = b"<</Length %d>>\nstream\n%s\nendstream" % (len(cmap), cmap)
    for i, body in enumerate(pages):
        raw = zlib.compress(body)
        obj[10 + 2 * i] = b"<</Type /Page /Parent 2 0 R /Contents %d 0 R /Resources <</Font <</F1 3 0 R /F2 5 0 R>>>>>>" % (11 + 2 * i)
        obj[11 + 2 * i] = b"<</Length %d /Filter /FlateDecode>>\nstream\n%s\nendstream" % (len(raw), raw)
    for k, (title, page) in enumerate(outline):
        nxt = b"/Next %d 0 R" % (101 + k) if k + 1 < len(outline) else b""
        obj[100 + k] = b"<</Title %s /Dest [%d 0 R /Fit] %s>>" % (title, 10 + 2 * page, nxt)
    plain = {k: v for k, v in obj.items() if not packed or b"stream" in v}
    if packed:  # the others in an object stream
        rest = {k: v for k, v in obj.items() if k not in plain}
        head, body = b"", b""
        for k, v in rest.items():
            head += b"%d %d " % (k, len(body))
            body += v + b" "
        raw = zlib.compress(head + body)
        plain[900] = b"<</Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode>>\nstream\n%s\nendstream" % (len(rest), len(head), len(raw), raw)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in plain.items()) + b"trailer <</Root 1 0 R %s>>\n%%%%EOF" % extra


ONE = rb"BT /F1 20 Tf 50 700 Td (Title \(one\)) Tj 0 -30 Td /F1 10 Tf (AB and ) Tj [(m)-50(ore)-300(words)] TJ T* ET"
TWO = rb"q 2 0 0 2 0 0 cm BT /F2 8 Tf 1 0 0 1 10 100 Tm <00010010001100120002> Tj ET Q BT /F1 12 Tf 14 TL 100 300 Td (x\344y) Tj (next) ' ET"
TITLES = [(b"(First)", 0), (b"<FEFF010C0061>", 1)]


@pytest.mark.parametrize("packed", [False, True])
def test_text_outline_and_spans(packed):
    pdf = Pdf(make([ONE, TWO, b""], TITLES, packed))
    assert [pdf.text(n) for n in range(3)] == ["Title (one)\nAB and more words", "řabc😀\nxäy\nnext", ""]
    assert pdf.outline() == [(1, "First", 1), (1, "Ča", 2)] and pdf.size(0) == (600.0, 800.0)
    s = pdf.spans(0)
    assert s[0].size == 20 and s[0].bold and (s[0].x1, round(s[0].y2, 6)) == (50, 104) and round(s[1].x2 - s[1].x1, 6) == round(10 * (2 * 0.6 + 5 * 0.5), 6)
    assert pdf.spans(1)[0].size == 16 and pdf.spans(1)[0].x1 == 20


def test_page_ranges():
    pdf = Pdf(make([ONE, TWO, b"BT /F1 9 Tf (three) Tj ET"], TITLES))
    cut = Pdf(pdf.extract(1, 2))
    assert [cut.text(n) for n in range(len(cut.pages))] == ["řabc😀\nxäy\nnext", "three"]
    for a, b in ((2, 1), (-1, 0), (0, 3)):
        with pytest.raises(ValueError):
            pdf.extract(a, b)


def test_refused_files():
    for data in (b"", b"hello", b"%PDF-1.4 nothing", make([ONE], extra=b"/Encrypt 9 0 R")):
        with pytest.raises(ValueError):
            Pdf(data)


def test_files_and_pages_through_spark(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make([ONE, b"", TWO], TITLES))
    (tmp_path / "b.pdf").write_bytes(make([ONE], extra=b"/Encrypt 9 0 R"))
    (tmp_path / "c.pdf").write_bytes(make([b""]))
    docs, errors = read_files(spark, str(tmp_path))
    got = docs.collect()
    assert len(got) == 1 and got[0].content == "Title (one)\nAB and more words\n\nřabc😀\nxäy\nnext" and got[0].metadata == {"page_count": "3", "pages_with_text": "2"}
    assert {r.source_file.rsplit("/", 1)[1]: r.error for r in errors.collect()} == {"b.pdf": "ValueError: encrypted", "c.pdf": "blank or too large"}
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a.pdf").select(F.lit("a").alias("path"), "content")
    pages = {r.page: r for r in P.scan(files, lambda d: P.read_pages(d, cleaned=True), P.PAGES).collect()}
    assert pages[0].text_source == "second" and pages[1].text_source == "none" and pages[0].zoom == 2.0 and pages[2].text == "řabc😀\nxäy\nnext"
    assert [(r.level, r.title, r.page) for r in P.scan(files, P.read_outline, P.OUTLINE).orderBy("ord").collect()] == [(1, "First", 1), (1, "Ča", 2)]
    lines = P.scan(files, P.read_lines, P.LINES).collect()
    assert [r.text for r in lines if r.page == 0][:2] == ["Title (one)", "AB and"] and {r.flags for r in lines} == {0, 16}
    ranges = spark.createDataFrame([("a", 0, 0, 0), ("a", 1, 1, 2), ("a", 2, 2, 5), ("a", 3, 1, 0)], "path string, section int, start_page int, end_page int")
    cut = {r.section: r for r in P.cut_pages(files, ranges).collect()}
    assert len(Pdf(cut[1].content).pages) == 2 and cut[0].error is None and cut[2].error == "ValueError: out of range" and cut[3].error == "ValueError: start after end"


def test_layout_boxes_page_by_page(spark):
    def detect(images):
        if len(images) > 1:
            raise RuntimeError("too many")
        detect.calls += 1
        if detect.calls == 2:
            raise RuntimeError("bad page")
        return [[{"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "label": "Text", "confidence": 0.5}] for _ in images]

    detect.calls = 0
    got = list(P.layout_reader(detect)(make([ONE, TWO, b""])))
    assert [(r["page"], r.get("label"), r.get("error")) for r in got] == [(0, "Text", None), (1, None, "RuntimeError: bad page"), (2, "Text", None)]


def test_cleaned_text_equals_the_column_function(spark):
    from docloom.functions.text import clean_page_text

    t = "a  b ..... c\n \n\td e "
    assert spark.range(1).select(clean_page_text(F.lit(t))).first()[0] == P.clean(t)

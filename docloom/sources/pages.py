"""Pages of binary documents: text, pictures, outlines, positioned lines and layout boxes.

Texts, outlines and lines come from an outside parser where one is installed, else from ``docloom.sources.pdf``, which is
also asked for the text of a page on which the first finds none.  Pictures need the outside parser; without it they stay
null, and layout boxes, which are found on pictures, become error rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.pdf import Pdf

PAGES = "source_file string, page int, text string, text_source string, width double, height double, zoom double, image binary, error string"
OUTLINE = "source_file string, ord int, level int, title string, page int, error string"
LINES = "source_file string, page int, ord int, text string, x1 double, y1 double, x2 double, y2 double, font_size double, flags int, error string"
BOXES = "source_file string, page int, x1 double, y1 double, x2 double, y2 double, label string, confidence double, error string"

Reader = Callable[[bytes], Iterator[dict[str, object]]]


def zoom(width: float, target: float = 1200.0, least: float = 0.5, most: float = 3.0) -> float:
    """The factor that brings a page to about the target width, within bounds."""
    return max(least, min(most, target / width)) if width else 1.0


def zoom_column(width: Column, target: float = 1200.0) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.lit(target) / width))


def first_text(a: str, b: Callable[[], str]) -> tuple[str, str]:
    """(text, which extractor gave it): the first one's, the second one's where that is blank."""
    if a.strip():
        return a, "native"
    second = b()
    return (second, "second") if second.strip() else ("", "none")


def clean(text: str) -> str:
    """Single blanks, short dot runs, trimmed lines, no blank ones: ``clean_page_text`` for a text in a worker."""
    lines = (x.strip() for x in re.sub(r"\.{3,}", "...", re.sub(" +", " ", re.sub("[\u00a0\u2000-\u200a\u202f\u3000]", " ", text))).split("\n"))
    return "\n".join(x for x in lines if x)


def _outside(data: bytes):
    """The file in the outside parser, or None if there is none."""
    try:
        import fitz
    except ImportError:
        return None
    return fitz.open(stream=data, filetype="pdf")


def read_pages(data: bytes, pictures: bool = False, cleaned: bool = False, target: float = 1200.0) -> Iterator[dict[str, object]]:
    """Every page with its text, where that comes from, its size, zoom, and its picture if asked for."""
    own, doc = [], _outside(data)

    def second(n: int) -> str:
        if not own:
            own.append(Pdf(data))
        return own[0].text(n)

    if doc is None:
        own.append(Pdf(data))
    for n in range(len(own[0].pages) if doc is None else len(doc)):
        width, height = own[0].size(n) if doc is None else (doc[n].rect.width, doc[n].rect.height)
        text, source = first_text("" if doc is None else doc[n].get_text(), lambda n=n: second(n))
        z = zoom(width, target)
        image = doc[n].get_pixmap(matrix=__import__("fitz").Matrix(z, z)).tobytes("jpeg", jpg_quality=70) if pictures and doc is not None else None
        yield {"page": n, "text": clean(text) if cleaned else text, "text_source": source, "width": width, "height": height, "zoom": z, "image": image}


def read_outline(data: bytes) -> Iterator[dict[str, object]]:
    doc = _outside(data)
    for n, (level, title, page) in enumerate(Pdf(data).outline() if doc is None else doc.get_toc()):
        yield {"ord": n, "level": level, "title": title, "page": page}


def read_lines(data: bytes) -> Iterator[dict[str, object]]:
    """Positioned spans of more than one character."""
    doc, pdf = _outside(data), None
    if doc is None:
        pdf = Pdf(data)
    for p in range(len(pdf.pages) if doc is None else len(doc)):
        if doc is None:
            found = [(s.text, (s.x1, s.y1, s.x2, s.y2), s.size, 16 if s.bold else 0) for s in pdf.spans(p)]
        else:
            found = [(s["text"], s["bbox"], s["size"], s["flags"]) for block in doc[p].get_text("dict")["blocks"] for line in block.get("lines", []) for s in line["spans"]]
        kept = [f for f in found if len(f[0].strip()) > 1]
        for n, (text, (x1, y1, x2, y2), size, flags) in enumerate(kept):
            yield {"page": p, "ord": n, "text": text.strip(), "x1": x1, "y1": y1, "x2": x2, "y2": y2, "font_size": size, "flags": flags}


def cut_pages(files: DataFrame, sections: DataFrame) -> DataFrame:
    """Files (path, content) cut into the page ranges of ``sections`` (path, section, start_page, end_page; from 0, both
    included): (path, section, content, error).  A range that a file hasn't, or that starts after its end, is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, open_at, pdf = [], None, None
            for path, data, section, start, end in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    if open_at != path:
                        pdf, open_at = Pdf(data), path
                    out.append((path, section, pdf.extract(start, end), None))
                except Exception as e:  # noqa: BLE001 - a bad range is a row, not a failed task
                    out.append((path, section, None, f"{type(e).__name__}: {e}"))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.binary(), pa.string()))], ["path", "section", "content", "error"])

    both = files.select("path", "content").join(sections, "path").select("path", "content", F.col("section").cast("int"), F.col("start_page").cast("int"), F.col("end_page").cast("int"))
    return both.mapInArrow(run, "path string, section int, content binary, error string")


def layout_reader(detect: Callable[[list[bytes | None]], list[list[dict[str, object]]]]) -> Reader:
    """A reader of layout boxes from a model that takes page pictures; the model lives in the worker.

    If the model fails on a file's pages together, each is tried alone, and one that fails gives a row with its error.
    """

    def read(data: bytes) -> Iterator[dict[str, object]]:
        pages = list(read_pages(data, pictures=True))
        try:
            found: list[object] = list(detect([p["image"] for p in pages]))
        except Exception:  # noqa: BLE001 - tried again page by page
            found = []
            for p in pages:
                try:
                    found += detect([p["image"]])
                except Exception as e:  # noqa: BLE001 - the error is the page's row
                    found.append(e)
        for page, boxes in zip(pages, found):
            if isinstance(boxes, Exception):
                yield {"page": page["page"], "error": f"{type(boxes).__name__}: {boxes}"}
            else:
                yield from ({"page": page["page"], **b} for b in boxes)

    return read


def scan(files: DataFrame, reader: Reader, schema: str) -> DataFrame:
    """Rows of every file (path, content) by ``reader``; a file that fails gives one row with its ``error``."""
    kinds = dict(c.strip().split(" ") for c in schema.split(","))
    arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                try:
                    rows = [r | {"source_file": path.as_py()} for r in reader(data.as_py())]
                except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failed task
                    rows = [{"source_file": path.as_py(), "error": f"{type(e).__name__}: {e}"}]
                yield pa.record_batch([pa.array([r.get(n) for r in rows], arrow[k]) for n, k in kinds.items()], list(kinds))

    return files.select("path", "content").mapInArrow(run, schema)

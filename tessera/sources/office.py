"""Rows of spreadsheets and tables of word-processor files, read with the standard library; extractors for `documents_text`."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sheet_rows(data: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet as text; cells that are left out are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheet = next((n for n in sorted(names) if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), None)
        rows: list[list[str]] = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row") if sheet else ():
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                at = _column(c.get("r") or "") if c.get("r") else len(cells)
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (c.findtext(f"{_S}v") or "")
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                cells += [""] * (at - len(cells)) + [value]
            rows.append(cells)
        return rows


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def records(rows: list[list[str]], header_word: str = "name", split: str | None = None) -> list[dict[str, str | list[str]]]:
    """Rows as records under the first row that has the header word; cells of column `split` become lists by line."""
    at = next((i for i, r in enumerate(rows) if any(header_word in c.lower() for c in r)), None)
    if at is None:
        return []
    head = [c.strip().lower() for c in rows[at]]
    out = []
    for r in rows[at + 1 :]:
        if any(c.strip() for c in r):
            rec: dict[str, str | list[str]] = {h: (r[i].strip() if i < len(r) else "") for i, h in enumerate(head) if h}
            if split in rec:
                rec[split] = [x.strip() for x in str(rec[split]).splitlines() if x.strip()]
            out.append(rec)
    return out


def _body(data: bytes) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read("word/document.xml"))


def _paragraph(p: ElementTree.Element) -> str:
    return "".join((x.text or "") if x.tag == f"{_W}t" else "\n" if x.tag == f"{_W}br" else "" for x in p.iter())


def docx_text(data: bytes) -> str:
    """Paragraphs of a document, one a line."""
    return "\n".join(t for p in _body(data).iter(f"{_W}p") if (t := _paragraph(p)))


def docx_tables(data: bytes) -> list[list[list[str]]]:
    """Tables as rows of cell texts."""
    return [[["\n".join(_paragraph(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.iter(f"{_W}tc")] for row in t.iter(f"{_W}tr")] for t in _body(data).iter(f"{_W}tbl")]


def two_columns(tables: list[list[list[str]]]) -> list[tuple[str, str]]:
    """(original, amended) of each two-column table: the rows behind its heading, joined."""
    out = []
    for t in tables:
        rows = [r for r in t if len(r) == 2]
        if rows:
            body = rows[1:] if len(rows) > 1 else rows
            out.append(("\n".join(r[0] for r in body).strip(), "\n".join(r[1] for r in body).strip()))
    return out

import io
import zipfile

from tessera.operators import documents as P
from tessera.sources import office as O


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_sheet():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = zipped({
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Name</t></si><si><t>Bodies</t></si><si><r><t>A</t></r><r><t>nn</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>Export</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="A3" t="s"><v>2</v></c><c r="C3" t="inlineStr"><is><t>X Ltd\nY Ltd</t></is></c></row><row/></sheetData></worksheet>',
    })
    rows = O.sheet_rows(data)
    assert rows[1] == ["Name", "", "Bodies"]
    assert O.records(rows, "name", "bodies") == [{"name": "Ann", "bodies": ["X Ltd", "Y Ltd"]}] and O.records([["x"]], "name") == []


def test_docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join(f"<w:tr><w:tc>{p(a)}</w:tc><w:tc>{p(b)}</w:tc></w:tr>" for a, b in [("Text proposed", "Amendment"), ("old", "new"), ("more", "less")]) + "</w:tbl>"
    data = zipped({"word/document.xml": f"<w:document {ns}><w:body>{p('Amendment 1')}{table}</w:body></w:document>"})
    assert O.docx_text(data).startswith("Amendment 1\nText proposed")
    assert O.two_columns(O.docx_tables(data)) == [("old\nmore", "new\nless")]


def test_pages():
    page = "<h2>CHAPTER I</h2><p>Article 1 Scope</p><p>This <del>old</del>applies widely.</p>"
    assert P.html_structure(page) == [("article", "1", "Chapter I", "Scope\nThis applies widely.")]
    assert P.html_structure(None) == []
    assert P.html_amendments("<table><tr><td>Text proposed</td><td>Amendment</td></tr><tr><td>a</td><td>b</td></tr></table>") == [("a", "b")]
    chunks = P.structural_chunks("ANNEX I\nlist\nArticle 1\n" + "Words here. " * 300, 500)
    assert all(len(c) <= 500 for *_, c in chunks) and chunks[-1][0] == "annex"


def test_documents_text(spark, tmp_path):
    from tessera.sources.connectors import documents_text

    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    got = {r["path"][-5:]: r["text"] for r in documents_text(spark, f"file://{tmp_path}", lambda b: b.decode()).collect()}
    assert got == {"a.txt": "hello", "b.txt": None}

from tessera.sources import pages as P

CARDS = """<div class="es_document"><h3 class="es_document-title"><span class="t-item">Talks &amp; more</span></h3><span class="es_document-subtitle-member">Ann B</span><time datetime="2024-05-06">6</time>
<span class="es_document-subtitle-location">Brussels </span><span class="es_document-subtitle-capacity">Rapporteur</span><span class="es_document-subtitle-reference">2021/0106(COD)</span><span class="es_badge es_badge-committee">ITRE</span>
<span class="es_document-subtitle-author"><a href="https://transparency-register.europa.eu/x?id=123456789-12&lang=en">Foo Ltd</a></span><span class="es_document-subtitle-author">Bar<br>Baz</span></div>
<div class="es_document"><h3 class="es_document-title"><span class="t-item">Nobody</span></h3></div>"""


def test_cards():
    assert P.meeting_cards(CARDS) == [("Talks & more", "Ann B", "2024-05-06", "Brussels", "Rapporteur", "2021/0106(COD)", "ITRE", "Foo Ltd|Bar|Baz", "123456789-12")]
    assert P.meeting_cards(None) == [] and P.meeting_cards("<p>x") == []


def test_rows_of_both_layouts():
    new = """<p>Page 2 of 3</p><table><tr><th>Commission
     Representative(s)</th><th>Date</th></tr><tr><td>Ann<br>Bob</td><td>06/05/2024</td><td>Brussels</td><td><ul><li>Foo</li><li>Bar</li></ul></td><td>Talks</td><td><a href="/meetings/data/meetings/1-2/minutes">pdf</a></td></tr><tr><td>short</td></tr></table>"""
    assert P.meeting_rows(new) == [("Ann, Bob", "2024-05-06", "Brussels", "Foo\nBar", "Talks", "https://ec.europa.eu/meetings/data/meetings/1-2/minutes", 60)]
    old = "<span>1-10 of 81</span><table><tr><th>Date</th></tr><tr><td>6 May 2019</td><td>Online</td><td>Foo</td><td>Talks</td></tr><tr><td>never</td><td>x</td><td></td><td></td></tr></table>"
    assert P.meeting_rows(old) == [(None, "2019-05-06", "Online", "Foo", "Talks", None, 81), (None, None, "x", "", "", None, 81)]
    assert P.meeting_rows("<p>none</p>") == []


def test_hosts():
    page = """<a href="/meeting/commissioner?id=ab-1" title="Information on meetings held by Executive Vice-President Ann Bee.">x</a><a href="/meeting/cabinet?id=ab-1">Meetings held by members of Ann Bee's cabinet</a><a href="/meeting/commissioner?id=ab-1">again</a><a href="/else">no</a>"""
    assert P.hosts(page) == [("Ann Bee", "ab-1", "commissioner"), ("Ann Bee", "ab-1", "cabinet")]


PROCEDURE = """<h2 class="erpl_title-h1">An Act</h2><p class="font-weight-bold mb-1">Status</p><p>Procedure completed</p><p class="font-weight-bold mb-1">Subject</p><p>3.10.04.02 Animal protection<br>4 Economy<br>nothing</p>
<table><tr><th scope="row">Legal basis</th><td><span class="d-block">TFEU 114</span><span class="d-block">TFEU 16-p2</span></td></tr></table><button class="es_accordion-item-title" aria-expanded="true">European Parliament</button>
<div><span class="t-x">European Parliament</span><table class="table"><thead><tr><th>Committee responsible</th><th>Rapporteur</th></tr></thead><tbody><tr><th><span class="es_badge-committee">ITRE</span><a href="/c">Industry</a></th><td><a href="/meps/en/77/x">DOE Jane</a></td></tr><tr><td>Shadow rapporteur <a href="/meps/en/78/x">ROE John</a></td></tr></tbody></table></div>
<h2>Council of the European Union</h2><table><thead><tr><th>Council configuration</th><th>Date</th></tr></thead><tbody><tr><td>Transport</td><td>2024</td></tr></tbody></table>
<div id="section3"><table class="table"><tbody><tr><td>06/05/2024</td><td>Act signed</td><td><a href="/doc/1">COM(2021)0206</a><a class="flag-icon" href="/x">f</a></td><td><a href="/document-summary?id=99">s</a></td></tr><tr><td>soon</td><td>x</td></tr></tbody></table></div><a href="http://e/32024R1689">act</a>"""


def test_procedure():
    assert P.procedure(PROCEDURE) == [("An Act", "Procedure completed", "European Parliament", "COM(2021)0206", "32024R1689", ["3.10.04.02 Animal protection", "4 Economy"], ["TFEU 114", "TFEU 16-p2"], [])]
    assert P.procedure_events(PROCEDURE) == [("2024-05-06", "Act signed", [("COM(2021)0206", "https://oeil.europarl.europa.eu/doc/1")], "99")]
    assert P.procedure_actors(PROCEDURE) == [("European Parliament", "committee", "committee_responsible", "ITRE", "Industry", None), ("European Parliament", "member", "rapporteur", "ITRE", "DOE Jane", "77"), ("European Parliament", "member", "shadow_rapporteur", None, "ROE John", "78"), ("Council of the European Union", "configuration", "council", None, "Transport", "2024")]
    assert P.procedure(None) == [] and P.procedure_events("") == [] and P.procedure_actors("<table><tr><td>x</td></tr></table>") == []


def test_profile():
    page = """<p class="sln-political-group-role">Member</p><time class="sln-birth-date" datetime="1970-01-02">2</time><span class="sln-birth-place">Foo</span><a href="https://x.example/ann" data-original-title="X">x</a><h4>Education</h4><ul><li><strong>1990</strong>: School</li><li>Other</li></ul><h3>Contacts</h3><a href="tel:123">123</a><a href="mailto:a@b">mail</a><h4>Declarations</h4><a href="/d.pdf">Declaration</a>"""
    got = P.profile(page)
    assert ("Education", "entry", "1990", "School") in got and ("Education", "entry", None, "Other") in got and ("Contacts", "phone", "123", "123") in got and ("Declarations", "document", "Declaration", "/d.pdf") in got
    assert ("profile", "birth_date", None, "1970-01-02") in got and ("profile", "social", "X", "https://x.example/ann") in got and P.profile(None) == []

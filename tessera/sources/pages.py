"""Readers of web pages: meeting lists, tables of meetings with their pager, procedure pages, listings of hosts, profiles.

A page is parsed once to a light tree with the standard library; each reader returns plain tuples, so that
`connectors.pages_parsed` or `read_pages` can run it over a table of pages in one narrow pass. A page that is null, empty
or of another make gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "wbr"}
#: Tags that end an open one of their kind.
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}


class Node:
    """An element: tag, attributes, children (elements and strings) and the element around it."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def all(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> list[Node]:
        """Elements below, in order, by tag, class and attributes (an attribute's value must contain the one given)."""
        return [n for n in self.walk() if (tag is None or n.tag == tag) and (cls is None or cls in n.attrs.get("class", "").split()) and all(v in n.attrs.get(k, "") for k, v in attrs.items())]

    def first(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> Node | None:
        return next(iter(self.all(tag, cls, **attrs)), None)

    def pieces(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag == "br":
                yield "\n"
            elif c.tag not in ("script", "style"):
                stack += list(reversed(c.children))

    def text(self, sep: str = "") -> str:
        return squeezed(sep.join(self.pieces()))

    def lines(self) -> list[str]:
        """The parts of the text that tags and line breaks set apart."""
        return [x for p in self.pieces() for part in p.split("\n") if (x := squeezed(part))]

    def next(self, tag: str | None = None) -> Node | None:
        """The next element beside this one."""
        around = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        return next((c for c in around[around.index(self) + 1 :] if tag is None or c.tag == tag), None) if self in around else None


def squeezed(text: str) -> str:
    return " ".join(text.replace(" ", " ").replace("​", "").split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in _CLOSES.get(tag, ()) and self.at.parent:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def _text(n: Node | None) -> str | None:
    return n.text() or None if n is not None else None


def register_id(url: str) -> str | None:
    """The register id in a link to a register's entry."""
    m = re.search(r"[?&]id=([0-9]+-[0-9]+)|([0-9]{6,}-[0-9]{2})", url)
    return (m[1] or m[2]) if m else None


def day(text: str) -> str | None:
    """A date in one of the pages' formats as ISO."""
    for form in ("%d/%m/%Y", "%d %B %Y", "%Y-%m-%d"):
        try:
            return datetime.strptime(text.strip(), form).date().isoformat()
        except ValueError:
            continue
    return None


MEETING_CARD = "title:string,member:string,meeting_date:string,location:string,capacity:string,reference:string,committee:string,attendees:string,register_id:string"


def meeting_cards(page: str | None) -> list[tuple]:
    """Cards of a list of meetings that name an attendee; attendees are joined by pipes, the first linked register id is kept."""
    out = []
    for card in tree(page).all("div", "es_document"):
        title = card.first("h3", "es_document-title")
        part = lambda kind: _text(card.first("span", kind))  # noqa: B023, E731
        names, ids = [], []
        for a in card.all("span", "es_document-subtitle-author"):
            link = next((x for x in a.all("a") if "transparency-register" in x.attrs.get("href", "")), None)
            name = link.text() if link else "|".join(x for p in a.pieces() if (x := squeezed(p)))
            names += [name] if name else []
            ids += [i] if link and (i := register_id(link.attrs["href"])) else []
        when = card.first("time")
        if names:
            out.append((_text(title.first("span", "t-item")) if title else None, part("es_document-subtitle-member"), when.attrs.get("datetime") if when else None, part("es_document-subtitle-location"), part("es_document-subtitle-capacity"), part("es_document-subtitle-reference"), part("es_badge-committee"), "|".join(names), ids[0] if ids else None))
    return out


MEETING_ROW = "cabinet_member:string,meeting_date:string,location:string,organizations:string,subject:string,minutes_url:string,rows_in_all:int"


def meeting_rows(page: str | None, rows_a_page: int = 20, base: str = "https://ec.europa.eu") -> list[tuple]:
    """Rows of a table of meetings, with or without a column of representatives, and how many rows all pages have.

    The pager says "Page 2 of 5" (pages of rows_a_page rows) or "11-20 of 81" (rows).
    """
    root = tree(page)
    whole = root.text(" ")
    pages, counted = re.search(r"Page\s+\d+\s+of\s+(\d+)", whole), re.search(r"\d+\s*-\s*\d+\s+of\s+(\d+)", whole)
    total = int(pages[1]) * rows_a_page if pages else int(counted[1]) if counted else 0
    table = root.first("table")
    if table is None:
        return []
    with_host = any("commission representative" in th.text().lower() for th in table.all("th"))
    out = []
    for row in table.all("tr"):
        cells = row.all("td")
        if len(cells) < (5 if with_host else 4):
            continue
        host, (date, place, bodies, subject) = (", ".join(cells[0].lines()), cells[1:5]) if with_host else (None, cells[:4])
        links = [*row.all("a"), *((n.all("a") if (n := row.next("tr")) and len(n.all("td")) < 4 else []))]
        href = next((a.attrs["href"] for a in links if re.search(r"/meetings/.+/minutes|exportmeetings", a.attrs.get("href", ""))), None)
        out.append((host, day(date.text()), place.text(), "\n".join(bodies.lines()), subject.text(), href if href is None or href.startswith("http") else base + href, total))
    return out


HOST = "name:string,host_id:string,meeting_type:string"


def hosts(page: str | None) -> list[tuple]:
    """Hosts of meetings that a listing links to, each (id, kind) once, with the name in the link."""
    out: dict[tuple[str, str], str] = {}
    for a in tree(page).all("a"):
        if (m := re.search(r"/meeting/(commissioner|cabinet)\?id=([a-f0-9-]+)", a.attrs.get("href", ""))) and (m[2], m[1]) not in out:
            said = re.sub(r"['’]s cabinet.*$", "", a.attrs.get("title") or a.text())
            said = re.sub(r"(?i)^.*?held by\s+(?:members of\s+)?", "", said)
            said = re.sub(r"(?i)^.*?(?:president|high representative[^,]*|commissioner)\s+", "", said, count=1)
            out[m[2], m[1]] = said.strip().rstrip(".")
    return [(name, id_, kind) for (id_, kind), name in out.items()]


PROCEDURE = "title:string,status:string,stage:string,commission_document:string,celex:string,subjects:array<string>,legal_basis:array<string>,amending_acts:array<string>"


def _labelled(root: Node, word: str) -> Node | None:
    """The paragraph or cell behind one that is a label."""
    label = next((n for n in root.walk() if n.tag in ("p", "th", "td", "dt") and n.text().lower().startswith(word.lower()) and len(n.text()) <= len(word) + 24), None)
    return label.next() if label is not None else None


def procedure(page: str | None) -> list[tuple]:
    """The head of a procedure's page, one row a page."""
    root = tree(page)
    head = root.first("h2", "erpl_title-h1") or root.first("h1")
    if head is None:
        return []
    items = lambda word: [] if (n := _labelled(root, word)) is None else [s.text() for s in n.all("span", "d-block") if s.text()] or n.lines()
    status = _labelled(root, "Status") or _labelled(root, "Stage reached")
    stage = next((b.text() for b in root.all("button", "es_accordion-item-title") if b.attrs.get("aria-expanded") == "true"), None)
    links = [x for a in root.all("a") for x in (a.attrs.get("href", ""), a.text())]
    cited = lambda pattern: next((m[0] for x in [*links, root.text(" ")] if (m := re.search(pattern, x))), None)
    subjects = [x for x in items("Subject") if re.match(r"\d+(\.\d+){0,3}\s+\w", x)]
    return [(head.text(), _text(status), stage, cited(r"COM\(\d{4}\)\d{4}"), cited(r"\b3\d{4}[A-Z]\d{4}\b"), subjects, items("Legal basis"), items("Amending"))]


EVENT = "event_date:string,event:string,documents:array<struct<id:string,url:string>>,summary_id:string"


def procedure_events(page: str | None, base: str = "https://oeil.europarl.europa.eu") -> list[tuple]:
    """Dated rows of the table of key events: date, what happened, linked documents, id of the summary."""
    root = tree(page)
    section = root.first("div", id="section3") or next((h.parent for h in root.all("h2") if "Key events" in h.text()), None)
    table = section.first("table") if section is not None else None
    out = []
    for row in table.all("tr") if table is not None else ():
        cells = row.all("td")
        if len(cells) < 2 or (when := day(cells[0].text())) is None or not cells[1].text():
            continue
        documents = [(a.text(), base + h if (h := a.attrs.get("href", "")).startswith("/") else h or None) for a in (cells[2].all("a") if len(cells) > 2 else ()) if a.text() and not a.attrs.get("href", "").endswith("/") and "flag-icon" not in a.attrs.get("class", "")]
        summary = next((h.split("id=")[-1] for a in (cells[3].all("a") if len(cells) > 3 else ()) if "document-summary" in (h := a.attrs.get("href", "")) and "id=" in h), None)
        out.append((when, cells[1].text(), documents, summary))
    return out


ACTOR = "institution:string,kind:string,role:string,code:string,name:string,actor_id:string"
_ROLES = (("joint committee responsible", "joint_committee_responsible"), ("former committee responsible", "former_committee_responsible"), ("committee responsible", "committee_responsible"), ("former committee for opinion", "former_committee_opinion"), ("committee for opinion", "committee_opinion"), ("committee for budgetary", "committee_budgetary"))


def procedure_actors(page: str | None) -> list[tuple]:
    """Actors of a procedure: committees and members of the parliament's tables, configurations of the council, departments and consultative bodies."""
    root = tree(page)
    out = []
    for table in root.all("table"):
        top = table.first("thead")
        heading = top.text().lower() if top else ""
        section = _section(table)
        role = next((r for w, r in _ROLES if w in heading), None)
        body = table.first("tbody") or table
        for row in body.all("tr"):
            cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("th", "td")]
            shadow = "shadow rapporteur" in row.text().lower()
            if role:
                badge = row.first("span", "es_badge-committee")
                code = _text(badge)
                named = next((a for c in cells if c.tag == "th" for a in c.all("a")), None)
                if code and not shadow:
                    out.append(("European Parliament", "committee", role, code, _text(named), None))
                for a in (a for c in cells if c.tag == "td" for a in c.all("a")):
                    if m := re.search(r"/meps/[a-z]{2}/(\d+)", a.attrs.get("href", "")):
                        kind = "shadow_rapporteur" if shadow else "rapporteur" if "opinion" not in role else "rapporteur_opinion"
                        out.append(("European Parliament", "member", kind, None if shadow else code, a.text(), m[1]))
            elif "council" in section and "council" in heading and len(cells) >= 2:
                out.append(("Council of the European Union", "configuration", "council", None, cells[0].text(), cells[1].text() or None))
            elif "commission" in section and len(cells) >= 2 and "dg" in heading:
                out.append(("European Commission", "department", "dg", None, cells[0].text(), cells[1].text() or None))
            elif "consultative" in section or "committee" in section and "european" in section:
                if cells and cells[0].text():
                    out.append((cells[0].text(), "body", "consultative", None, cells[0].text(), None))
    return out


def _section(n: Node) -> str:
    """The nearest heading or accordion button before a table, lowered."""
    at = n
    while at.parent is not None:
        before = [c for c in at.parent.children[: at.parent.children.index(at)] if isinstance(c, Node)]
        for c in reversed(before):
            heads = [c, *c.walk()] if c.tag not in ("table",) else []
            for h in reversed(heads):
                if h.tag in ("h2", "h3", "button") or (h.tag == "span" and "t-x" in h.attrs.get("class", "").split()):
                    return h.text().lower()
        at = at.parent
    return ""


PROFILE = "section:string,kind:string,label:string,value:string"


def profile(page: str | None) -> list[tuple]:
    """What a person's page says, as (section, kind, label, value): birth, role, contacts, social links, committees, entries of a CV, assistants, declarations.

    Sections are named by their headings. Entries of a list that begin in bold have that as their label.
    """
    root = tree(page)
    out = []
    for kind, n in (("role", root.first("p", "sln-political-group-role")), ("birth_place", root.first("span", "sln-birth-place"))):
        if _text(n):
            out.append(("profile", kind, None, n.text()))
    if (born := root.first("time", "sln-birth-date")) is not None:
        out.append(("profile", "birth_date", None, born.attrs.get("datetime")))
    section = "profile"
    for n in root.walk():
        if n.tag in ("h1", "h2", "h3", "h4", "h5"):
            section = n.text() or section
        elif n.tag == "a" and n.attrs.get("href"):
            href = n.attrs["href"]
            kind = "phone" if href.startswith("tel:") else "mail" if href.startswith("mailto:") else "committee" if "erpl_badge" in n.attrs.get("class", "") else "document" if href.lower().endswith((".pdf", ".docx")) else "social" if n.attrs.get("data-original-title") else "link"
            out.append((section, kind, n.attrs.get("data-original-title") or _text(n), re.sub(r"^(?:tel|mailto):", "", href)))
        elif n.tag == "li" and not n.all("li"):
            bold = n.first("strong") or n.first("b")
            said = n.text()
            if bold is not None and bold.text():
                said = said.replace(bold.text(), "", 1).lstrip(": ").strip()
            if said and not n.all("a"):
                out.append((section, "entry", _text(bold), said))
    return out


def read_pages(pages: DataFrame, id_col: str, page_col: str, read: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """id, pos (from 0) and a reader's columns for every page; `schema` is the constant beside the reader."""

    @F.pandas_udf(f"array<struct<{schema}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([read(x) if x else [] for x in b], dtype=object)

    found = pages.select(pages[id_col].alias("__id"), F.posexplode(run(pages[page_col])).alias("pos", "__r"))
    return found.select(F.col("__id").alias(id_col), "pos", "__r.*")

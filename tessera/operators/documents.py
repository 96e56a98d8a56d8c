"""Documents: chunking, structure, HTML, amendments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def recursive_chunks(text: str | None, size: int = 1500, overlap: int = 200, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that occurs, then at finer ones; neighbours overlap.

    Single line breaks first become spaces. Separators at cuts are dropped. Null and blank texts give nothing.
    """
    text = re.sub(r"(?<!\n)\n(?!\n)", " ", text or "").strip()
    return [c for c in _cut(text, size, overlap, separators) if c.strip()] if text else []


def _cut(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    if len(text) <= size:
        return [text]
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else []
    parts = text.split(sep) if sep else list(text)
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if len(part) > size:
            if held:
                out.append(sep.join(held))
                held, length = [], 0
            out += _cut(part, size, overlap, finer or [""])
            continue
        grown = length + len(part) + (len(sep) if held else 0)
        if grown > size and held:
            out.append(sep.join(held))
            while held and (length > overlap or length + len(part) + len(sep) > size):
                length -= len(held.pop(0)) + (len(sep) if held else 0)
            grown = length + len(part) + (len(sep) if held else 0)
        held.append(part)
        length = grown
    if held:
        out.append(sep.join(held))
    return out


def chunk_records(df: DataFrame, id_col: str, text_col: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """id, chunk_index (from 0), n_chunks, text."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([recursive_chunks(t, size, overlap) for t in batch], dtype=object)

    c = df.select(df[id_col].alias("__id"), cut(df[text_col]).alias("__c"))
    return c.select(F.col("__id").alias(id_col), F.size("__c").alias("n_chunks"), F.posexplode("__c").alias("chunk_index", "text"))


def four_parts(text: Column, markers: tuple[str, str, str], least: int = 500) -> Column:
    """The parts before, between and behind three markers, in order; parts under `least` characters are left out."""
    at = [F.when(F.locate(m, text) > 0, F.locate(m, text)) for m in markers]
    n = F.length(text) + 1
    cuts = [F.lit(1), F.coalesce(at[0], at[1], at[2], n), F.coalesce(at[1], at[2], n), F.coalesce(at[2], n), n]
    names = ["preamble", "recitals", "articles", "annexes"]
    parts = F.array(*[F.struct(F.lit(x).alias("part"), F.substring(text, a, F.greatest(b - a, F.lit(0))).alias("text")) for x, a, b in zip(names, cuts, cuts[1:])])
    return F.filter(parts, lambda p: F.length(p["text"]) >= least)


_HEADER = re.compile(r"^\s*(CHAPTER|TITLE|SECTION|Section|Chapter|Title|Article|Part|PART|ANNEX|Annex)\s+([0-9IVXLC]+)\b[ \t]*(.*)$")
_RECITAL = re.compile(r"^\s*\((\d+)\)\s+(.*)$")


def legal_structure(text: str | None) -> list[tuple[str, str, str, str]]:
    """(kind, number, context, text) of the preamble, recitals, articles and annexes of a legal text, in order."""
    out: list[list[str]] = []
    context, kind = "", "preamble"
    current = ["preamble", "", "", ""]
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        h, r = _HEADER.match(line), _RECITAL.match(line)
        if h and h[1].lower() in ("chapter", "title", "section", "part"):
            context = f"{h[1].title()} {h[2]} {h[3]}".strip()
            continue
        if h:
            out.append(current)
            kind = "article" if h[1].lower() == "article" else "annex"
            current = [kind, h[2], context if kind == "article" else "", h[3].strip()]
        elif r and kind in ("preamble", "recital"):
            out.append(current)
            kind = "recital"
            current = ["recital", r[1], "", r[2]]
        else:
            current[3] = f"{current[3]}\n{line}".strip("\n")
    out.append(current)
    return [(a, b, c, d.strip()) for a, b, c, d in out if d.strip() or a != "preamble"]


def html_structure(page: str | None) -> list[tuple[str, str, str, str]]:
    """legal_structure of a page's text; deleted mark-up is gone by then."""
    return legal_structure(html_text(page)) if page else []


def html_amendments(page: str | None) -> list[tuple[str, str]]:
    """(original, amended) of each two-column row behind a heading row, in order."""
    rows = [r for r in html_rows(page) if len(r) == 2]
    return [(a, b) for a, b in rows if not re.match(r"(?i)^(text proposed|original|draft)", a)]


def structural_chunks(text: str | None, most: int = 1500) -> list[tuple[str, str, str]]:
    """(kind, number, piece): provisions packed to pieces of at most `most`; long ones are cut, annexes come last."""
    parts = legal_structure(text)
    out = []
    for kind, number, _, body in [p for p in parts if p[0] != "annex"] + [p for p in parts if p[0] == "annex"]:
        out += [(kind, number, piece) for piece in recursive_chunks(body, most, 0)]
    return out


def provisions(df: DataFrame, id_col: str, text_col: str, least: int = 11, most: int = 10_000) -> DataFrame:
    """One row a provision: id, kind, number, context, sort_order, text cut at `most`; very short ones are left out."""

    @F.pandas_udf("array<struct<kind:string,number:string,context:string,text:string>>")
    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([legal_structure(t) if t else [] for t in batch], dtype=object)

    p = df.select(df[id_col].alias("__id"), F.posexplode(parse(df[text_col])).alias("sort_order", "__p"))
    return p.select(F.col("__id").alias(id_col), "sort_order", "__p.kind", "__p.number", "__p.context", F.substring("__p.text", 1, most).alias("text")).where(F.length("text") >= least)


class _Text(HTMLParser):
    """Text of a page: block tags break lines, deleted and hidden matter is left out."""

    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}
    GONE = {"script", "style", "del", "s", "strike", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.GONE
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.GONE and self.depth > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_text(page: str | None) -> str | None:
    """A page's text, one line a block, white space collapsed; null stays null."""
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    text = "".join(parser.parts).replace(" ", " ").replace("​", "")
    lines = (re.sub(r"[ \t\r\f]+", " ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


class _Table(HTMLParser):
    """Rows of cells of all tables, and the links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.links: list[tuple[str, str]] = []
        self.cell: list[str] | None = None
        self.link: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "a":
            self.link = (dict(attrs).get("href") or "", [])

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "a" and self.link is not None:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split())))
            self.link = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        if self.link is not None:
            self.link[1].append(data)


def html_rows(page: str | None) -> list[list[str]]:
    parser = _Table()
    parser.feed(page or "")
    parser.close()
    return [r for r in parser.rows if any(r)]


def html_links(page: str | None) -> list[tuple[str, str]]:
    parser = _Table()
    parser.feed(page or "")
    parser.close()
    return parser.links


_AMENDMENT = re.compile(r"^\s*Amendment\s+(\d+)\s*$", re.M)


def amendments(text: str | None) -> list[tuple[int, str, str, str, str]]:
    """(number, authors, target, body, justification) of each block that an 'Amendment n' line opens."""
    out = []
    starts = list(_AMENDMENT.finditer(text or ""))
    for m, nxt in zip(starts, [*starts[1:], None]):
        block = (text or "")[m.end() : nxt.start() if nxt else len(text or "")]
        lines = [x.strip() for x in block.strip().split("\n")]
        at = next((i for i, x in enumerate(lines) if re.match(r"(?i)^(article|recital|annex|title|citation|paragraph)\b", x)), None)
        authors = ", ".join(x for x in lines[:at] if x) if at else ""
        target = lines[at] if at is not None else ""
        rest = "\n".join(lines[at + 1 :] if at is not None else lines).strip()
        body, _, why = re.sub(r"(?im)^\s*or\.\s*\w{2}\s*$", "", rest).partition("Justification")
        out.append((int(m[1]), authors, target, body.strip(), why.strip()))
    return out


def amendment_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row an amendment: id, number, authors, target, body, justification."""

    @F.pandas_udf("array<struct<number:int,authors:string,target:string,body:string,justification:string>>")
    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([amendments(t) if t else [] for t in batch], dtype=object)

    return df.select(df[id_col].alias("__id"), F.explode(parse(df[text_col])).alias("__a")).select(F.col("__id").alias(id_col), "__a.*")


def citation_windows(text: str | None, pattern: str = r"\b(?:Article|Art\.|Recital|recital|Annex)\s+\d+", reach: int = 900, least: int = 80) -> list[tuple[str, int, str]]:
    """(citation, position, text around it without citations) of every citation; short surroundings are left out."""
    out = []
    for m in re.finditer(pattern, text or ""):
        around = re.sub(r"\s+", " ", re.sub(pattern, " ", text[max(0, m.start() - reach) : m.end() + reach])).strip()
        if len(around) >= least:
            out.append((m[0], m.start(), around))
    return out


def rouge_l(a: str, b: str, most: int = 150) -> float:
    """ROUGE-L F1 over word tokens; the common subsequence looks at the first `most` tokens, lengths count all."""
    x, y = re.findall(r"\w+", a.lower()), re.findall(r"\w+", b.lower())
    if not x or not y:
        return 0.0
    row = [0] * (min(len(y), most) + 1)
    for w in x[:most]:
        last = 0
        for j, v in enumerate(y[:most], 1):
            last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
    p, r = row[-1] / len(y), row[-1] / len(x)
    return 2 * p * r / (p + r) if p + r else 0.0


def glued_split(text: str, names: set[str]) -> list[str]:
    """A run of names without separators cut greedily at known names, the longest first; unknown stretches stay whole."""
    longest, out, at, held = max(map(len, names), default=0), [], 0, ""
    while at < len(text):
        hit = next((text[at : at + n] for n in range(min(longest, len(text) - at), 0, -1) if text[at : at + n] in names), None)
        if hit:
            if held.strip():
                out.append(held.strip())
            out.append(hit)
            held, at = "", at + len(hit)
        else:
            held += text[at]
            at += 1
    return [*out, held.strip()] if held.strip() else out


def contents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, number, level, title of the numbered headings of a text, in their order: "2.1. Scope" has level 2."""
    lines = df.where(df[text_col].isNotNull()).select(df[id_col].alias("__id"), F.posexplode(F.split(df[text_col], "\n")).alias("pos", "line"))
    rx = r"^([0-9]+(?:\.[0-9]+)*)\.? +([A-Z].*)$"
    heads = lines.where(F.col("line").rlike(rx)).select("__id", "pos", F.regexp_extract("line", rx, 1).alias("number"), F.regexp_extract("line", rx, 2).alias("title"))
    return heads.select(F.col("__id").alias(id_col), "pos", "number", F.size(F.split("number", r"\.")).alias("level"), "title")


def glued_names(text: Column, names: list[str]) -> Column:
    """glued_split as a column, for a dictionary of bounded size."""
    known = set(names)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if t is None else glued_split(t, known) for t in b], dtype=object)

    return cut(text)


def weighted_ratio(a: str, b: str) -> float:
    """A similarity from 0 to 100: the best of plain, sorted-token and token-set ratios and, for unequal lengths, a partial one."""
    from difflib import SequenceMatcher

    ratio = lambda x, y: 100 * SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0
    a, b = (re.sub(r"\W+", " ", x.lower()).strip() for x in (a, b))
    if not a or not b:
        return 0.0
    s, t = sorted(a.split()), sorted(b.split())
    both = sorted(set(s) & set(t))
    sets = max(ratio(" ".join(both), " ".join([*both, *sorted(set(s) - set(t))])), ratio(" ".join(both), " ".join([*both, *sorted(set(t) - set(s))])), ratio(" ".join([*both, *sorted(set(s) - set(t))]), " ".join([*both, *sorted(set(t) - set(s))])))
    best = max(ratio(a, b), 0.95 * ratio(" ".join(s), " ".join(t)), 0.95 * sets)
    short, long = sorted((a, b), key=len)
    if len(long) > 1.5 * len(short):
        scale = 0.9 if len(long) < 8 * len(short) else 0.6
        best = max(ratio(a, b), scale * max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)), 0.95 * scale * sets)
    return round(best, 4)

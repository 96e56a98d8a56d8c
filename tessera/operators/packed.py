"""Several values packed in one field: one row a value, with its position.

The field is split on quote characters; every second piece is a literal, the others are split on delimiters. A fold
over the resulting tokens puts values together again (a literal may be part of a longer value, doubled quotes stand
for one), and a second fold joins values that a comma split although they are one name. All of it is built from array
functions of SQL, so it runs inside the JVM and in a single narrow pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows

QUOTES = '"“”„«»'
#: Delimiters that always separate, and the mark of a list's entry behind the start, a delimiter or a line break.
STRONG = r"[;|\t\r\n]+|//+"
MARK = r"(?:[-*•·–‣▪][  ]+|\(?[0-9]{1,3}[.)][  ]+)"
#: What follows a comma without being a value of its own: an office of the body before, a legal form.
ATTACHED = r"(?i)^(?:(?:the |an )?(?:(?:eu|european|brussels)[ -])?(?:liaison |representative |representation )?office|headquarters|hq|brussels(?: office)?|inc\.?|ltd\.?|llc\.?|plc\.?|l\.l\.c\.|s\.a\.?|n\.v\.?|gmbh|e\.v\.|lda\.?|s\.l\.?|b\.v\.?)(?: \([^)]*\))?$"

# Marks that can't occur in the data: they are removed from it first.
STRONG_MARK, COMMA_MARK, ESCAPE, OPEN, CLOSE, CUT = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005", "\u0006"

#: Rows a register may have, as many as names can be linked to, and words of it that become a literal of the plan.
MOST_REGISTER = 200_000
MOST_WORDS = 50_000


@dataclass
class Hints:
    """What a register says about names that hold a comma: given names of persons, and the words on both sides of commas."""

    given: list[str] = field(default_factory=list)
    around: list[tuple[str, str]] = field(default_factory=list)


def register_hints(register: DataFrame, name_col: str = "name", type_col: str = "organization_type", person_type: str = "self_employed") -> Hints:
    """Hints from a register of bounded size; a larger one, or one with too many different words, is refused."""
    rows = bounded_rows(register.select(F.col(name_col), F.col(type_col)).where(F.col(name_col).isNotNull()), MOST_REGISTER)
    if rows is None:
        raise ValueError(f"the register has more than {MOST_REGISTER} rows")
    given, around = set(), set()
    for name, kind in rows:
        words = name.lower().split()
        if kind == person_type and len(words) > 1:
            given.add(words[0])
        parts = [p.strip() for p in name.lower().split(",")]
        around |= {(a.split()[-1], b.split()[0]) for a, b in zip(parts, parts[1:]) if a and b}
    if max(len(given), len(around)) > MOST_WORDS:
        raise ValueError(f"the register has more than {MOST_WORDS} given names or words around commas")
    return Hints(sorted(given), sorted(around))


def _last(a: Column) -> Column:
    return F.element_at(a, -1)


def _put_last(a: Column, x: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(x))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _tokens(raw: Column) -> Column:
    """The field as tokens: text after a delimiter begins with that delimiter's mark, literals stand between OPEN and CLOSE."""
    clean = F.regexp_replace(raw, "[\u0001-\u0006]", "")

    def plain(p: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(p, STRONG, STRONG_MARK), r",(?![0-9])", COMMA_MARK)
        return F.split(marked, f"(?=[{STRONG_MARK}{COMMA_MARK}])", -1)

    def cut(x: Column) -> Column:
        pieces, balanced = x["pieces"], x["balanced"]

        def token(p: Column, i: Column) -> Column:
            escape = (i % 4 == 0) & (i > 0) & (i < balanced) & (p == "")
            return (
                F.when(i > balanced, F.when((i % 2) == 1, F.array(F.lit(""))).otherwise(plain(p)))
                .when(escape, F.array(F.lit(ESCAPE)))
                .when(i % 4 == 0, plain(p))
                .when(i % 4 == 2, F.array(F.concat(F.lit(OPEN), F.element_at(pieces, (i).cast("int")), p, F.element_at(pieces, (i + 2).cast("int")), F.lit(CLOSE))))
                .otherwise(F.array().cast("array<string>"))
            )

        return F.flatten(F.transform(pieces, token))

    def counted(c: Column) -> Column:
        quotes = F.length(c) - F.length(F.translate(c, QUOTES, ""))
        return F.struct(F.split(F.regexp_replace(c, f"([{QUOTES}])", f"{CUT}$1{CUT}"), CUT, -1).alias("pieces"), ((quotes - quotes % 2) * 2).alias("balanced"))

    return _let(_let(clean, counted), cut)


def _values(tokens: Column) -> Column:
    """Tokens folded to values; a value's first character is the mark of the delimiter before it."""

    def step(acc: Column, t: Column) -> Column:
        last = _last(acc)
        literal = F.when(last.endswith(ESCAPE), F.concat(F.substring(last, F.lit(1), F.length(last) - 1), F.lit('"'), F.substring(t, F.lit(3), F.length(t)))).otherwise(F.concat(last, t))
        return (
            F.when(t.startswith(STRONG_MARK) | t.startswith(COMMA_MARK), F.concat(acc, F.array(t)))
            .when(t == ESCAPE, _put_last(acc, F.concat(F.substring(last, F.lit(1), F.length(last) - 2), F.lit(ESCAPE))))
            .when(t.startswith(OPEN), _put_last(acc, literal))
            .otherwise(_put_last(acc, F.concat(last, t)))
        )

    return F.aggregate(tokens, F.array(F.lit(STRONG_MARK)), step)


def _bare(v: Column) -> Column:
    """A value without its delimiter, list mark and white space outside."""
    text = F.regexp_replace(F.regexp_replace(v, f"^[{STRONG_MARK}{COMMA_MARK}]", ""), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(text, "^" + MARK, ""), r"^[-*•·–‣▪]+$", "")


def _clean(v: Column) -> Column:
    """A value as it goes out: enclosing quotes gone, quotes inside as typed, white space collapsed."""

    def inner(bare: Column) -> Column:
        whole = f"(?s)^{OPEN}.([^{OPEN}{CLOSE}]*).{CLOSE}$"
        return F.when(bare.rlike(whole), F.regexp_extract(bare, whole, 1)).otherwise(F.translate(bare, OPEN + CLOSE, ""))

    return F.regexp_replace(F.regexp_replace(_let(_bare(v), inner), r"(?U)\s+", " "), r"^ | $", "")


def _close(x: Column, y: Column) -> Column:
    """Whether x is y but for one slip, or two in a word of six letters or more."""
    most = F.when(F.length(y) >= 6, 2).otherwise(1)
    return (F.abs(F.length(x) - F.length(y)) <= most) & (F.levenshtein(x, y) <= most)


def _constant(lists: dict, empty: str) -> Callable[[Column], Column]:
    """A lookup in a constant map of lists, empty where a key is missing. The map is one literal of the plan, however large."""
    held = F.from_json(F.lit(json.dumps({str(k): v for k, v in lists.items()})), f"map<string,{empty}>")
    return lambda key: F.coalesce(F.try_element_at(held, key.cast("string")), F.array().cast(empty))


def _as_long(words: list[str]) -> Callable[[Column], Column]:
    """A lookup, by a length, of those of some words whose length differs by no more than two."""
    held: dict[int, list[str]] = {}
    for w in words:
        for n in range(max(1, len(w) - 2), len(w) + 3):
            held.setdefault(n, []).append(w)
    return _constant(held, "array<string>")


def _joined(values: Column, hints: Hints) -> Column:
    """Values that only a comma separates joined again where they are one name."""

    single = lambda x: ~x.rlike(r"(?U)\s") & (x != "")
    literal = lambda x: x.rlike(f"^{OPEN}[^{OPEN}{CLOSE}]*{CLOSE}$")
    behind: dict[str, list[str]] = {}
    for x, y in hints.around:
        behind.setdefault(x, []).append(y)
    given, before_comma, follows = _as_long(hints.given), _as_long(sorted(behind)), _constant(behind, "array<string>")

    def one_name(both: Column) -> Column:
        l, r = both["l"], both["r"]  # noqa: E741
        out = r.rlike(ATTACHED) | (r.rlike(r"(?U)^(?=.*\s)[^,]*\s(?:of|of the|for|des|de|der|dos|degli)$") & (l != "")) | (single(l) & r.rlike(r"(?U)^\S+ (?:&|and|und|et|e|y) \S+$"))
        if hints.given:
            out = out | (single(l) & single(r) & (F.length(r) > 2) & F.exists(given(F.length(r)), lambda g: _close(r, g)))
        if behind:
            after, before = F.regexp_extract(r, r"^(\S+)", 1), F.regexp_extract(l, r"(\S+)$", 1)
            near = _let(before, lambda b: F.filter(before_comma(F.length(b)), lambda x: _close(b, x)))
            out = out | F.exists(near, lambda x: F.exists(follows(x), lambda y: _close(after, y)))
        return out & ~literal(l) & ~literal(r)

    def step(acc: Column, v: Column) -> Column:
        left = _last(acc)
        both = F.struct(F.lower(_bare(left)).alias("l"), F.lower(_bare(v)).alias("r"))
        return F.when((F.size(acc) > 0) & v.startswith(COMMA_MARK) & F.coalesce(_let(both, one_name), F.lit(False)), _put_last(acc, F.concat(left, F.lit(","), F.substring(v, F.lit(2), F.length(v))))).otherwise(F.concat(acc, F.array(v)))

    plain = F.aggregate(values, F.array().cast("array<string>"), step)
    return F.when(F.exists(values, lambda v: v.startswith(COMMA_MARK)), plain).otherwise(values)


def unpack(raw: Column, hints: Hints | None = None) -> Column:
    """The values of a packed field, in their order, as an array; empty pieces don't count. Null gives null."""
    return F.filter(F.transform(_let(_values(_tokens(raw)), lambda v: _joined(v, hints or Hints())), _clean), lambda v: v != "")


def unpacked(df: DataFrame, id_col: str, raw_col: str, hints: Hints | None = None, value: str = "value", least: int = 1) -> DataFrame:
    """One row a value: id, pos (from 1) and value, for fields that hold at least `least` values.

    Null, empty and blank fields give no row; a quote without its partner is left out and closes nothing; values keep
    their writing. Rows that are repeated in full come out once for each row; other columns don't matter.
    """
    found = df.where(df[raw_col].isNotNull()).select(df[id_col].alias("__id"), unpack(df[raw_col], hints).alias("__v"))
    return found.where(F.size("__v") >= least).select(F.col("__id").alias(id_col), F.posexplode("__v").alias("pos", value)).withColumn("pos", (F.col("pos") + 1).cast("int"))


def recombined(df: DataFrame, id_col: str, raw_col: str, known: DataFrame, name_col: str, most: int = 4) -> DataFrame:
    """id, pos (from 1), value, resolved: a field cut at its commas, where up to `most` neighbouring parts that together are
    a known name (by its lowered writing) become one value again, from left to right, the longest first.

    Runs of parts meet the names in an equi-join; only the places of hits come back to a field, which are no more than it
    has parts. Null fields and those without a part give no row; fields of one id must be alike.
    """
    parts = F.filter(F.transform(F.split(df[raw_col], ","), lambda x: F.regexp_replace(x, "^ +| +$", "")), lambda x: x != "")
    fields = df.where(df[raw_col].isNotNull()).select(df[id_col].alias("__id"), parts.alias("__p")).groupBy("__id").agg(F.min("__p").alias("__p")).where(F.size("__p") > 0)
    starts = fields.select("__id", "__p", F.posexplode("__p").alias("i", "__x")).select("__id", "__p", "i", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")).where(F.col("i") + F.col("k") <= F.size("__p"))
    runs = starts.select("__id", "i", "k", F.lower(F.array_join(F.slice("__p", F.col("i") + 1, F.col("k")), ", ")).alias("__n"))
    names = known.where(known[name_col].isNotNull()).select(F.lower(known[name_col]).alias("__n")).distinct()
    hits = runs.join(names, "__n").groupBy("__id", "i").agg(F.max("k").alias("k")).groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("i", "k"))).alias("__h"))
    both = fields.join(hits, "__id", "left")
    empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<value:string,resolved:boolean>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        k = F.try_element_at("__h", i)
        value = F.struct(F.array_join(F.slice("__p", i + 1, F.coalesce(k, F.lit(1))), ", ").alias("value"), k.isNotNull().alias("resolved"))
        return F.when(i < acc["next"], acc).otherwise(F.struct((i + F.coalesce(k, F.lit(1))).alias("next"), F.concat(acc["out"], F.array(value)).alias("out")))

    folded = both.select("__id", F.posexplode(F.aggregate(F.sequence(F.lit(0), F.size("__p") - 1), empty, step)["out"]).alias("pos", "v"))
    return folded.select(F.col("__id").alias(id_col), (F.col("pos") + 1).alias("pos"), "v.value", "v.resolved")

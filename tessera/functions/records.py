"""Functions on nested records: lookups by keyword, files, roles, events and stages, labelled fields of minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of preference of file formats.
FORMATS = ["docx", "html", "pdf"]
#: What an event says about a file's stage, in the order in which events come; a later event overwrites.
STAGES = {"proposal": "preparatory", "committee": "awaiting_committee", "first reading": "awaiting_council", "council adopted": "awaiting_signature", "adopted": "adopted", "signed": "completed", "withdrawn": "withdrawn"}
#: Labels before the fields of minutes.
MINUTES = {"points": "points raised|main points", "conclusions": "conclusions|main conclusions|follow-up", "location": "location|place", "participants": "participants|attendees"}


def keyed(x: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """A value by exact key (lowered), else by the first key, in the mapping's order, that the text contains."""
    low = F.lower(F.trim(x))
    exact = F.element_at(F.create_map(*[F.lit(v) for kv in mapping.items() for v in (kv[0].lower(), kv[1])]), low)
    contained = F.coalesce(*[F.when(low.contains(k.lower()), F.lit(v)) for k, v in mapping.items()])
    return F.coalesce(exact, contained, F.lit(default).cast("string"))


def target_type(x: Column) -> Column:
    """The kind of provision that a target names by its first word."""
    low = F.lower(F.trim(x))
    out = F.when(low.startswith("recital"), "recital").when(low.startswith("article"), "article").when(low.startswith("annex"), "annex").when(low.startswith("title"), "title").when(low.startswith("citation"), "citation")
    return out.otherwise("other")


def provision_text(kind: Column, number: Column, title: Column, text: Column) -> Column:
    """A provision's header and body."""
    return F.concat_ws("\n", F.concat_ws(" ", F.initcap(kind), number, F.when(F.length(title) > 0, F.concat(F.lit("– "), title))), text)


def markup_clean(x: Column) -> Column:
    """Non-breaking and zero-width characters, change marks and runs of spaces put right."""
    s = F.regexp_replace(F.regexp_replace(x, r"[\u00A0\u2002\u2003\u2009\u202F]", " "), r"[\u200B\u200C\u200D\uFEFF\u258C\u25C4\u25BA]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r" *\n *", "\n"))


def minutes_field(text: Column, field: str) -> Column:
    """What follows a label of minutes up to the next label; bullets go, and 'n/a' or nothing is null."""
    every = "|".join(MINUTES.values())
    found = F.regexp_extract(text, rf"(?is)(?:^|\n)\s*(?:{MINUTES[field]})\s*:\s*(.*?)(?=\n\s*(?:{every})\s*:|\z)", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(found, r"(?m)^\s*[-•*·]\s*", ""), r"\s*\n\s*", "\n"))
    return F.when((plain == "") | F.lower(plain).isin("n/a", "na", "none", "-"), None).otherwise(plain)


def preferred_file(files: Column) -> Column:
    """The URL of the file whose format comes first in FORMATS, then the first one. files: array<struct<format,url>>."""
    rank = lambda f: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in FORMATS]), F.lower(f["format"])), F.lit(0)), F.lit(len(FORMATS) + 1))
    return F.array_min(F.transform(files, lambda f, i: F.struct(rank(f).alias("r"), i.alias("i"), f["url"].alias("url"))))["url"]


def with_institution(actors: Column, name: str, when: Column) -> Column:
    """Actors with an institution added where a condition holds and it is missing. actors: array<struct<name,role>>."""
    missing = ~F.exists(actors, lambda a: a["name"] == name)
    extra = F.array(F.struct(F.lit(name).alias("name"), F.lit("Institution").alias("role")))
    return F.when(when & missing, F.concat(actors, extra)).otherwise(actors)


def tagged(events: Column, known: Column, source: str, other: str) -> Column:
    """Events with the source they are from: `source` where their title is among the known ones. events: array<struct<title,date>>."""
    return F.transform(events, lambda e: e.withField("source", F.when(F.array_contains(known, e["title"]), source).otherwise(other)))


def stage(events: Column) -> Column:
    """The stage after all events, folded in their order; null titles change nothing. events: array<struct<title,date>>."""
    def step(acc: Column, e: Column) -> Column:
        low = F.lower(e["title"])
        out = F.when(low.isNull(), acc)
        for word, value in reversed(STAGES.items()):  # the more advanced words are looked for first
            out = out.when(low.contains(word), F.lit(value))
        return out.otherwise(acc)

    return F.aggregate(events, F.lit(None).cast("string"), step)


def files_by_url(files: Column) -> Column:
    """A map from URL to name over nested arrays, the last one of each URL winning. files: array<array<struct<url,name>>>."""
    flat = F.flatten(files)
    urls = F.array_distinct(F.transform(flat, lambda f: f["url"]))
    return F.map_from_entries(F.transform(urls, lambda u: F.struct(u, F.element_at(F.filter(flat, lambda f: f["url"] == u), -1)["name"])))


def by_language(titles: Column, language: str = "en") -> Column:
    """The title in one language, else in the first there is. titles: map<string,string>."""
    return F.coalesce(F.try_element_at(titles, F.lit(language)), F.try_element_at(F.map_values(titles), F.lit(1)))


def celex(x: Column) -> Column:
    """'32021R0694' from 'Regulation (EU) 2021/694': sector, year, letter, padded number; null elsewhere."""
    kind, year, number = (F.regexp_extract(x, r"(?i)(regulation|directive|decision)[^0-9]*([0-9]{4})/([0-9]{1,4})", i) for i in (1, 2, 3))
    letter = F.when(F.lower(kind) == "regulation", "R").when(F.lower(kind) == "directive", "L").when(F.lower(kind) == "decision", "D")
    return F.when(letter.isNotNull(), F.concat(F.lit("3"), year, letter, F.lpad(number, 4, "0")))


def parameter_grid(df: DataFrame, **values: list) -> DataFrame:
    """Every row with every combination of parameters, by exploding literal arrays."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return df


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """statistic, dof of a table of counts, from one aggregation and three small joins."""
    n = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("__row"), F.col(col).alias("__col")).agg(F.count("*").alias("n"))
    r, c = n.groupBy("__row").agg(F.sum("n").alias("__r")), n.groupBy("__col").agg(F.sum("n").alias("__c"))
    total = n.agg(F.sum("n")).first()[0] or 0
    # cells without rows add their expectation, and all expectations add up to the total
    seen = n.join(r, "__row").join(c, "__col").withColumn("e", F.col("__r") * F.col("__c") / F.lit(float(max(total, 1))))
    parts = seen.agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("a"), F.sum("e").alias("e"), F.count_distinct("__row").alias("nr"), F.count_distinct("__col").alias("nc"))
    return parts.select((F.coalesce("a", F.lit(0.0)) + F.lit(float(total)) - F.coalesce("e", F.lit(0.0))).alias("statistic"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"))

"""Queries of document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import documents as T
from ..session import table
from .registry import query

THEMES = {"costs": ["yearly costs", "burden"], "data": ["data points", "reporting template"], "timing": ["weeks", "transition period"], "scope": ["annex", "exemption"]}


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)(yearly costs|burden)') THEN 'costs' END, CASE WHEN regexp_matches(text, '(?i)(data points|reporting template)') THEN 'data' END, CASE WHEN regexp_matches(text, '(?i)(weeks|transition period)') THEN 'timing' END, CASE WHEN regexp_matches(text, '(?i)(annex|exemption)') THEN 'scope' END], lambda x: x IS NOT NULL), ',') AS themes FROM documents""")
def E18_themes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(A.themes_of(F.col("text"), THEMES), ",").alias("themes"))


@query("""SELECT doc_id, substr(CASE WHEN len(h) = 0 THEN text ELSE array_to_string(h, chr(10) || chr(10)) END, 1, 2000) AS part FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: regexp_matches(p, '(?i)(yearly costs|burden)')) AS h FROM documents WHERE text IS NOT NULL AND text <> '')""")
def E19_theme_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", A.theme_paragraphs(F.col("text"), THEMES["costs"]).alias("part"))


@query("""WITH t AS (SELECT doc_id, text, nullif(strpos(text, 'Whereas'), 0) AS a, nullif(strpos(text, 'Article'), 0) AS b, nullif(strpos(text, 'Annex'), 0) AS c, length(text) + 1 AS n FROM documents WHERE text IS NOT NULL),
 k AS (SELECT doc_id, text, coalesce(a, b, c, n) AS p1, coalesce(b, c, n) AS p2, coalesce(c, n) AS p3, n FROM t),
 u AS (SELECT doc_id, 'preamble' AS part, substr(text, 1, greatest(p1 - 1, 0)) AS x FROM k UNION ALL SELECT doc_id, 'recitals', substr(text, p1, greatest(p2 - p1, 0)) FROM k UNION ALL SELECT doc_id, 'articles', substr(text, p2, greatest(p3 - p2, 0)) FROM k UNION ALL SELECT doc_id, 'annexes', substr(text, p3, greatest(n - p3, 0)) FROM k)
 SELECT doc_id, part, length(x) AS n_chars FROM u WHERE length(x) >= 500""")
def DP06_four_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", F.explode(T.four_parts(F.col("text"), ("Whereas", "Article", "Annex"))).alias("p"))
    return p.select("doc_id", "p.part", F.length("p.text").cast("long").alias("n_chars"))


@query()
def DP01_chunk_records(spark: SparkSession, d: str) -> DataFrame:
    return T.chunk_records(table(spark, d, "documents"), "doc_id", "text")


_TRIM = r"regexp_replace({x}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+$', '', 'g')"
_HEADER = r"^\s*(CHAPTER|TITLE|SECTION|Section|Chapter|Title|Article|Part|PART|ANNEX|Annex)\s+([0-9IVXLC]+)\b[ \t]*(.*)$"
_LINE = "CASE WHEN kind IN ('article', 'annex') THEN h3 WHEN kind = 'recital' THEN r2 ELSE line END"


@query(rf"""WITH l AS (SELECT doc_id, i, line, regexp_extract(line, '{_HEADER}', 1) AS h1, regexp_extract(line, '{_HEADER}', 2) AS h2, regexp_extract(line, '{_HEADER}', 3) AS h3, regexp_extract(line, '^\s*\(([0-9]+)\)\s+(.*)$', 1) AS r1, regexp_extract(line, '^\s*\(([0-9]+)\)\s+(.*)$', 2) AS r2 FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM documents WHERE text IS NOT NULL AND text <> ''))),
 k AS (SELECT *, CASE WHEN lower(h1) IN ('chapter', 'title', 'section', 'part') THEN 'context' WHEN lower(h1) = 'article' THEN 'article' WHEN h1 <> '' THEN 'annex' WHEN r1 <> '' AND count(*) FILTER (lower(h1) IN ('article', 'annex')) OVER (PARTITION BY doc_id ORDER BY i) = 0 THEN 'recital' ELSE 'line' END AS kind FROM l),
 g AS (SELECT *, count(*) FILTER (kind IN ('article', 'annex', 'recital')) OVER w AS part, last_value(CASE WHEN kind = 'context' THEN trim(upper(h1[1:1]) || lower(h1[2:]) || ' ' || h2 || ' ' || h3) END IGNORE NULLS) OVER w AS context FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 p AS (SELECT doc_id, part, coalesce(max(kind) FILTER (kind NOT IN ('line', 'context')), 'preamble') AS kind, coalesce(max(CASE WHEN kind = 'recital' THEN r1 ELSE h2 END) FILTER (kind NOT IN ('line', 'context')), '') AS number, coalesce(max(context) FILTER (kind = 'article'), '') AS context, coalesce(string_agg({_LINE}, chr(10) ORDER BY i) FILTER (kind <> 'context' AND {_LINE} <> ''), '') AS t FROM g GROUP BY 1, 2),
 o AS (SELECT doc_id, kind, number, context, {_TRIM.format(x="t")} AS t, part FROM p), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS sort_order FROM o WHERE t <> '' OR kind <> 'preamble') SELECT doc_id, sort_order, kind, number, context, substr(t, 1, 10000) AS text FROM s WHERE length(t) >= 11""")
def DP04_provisions(spark: SparkSession, d: str) -> DataFrame:
    return T.provisions(table(spark, d, "documents"), "doc_id", "text")


@query(rf"""WITH b AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(?m)^\s*Amendment\s+(\d+)\s*$', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:]) AS b FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, CAST(split_part(b, chr(2), 1) AS INTEGER) AS number, list_transform(string_split({_TRIM.format(x="split_part(b, chr(2), 2)")}, chr(10)), lambda x: {_TRIM.format(x="x")}) AS x FROM b),
 a AS (SELECT *, coalesce(list_position(list_transform(x, lambda y: regexp_matches(y, '(?i)^(article|recital|annex|title|citation|paragraph)\b')), true), 0) AS k FROM l),
 r AS (SELECT doc_id, number, CASE WHEN k > 1 THEN array_to_string(list_filter(x[1:k - 1], lambda y: y <> ''), ', ') ELSE '' END AS authors, CASE WHEN k > 0 THEN x[k] ELSE '' END AS target, regexp_replace({_TRIM.format(x="array_to_string(x[k + 1:], chr(10))")}, '(?im)^\s*or\.\s*\w{{2}}\s*$', '', 'g') AS rest FROM a)
 SELECT doc_id, number, authors, target, {_TRIM.format(x="split_part(rest, 'Justification', 1)")} AS body, CASE WHEN contains(rest, 'Justification') THEN {_TRIM.format(x="rest[strpos(rest, 'Justification') + 13:]")} ELSE '' END AS justification FROM r""")
def DP11_amendments(spark: SparkSession, d: str) -> DataFrame:
    return T.amendment_rows(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\b(?:Article|Annex) [0-9]+')) AS n_citations FROM documents WHERE text IS NOT NULL""")
def C14_citations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\b(?:Article|Annex) [0-9]+"), 0)).cast("long").alias("n_citations"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(?:articles?|art\\.|recitals?|annex(?:es)?|paragraphs?|para\\.?) +[0-9]+(?: *\\([0-9a-z]+\\))*(?: *(?:,|and|to|-) *[0-9]+(?: *\\([0-9a-z]+\\))*)*', ' ', 'g'), ' +', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents WHERE text IS NOT NULL""")
def C13_without_citations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", X.without_citations(F.col("text")).alias("t"))


@query("""WITH e AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents), f AS (SELECT w, count(*) AS n FROM e GROUP BY 1) SELECT w, n FROM f WHERE n >= 2""")
def A22_hotspots(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    return e.groupBy("w").agg(F.count("*").alias("n")).where("n >= 2")


@query("""SELECT CASE WHEN b = '' AND a = '' THEN 'empty' WHEN a = b THEN 'no_change' WHEN b = '' THEN 'insertion' WHEN a = '' THEN 'deletion' ELSE 'modification' END AS kind, count(*) AS n FROM (SELECT trim(coalesce(title, '')) AS b, trim(coalesce(description, '')) AS a FROM legal_procedures) GROUP BY 1""")
def Z44_diff_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").groupBy(X.diff_kind(F.col("title"), F.col("description")).alias("kind")).agg(F.count("*").alias("n"))

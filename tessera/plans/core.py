"""All queries of the core, by name, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed
from ..operators.joins import resolve_cascade
from ..operators.packed import register_hints, unpacked
from ..session import table
from . import fields, ingest, more, relational, scalars, steps, texts  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES, Query


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    hints = register_hints(table(spark, d, "organizations"))
    found = unpacked(table(spark, d, "commission_meetings"), "id", "organizations_raw", hints, "organization", least=2)
    return found.withColumnRenamed("id", "meeting_id").distinct()


def _values_sql(result: str) -> str:
    """Packed values as folds over lists: pieces between quotes, tokens, values, and values that a comma split although they are one name."""
    space = r"[\s\x{0B}\x{85}\p{Z}]"
    mark = packed.MARK.replace("'", "''")

    def bare(v: str) -> str:
        plain = rf"regexp_replace(regexp_replace({v}, '^[\x01\x02]', ''), '^{space}+|{space}+$', '', 'g')"
        return rf"regexp_replace(regexp_replace({plain}, '^{mark}', ''), '^[-*•·–‣▪]+$', '')"

    def close(x: str, y: str) -> str:
        return rf"levenshtein({x}, {y}) <= CASE WHEN length({y}) >= 6 THEN 2 ELSE 1 END"

    last, front = "acc[len(acc)]", "acc[1:len(acc) - 1]"
    plain = r"string_split(regexp_replace(regexp_replace(replace(regexp_replace(p, '[;|\t\r\n]+|//+', chr(1), 'g'), ',', chr(2)), '\x02([0-9])', ',\1', 'g'), '([\x01\x02])', chr(7) || '\1', 'g'), chr(7))"
    token = rf"CASE WHEN i - 1 > balanced THEN CASE WHEN (i - 1) % 2 = 1 THEN [''] ELSE {plain} END WHEN (i - 1) % 4 = 0 AND i > 1 AND i - 1 < balanced AND p = '' THEN [chr(3)] WHEN (i - 1) % 4 = 0 THEN {plain} WHEN (i - 1) % 4 = 2 THEN [chr(4) || pieces[i - 1] || p || pieces[i + 1] || chr(5)] ELSE [] END"
    value = rf"CASE WHEN starts_with(t[1], chr(1)) OR starts_with(t[1], chr(2)) THEN list_concat(acc, t) WHEN t[1] = chr(3) THEN list_append({front}, substr({last}, 1, greatest(length({last}) - 2, 0)) || chr(3)) WHEN starts_with(t[1], chr(4)) AND ends_with({last}, chr(3)) THEN list_append({front}, substr({last}, 1, length({last}) - 1) || chr(34) || substr(t[1], 3)) ELSE list_append({front}, {last} || t[1]) END".replace('\\"', '"')
    left, right = bare(last), bare("v[1]")
    after, before = rf"regexp_extract(lower({right}), '^([^\s]+)', 1)", rf"regexp_extract(lower({left}), '([^\s]+)$', 1)"
    single = lambda x: rf"NOT regexp_matches({x}, '{space}') AND {x} <> ''"
    literal = lambda x: rf"regexp_matches({x}, '^\x04[^\x04\x05]*\x05$')"
    one = (
        rf"(regexp_matches(lower({right}), '{packed.ATTACHED}') OR (regexp_matches(lower({right}), '^[^,]*{space}(?:of|of the|for|des|de|der|dos|degli)$') AND {left} <> '') OR ({single(left)} AND regexp_matches(lower({right}), '^[^\s\p{{Z}}]+ (?:&|and|und|et|e|y) [^\s\p{{Z}}]+$'))"
        rf" OR ({single(left)} AND {single(right)} AND length({right}) > 2 AND len(list_filter(given, lambda g: {close(f'lower({right})', 'g')})) > 0) OR len(list_filter(around, lambda w: {close(before, 'w.a')} AND {close(after, 'w.b')})) > 0) AND NOT {literal(left)} AND NOT {literal(right)}"
    )
    join = rf"CASE WHEN len(acc) > 0 AND starts_with(v[1], chr(2)) AND ({one}) THEN list_append({front}, {last} || ',' || substr(v[1], 2)) ELSE list_concat(acc, v) END"
    clean = rf"regexp_replace(regexp_replace(CASE WHEN regexp_matches({bare('x')}, '(?s)^\x04.[^\x04\x05]*.\x05$') THEN regexp_extract({bare('x')}, '(?s)^\x04.([^\x04\x05]*).\x05$', 1) ELSE regexp_replace({bare('x')}, '[\x04\x05]', '', 'g') END, '{space}+', ' ', 'g'), '^ | $', '', 'g')"
    return rf"""WITH nm AS (SELECT lower(name) AS n, string_split_regex(trim(lower(name)), '\s+') AS w, organization_type AS kind FROM organizations WHERE name IS NOT NULL),
 hints AS (SELECT (SELECT coalesce(list(DISTINCT w[1]), []) FROM nm WHERE kind = 'self_employed' AND len(w) > 1) AS given, (SELECT coalesce(list(DISTINCT {{'a': regexp_extract(trim(x), '([^\s]+)$', 1), 'b': regexp_extract(trim(y), '^([^\s]+)', 1)}}), []) FROM (SELECT unnest(string_split(n, ',')[1:-2]) AS x, unnest(string_split(n, ',')[2:]) AS y FROM nm WHERE contains(n, ',')) WHERE trim(x) <> '' AND trim(y) <> '') AS around),
 c AS (SELECT DISTINCT id, regexp_replace(organizations_raw, '[\x01-\x06]', '', 'g') AS c FROM commission_meetings WHERE organizations_raw IS NOT NULL),
 q AS (SELECT id, string_split(regexp_replace(c, '(["“”„«»])', chr(6) || '\1' || chr(6), 'g'), chr(6)) AS pieces, (length(c) - length(translate(c, '"“”„«»', ''))) AS n FROM c), b AS (SELECT id, pieces, (n - n % 2) * 2 AS balanced FROM q),
 t AS (SELECT id, list_transform(flatten(list_transform(pieces, lambda p, i: {token})), lambda x: [x]) AS t FROM b), v AS (SELECT id, list_transform(list_reduce(t, lambda acc, t: {value}, [chr(1)]), lambda x: [x]) AS v FROM t),
 j AS (SELECT id, list_reduce(v, lambda acc, v: {join}, CAST([] AS VARCHAR[])) AS j FROM v, hints), o AS (SELECT id, list_filter(list_transform(j, lambda x: {clean}), lambda x: x <> '') AS o FROM j) {result}"""


def C18_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Values that hold a comma because they are one name, in each packed field that has a comma."""
    m = table(spark, d, "commission_meetings").where(F.col("organizations_raw").contains(",")).select("id", "organizations_raw").distinct()
    v = packed.unpack(F.col("organizations_raw"), register_hints(table(spark, d, "organizations")))
    return m.select("id", F.size(F.filter(v, lambda x: x.contains(","))).alias("n"))


def E05_meeting_links(spark: SparkSession, d: str) -> DataFrame:
    """Meetings with the bodies of their packed fields, resolved by the cascade: each body once a meeting."""
    hints = register_hints(table(spark, d, "organizations"))
    values = unpacked(table(spark, d, "commission_meetings"), "id", "organizations_raw", hints, "name").select("id", F.trim("name").alias("name")).distinct()
    found = resolve_cascade(values.withColumn("told", F.lit(None).cast("string")), table(spark, d, "organizations"), "name", "told")
    return values.join(found.drop("told"), "name").select(F.col("id").alias("meeting_id"), F.col("resolved_id").alias("org"), "method").distinct()


def _links_sql() -> str:
    by_table = "SELECT DISTINCT trim(coalesce(organization_name, '')) AS name, trim(eu_transparency_register_id) AS told FROM commission_meeting_organizations"
    assert by_table in relational._CASCADE
    cascade = relational._CASCADE.replace(by_table, "SELECT DISTINCT trim(x) AS name, CAST(NULL AS VARCHAR) AS told FROM (SELECT unnest(o) AS x FROM o)").replace(" c AS (SELECT name, told", " cc AS (SELECT name, told").replace("FROM c\n", "FROM cc\n").replace("FROM c)", "FROM cc)").replace("FROM c ", "FROM cc ")
    return _values_sql("SELECT DISTINCT m.id AS meeting_id, k.resolved_id AS org, k.method FROM (SELECT id, unnest(o) AS x FROM o) m JOIN cascade k ON k.name = trim(m.x)").replace(" SELECT DISTINCT m.id", f", {cascade} SELECT DISTINCT m.id")


def queries() -> dict[str, Query]:
    return {"p4_found": p4_found, "C18_rejoined": C18_rejoined, "E05_meeting_links": E05_meeting_links} | QUERIES


def oracle_sql() -> dict[str, str]:
    rows = "SELECT DISTINCT id AS meeting_id, CAST(generate_subscripts(o, 1) AS INTEGER) AS pos, unnest(o) AS organization FROM o WHERE len(o) >= 2"
    sizes = "SELECT id, CAST(len(o) AS INTEGER) AS n FROM o UNION ALL SELECT DISTINCT id, NULL FROM commission_meetings WHERE organizations_raw IS NULL"
    rejoined = "SELECT o.id, CAST(len(list_filter(o, lambda x: contains(x, ','))) AS INTEGER) AS n FROM o JOIN (SELECT DISTINCT id, organizations_raw FROM commission_meetings) m ON m.id = o.id WHERE contains(m.organizations_raw, ',')"
    return {"C18_rejoined": _values_sql(rejoined), "E05_meeting_links": _links_sql(), "p4_found": _values_sql(rows), "C16_split_lists": _values_sql(sizes)} | ORACLES

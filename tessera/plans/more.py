"""Further queries: linking, rankings, sets, identifiers, incremental behaviour."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import stats as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import documents as T
from ..operators import joins as J
from ..operators import linking as L
from ..operators import merge as M
from ..operators import similarity as E
from ..session import stored, table
from .registry import ORACLES, query
from .relational import _MEETINGS, _dyads, _meetings
from .scalars import _PAIRS


_SQUEEZED = "trim(regexp_replace(lower({c}), '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
_FITS = "(day IS NULL OR (p IS NULL AND q IS NULL AND l IS NULL) OR (day >= coalesce(CAST(p - INTERVAL 540 DAY AS DATE), DATE '2000-01-01') AND day <= coalesce(CAST(q + INTERVAL 180 DAY AS DATE), CAST(l + INTERVAL 180 DAY AS DATE), DATE '2099-12-31')))"
_GENERIC = ", ".join(f"'{x}'" for x in X.GENERIC_TITLES)
_OPENING = X.FILLER.replace("'", "''")


@query(f"""WITH {_MEETINGS}, t AS (SELECT DISTINCT id AS record, meeting_date AS day, subject AS title, {_SQUEEZED.format(c="subject")} AS k FROM mt WHERE subject IS NOT NULL), e AS (SELECT id AS entry, proposal_date AS p, decision_date AS q, last_activity_date AS l FROM legal_procedures),
 al AS (SELECT DISTINCT procedure_id AS entry, {_SQUEEZED.format(c="alias")} AS k FROM procedure_aliases WHERE alias IS NOT NULL), a AS (SELECT al.entry, al.k, trim(regexp_replace(al.k, '[^a-z0-9]+', ' ', 'g')) AS w, e.p, e.q, e.l FROM al JOIN e ON e.entry = al.entry WHERE al.k <> ''),
 u AS (SELECT * FROM t WHERE length(k) >= 3 AND k NOT IN ({_GENERIC})), held AS (SELECT record, w FROM (SELECT u.record, a.w, row_number() OVER (PARTITION BY u.record ORDER BY length(a.w) DESC, a.w) AS rn FROM u JOIN (SELECT DISTINCT trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS w FROM procedure_aliases) a ON length(a.w) >= 3 AND contains(' ' || trim(regexp_replace(lower(u.title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || a.w || ' ')) WHERE rn = 1),
 links AS (SELECT t.record, t.day, e.entry, e.p, e.q, e.l, 1 AS step, 'cited' AS method FROM (SELECT record, day, unnest(list_distinct(regexp_extract_all(title, '\\b([0-9]{{4}}/[0-9]{{4}}\\([A-Z]{{2,4}}\\))', 1))) AS cited FROM t) t JOIN e ON e.entry = t.cited
 UNION SELECT u.record, u.day, a.entry, a.p, a.q, a.l, 2, 'alias_exact' FROM (SELECT record, day, k FROM u UNION SELECT record, day, {_SQUEEZED.format(c=f"regexp_replace(k, '{_OPENING}', '')")} FROM u) u JOIN a ON a.k = u.k WHERE {_FITS} UNION SELECT u.record, u.day, a.entry, a.p, a.q, a.l, 3, 'alias_substring' FROM (SELECT DISTINCT record, day FROM u) u JOIN held ON held.record = u.record JOIN a ON a.w = held.w WHERE {_FITS}),
 first AS (SELECT *, min(step) OVER (PARTITION BY record) AS s FROM links), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY record ORDER BY coalesce(list_min(list_filter([abs(datediff('day', p, day)), abs(datediff('day', q, day)), abs(datediff('day', l, day))], lambda x: x IS NOT NULL)), 1000000000), entry) AS INTEGER) AS rank FROM first WHERE step = s)
 SELECT record, entry, method, rank, rank = 1 AS is_primary FROM ranked""")
def E14_title_links(spark: SparkSession, d: str) -> DataFrame:
    """The bulk matcher over whole tables."""
    return L.link_titles(_meetings(spark, d), table(spark, d, "legal_procedures"), table(spark, d, "procedure_aliases"), "id", "subject", "meeting_date")


@query("""WITH n AS (SELECT DISTINCT organisation_name AS name, regexp_replace(lower(organisation_name), '[^a-z0-9]', '', 'g') AS k FROM hys_feedback_bronze), r AS (SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS rk, regexp_replace(lower(acronym), '[^a-z0-9]', '', 'g') AS ak FROM organizations),
 p AS (SELECT k, rk, CASE WHEN k = rk THEN 100.0 ELSE round(100.0 * (1 - levenshtein(k, rk) / greatest(length(k), length(rk))), 4) END AS score FROM (SELECT DISTINCT k FROM n WHERE length(k) >= 3) CROSS JOIN (SELECT DISTINCT rk FROM r WHERE length(rk) >= 3)),
 s AS (SELECT n.name, r.id, p.score FROM p JOIN n USING (k) JOIN r USING (rk) WHERE p.score >= 60 UNION ALL SELECT n.name, r.id, 95.0 FROM n JOIN r ON n.k = r.ak WHERE length(n.k) BETWEEN 1 AND 10), b AS (SELECT name, id, CAST(max(score) AS DOUBLE) AS score FROM s GROUP BY 1, 2), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS INTEGER) AS rank FROM b)
 SELECT name, id, score, rank, CASE WHEN score >= 96 THEN 'auto_accept' WHEN score >= 93 THEN 'to_decider' ELSE 'no_match' END AS band FROM o WHERE rank <= 3""")
def E08_fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Top candidates of every typed name by edit distance and acronym; a test compares them with all pairs."""
    out = L.fuzzy_candidates(table(spark, d, "hys_feedback_bronze"), table(spark, d, "organizations"), "organisation_name", "name", "id", reg_acronym="acronym")
    return out.withColumn("band", L.decision_band(F.col("score")))


@query("""WITH n AS (SELECT DISTINCT organization_name AS name, eu_transparency_register_id AS told FROM commission_meeting_organizations WHERE organization_name IS NOT NULL)
 SELECT name, told, 'org_' || substr(sha256('name_' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g')), 1, 16) AS stub, coalesce(told, 'org_' || substr(sha256('name_' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g')), 1, 16)) AS id FROM n""")
def H01_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "commission_meeting_organizations").where(F.col("organization_name").isNotNull()).select(F.col("organization_name").alias("name"), F.col("eu_transparency_register_id").alias("told")).distinct()
    stub = X.stub_id(X.ascii_key(F.col("name")))
    return n.select("name", "told", stub.alias("stub"), F.coalesce("told", stub).alias("id"))


@query("""SELECT substr(sha256(coalesce(CAST(feedback_id AS VARCHAR), 'None') || '_' || coalesce(procedure_id, 'None')), 1, 20) AS memo, feedback_id FROM (SELECT DISTINCT feedback_id, procedure_id FROM hys_feedback_bronze)""")
def H05_memo_keys(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hys_feedback_bronze").select("feedback_id", "procedure_id").distinct()
    text = F.concat_ws("_", F.coalesce(F.col("feedback_id").cast("string"), F.lit("None")), F.coalesce("procedure_id", F.lit("None")))
    return h.select(F.substring(F.sha2(text, 256), 1, 20).alias("memo"), "feedback_id")


@query("""SELECT l_returnflag AS theme, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, theme""")
def A05_theme_density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("theme")).agg(F.count_distinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "theme")


@query("""WITH s AS (SELECT DISTINCT id, unnest(subjects) AS theme FROM legal_procedures WHERE policy_area = 'Energy'), f AS (SELECT DISTINCT h.feedback_id, p.theme FROM hys_feedback_bronze h JOIN (SELECT DISTINCT id, unnest(subjects) AS theme FROM legal_procedures) p ON p.id = h.procedure_id),
 a AS (SELECT id FROM legal_procedures WHERE policy_area = 'Energy') SELECT a.id, count(DISTINCT f.feedback_id) AS n FROM a LEFT JOIN s ON s.id = a.id LEFT JOIN f ON f.theme = s.theme GROUP BY a.id""")
def A06_density(spark: SparkSession, d: str) -> DataFrame:
    """Positions that share a theme with each entry of one area, zero kept."""
    p = table(spark, d, "legal_procedures")
    area = p.where("policy_area = 'Energy'")
    themes = p.select("id", F.explode("subjects").alias("theme")).distinct()
    f = table(spark, d, "hys_feedback_bronze").select("feedback_id", F.col("procedure_id").alias("id")).join(themes, "id").select("feedback_id", "theme").distinct()
    hits = area.select("id").join(themes, "id").join(f, "theme").groupBy("id").agg(F.count_distinct("feedback_id").alias("n"))
    return area.select("id").join(hits, "id", "left").fillna(0, ["n"])


@query("""SELECT o_orderpriority AS stage, o_custkey AS org, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def A14_sum_by_stage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_custkey").alias("org")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT count(*) AS n, count(DISTINCT procedure_id) AS n_files, count(*) FILTER (pdf_extracted) AS n_pdf, count(*) FILTER (attachment_count > 0) AS n_attached, count(DISTINCT country) AS n_countries FROM hys_feedback_bronze""")
def A21_report_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hys_feedback_bronze").agg(F.count("*").alias("n"), F.count_distinct("procedure_id").alias("n_files"), F.count_if("pdf_extracted").alias("n_pdf"), F.count_if(F.col("attachment_count") > 0).alias("n_attached"), F.count_distinct("country").alias("n_countries"))


@query("""SELECT DISTINCT id, commission_representatives[1].name AS first_name, len(list_filter(commission_representatives, lambda x: x.function = 'Commissioner')) AS n_heads FROM commission_meetings WHERE commission_representatives IS NOT NULL""")
def A25_flat_actors(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings").where(F.col("commission_representatives").isNotNull())
    return m.select("id", F.try_element_at("commission_representatives", F.lit(1))["name"].alias("first_name"), F.size(F.filter("commission_representatives", lambda x: x["function"] == "Commissioner")).cast("long").alias("n_heads")).distinct()


@query("""WITH x AS (SELECT id, updated_at, r.unnest.name AS name, r.unnest.function AS function, r.pos AS pos FROM (SELECT id, updated_at, unnest(commission_representatives) AS unnest, generate_subscripts(commission_representatives, 1) AS pos FROM commission_meetings) r)
 SELECT name, count(DISTINCT id) AS n_meetings, count(DISTINCT function) AS n_functions FROM x WHERE name IS NOT NULL GROUP BY name""")
def A26_key_members(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "commission_meetings").select("id", F.explode("commission_representatives").alias("r")).select("id", "r.name", "r.function").where(F.col("name").isNotNull())
    return x.groupBy("name").agg(F.count_distinct("id").alias("n_meetings"), F.count_distinct("function").alias("n_functions"))


_SURVIVAL = """SELECT count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS recall_1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) AS recall_3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS recall_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall_10, {k} AS k_reverse
 FROM g LEFT JOIN (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM r WHERE place <= {k}) USING (q, c)"""


@query(f"WITH {_PAIRS}, r AS (SELECT q, c, score, row_number() OVER (PARTITION BY c ORDER BY score DESC, q) AS place FROM pr), g AS (SELECT q, c FROM (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS i FROM pr) WHERE i = 1) " + " UNION ALL ".join(_SURVIVAL.format(k=k) for k in (5, 10, 20)))
def A32_reciprocal_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval after the reciprocal filter for several reverse depths; items filtered out count as 0."""
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0)
    pairs = stored(E.nearest_queries(q, e, "vec_id", "vec_id", "embedding", 20), "nearest-queries")
    gold = E.nearest_items(q, e, "vec_id", "vec_id", "embedding")
    out = None
    for k in (5, 10, 20):
        row = E.retrieval(E.gold_ranks(pairs.where(F.col("place") <= k).select("q", "c", "score"), gold)).withColumn("k_reverse", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("mrr", F.round("mrr", 9))


@query("""SELECT coalesce(source, 'none') AS source, count(*) AS n, count(title) AS with_title FROM documents GROUP BY 1""")
def A35_provenance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.count("title").alias("with_title"))


@query("""WITH c AS (SELECT l_suppkey AS g, l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT g, k, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, k) AS rn FROM c) WHERE rn <= 10""")
def W07_top_ten(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.windows import top_k

    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    return top_k(c, ["g"], [F.desc("n"), "k"], 10).select("g", "k", "n")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders""")
def W09_running_sum(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("""SELECT id, CAST(generate_subscripts(subjects, 1) - 1 AS INTEGER) AS sort_order, unnest(subjects) AS subject FROM legal_procedures""")
def W12_numbering(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", F.posexplode("subjects").alias("sort_order", "subject"))


@query("""SELECT organization_name AS name, count(*) AS n FROM commission_meeting_organizations WHERE organization_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 10""")
def L03_value_counts_head(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commission_meeting_organizations").where(F.col("organization_name").isNotNull())
    return c.groupBy(F.col("organization_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query("""SELECT procedure_id, max(length(alias)) AS n, min(alias) FILTER (length(alias) = m) AS alias FROM (SELECT *, max(length(alias)) OVER (PARTITION BY procedure_id) AS m FROM procedure_aliases) GROUP BY procedure_id""")
def L05_longest_alias(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "procedure_aliases").groupBy("procedure_id").agg(F.min(F.struct((-F.length("alias")).alias("l"), "alias")).alias("b"))
    return a.select("procedure_id", (-F.col("b.l")).cast("long").alias("n"), F.col("b.alias").alias("alias"))


@query("""SELECT id, subject, NULL AS title, 'meeting' AS kind FROM commission_meetings UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, title, 'document' FROM documents""")
def U01_union_with_missing(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "commission_meetings").select("id", "subject", F.lit("meeting").alias("kind"))
    return a.unionByName(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "title", F.lit("document").alias("kind")), allowMissingColumns=True)


@query("""SELECT DISTINCT transparency_reg_id AS id FROM hys_feedback_bronze WHERE transparency_reg_id IS NOT NULL EXCEPT SELECT organization_id FROM commission_meeting_organizations""")
def U03_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "hys_feedback_bronze").select(F.col("transparency_reg_id").alias("id")).where("id IS NOT NULL").distinct()
    return a.join(table(spark, d, "commission_meeting_organizations").select(F.col("organization_id").alias("id")), "id", "left_anti")


@query("""SELECT id, array_to_string(list_filter(subjects, lambda x, i: list_position(list_transform(subjects, lambda y: lower(y)), lower(x)) = i), '|') AS s FROM legal_procedures""")
def U05_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    low = F.transform("subjects", F.lower)
    return table(spark, d, "legal_procedures").select("id", F.array_join(F.filter("subjects", lambda x, i: F.array_position(low, F.lower(x)) == i + 1), "|").alias("s"))


@query("""SELECT DISTINCT h.com_number AS ref FROM hys_feedback_bronze h WHERE h.com_number IS NOT NULL AND h.com_number NOT IN (SELECT commission_document FROM legal_procedures WHERE commission_document IS NOT NULL) AND h.com_number NOT IN (SELECT title FROM documents WHERE title IS NOT NULL)""")
def J05_three_sets(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "hys_feedback_bronze").select(F.col("com_number").alias("ref")).where("ref IS NOT NULL").distinct()
    one = refs.join(table(spark, d, "legal_procedures").select(F.col("commission_document").alias("ref")), "ref", "left_anti")
    return one.join(table(spark, d, "documents").select(F.col("title").alias("ref")), "ref", "left_anti")


@query("""WITH o AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(DISTINCT o_custkey) AS corpus FROM orders WHERE o_totalprice > 100000 GROUP BY 1, 2) SELECT o.p, o.s, n, corpus FROM o LEFT JOIN c ON o.p = c.p AND o.s = c.s""")
def J08_two_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), "o_custkey", "o_totalprice")
    return o.groupBy("p", "s").agg(F.count("*").alias("n")).join(o.where("o_totalprice > 100000").groupBy("p", "s").agg(F.count_distinct("o_custkey").alias("corpus")), ["p", "s"], "left")


@query("""WITH a AS (SELECT DISTINCT meeting_id AS id, 0 AS o FROM commission_meeting_organizations WHERE eu_transparency_register_id IS NOT NULL), b AS (SELECT DISTINCT id, 1 AS o FROM commission_meetings WHERE match_status = 'matched') SELECT id, CASE WHEN min(o) = 0 THEN 'direct' ELSE 'linked' END AS origin FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def J09_direct_first(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "commission_meeting_organizations").where("eu_transparency_register_id IS NOT NULL").select(F.col("meeting_id").alias("id"), F.lit(0).alias("o"), F.lit("direct").alias("origin"))
    b = table(spark, d, "commission_meetings").where("match_status = 'matched'").select("id", F.lit(1).alias("o"), F.lit("linked").alias("origin"))
    return J.first_of(a.unionByName(b), ["id"], [F.col("o")]).select("id", "origin")


@query("""SELECT DISTINCT m.id, o.id AS org FROM (SELECT DISTINCT id, unnest(string_split_regex(lower(organizations_raw), '[;|\\n]')) AS part FROM commission_meetings) m JOIN organizations o ON trim(m.part) = lower(o.name)""")
def J22_name_parts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings").select("id", F.explode(F.split(F.lower("organizations_raw"), r"[;|\n]")).alias("part"))
    o = table(spark, d, "organizations").select(F.col("id").alias("org"), F.lower("name").alias("k"))
    return m.join(o, F.trim("part") == F.col("k")).select("id", "org").distinct()


@query("""SELECT feedback_id, regexp_matches(lower(coalesce(organisation_name, '')), 'universit|town of|port of|province of') AS public_body FROM hys_feedback_bronze""")
def F05_public_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hys_feedback_bronze").select("feedback_id", F.lower(F.coalesce("organisation_name", F.lit(""))).rlike("universit|town of|port of|province of").alias("public_body"))


@query("""SELECT h.feedback_id FROM hys_feedback_bronze h WHERE EXISTS (SELECT 1 FROM commission_meeting_organizations c WHERE c.eu_transparency_register_id = h.transparency_reg_id) OR EXISTS (SELECT 1 FROM commission_meeting_organizations c WHERE lower(c.organization_name) = lower(h.organisation_name))""")
def F09_access_filter(spark: SparkSession, d: str) -> DataFrame:
    """Feedback of bodies that had a meeting, by id or lowered name: two semi-joins, not a join on an OR."""
    h = table(spark, d, "hys_feedback_bronze").select("feedback_id", "scraped_at", F.col("transparency_reg_id").alias("tr"), F.lower("organisation_name").alias("n"))
    c = table(spark, d, "commission_meeting_organizations")
    ids, names = c.select(F.col("eu_transparency_register_id").alias("tr")).where("tr IS NOT NULL").distinct(), c.select(F.lower("organization_name").alias("n")).where("n IS NOT NULL").distinct()
    hit = h.join(ids.withColumn("a", F.lit(True)), "tr", "left").join(names.withColumn("b", F.lit(True)), "n", "left")
    return hit.where("a OR b").select("feedback_id")


@query("""SELECT feedback_id FROM hys_feedback_bronze WHERE publication_status IS NULL OR lower(publication_status) = 'published'""")
def F11_null_or_equal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hys_feedback_bronze").where(F.col("publication_status").isNull() | (F.lower("publication_status") == "published")).select("feedback_id")


@query("""SELECT doc_id FROM documents WHERE title IS NULL OR trim(title) = '' OR title = procedure_id""")
def F12_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title IS NULL OR trim(title) = '' OR title = procedure_id").select("doc_id")


@query("""SELECT id, CAST(try_strptime(CAST(proposal_date AS VARCHAR), '%Y-%m-%d') AS DATE) AS iso, strftime(proposal_date, '%d.%m.%Y') AS dotted, CASE WHEN proposal_date >= CAST(DATE '2024-01-01' - INTERVAL 28 DAY AS DATE) THEN 'recent' ELSE 'settled' END AS mode FROM legal_procedures WHERE proposal_date IS NOT NULL""")
def D01_dates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").where("proposal_date IS NOT NULL")
    return p.select("id", D.any_date(F.date_format("proposal_date", "dd/MM/yyyy")).alias("iso"), F.date_format("proposal_date", "dd.MM.yyyy").alias("dotted"), D.recent(F.col("proposal_date"), F.lit("2024-01-01").cast("date")).alias("mode"))


@query("""SELECT c_custkey AS k, round_even(c_acctbal / 7, 3) AS r FROM customer""")
def M03_half_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.bround(F.col("c_acctbal") / 7, 3).alias("r"))


@query("""SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(name, ' '), lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS t FROM organizations""")
def R01_split_strip(spark: SparkSession, d: str) -> DataFrame:
    t = F.filter(F.transform(F.split("name", " "), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return table(spark, d, "organizations").select("id", F.array_join(F.array_sort(F.array_distinct(t)), "|").alias("t"))


@query("""SELECT id, to_json({'id': id, 'title': title, 'n': len(subjects)}) AS j FROM legal_procedures WHERE title IS NOT NULL""")
def R11_json(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").where("title IS NOT NULL")
    return p.select("id", F.to_json(F.struct("id", "title", F.size("subjects").alias("n"))).alias("j"))


@query("""SELECT CAST(to_timestamp(floor((epoch(ts) - 5 * 86400) / (7 * 86400)) * 7 * 86400 + 5 * 86400) AT TIME ZONE 'UTC' AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def I01_weekly_partitions(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.incremental import weekly

    e = table(spark, d, "events").withColumn("w", weekly(table(spark, d, "events"), F.col("ts").cast("timestamp")).cast("date"))
    return e.groupBy(F.col("w").alias("week"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def I05_idempotent_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return J.first_of(e, ["user_id", "event_type", "day"], [F.col("ts"), F.col("event_id")]).select("event_id")


@query("""WITH s AS (SELECT DISTINCT id, coalesce(subject, '') AS k FROM commission_meetings), c AS (SELECT organization_id AS org, meeting_id FROM commission_meeting_organizations WHERE organization_id IS NOT NULL) SELECT org, count(DISTINCT meeting_id) AS n, count(DISTINCT k) AS n_subjects FROM c JOIN s ON s.id = c.meeting_id GROUP BY org""")
def Z45_linked_meetings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "commission_meetings").select(F.col("id").alias("meeting_id"), F.coalesce("subject", F.lit("")).alias("k")).distinct()
    c = table(spark, d, "commission_meeting_organizations").where("organization_id IS NOT NULL").select(F.col("organization_id").alias("org"), "meeting_id")
    return c.join(s, "meeting_id").groupBy("org").agg(F.count_distinct("meeting_id").alias("n"), F.count_distinct("k").alias("n_subjects"))


@query("""WITH m AS (SELECT meeting_id, count(*) AS n FROM commission_meeting_organizations GROUP BY 1), p AS (SELECT * FROM (SELECT DISTINCT id, commissioner_portfolio AS area, CASE WHEN meeting_date < DATE '2019-12-01' THEN 'before' ELSE 'after' END AS stage FROM commission_meetings WHERE meeting_date IS NOT NULL AND commissioner_portfolio IS NOT NULL) JOIN m ON m.meeting_id = id)
 SELECT area, CAST(coalesce(sum(n) FILTER (stage = 'before'), 0) AS BIGINT) AS before, CAST(coalesce(sum(n) FILTER (stage = 'after'), 0) AS BIGINT) AS after FROM p GROUP BY area""")
def Z47_wide_by_stage(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meeting_organizations").groupBy(F.col("meeting_id").alias("id")).agg(F.count("*").alias("n"))
    p = table(spark, d, "commission_meetings").where("meeting_date IS NOT NULL AND commissioner_portfolio IS NOT NULL")
    p = p.select("id", F.col("commissioner_portfolio").alias("area"), F.when(F.col("meeting_date") < F.lit("2019-12-01").cast("date"), "before").otherwise("after").alias("stage")).distinct()
    return p.join(m, "id").groupBy("area").pivot("stage", ["before", "after"]).agg(F.sum("n")).fillna(0)


@query("""SELECT id, CASE WHEN lower(title) LIKE '%recast%' THEN title ELSE id END AS title FROM legal_procedures""")
def Z20_titles_kept(spark: SparkSession, d: str) -> DataFrame:
    """A reference id doesn't replace a real title."""
    p = table(spark, d, "legal_procedures").select("id", "title")
    current = p.withColumn("title", F.when(F.lower("title").contains("recast"), F.col("title")).otherwise(F.col("id")))
    return M.real_titles_kept(current, p.withColumn("title", F.col("id")), "id", "title")


@query("""SELECT feedback_id, nullif(array_to_string(list_filter([organisation_name, country, user_type], lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10) || chr(10) || '---' || chr(10) || chr(10)), '') AS joined FROM hys_feedback_bronze""")
def Z39_joined_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.array("organisation_name", "country", "user_type"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return table(spark, d, "hys_feedback_bronze").select("feedback_id", F.nullif(F.array_join(parts, "\n\n---\n\n"), F.lit("")).alias("joined"))


@query()
def C16_split_lists(spark: SparkSession, d: str) -> DataFrame:
    """The general splitter over all packed fields, one row a field; p4_found has the values as rows."""
    from ..operators.packed import register_hints, unpack

    m = table(spark, d, "commission_meetings").select("id", "organizations_raw").distinct()
    return m.select("id", F.size(unpack(F.col("organizations_raw"), register_hints(table(spark, d, "organizations")))).alias("n"))


@query(r"""WITH w AS (SELECT id, regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}_]+') AS x, regexp_extract_all(lower(coalesce(description, '')), '[\p{L}\p{N}_]+') AS y FROM legal_procedures), k AS (SELECT id, len(x) AS nx, len(y) AS ny, list_transform(x[1:150], lambda a: [CAST(coalesce(list_position(y[1:150], a), 0) AS INTEGER)]) AS i, list_transform(y[1:150], lambda b: CAST(list_position(y[1:150], b) AS INTEGER)) AS j FROM w),
 c AS (SELECT id, nx, ny, list_reduce(i, lambda old, a: list_reduce(list_transform(range(1, len(j) + 1), lambda n: [CAST(n AS INTEGER)]), lambda row, n: list_append(row, CASE WHEN j[n[1]] = a[1] THEN old[n[1]] + 1 ELSE greatest(old[n[1] + 1], row[len(row)]) END), [CAST(0 AS INTEGER)]), list_transform(range(0, len(j) + 1), lambda n: CAST(0 AS INTEGER))) AS f FROM k),
 r AS (SELECT id, CASE WHEN nx = 0 OR ny = 0 OR f[len(f)] = 0 THEN 0.0 ELSE round(2.0 * f[len(f)] / ny * f[len(f)] / nx / (f[len(f)] / ny + f[len(f)] / nx), 6) END AS rouge FROM c) SELECT id, CAST(rouge AS DOUBLE) AS rouge, rouge >= 0.30 AS paraphrase FROM r""")
def E17_rouge(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-L of each file's title and description, as a paraphrase flag at 0.30; tested on a fixture."""

    @F.pandas_udf("double")
    def rouge(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([T.rouge_l(a or "", b or "") for a, b in zip(x, y)])

    p = table(spark, d, "legal_procedures").select("id", F.round(rouge("title", "description"), 6).alias("rouge"))
    return p.withColumn("paraphrase", F.col("rouge") >= 0.30)


@query()
def X01_count_regression(spark: SparkSession, d: str) -> DataFrame:
    """Aligned items of each organisation on log meetings, by negative binomial regression over the aggregated rows."""
    import numpy as np

    from ..session import bounded_rows

    level = A.organisation_level(_dyads(spark, d), "org", "label", "item", "meetings")
    rows = bounded_rows(level.select("n_aligned", "n_rows", "n_items").orderBy("org"), 1_000_000)
    if rows is None:
        raise ValueError("more than 1000000 organisations")
    y, n, items = (np.array([float(r[i]) for r in rows]) for i in range(3))
    fit = S.negative_binomial(y, np.log(np.maximum(n, 1))[:, None], items)
    out = [("intercept", float(fit["coefficients"][0]), float(fit["rate_ratios"][0])), ("log_rows", float(fit["coefficients"][1]), float(fit["rate_ratios"][1])), ("alpha", float(fit["alpha"]), None), ("pseudo_r2", float(fit["pseudo_r2"]), None)]
    return spark.createDataFrame(out, "term string, value double, rate_ratio double")


@query()
def X03_bootstrap_f1(spark: SparkSession, d: str) -> DataFrame:
    """Interval of F1 over a gold set of bounded size, on the driver."""
    from ..session import bounded_rows

    e = table(spark, d, "embeddings").select((F.col("label") < 4).alias("t"), ((F.col("label") + F.col("vec_id") % 3) < 4).alias("p")).orderBy("vec_id")
    rows = bounded_rows(e, 100_000)
    if rows is None:
        raise ValueError("the gold set has more than 100000 rows")
    low, high = S.bootstrap_f1([r[0] for r in rows], [r[1] for r in rows], 500)
    return spark.createDataFrame([(len(rows), low, high)], "n int, low double, high double")


@query(f"SELECT name, id, score FROM ({ORACLES['E08_fuzzy_candidates']}) WHERE rank = 1")
def L04_best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of every typed name."""
    return L.fuzzy_candidates(table(spark, d, "hys_feedback_bronze"), table(spark, d, "organizations"), "organisation_name", "name", "id", top=1, reg_acronym="acronym").select("name", "id", "score")


@query(f"SELECT record, entry, method FROM ({ORACLES['E14_title_links']}) WHERE is_primary")
def E13_primary_links(spark: SparkSession, d: str) -> DataFrame:
    """The file that each meeting is matched to, where it is matched."""
    links = L.link_titles(_meetings(spark, d), table(spark, d, "legal_procedures"), table(spark, d, "procedure_aliases"), "id", "subject", "meeting_date")
    return links.where("is_primary").select("record", "entry", "method")

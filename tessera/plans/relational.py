"""Queries of joins, aggregations, windows, sets, sorting and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import stats as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import merge as M
from ..operators import windows as W
from ..session import table
from .registry import query

# A dyad table from lineitem: organisation = supplier, item = part, label from the return flag, score from the discount.
_LABEL = {"A": "ALIGNED", "N": "OPPOSING", "R": "NOISE"}
_DYADS = """dy AS (SELECT l_suppkey AS org, l_partkey AS item, CASE l_returnflag WHEN 'A' THEN 'ALIGNED' WHEN 'N' THEN 'OPPOSING' ELSE 'NOISE' END AS label,
 l_discount AS score, l_orderkey * 100000 + l_linenumber * 10000 + l_quantity * 100 + l_tax * 100 AS ord, l_linenumber AS meetings FROM lineitem)"""
_RANK = "CASE label WHEN 'ALIGNED' THEN 0 WHEN 'OPPOSING' THEN 1 WHEN 'UNDETECTABLE' THEN 2 WHEN 'NOISE' THEN 3 ELSE 4 END"


def _dyads(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "ALIGNED").when(F.col("l_returnflag") == "N", "OPPOSING").otherwise("NOISE")
    order = F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_quantity") * 100 + F.col("l_tax") * 100
    return li.select(F.col("l_suppkey").alias("org"), F.col("l_partkey").alias("item"), label.alias("label"), F.col("l_discount").alias("score"), order.alias("ord"), F.col("l_linenumber").alias("meetings"))


def _meetings(spark: SparkSession, d: str) -> DataFrame:
    """Meetings, each once: the row scraped last."""
    return J.first_of(table(spark, d, "commission_meetings"), ["id"], [F.col("updated_at"), F.coalesce("match_status", F.lit(""))], last=True)


_MEETINGS = "mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, coalesce(match_status, '') DESC) AS rn FROM commission_meetings) WHERE rn = 1)"


@query(f"""WITH {_MEETINGS}, lk AS (SELECT DISTINCT organization_id, meeting_id FROM commission_meeting_organizations WHERE organization_id IS NOT NULL),
 acc AS (SELECT commissioner_portfolio AS area, organization_id, count(*) AS n FROM lk JOIN mt ON mt.id = lk.meeting_id WHERE commissioner_portfolio IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT area, n, row_number() OVER (PARTITION BY area ORDER BY n) AS i, count(*) OVER (PARTITION BY area) AS m FROM acc)
 SELECT area, m AS n, CASE WHEN sum(n) = 0 THEN 0.0 ELSE round(2.0 * sum(i * n) / (m * sum(n)) - (m + 1.0) / m, 9) END AS gini FROM r GROUP BY area, m""")
def A15_access_gini(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: how concentrated access to each portfolio is over organisations."""
    links = table(spark, d, "commission_meeting_organizations").where(F.col("organization_id").isNotNull()).select("organization_id", "meeting_id").distinct()
    areas = _meetings(spark, d).where(F.col("commissioner_portfolio").isNotNull()).select(F.col("id").alias("meeting_id"), F.col("commissioner_portfolio").alias("area"))
    counts = links.join(areas, "meeting_id").groupBy("area", "organization_id").agg(F.count("*").alias("n_meetings"))
    return S.gini(counts, ["area"], "n_meetings").withColumn("gini", F.round("gini", 9))


@query("""WITH a AS (SELECT organization_id AS org, count(*) AS n_meetings FROM commission_meeting_organizations WHERE organization_id IS NOT NULL GROUP BY 1),
 b AS (SELECT transparency_reg_id AS org, count(*) AS n_feedback FROM hys_feedback_bronze WHERE transparency_reg_id IS NOT NULL GROUP BY 1)
 SELECT coalesce(a.org, b.org) AS org, coalesce(n_meetings, 0) AS n_meetings, coalesce(n_feedback, 0) AS n_feedback, coalesce(n_meetings, 0) + coalesce(n_feedback, 0) AS n_total FROM a FULL JOIN b ON a.org = b.org""")
def A01_access_counts(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "commission_meeting_organizations").select(F.col("organization_id").alias("org"))
    two = table(spark, d, "hys_feedback_bronze").select(F.col("transparency_reg_id").alias("org"))
    return A.access_counts(one, two, "org", ("n_meetings", "n_feedback"))


@query(f"""WITH {_DYADS}, r AS (SELECT *, row_number() OVER (PARTITION BY org, item ORDER BY {_RANK}, score DESC, ord) AS rn, count(*) OVER (PARTITION BY org, item) AS n_chunks,
 bool_or(label = 'ALIGNED') OVER (PARTITION BY org, item) AND bool_or(label = 'OPPOSING') OVER (PARTITION BY org, item) AS conflict FROM dy)
 SELECT org, item, label, score, n_chunks, conflict FROM r WHERE rn = 1""")
def A07_dyad_collapse(spark: SparkSession, d: str) -> DataFrame:
    return A.collapse_dyads(_dyads(spark, d), ["org", "item"], "label", "score", "ord", [])


@query(f"""WITH {_DYADS} SELECT org, item, max(score) AS score, count(*) AS n FROM dy GROUP BY 1, 2""")
def A08_dyad_before_classification(spark: SparkSession, d: str) -> DataFrame:
    return _dyads(spark, d).groupBy("org", "item").agg(F.max("score").alias("score"), F.count("*").alias("n"))


_ORG_LEVEL = f"""WITH {_DYADS} SELECT org, coalesce(max(meetings), 0) AS meetings_total, count(*) FILTER (label = 'ALIGNED') AS n_aligned, count(*) FILTER (label = 'OPPOSING') AS n_opposing,
 count(*) FILTER (label = 'UNDETECTABLE') AS n_undetectable, count(*) FILTER (label = 'NOISE') AS n_noise, count(*) AS n_rows, count(DISTINCT item) AS n_items FROM dy WHERE org IS NOT NULL GROUP BY org"""


@query(_ORG_LEVEL)
def A09_organisation_level(spark: SparkSession, d: str) -> DataFrame:
    return A.organisation_level(_dyads(spark, d), "org", "label", "item", "meetings")


@query(f"""WITH {_DYADS}, o AS (SELECT org, count(*) FILTER (label = 'ALIGNED') AS n_aligned, count(DISTINCT item) AS n_items FROM dy GROUP BY 1), c AS (SELECT count(DISTINCT item) AS corpus FROM dy)
 SELECT org, n_aligned, n_items, corpus, n_items / corpus AS coverage FROM o, c""")
def A10_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Organisation level against the corpus size, which is one row and joined on a constant."""
    dyads = _dyads(spark, d)
    o = dyads.groupBy("org").agg(F.count_if(F.col("label") == "ALIGNED").alias("n_aligned"), F.count_distinct("item").alias("n_items")).withColumn("__k", F.lit(1))
    c = dyads.agg(F.count_distinct("item").alias("corpus")).withColumn("__k", F.lit(1))
    return o.join(c, "__k").drop("__k").withColumn("coverage", F.col("n_items") / F.col("corpus"))


@query("""SELECT o_orderpriority AS stage, o_orderstatus AS status, count(DISTINCT o_custkey) AS corpus FROM orders GROUP BY 1, 2""")
def A11_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status")).agg(F.count_distinct("o_custkey").alias("corpus"))


@query("""SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS n_items, quantile_cont(c_acctbal, 0.5) AS median, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS largest, count(*) FILTER (c_acctbal > 0) / count(*) AS share_positive FROM customer GROUP BY 1""")
def A12_summary(spark: SparkSession, d: str) -> DataFrame:
    out = A.summary(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "segment"), ["segment"], "c_custkey", "c_acctbal")
    return out.withColumn("mean", F.round("mean", 4))


@query("""SELECT label, count(*) AS n FROM embeddings GROUP BY label""")
def A16_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag AS label, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1""")
def A17_crosstab(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.lower("l_linestatus").alias("s"))
    return A.crosstab(li, "label", "s", ["f", "o"])


@query("""SELECT CAST(date_trunc('month', meeting_date) AS DATE) AS month, count(*) FILTER (meeting_type = 'cabinet') AS cabinet, count(*) FILTER (meeting_type = 'commissioner') AS commissioner FROM commission_meetings GROUP BY 1""")
def A18_monthly(spark: SparkSession, d: str) -> DataFrame:
    return A.monthly(table(spark, d, "commission_meetings"), F.col("meeting_date"), "meeting_type", ["cabinet", "commissioner"])


@query(f"""WITH {_DYADS}, c AS (SELECT org, label, count(*) AS n, min(ord) AS f FROM dy GROUP BY 1, 2) SELECT org, upper(label) AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY n DESC, f, label) AS rn FROM c) WHERE rn = 1""")
def A19_plurality_label(spark: SparkSession, d: str) -> DataFrame:
    return A.plurality(_dyads(spark, d), "org", "label", "ord")


@query("""SELECT coalesce(org_match_method, 'none') AS method, count(*) AS n, count(*) FILTER (eu_transparency_register_id IS NOT NULL) AS n_registered, count(*) FILTER (eu_transparency_register_id IS NOT NULL) / count(*) AS share FROM commission_meeting_organizations GROUP BY 1""")
def A20_method_counts(spark: SparkSession, d: str) -> DataFrame:
    r = F.count_if(F.col("eu_transparency_register_id").isNotNull())
    return table(spark, d, "commission_meeting_organizations").groupBy(F.coalesce("org_match_method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"), r.alias("n_registered"), (r / F.count("*")).alias("share"))


@query("""WITH o AS (SELECT o_custkey AS member, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS theme, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
 SELECT member, max(CASE WHEN n = 1 THEN day END) AS first_day, max(CASE WHEN n = 2 THEN day END) AS second_day FROM o GROUP BY member""")
def A23_nth_dates(spark: SparkSession, d: str) -> DataFrame:
    """First and second event of each key, as key dates of a file are found."""
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    one, two = (A.nth(o, "o_custkey", ["o_orderdate", "o_orderkey"], n, "day").select(F.col("o_custkey").alias("member"), F.col("day").alias(name)) for n, name in ((1, "first_day"), (2, "second_day")))
    return one.join(two, "member", "left")


@query("""SELECT id, list_max([x for x in [proposal_date, decision_date, last_activity_date] if x IS NOT NULL]) AS last_date FROM legal_procedures""")
def A24_last_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", F.array_max(F.array("proposal_date", "decision_date", "last_activity_date")).alias("last_date"))


@query("""WITH g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label END AS gold, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN (label + 1) % 8 ELSE label END AS pred FROM embeddings),
 c AS (SELECT count(*) FILTER (gold = pred) AS tp, count(*) FILTER (pred IS NOT NULL AND (gold IS NULL OR gold <> pred)) AS fp, count(*) FILTER (gold IS NOT NULL AND (pred IS NULL OR gold <> pred)) AS fn, count(*) FILTER (gold IS NULL AND pred IS NULL) AS tn FROM g)
 SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM c""")
def A27_link_confusion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 7 != 0, F.col("label")).alias("gold"), F.when(F.col("vec_id") % 5 == 0, None).when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 8).otherwise(F.col("label")).alias("pred"))
    out = A.precision_recall(A.confusion(e, "gold", "pred"))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""WITH g AS (SELECT vec_id % 4 AS method, label AS gold, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 8 ELSE label END AS pred FROM embeddings) SELECT method, count(*) AS n, count(*) FILTER (gold = pred) / count(*) AS precision FROM g GROUP BY 1""")
def A28_precision_per_method(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("method"), F.col("label").alias("gold"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 8).otherwise(F.col("label")).alias("pred"))
    return e.groupBy("method").agg(F.count("*").alias("n"), (F.count_if(F.col("gold") == F.col("pred")) / F.count("*")).alias("precision"))


@query("""WITH g AS (SELECT label AS g, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 8 ELSE label END AS p FROM embeddings), l AS (SELECT DISTINCT g AS label FROM g UNION SELECT DISTINCT p FROM g),
 c AS (SELECT label, (SELECT count(*) FROM g WHERE g.g = l.label) AS support, (SELECT count(*) FROM g WHERE g.p = l.label) AS predicted, (SELECT count(*) FROM g WHERE g.g = l.label AND g.p = l.label) AS tp FROM l),
 r AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM c)
 SELECT label, support, predicted, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM r""")
def A29_per_class(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("g0"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 8).otherwise(F.col("label")).alias("p0"))
    return A.per_class(e, "g0", "p0").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, (SELECT event_type FROM n m WHERE m.user_id = n.user_id ORDER BY m.n DESC, event_type LIMIT 1) AS majority, CAST(sum(n) AS BIGINT) AS n_runs, count(*) = 1 AS stable FROM n GROUP BY user_id""")
def A30_stability(spark: SparkSession, d: str) -> DataFrame:
    return A.stability(table(spark, d, "events"), "user_id", "event_type")


@query("""SELECT count(DISTINCT organization_id) AS organisations, count(DISTINCT meeting_id) AS meetings, count(DISTINCT organization_name) AS names FROM commission_meeting_organizations""")
def A33_distinct_listings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commission_meeting_organizations")
    return c.agg(F.count_distinct("organization_id").alias("organisations"), F.count_distinct("meeting_id").alias("meetings"), F.count_distinct("organization_name").alias("names"))


@query("""SELECT count(*) AS n, count(*) FILTER (length(points_raised) > 0) AS with_points, count(*) FILTER (length(conclusions) > 0) AS with_conclusions, count(*) FILTER (len(commission_representatives) > 0) AS with_representatives, count(*) FILTER (len(transparency_register_ids) > 0) / count(*) AS share_ids FROM commission_meetings""")
def A34_completeness(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings")
    some = lambda c: F.count_if(F.length(c) > 0)
    return m.agg(F.count("*").alias("n"), some("points_raised").alias("with_points"), some("conclusions").alias("with_conclusions"), F.count_if(F.size("commission_representatives") > 0).alias("with_representatives"), (F.count_if(F.size("transparency_register_ids") > 0) / F.count("*")).alias("share_ids"))


@query("""WITH s AS (SELECT DISTINCT id, unnest(subjects) AS theme FROM legal_procedures), n AS (SELECT procedure_id, count(*) AS n FROM hys_feedback_bronze GROUP BY 1),
 t AS (SELECT DISTINCT theme FROM s) SELECT t.theme, count(DISTINCT s.id) AS n_files, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS n_feedback FROM t LEFT JOIN s ON s.theme = t.theme LEFT JOIN n ON n.procedure_id = s.id GROUP BY t.theme""")
def A04_theme_indicators(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "legal_procedures").select("id", F.explode("subjects").alias("theme")).distinct()
    n = table(spark, d, "hys_feedback_bronze").groupBy(F.col("procedure_id").alias("id")).agg(F.count("*").alias("n"))
    return s.join(n, "id", "left").groupBy("theme").agg(F.count_distinct("id").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_feedback"))


@query("""WITH m AS (SELECT id, unnest(list_distinct(transparency_register_ids)) AS org FROM commission_meetings), p AS (SELECT DISTINCT commissioner_name, id FROM commission_meetings WHERE commissioner_name IS NOT NULL)
 SELECT org, count(DISTINCT m.id) AS n_meetings, string_agg(DISTINCT commissioner_name, '|' ORDER BY commissioner_name) AS hosts FROM m JOIN p ON p.id = m.id GROUP BY org""")
def A02_influence(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings").where(F.col("commissioner_name").isNotNull())
    e = m.select("id", "commissioner_name", F.explode(F.array_distinct("transparency_register_ids")).alias("org"))
    return e.groupBy("org").agg(F.count_distinct("id").alias("n_meetings"), F.array_join(F.array_sort(F.collect_set("commissioner_name")), "|").alias("hosts"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS member, l_partkey % 10 AS theme FROM lineitem), b AS (SELECT DISTINCT o_custkey % 100 AS member, o_custkey % 10 AS theme FROM orders)
 SELECT a.member AS member, count(*) AS shared FROM a JOIN b ON a.member = b.member AND a.theme = b.theme GROUP BY 1""")
def A03_cross_reference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("member"), (F.col("l_partkey") % 10).alias("theme")).distinct()
    b = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("member"), (F.col("o_custkey") % 10).alias("theme")).distinct()
    return a.join(b, ["member", "theme"]).groupBy("member").agg(F.count("*").alias("shared"))


@query("""SELECT m.id AS meeting_id, string_agg(DISTINCT o.organization_name, '|' ORDER BY o.organization_name) AS organisations FROM (SELECT DISTINCT id FROM commission_meetings) m LEFT JOIN commission_meeting_organizations o ON o.meeting_id = m.id GROUP BY 1""")
def J03_collect_nested(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "commission_meeting_organizations").groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_set("organization_name")), "|").alias("organisations"))
    m = table(spark, d, "commission_meetings").select(F.col("id").alias("meeting_id")).distinct()
    return m.join(o, "meeting_id", "left").withColumn("organisations", F.nullif("organisations", F.lit("")))


@query(f"""WITH {_MEETINGS} SELECT DISTINCT mt.id AS meeting_id, mt.meeting_date AS day, o.organization_id AS org FROM commission_meeting_organizations o JOIN mt ON mt.id = o.meeting_id""")
def J01_links_with_meetings(spark: SparkSession, d: str) -> DataFrame:
    m = _meetings(spark, d).select(F.col("id").alias("meeting_id"), F.col("meeting_date").alias("day"))
    return table(spark, d, "commission_meeting_organizations").select("meeting_id", F.col("organization_id").alias("org")).join(m, "meeting_id").distinct()


@query("""SELECT c.id, coalesce(o.name, 'Unknown') AS organisation FROM (SELECT DISTINCT id, organization_id FROM commission_meeting_organizations) c LEFT JOIN organizations o ON o.id = c.organization_id""")
def J02_lookup_with_default(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "organizations").select(F.col("id").alias("organization_id"), "name")
    return table(spark, d, "commission_meeting_organizations").select("id", "organization_id").distinct().join(o, "organization_id", "left").select("id", F.coalesce("name", F.lit("Unknown")).alias("organisation"))


@query("""SELECT organization_id AS id, min(organization_name) AS name, 'placeholder' AS kind FROM commission_meeting_organizations WHERE organization_id IS NOT NULL AND organization_id NOT IN (SELECT id FROM organizations) GROUP BY 1 UNION ALL SELECT id, name, 'register' FROM organizations""")
def J04_placeholder_union(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "organizations").select("id", "name", F.lit("register").alias("kind"))
    refs = table(spark, d, "commission_meeting_organizations").where(F.col("organization_id").isNotNull()).groupBy(F.col("organization_id").alias("id")).agg(F.min("organization_name").alias("name"))
    return known.unionByName(refs.join(known.select("id"), "id", "left_anti").withColumn("kind", F.lit("placeholder")))


@query("""SELECT o.id FROM organizations o WHERE NOT EXISTS (SELECT 1 FROM commission_meeting_organizations c WHERE c.organization_id = o.id) AND NOT EXISTS (SELECT 1 FROM hys_feedback_bronze h WHERE h.transparency_reg_id = o.id)""")
def J06_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    o, c, h = (table(spark, d, t) for t in ("organizations", "commission_meeting_organizations", "hys_feedback_bronze"))
    return o.select("id").join(c.select(F.col("organization_id").alias("id")), "id", "left_anti").join(h.select(F.col("transparency_reg_id").alias("id")), "id", "left_anti")


@query("""SELECT id, CASE WHEN organization_id IN (SELECT id FROM organizations) THEN organization_id END AS organization_id FROM (SELECT DISTINCT id, organization_id FROM commission_meeting_organizations)""")
def J07_null_missing_fk(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commission_meeting_organizations").select("id", "organization_id").distinct()
    return J.null_missing(c, "organization_id", table(spark, d, "organizations"), "id").select("id", "organization_id")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events) SELECT event_id, signup FROM e""")
def W13_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return W.carry_forward(e, ["user_id"], ["ts", "event_id"], "s", "signup").select("event_id", "signup")


@query("""SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM events""")
def W14_blocks(spark: SparkSession, d: str) -> DataFrame:
    return W.blocks(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "block")


@query("""SELECT e.event_id, (SELECT max_by(p.event_id, p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts) AS previous_event FROM events e WHERE e.event_type = 'error'""")
def J25_as_of_previous(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("event"))
    return J.previous(left, right, ["user_id"], "ts", "at", "event").select("event_id", "previous_event")


@query("""SELECT DISTINCT ON (p.id, m.id) p.id AS procedure_id, m.id AS meeting_id FROM legal_procedures p JOIN procedure_aliases a ON a.procedure_id = p.id JOIN commission_meetings m ON lower(trim(m.subject)) = lower(trim(a.alias))
 WHERE m.meeting_date IS NULL OR (p.proposal_date IS NULL AND p.decision_date IS NULL AND p.last_activity_date IS NULL) OR (m.meeting_date >= coalesce(CAST(p.proposal_date - INTERVAL 540 DAY AS DATE), DATE '2000-01-01') AND m.meeting_date <= coalesce(CAST(p.decision_date + INTERVAL 180 DAY AS DATE), CAST(p.last_activity_date + INTERVAL 180 DAY AS DATE), DATE '2099-12-31'))""")
def J13_alias_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Equi-join on the alias with the interval of dates as residual condition."""
    key = lambda c: F.lower(F.trim(c))
    p = table(spark, d, "legal_procedures").select(F.col("id").alias("procedure_id"), "proposal_date", "decision_date", "last_activity_date")
    a = table(spark, d, "procedure_aliases").select("procedure_id", key(F.col("alias")).alias("k")).join(p, "procedure_id")
    m = table(spark, d, "commission_meetings").select(F.col("id").alias("meeting_id"), "meeting_date", key(F.col("subject")).alias("k"))
    fits = D.in_force(F.col("meeting_date"), F.col("proposal_date"), F.col("decision_date"), F.col("last_activity_date"))
    return m.join(a, "k").where(fits).select("procedure_id", "meeting_id").distinct()


@query("""WITH t AS (SELECT DISTINCT id, ' ' || trim(regexp_replace(lower(subject), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM commission_meetings WHERE subject IS NOT NULL), a AS (SELECT DISTINCT trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS alias FROM procedure_aliases),
 h AS (SELECT t.id, a.alias FROM t JOIN a ON contains(t.t, ' ' || a.alias || ' ') WHERE length(a.alias) >= 3) SELECT id, alias FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(alias) DESC, alias) AS rn FROM h) WHERE rn = 1""")
def J14_alias_in_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "commission_meetings").select("id", "subject").distinct()
    return J.alias_in_text(t, table(spark, d, "procedure_aliases"), "id", "subject")


@query("""SELECT DISTINCT a.id AS a_id, b.id AS b_id, len(list_intersect(list_distinct(a.subjects), list_distinct(b.subjects))) AS shared FROM legal_procedures a JOIN legal_procedures b ON list_has_any(a.subjects, b.subjects) WHERE a.policy_area = 'Energy' AND b.policy_area = 'Transport'""")
def J17_shared_theme(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures")
    a, b = (p.where(F.col("policy_area") == x).select(F.col("id").alias(n), "subjects") for x, n in (("Energy", "a_id"), ("Transport", "b_id")))
    return J.any_shared(a, b, "a_id", "b_id", "subjects")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def W05_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous_key"), F.lead("o_orderkey").over(w).alias("next_key"))


@query("""SELECT event_id, b.event_id AS previous, c.event_id AS following FROM events a LEFT JOIN events b ON b.event_id = a.event_id - 1 AND b.user_id % 3 = a.user_id % 3 LEFT JOIN events c ON c.event_id = a.event_id + 1 AND c.user_id % 3 = a.user_id % 3""".replace("SELECT event_id,", "SELECT a.event_id,"))
def J18_dense_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours only where the index has no gap, by lag and lead instead of a self-join."""
    e = table(spark, d, "events").withColumn("g", F.col("user_id") % 3)
    return W.neighbours(e, ["g"], "event_id", "event_id").select("event_id", F.col("previous_text").alias("previous"), F.col("next_text").alias("following"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(datediff('day', o_orderdate, DATE '1998-01-01')), o_orderkey) AS rank FROM orders) SELECT o_orderkey, rank, rank = 1 AS is_primary FROM r""")
def W01_rank_by_distance(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("dist", D.nearest_anchor(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date")))
    return W.ranked_by_distance(o, "o_custkey", "dist", "o_orderkey").select("o_orderkey", F.col("rank").cast("long").alias("rank"), "is_primary")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rank) AS top FROM r WHERE rank <= 5 GROUP BY 1""")
def W06_first_five(spark: SparkSession, d: str) -> DataFrame:
    t = W.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("o_orderkey").cast("string").alias("k"))))
    return t.groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda x: x["k"]), ",").alias("top"))


@query("""SELECT feedback_id, scraped_at FROM (SELECT *, row_number() OVER (PARTITION BY feedback_id ORDER BY scraped_at) AS rn FROM hys_feedback_bronze) WHERE rn = 1""")
def W10_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return J.first_of(table(spark, d, "hys_feedback_bronze").select("feedback_id", "scraped_at"), ["feedback_id"], [F.col("scraped_at")])


@query("""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at, doc_id) AS rn FROM documents) WHERE rn = 1),
 b AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) AS k1, trim(regexp_replace(lower(coalesce(source, '')), '\\s+', ' ', 'g')) AS k2 FROM a)
 SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY k1, k2 ORDER BY ingested_at, doc_id) AS rn FROM b) WHERE rn = 1""")
def W11_content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return W.content_dedupe(table(spark, d, "documents").select("doc_id", "title", "source", "ingested_at"), "doc_id", ["title", "source"], ["ingested_at"]).select("doc_id")


@query("""WITH RECURSIVE li AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM li),
 f AS (SELECT l_orderkey, l_linenumber, i, CAST(0 AS BIGINT) AS bundle, q AS held FROM r WHERE i = 1 UNION ALL SELECT r.l_orderkey, r.l_linenumber, r.i, CASE WHEN f.held > 0 AND (f.held + r.q > 100 OR f.held >= 75) THEN f.bundle + 1 ELSE f.bundle END, CASE WHEN f.held > 0 AND (f.held + r.q > 100 OR f.held >= 75) THEN r.q ELSE f.held + r.q END FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.i = f.i + 1)
 SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, bundle FROM f""")
def W15_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Greedy bundling of line items of an order; its test compares with a loop."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return W.bundled(li, "l_orderkey", "l_linenumber", "q", 100)


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, min(o_orderkey) LIMIT 10""")
def L02_most_common(spark: SparkSession, d: str) -> DataFrame:
    return A.top_with_ties_first(table(spark, d, "orders"), "o_custkey", 10, "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def L01_sorted_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.75) AS p FROM orders) SELECT o_orderkey FROM orders, q ORDER BY abs(o_totalprice - p), o_orderkey LIMIT 1""")
def L06_case_near_percentile(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("k", F.lit(1))
    p = o.groupBy("k").agg(F.percentile("o_totalprice", 0.75).alias("p"))
    return o.join(p, "k").orderBy(F.abs(F.col("o_totalprice") - F.col("p")), "o_orderkey").limit(1).select("o_orderkey")


@query("""SELECT doc_id, lang FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def L07_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 100 by the hash of id and seed: the same rows in every run and engine."""
    return table(spark, d, "documents").select("doc_id", "lang").orderBy(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))), "doc_id").limit(100)


@query("""SELECT organization_id AS id, 'meeting' AS source FROM commission_meeting_organizations WHERE organization_id IS NOT NULL UNION SELECT transparency_reg_id, 'feedback' FROM hys_feedback_bronze WHERE transparency_reg_id IS NOT NULL""")
def U02_union_of_ids(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "commission_meeting_organizations").select(F.col("organization_id").alias("id"), F.lit("meeting").alias("source"))
    b = table(spark, d, "hys_feedback_bronze").select(F.col("transparency_reg_id").alias("id"), F.lit("feedback").alias("source"))
    return a.unionByName(b).where(F.col("id").isNotNull()).distinct()


@query("""SELECT feedback_id AS id, 'feedback' AS kind, organisation_name AS org, NULL AS meeting FROM hys_feedback_bronze UNION ALL SELECT NULL, 'meeting', organization_name, meeting_id FROM commission_meeting_organizations""")
def U06_one_pool(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "hys_feedback_bronze").select(F.col("feedback_id").alias("id"), F.lit("feedback").alias("kind"), F.col("organisation_name").alias("org"))
    b = table(spark, d, "commission_meeting_organizations").select(F.lit("meeting").alias("kind"), F.col("organization_name").alias("org"), F.col("meeting_id").alias("meeting"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH cur AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'BUILDING'), new AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal + 1 END AS v FROM customer WHERE c_acctbal < 2000)
 SELECT coalesce(cur.k, new.k) AS k, coalesce(new.v, cur.v) AS v, cur.s AS s FROM cur FULL JOIN new ON cur.k = new.k""")
def S28_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))
    new = c.where("v < 2000").select("k", F.when(F.col("v") >= 0, F.col("v") + 1).alias("v"))
    return M.upserted(c.where("s <> 'BUILDING'"), new, ["k"])


@query("""WITH fresh AS (SELECT l_orderkey AS o, l_linenumber AS n, -1.0 AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2) SELECT o, n, q FROM fresh UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o FROM fresh)""")
def S29_children_replaced(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    new = li.where("q > 45").select("o", "n").distinct().withColumn("q", F.lit(-1.0))
    return M.children_replaced(li, new, "o")


@query("""SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS s FROM orders""")
def S31_status_update(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), "o_totalprice")
    return M.statuses_set(o.drop("o_totalprice"), "k", "s", o.where("o_totalprice > 200000").select("k", F.lit("X").alias("s")))


@query("""SELECT o_orderkey AS k, CASE WHEN c_acctbal < 0 THEN o_custkey + 1 ELSE o_custkey END AS parent FROM orders JOIN customer ON c_custkey = o_custkey""")
def S32_relink(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("parent"))
    moved = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    return M.relinked(o, moved, "parent", "old", "new").select("k", "parent")


@query("""SELECT id FROM organizations o WHERE NOT (acronym IS NULL AND NOT EXISTS (SELECT 1 FROM commission_meeting_organizations c WHERE c.organization_id = o.id) AND NOT EXISTS (SELECT 1 FROM hys_feedback_bronze h WHERE h.transparency_reg_id = o.id))""")
def S34_orphan_cleanup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "organizations").select("id", "acronym")
    kept = M.without_orphans(o, "id", F.col("acronym").isNull(), (table(spark, d, "commission_meeting_organizations"), "organization_id"), (table(spark, d, "hys_feedback_bronze"), "transparency_reg_id"))
    return kept.select("id")


@query("""SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')""")
def I03_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type")
    return M.unprocessed(e.select("event_id"), e.where(F.col("event_type") == "click"), "event_id")


@query("""SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'update' ELSE 'insert' END AS action FROM customer""")
def Z01_update_or_insert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return M.split_for_write(c.select("k"), c.where("c_acctbal > 0"), "k")


@query("""WITH known AS (SELECT o_custkey AS k, 'd' || o_orderkey AS x FROM orders WHERE o_orderstatus = 'F'), found AS (SELECT o_custkey AS k, 'd' || o_orderkey AS x FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000),
 a AS (SELECT k, list(DISTINCT x ORDER BY x) AS v FROM known GROUP BY 1), b AS (SELECT k, list(DISTINCT x ORDER BY x) AS v FROM found GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS k, array_to_string(list_concat(coalesce(a.v, []), list_filter(coalesce(b.v, []), lambda x: NOT list_contains(coalesce(a.v, []), x))), ',') AS documents, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'known' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.k = b.k""")
def J19_merged_events(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_totalprice", F.array(F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))).alias("documents"))
    out = J.merged_events(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F' OR o_totalprice > 100000"), ["k"])
    return out.withColumn("documents", F.array_join("documents", ","))


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS r FROM customer), b AS (SELECT c_custkey AS k, 'X' AS r FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'Y' FROM customer WHERE c_acctbal < 0)
 SELECT DISTINCT k, r FROM b UNION SELECT k, r FROM a WHERE k NOT IN (SELECT k FROM b)""")
def J20_override(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("r"), "c_acctbal")
    b = c.where("c_acctbal < 0").select("k", F.explode(F.array(F.lit("X"), F.lit("Y"))).alias("r"))
    return J.overridden(c, b, "k", "r")


@query("""SELECT a.name AS name, b.id AS id FROM (SELECT DISTINCT organization_name AS name, list_sort(string_split_regex(lower(trim(organization_name)), ' +')) AS k FROM commission_meeting_organizations WHERE organization_name IS NOT NULL) a
 JOIN (SELECT id, list_sort(string_split_regex(lower(trim(name)), ' +')) AS k FROM organizations) b ON a.k = b.k""")
def J21_sorted_token_join(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import sorted_tokens

    a = table(spark, d, "commission_meeting_organizations").where(F.col("organization_name").isNotNull()).select(F.col("organization_name").alias("name")).distinct().withColumn("k", sorted_tokens(F.col("name")))
    b = table(spark, d, "organizations").select("id", sorted_tokens(F.col("name")).alias("k"))
    return a.join(b, "k").select("name", "id")


@query("""WITH a AS (SELECT id AS n, title AS t FROM legal_procedures WHERE substr(id, 1, 4) < '2020'), b AS (SELECT id AS n, CASE WHEN stage = 'completed' THEN title ELSE title || '!' END AS t FROM legal_procedures WHERE substr(id, 1, 4) > '2014')
 SELECT coalesce(a.n, b.n) AS n, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.t IS NOT DISTINCT FROM b.t THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.n = b.n""")
def J26_section_diff(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").select(F.col("id").alias("n"), F.col("title").alias("t"), "stage")
    new = p.where(F.substring("n", 1, 4) > "2014").withColumn("t", F.when(F.col("stage") == "completed", F.col("t")).otherwise(F.concat("t", F.lit("!"))))
    return J.sections_diff(p.where(F.substring("n", 1, 4) < "2020"), new, "n", "t")


@query("""WITH k AS (SELECT DISTINCT lower(substr(name, 1, 9)) AS p FROM organizations WHERE length(name) >= 9), n AS (SELECT DISTINCT lower(name) AS name FROM organizations)
 SELECT p, min(name) AS name FROM k JOIN n ON starts_with(n.name, k.p) GROUP BY p HAVING count(*) = 1""")
def J11_unique_prefix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "organizations").select(F.lower("name").alias("name"))
    p = o.where(F.length("name") >= 9).select(F.substring("name", 1, 9).alias("p")).distinct()
    return J.prefix_join(p, o, "p", "name").select("p", "name")


@query("""SELECT acronym, min(id) AS id FROM organizations WHERE acronym IS NOT NULL AND acronym <> '' GROUP BY acronym HAVING count(DISTINCT id) = 1""")
def J12_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    return J.unique_keys(table(spark, d, "organizations").select("acronym", "id"), "acronym", "id")


@query("""SELECT id, CASE WHEN transparency IS NOT NULL THEN transparency ELSE by_name END AS resolved FROM (SELECT DISTINCT h.feedback_id AS id, a.id AS transparency, b.id AS by_name FROM hys_feedback_bronze h LEFT JOIN organizations a ON a.id = h.transparency_reg_id LEFT JOIN (SELECT lower(trim(name)) AS k, min(id) AS id FROM organizations GROUP BY 1) b ON b.k = lower(trim(h.organisation_name)))""")
def J15_either_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "organizations")
    h = table(spark, d, "hys_feedback_bronze").select(F.col("feedback_id").alias("fid"), F.col("transparency_reg_id").alias("tr"), F.col("organisation_name").alias("org"))
    by_id = o.select(F.col("id").alias("tr"), F.col("id").alias("resolved"))
    by_name = o.groupBy(F.lower(F.trim("name")).alias("org")).agg(F.min("id").alias("resolved"))
    return J.either_key(h, by_id, by_name, "tr", "org", "resolved").select(F.col("fid").alias("id"), "resolved").distinct()


def _strict(x: str) -> str:
    """name_key as SQL."""
    bare = f"regexp_replace(regexp_replace(trim(lower(coalesce({x}, ''))), '{X.LEGAL_FORMS}', '', 'g'), '\\s*\\(.*?\\)\\s*', ' ', 'g')"
    word, space = r"\p{L}\p{N}_", r"\s\x{0B}\x{85}\p{Z}"
    return f"regexp_replace(regexp_replace({bare}, '[^{word}{space}]', '', 'g'), '[{space}]+', '', 'g')"


_CLEAN = r"""regexp_replace(regexp_replace(regexp_extract(trim(split_part(name, '|', 1)), '(?s)^(.*?)(?:\s*(?:,\s*)?(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|M\.\s|Mme\.?\s)\s.*)?$', 1), '\s*,\s*[A-Z][a-z]+\s+[A-Z][a-z]+(?:,.*)?$', ''), '[, ]+$', '')"""
_CASCADE = rf"""reg AS (SELECT id, {_strict("name")} AS k, lower(trim(acronym)) AS a, eu_transparency_register_id AS t FROM organizations WHERE id IS NOT NULL),
 byk AS (SELECT k, max(id) AS id FROM reg WHERE k <> '' GROUP BY 1), bya AS (SELECT a AS k, min(id) AS id FROM reg WHERE a <> '' GROUP BY 1 HAVING min(id) = max(id)), byt AS (SELECT t AS k, max(id) AS id FROM reg WHERE t IS NOT NULL GROUP BY 1),
 n AS (SELECT DISTINCT trim(coalesce(organization_name, '')) AS name, trim(eu_transparency_register_id) AS told FROM commission_meeting_organizations),
 c AS (SELECT name, told, {_CLEAN} AS clean, trim(regexp_extract(name, '^(.*?)\s*\(([^)]+)\)\s*$', 1)) AS o, trim(regexp_extract(name, '^(.*?)\s*\(([^)]+)\)\s*$', 2)) AS i FROM n),
 f AS (SELECT name, told, 0 AS rung, 'tr_id_exact' AS method, 't' AS kind, told AS k FROM c UNION ALL SELECT name, told, 1, 'name_exact', 'k', {_strict("name")} FROM c UNION ALL SELECT name, told, 2, 'cleaned_name', 'k', {_strict("clean")} FROM c WHERE clean <> name
 UNION ALL SELECT name, told, 3, 'cleaned_acronym', 'a', lower(clean) FROM c WHERE clean <> name UNION ALL SELECT name, told, 4, 'acronym', 'a', lower(name) FROM c UNION ALL SELECT name, told, 5, 'parenthetical', 'k', {_strict("o")} FROM c UNION ALL SELECT name, told, 6, 'parenthetical_acronym', 'a', lower(o) FROM c
 UNION ALL SELECT name, told, 7, 'parenthetical', 'k', {_strict("i")} FROM c UNION ALL SELECT name, told, 8, 'parenthetical_acronym', 'a', lower(i) FROM c UNION ALL SELECT name, told, 9, 'prefix', 'p', {_strict("clean")} FROM c WHERE length(name) >= 5 AND length({_strict("clean")}) >= 4
 UNION ALL SELECT name, told, 10, 'tr_id_extracted', 't', regexp_extract(name, '([0-9]{{10,}}-[0-9]{{2}})', 1) FROM c),
 g AS (SELECT * FROM f WHERE length(k) > 0 AND (name <> '' OR rung = 0)), pre AS (SELECT p.k, min(byk.id) AS id FROM (SELECT DISTINCT k FROM g WHERE kind = 'p') p JOIN byk ON starts_with(byk.k, p.k) GROUP BY 1 HAVING count(*) = 1),
 ix AS (SELECT 'k' AS kind, k, id FROM byk UNION ALL SELECT 'a', k, id FROM bya UNION ALL SELECT 't', k, id FROM byt UNION ALL SELECT 'p', k, id FROM pre),
 h AS (SELECT name, told, rung, method, id FROM g JOIN ix USING (kind, k) UNION ALL SELECT name, told, 11, CASE WHEN name = '' THEN 'stub_empty' ELSE 'stub' END, 'org_' || substr(sha256('name_' || CASE WHEN name = '' THEN 'unknown' ELSE {_strict("name")} END), 1, 16) FROM n),
 cascade AS (SELECT name, told, arg_min(id, rung) AS resolved_id, arg_min(method, rung) AS method FROM h GROUP BY name, told)"""


@query(f"WITH {_CASCADE} SELECT name, told, resolved_id, method FROM cascade")
def J10_resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every typed name with the body it resolves to; also tested rung by rung."""
    c = table(spark, d, "commission_meeting_organizations")
    return J.resolve_cascade(c, table(spark, d, "organizations"), "organization_name", "eu_transparency_register_id")


@query(f"""WITH {_MEETINGS} SELECT lower(trim(commissioner_name)) AS host, max_by(host_id, meeting_date) AS host_id FROM mt WHERE commissioner_name IS NOT NULL AND host_id IS NOT NULL AND meeting_date IS NOT NULL GROUP BY 1""")
def J23_fill_down(spark: SparkSession, d: str) -> DataFrame:
    m = _meetings(spark, d).where(F.col("commissioner_name").isNotNull() & F.col("host_id").isNotNull() & F.col("meeting_date").isNotNull())
    return m.groupBy(F.lower(F.trim("commissioner_name")).alias("host")).agg(F.max_by("host_id", "meeting_date").alias("host_id"))


@query(f"WITH {_CASCADE} SELECT DISTINCT c.meeting_id, resolved_id AS org, method, CASE WHEN c.eu_transparency_register_id IS NOT NULL OR resolved_id IN (SELECT id FROM organizations WHERE eu_transparency_register_id IS NOT NULL) THEN 'High' ELSE 'Low' END AS transparency FROM commission_meeting_organizations c JOIN cascade k ON k.name = trim(coalesce(c.organization_name, '')) AND k.told IS NOT DISTINCT FROM trim(c.eu_transparency_register_id)")
def E04_meeting_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of meetings with the body that each attendee resolves to, how, and how transparent it is: each body once a meeting."""
    c = table(spark, d, "commission_meeting_organizations").select("meeting_id", F.trim(F.coalesce("organization_name", F.lit(""))).alias("name"), F.trim("eu_transparency_register_id").alias("told"), F.col("eu_transparency_register_id").isNotNull().alias("with_id"))
    o = table(spark, d, "organizations")
    found = J.resolve_cascade(c, o, "name", "told").withColumn("told", F.coalesce("told", F.lit("")))
    known = o.where(F.col("eu_transparency_register_id").isNotNull()).select(F.col("id").alias("resolved_id"), F.lit(True).alias("registered")).distinct()
    rows = c.withColumn("told", F.coalesce("told", F.lit(""))).join(found, ["name", "told"]).join(known, "resolved_id", "left")
    return rows.select("meeting_id", F.col("resolved_id").alias("org"), "method", F.when(F.col("with_id") | F.col("registered"), "High").otherwise("Low").alias("transparency")).distinct()


@query(f"WITH {_CASCADE} SELECT method, count(*) AS n, count(DISTINCT resolved_id) AS n_bodies FROM cascade GROUP BY 1")
def E01_cascade_methods(spark: SparkSession, d: str) -> DataFrame:
    """How many names each rung of the cascade resolves."""
    found = J.resolve_cascade(table(spark, d, "commission_meeting_organizations"), table(spark, d, "organizations"), "organization_name", "eu_transparency_register_id")
    return found.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("resolved_id").alias("n_bodies"))


@query(f"WITH {_CASCADE.replace("(name <> '' OR rung = 0)", "name <> ''")} SELECT name, told, resolved_id, method FROM cascade")
def E02_older_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The cascade as it was: an empty name is the unknown stub, whatever its register id."""
    return J.resolve_cascade(table(spark, d, "commission_meeting_organizations"), table(spark, d, "organizations"), "organization_name", "eu_transparency_register_id", compat=True)


@query(f"WITH {_CASCADE.replace('g AS (SELECT * FROM f WHERE', 'g AS (SELECT * FROM f WHERE rung IN (0, 1, 9) AND')} SELECT name, told, CASE WHEN starts_with(method, 'stub') THEN NULL ELSE resolved_id END AS resolved_id, CASE WHEN starts_with(method, 'stub') THEN 'unmatched' ELSE method END AS method FROM cascade")
def E03_short_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The older matcher of the commission's meetings: register id, name, prefix, else unmatched."""
    found = J.resolve_cascade(table(spark, d, "commission_meeting_organizations"), table(spark, d, "organizations"), "organization_name", "eu_transparency_register_id", only={"tr_id_exact", "name_exact", "prefix"})
    stub = F.col("method").startswith("stub")
    return found.select("name", "told", F.when(~stub, F.col("resolved_id")).alias("resolved_id"), F.when(stub, "unmatched").otherwise(F.col("method")).alias("method"))

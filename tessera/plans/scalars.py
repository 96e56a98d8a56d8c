"""Queries of scalar functions: names, identifiers, dates, arrays, JSON, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import stats as S
from ..functions import text as X
from ..operators import similarity as E
from ..session import table
from .registry import query


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "organizations").select("id", "name")


@query("""SELECT id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS k FROM organizations""")
def C01_squeezed(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("id", X.squeezed(F.col("name")).alias("k"))


@query("""SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, translate(lower(name), ' .,-_''"()&', '') AS id_key, 'org_' || substr(sha256('name_' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g')), 1, 16) AS stub FROM organizations""")
def C07_keys_and_stub_ids(spark: SparkSession, d: str) -> DataFrame:
    k = X.ascii_key(F.col("name"))
    return _names(spark, d).select("id", k.alias("k"), X.id_key(F.col("name")).alias("id_key"), X.stub_id(k).alias("stub"))


_FILLER = X.FILLER.replace("'", "''")


@query(f"""SELECT DISTINCT id, regexp_replace(subject, '{_FILLER}', '') AS s FROM commission_meetings WHERE subject IS NOT NULL""")
def C10_without_filler(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings").where(F.col("subject").isNotNull())
    return m.select("id", X.without_filler(F.col("subject")).alias("s")).distinct()


@query("""SELECT id, array_to_string(list_distinct(regexp_extract_all('see ' || id || ' and ' || coalesce(commission_document, '') || ' ' || id, '([0-9]{4}/[0-9]{4}\\([A-Z]{2,4}\\))', 1)), ',') AS ids, replace(regexp_replace(id, '\\([A-Z]+\\)$', ''), '/', '-') AS process, regexp_extract(id, '\\(([A-Z]+)\\)$', 1) AS kind FROM legal_procedures""")
def C11_file_ids(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see "), "id", F.lit(" and "), F.coalesce("commission_document", F.lit("")), F.lit(" "), "id")
    return table(spark, d, "legal_procedures").select("id", F.array_join(X.file_ids(text), ",").alias("ids"), X.process_id(F.col("id")).alias("process"), X.file_type(F.col("id")).alias("kind"))


@query("""SELECT id, 'COM(' || regexp_extract(commission_document, 'COM\\(([0-9]{4})\\)', 1) || ')' || ltrim(regexp_extract(commission_document, '\\)([0-9]+)', 1), '0') AS com FROM legal_procedures WHERE commission_document IS NOT NULL""")
def C23_com_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").where(F.col("commission_document").isNotNull()).select("id", X.com_number(F.col("commission_document")).alias("com"))


@query("""SELECT DISTINCT id, CASE WHEN lower(coalesce(subject, '')) LIKE '%round table%' THEN 'roundtable' WHEN lower(coalesce(subject, '')) LIKE '%conference%' THEN 'conference' WHEN lower(coalesce(subject, '')) LIKE '%visit%' THEN 'visit' WHEN lower(coalesce(subject, '')) LIKE '%call%' THEN 'call' WHEN lower(coalesce(subject, '')) LIKE '%lunch%' THEN 'meal' WHEN lower(coalesce(subject, '')) LIKE '%dinner%' THEN 'meal' WHEN lower(coalesce(subject, '')) LIKE '%meeting%' THEN 'meeting' ELSE 'other' END AS kind FROM commission_meetings""")
def C20_meeting_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commission_meetings").select("id", X.meeting_type(F.col("subject")).alias("kind")).distinct()


@query("""SELECT feedback_id, CASE WHEN lower(user_type) LIKE '%citizen%' THEN 'citizen' ELSE 'body' END AS kind FROM hys_feedback_bronze WHERE NOT (coalesce(user_type, '') IN ('EU_CITIZEN', 'NON_EU_CITIZEN', 'CITIZEN')) AND (length(trim(coalesce(feedback_text, ''))) > 0 OR attachment_count > 0)""")
def F06_feedback_filter(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hys_feedback_bronze")
    kept = h.where(~F.coalesce("user_type", F.lit("")).isin("EU_CITIZEN", "NON_EU_CITIZEN", "CITIZEN") & ((F.length(F.trim(F.coalesce("feedback_text", F.lit("")))) > 0) | (F.col("attachment_count") > 0)))
    return kept.select("feedback_id", F.when(F.lower("user_type").contains("citizen"), "citizen").otherwise("body").alias("kind"))


@query("""SELECT feedback_id FROM hys_feedback_bronze WHERE date_feedback >= TIMESTAMP '2015-01-01' AND date_feedback < TIMESTAMP '2020-01-01' AND length(feedback_text) >= 80""")
def F07_range_and_length(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hys_feedback_bronze")
    return h.where((F.col("date_feedback") >= F.lit("2015-01-01").cast("timestamp_ntz")) & (F.col("date_feedback") < F.lit("2020-01-01").cast("timestamp_ntz")) & (F.length("feedback_text") >= 80)).select("feedback_id")


@query("""SELECT DISTINCT id FROM commission_meetings WHERE match_status IS NULL AND subject IS NOT NULL AND length(trim(subject)) >= 3 AND lower(trim(subject)) NOT IN ('exchange of views','general exchange of views','meeting','introductory meeting','introduction','introductory','various','austausch','möte','rencontre','incontro','general exchange of view','bilateral meeting','courtesy visit','courtesy call','phone call','video call','working lunch','working dinner','breakfast meeting','lunch meeting','dinner meeting','informal meeting','formal meeting')""")
def F04_unprocessed_titles(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings")
    s = F.lower(F.trim("subject"))
    return m.where(F.col("match_status").isNull() & (F.length(s) >= 3) & ~s.isin(X.GENERIC_TITLES)).select("id").distinct()


@query("""SELECT p.id AS procedure_id, m.id AS meeting_id FROM legal_procedures p JOIN (SELECT DISTINCT id, meeting_date FROM commission_meetings) m ON p.policy_area = 'Energy' AND month(p.proposal_date) = month(m.meeting_date)
 WHERE m.meeting_date >= coalesce(CAST(p.proposal_date - INTERVAL 540 DAY AS DATE), DATE '2000-01-01') AND m.meeting_date <= coalesce(CAST(p.decision_date + INTERVAL 180 DAY AS DATE), CAST(p.last_activity_date + INTERVAL 180 DAY AS DATE), DATE '2099-12-31')""")
def F03_in_force(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").where("policy_area = 'Energy'").withColumn("k", F.month("proposal_date"))
    m = table(spark, d, "commission_meetings").select(F.col("id").alias("meeting_id"), "meeting_date", F.month("meeting_date").alias("k")).distinct()
    fits = D.in_force(F.col("meeting_date"), F.col("proposal_date"), F.col("decision_date"), F.col("last_activity_date"))
    return p.join(m, "k").where(fits).select(F.col("id").alias("procedure_id"), "meeting_id")


@query("""SELECT id, CAST(DATE '2024-07-16' + CAST(floor(datediff('day', DATE '2024-07-16', proposal_date) / 7.0) * 7 AS INTEGER) AS DATE) AS week, CAST(proposal_date + INTERVAL (-18) MONTH AS DATE) AS from_day, CAST(date_trunc('month', proposal_date) AS DATE) AS month FROM legal_procedures WHERE proposal_date IS NOT NULL""")
def D05_weeks_and_months(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").where(F.col("proposal_date").isNotNull())
    return p.select("id", D.week_start(F.col("proposal_date")).alias("week"), F.add_months("proposal_date", -18).alias("from_day"), F.trunc("proposal_date", "month").alias("month"))


@query("""SELECT c_custkey AS k, CASE WHEN n < 1 THEN '0' WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' WHEN n < 50 THEN '10-49' WHEN n < 250 THEN '50-249' WHEN n < 1000 THEN '250-999' ELSE '1000+' END AS bin, ln(1 + abs(n)) AS log_n FROM (SELECT c_custkey, CAST(floor(c_acctbal / 5) AS BIGINT) AS n FROM customer)""")
def M01_bins_and_logs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_acctbal") / 5).alias("n"))
    return c.select("k", X.headcount_bin(F.col("n")).alias("bin"), F.log1p(F.abs("n").cast("double")).alias("log_n"))


@query("""WITH s AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'A') AS h, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, h / n AS p, 1.96 * 1.96 AS zz FROM s)
 SELECT k, round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 9) AS low, round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 9) AS high FROM p""")
def M04_wilson(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("h"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("h"), F.col("n"))
    return s.select("k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("""SELECT substr(sha256(lower(coalesce(subject, '') || '|' || coalesce(strftime(meeting_date, '%Y-%m-%d'), '') || '|' || coalesce(commissioner_name, ''))), 1, 16) AS h FROM (SELECT DISTINCT id, subject, meeting_date, commissioner_name FROM commission_meetings)""")
def H03_meeting_ids(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings").select("id", "subject", "meeting_date", "commissioner_name").distinct()
    return m.select(X.short_hash(F.col("subject"), F.col("meeting_date"), F.col("commissioner_name")).alias("h"))


@query("""WITH h AS (SELECT id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(id || CASE WHEN title IS NULL THEN '' ELSE '::' || title END)) AS h FROM legal_procedures)
 SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def H04_uuid5(spark: SparkSession, d: str) -> DataFrame:
    """Version 5 UUIDs; a test compares them with the standard library's."""
    p = table(spark, d, "legal_procedures")
    return p.select("id", X.uuid5(F.concat_ws("::", "id", "title")).alias("uuid"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def R06_json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT feedback_id, raw_json ->> '$.userType' AS user_type, raw_json ->> '$.country' AS country FROM hys_feedback_bronze WHERE raw_json IS NOT NULL""")
def R06_raw_records(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hys_feedback_bronze").where(F.col("raw_json").isNotNull())
    r = F.from_json("raw_json", "userType string, country string")
    return h.select("feedback_id", r["userType"].alias("user_type"), r["country"].alias("country"))


@query("""SELECT DISTINCT id, unnest(list_distinct(transparency_register_ids)) AS org FROM commission_meetings""")
def R02_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commission_meetings").select("id", F.explode(F.array_distinct("transparency_register_ids")).alias("org")).distinct()


@query("""SELECT DISTINCT id, array_to_string(list_transform(commission_representatives, lambda x: lower(x.name)), '|') AS names, len(list_filter(commission_representatives, lambda x: x.function IS NOT NULL)) AS n_functions FROM commission_meetings WHERE commission_representatives IS NOT NULL""")
def R03_nested(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings").where(F.col("commission_representatives").isNotNull())
    return m.select("id", F.array_join(F.transform("commission_representatives", lambda x: F.lower(x["name"])), "|").alias("names"), F.size(F.filter("commission_representatives", lambda x: x["function"].isNotNull())).cast("long").alias("n_functions")).distinct()


@query("""SELECT a.id, len(list_intersect(list_distinct(a.subjects), ['Energy', 'Trade', 'SMEs'])) AS shared, list_contains(a.subjects, 'Energy') AS energy FROM legal_procedures a""")
def R08_array_overlap(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("Energy"), F.lit("Trade"), F.lit("SMEs"))
    return table(spark, d, "legal_procedures").select("id", F.size(F.array_intersect("subjects", wanted)).cast("long").alias("shared"), F.array_contains("subjects", "Energy").alias("energy"))


@query("""SELECT feedback_id, coalesce(nullif(trim(organisation_name), ''), 'Unknown') AS name, nullif(trim(feedback_text), '') IS NOT NULL AS has_text FROM hys_feedback_bronze""")
def DP15_feedback_rows(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hys_feedback_bronze")
    return h.select("feedback_id", F.coalesce(F.nullif(F.trim("organisation_name"), F.lit("")), F.lit("Unknown")).alias("name"), F.nullif(F.trim("feedback_text"), F.lit("")).isNotNull().alias("has_text"))


_PAIRS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings), pr AS (SELECT a.vec_id AS q, b.vec_id AS c, round(list_dot_product(a.e, b.e), 6) AS score, list_dot_product(a.e, b.e) AS raw FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"""


@query(f"""WITH {_PAIRS}, r AS (SELECT q, c, score, row_number() OVER (PARTITION BY c ORDER BY score DESC, q) AS rr FROM pr WHERE raw >= 0.2), s AS (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM r WHERE rr <= 10) SELECT q, c, score, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 5""")
def E16_reciprocal_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """A stated set of queries (ids divisible by 50) against all vectors."""
    e = table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0)
    pairs = E.scored_pairs(queries, e, "vec_id", "vec_id", "embedding", 0.2, same=True)
    return E.reciprocal(pairs, queries.count())


@query(f"""WITH {_PAIRS}, r AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM pr WHERE raw >= -1), g AS (SELECT q, min(rank) AS rank FROM r JOIN v a ON a.vec_id = q JOIN v b ON b.vec_id = c WHERE a.label = b.label GROUP BY q)
 SELECT count(*) AS n, round(avg(1.0 / rank), 9) AS mrr, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS recall_1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) AS recall_3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS recall_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall_10 FROM g""")
def A31_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the nearest vector with the query's own label."""
    e = table(spark, d, "embeddings")
    ranks = E.label_ranks(e.where(F.col("vec_id") % 50 == 0), e, "vec_id", "vec_id", "embedding", "label")
    return E.retrieval(ranks).withColumn("mrr", F.round("mrr", 9))


@query("""SELECT c_mktsegment AS g, count(*) AS n, round(regr_slope(ln(1 + c_acctbal + 1000), c_custkey), 9) AS slope, round(regr_intercept(ln(1 + c_acctbal + 1000), c_custkey), 6) AS intercept FROM customer GROUP BY 1 HAVING count(*) >= 5""")
def X02_trend(spark: SparkSession, d: str) -> DataFrame:
    y = F.log1p(F.col("c_acctbal") + 1000)
    out = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.count("*").alias("n"), F.round(F.regr_slope(y, F.col("c_custkey").cast("double")), 9).alias("slope"), F.round(F.regr_intercept(y, F.col("c_custkey").cast("double")), 6).alias("intercept"))
    return out.where("n >= 5")


@query("""SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY 1""")
def X06_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.count("*").alias("n"), F.percentile("l_extendedprice", 0.5).alias("median"))

"""Queries of single steps of the pipelines: filters, rankings, incremental behaviour, answers of classifiers, small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import records as R
from ..functions import stats as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import decisions as K
from ..operators import joins as J
from ..operators import linking as L
from ..operators import merge as M
from ..operators import packed
from ..operators import similarity as E
from ..operators import windows as W
from ..session import table
from .registry import query
from .relational import _MEETINGS, _meetings
from .scalars import _PAIRS
from .texts import THEMES

# -- filters --


@query("""SELECT id AS process, title AS name, policy_area AS area, 'procedures' AS source FROM legal_procedures""")
def F01_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select(F.col("id").alias("process"), F.col("title").alias("name"), F.col("policy_area").alias("area"), F.lit("procedures").alias("source"))


@query("""SELECT DISTINCT id FROM commission_meetings WHERE match_status IS NULL""")
def F02_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commission_meetings").where(F.col("match_status").isNull()).select("id").distinct()


@query("""SELECT feedback_id FROM hys_feedback_bronze WHERE length(regexp_replace(feedback_text, '(?i)\\b(?:article|annex) +[0-9]+', ' ', 'g')) >= 80""")
def F08_minimum_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hys_feedback_bronze").where(F.length(F.regexp_replace("feedback_text", r"(?i)\b(?:article|annex) +[0-9]+", " ")) >= 80).select("feedback_id")


@query("""SELECT feedback_id, attachment_count AS n FROM hys_feedback_bronze WHERE attachment_count > 0""")
def F10_positive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hys_feedback_bronze").where("attachment_count > 0").select("feedback_id", F.col("attachment_count").alias("n"))


@query("""SELECT id FROM legal_procedures WHERE trim(coalesce(title, '')) <> trim(coalesce(description, ''))""")
def F13_changed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures")
    return p.where(~X.diff_kind(F.col("title"), F.col("description")).isin("no_change", "empty")).select("id")


@query("""SELECT feedback_id FROM hys_feedback_bronze WHERE coalesce(pdf_extracted, true)""")
def F14_relevant(spark: SparkSession, d: str) -> DataFrame:
    return K.relevant(table(spark, d, "hys_feedback_bronze"), "pdf_extracted").select("feedback_id")


@query(f"""WITH {_MEETINGS} SELECT DISTINCT mt.id FROM mt WHERE EXISTS (SELECT 1 FROM legal_procedures p JOIN procedure_aliases a ON a.procedure_id = p.id WHERE p.policy_area = 'Energy' AND a.alias IS NOT NULL AND contains(lower(coalesce(mt.subject, '') || ' ' || coalesce(mt.points_raised, '')), lower(a.alias)))
 AND mt.meeting_date BETWEEN DATE '2014-01-01' AND DATE '2021-12-31' AND mt.id NOT IN (SELECT meeting_id FROM commission_meeting_organizations WHERE eu_transparency_register_id IS NOT NULL)""")
def F15_any_alias_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Any of a bounded list of aliases in the concatenated text, in a window of dates, not yet linked."""
    from ..session import bounded_rows

    p = table(spark, d, "legal_procedures").where("policy_area = 'Energy'").select(F.col("id").alias("procedure_id"))
    names = bounded_rows(table(spark, d, "procedure_aliases").where("alias IS NOT NULL").join(p, "procedure_id").select(F.lower("alias").alias("a")).distinct(), 2_000)
    if names is None:
        raise ValueError("more than 2000 aliases")
    held = F.array(*[F.lit(r["a"]) for r in names]) if names else F.array().cast("array<string>")
    m = _meetings(spark, d).withColumn("h", F.lower(F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("points_raised", F.lit("")))))
    linked = table(spark, d, "commission_meeting_organizations").where("eu_transparency_register_id IS NOT NULL").select(F.col("meeting_id").alias("id"))
    return m.where("meeting_date BETWEEN DATE '2014-01-01' AND DATE '2021-12-31'").where(F.exists(held, lambda a: F.contains(F.col("h"), a))).join(linked, "id", "left_anti").select("id").distinct()


@query("""SELECT label, count(*) AS n, label BETWEEN 0 AND 5 AS valid FROM embeddings GROUP BY 1""")
def F16_label_domain(spark: SparkSession, d: str) -> DataFrame:
    """Labels against their domain, after a check that the columns are there."""
    e = table(spark, d, "embeddings")
    if missing := {"vec_id", "label"} - set(e.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return e.groupBy("label").agg(F.count("*").alias("n")).withColumn("valid", F.col("label").between(0, 5))


@query("""SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT min(CAST(ts AS DATE)) FROM events) AND (SELECT min(CAST(ts AS DATE)) + 10 FROM events)""")
def F17_cutoff_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = e.agg(F.min(F.col("ts").cast("date")).alias("d")).first()["d"]
    return e.where(F.col("ts").cast("date").between(F.lit(first), F.date_add(F.lit(first), 10))).select("event_id")


# -- joins, aggregates, windows --


@query(f"""WITH {_PAIRS}, r AS (SELECT q, c, score, row_number() OVER (PARTITION BY c ORDER BY score DESC, q) AS place FROM pr) SELECT q, c, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def W03_reverse_top(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest queries of every vector (also J16 before its second half)."""
    e = table(spark, d, "embeddings")
    return E.nearest_queries(e.where(F.col("vec_id") % 50 == 0), e, "vec_id", "vec_id", "embedding", 3).select("q", "c", "score", "place")


@query(f"""WITH {_PAIRS}, r AS (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM pr WHERE raw >= 0.25) SELECT q, c, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""")
def W02_top_with_floor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = E.scored_pairs(e.where(F.col("vec_id") % 50 == 0), e, "vec_id", "vec_id", "embedding", 0.25, same=True).withColumn("score", F.round("score", 6))
    return W.top_k(pairs, ["q"], [F.desc("score"), "c"], 4).select("q", "c", "score", "rank")


@query(f"""WITH {_PAIRS}, a AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS f, row_number() OVER (PARTITION BY c ORDER BY score DESC, q) AS b FROM pr WHERE raw >= 0.2) SELECT q, c FROM a WHERE f <= 10 AND b <= 5""")
def J16_mutual_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = E.scored_pairs(e.where(F.col("vec_id") % 50 == 0), e, "vec_id", "vec_id", "embedding", 0.2, same=True).withColumn("score", F.round("score", 6))
    both = W.top_k(W.top_k(pairs.withColumn("b", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "q"))), ["q"], [F.desc("score"), "c"], 10), ["q"], [F.desc("score"), "c"], 10, "again")
    return both.where("b <= 5").select("q", "c")


@query(f"""WITH {_PAIRS}, r AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM pr), g AS (SELECT q, min(rank) AS rank FROM r JOIN v a ON a.vec_id = q JOIN v b ON b.vec_id = c WHERE a.label = b.label GROUP BY q) SELECT q, rank FROM g""")
def W04_gold_ranks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return E.label_ranks(e.where(F.col("vec_id") % 50 == 0), e, "vec_id", "vec_id", "embedding", "label")


@query("""WITH k AS (SELECT DISTINCT trim(split_part(commissioner_name, ' ', -1)) AS member FROM commission_meetings WHERE commissioner_name IS NOT NULL), r AS (SELECT DISTINCT r.name AS author FROM (SELECT unnest(commission_representatives) AS r FROM commission_meetings) WHERE r.name IS NOT NULL)
 SELECT author, member FROM r JOIN k ON length(member) >= 3 AND contains(' ' || trim(regexp_replace(lower(author), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(member), '[^a-z0-9]+', ' ', 'g')) || ' ')""")
def J24_authors_by_member(spark: SparkSession, d: str) -> DataFrame:
    """Authors with the key member whose family name is a word of theirs: an equi-join on words instead of contains."""
    m = table(spark, d, "commission_meetings")
    word = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    members = m.where("commissioner_name IS NOT NULL").select(F.trim(F.element_at(F.split("commissioner_name", " "), -1)).alias("member")).distinct().where(F.length("member") >= 3).withColumn("k", word("member"))
    authors = m.select(F.explode("commission_representatives").alias("r")).select(F.col("r.name").alias("author")).where("author IS NOT NULL").distinct()
    near = authors.select("author", word("author").alias("t")).withColumn("w", F.explode(F.array_distinct(F.split("t", " ")))).join(members.withColumn("w", F.split_part("k", F.lit(" "), F.lit(1))), "w")
    return near.where(F.expr("contains(concat(' ', t, ' '), concat(' ', k, ' '))")).select("author", "member").distinct()


@query("""SELECT l_returnflag AS g, avg(l_quantity) AS mean, quantile_cont(l_quantity, 0.5) AS median, max(l_quantity) AS largest FROM lineitem GROUP BY 1""")
def A13_mean_median_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.avg("l_quantity").alias("mean"), F.percentile("l_quantity", 0.5).alias("median"), F.max("l_quantity").alias("largest"))


@query("""SELECT user_id, event_id AS second_purchase FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 2""")
def W08_second(spark: SparkSession, d: str) -> DataFrame:
    return A.nth(table(spark, d, "events").where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], 2, "event_id").withColumnRenamed("event_id", "second_purchase")


@query("""SELECT id FROM (SELECT DISTINCT id FROM commission_meetings WHERE match_status IS NULL) ORDER BY id LIMIT 30""")
def L08_work_cap(spark: SparkSession, d: str) -> DataFrame:
    """The next thirty pieces of work of a run."""
    return table(spark, d, "commission_meetings").where("match_status IS NULL").select("id").distinct().orderBy("id").limit(30)


@query("""SELECT org, n, rank FROM (SELECT organization_id AS org, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, organization_id) AS INTEGER) AS rank FROM commission_meeting_organizations WHERE organization_id IS NOT NULL GROUP BY 1) WHERE rank <= 30""")
def L09_summary_top(spark: SparkSession, d: str) -> DataFrame:
    """The thirty organisations of a summary with their rank, by a limit before the ranking."""
    c = table(spark, d, "commission_meeting_organizations").where("organization_id IS NOT NULL").groupBy(F.col("organization_id").alias("org")).agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "org").limit(30)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "org")))


@query("""SELECT a.id AS a, b.id AS b, len(list_intersect(a.subjects, b.subjects)) AS n FROM legal_procedures a JOIN legal_procedures b ON a.policy_area = b.policy_area AND a.proposal_date < b.proposal_date AND month(a.proposal_date) = month(b.proposal_date)""")
def U04_intersections(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").select("id", "policy_area", "proposal_date", "subjects", F.month("proposal_date").alias("m"))
    q = p.select(F.col("id").alias("b"), "policy_area", F.col("proposal_date").alias("later"), F.col("subjects").alias("other"), "m")
    both = p.withColumnRenamed("id", "a").join(q, ["policy_area", "m"]).where("proposal_date < later")
    return both.select("a", "b", F.when(F.col("subjects").isNotNull() & F.col("other").isNotNull(), F.size(F.array_intersect("subjects", "other"))).cast("long").alias("n"))


@query("""SELECT DISTINCT id, CAST(epoch(created_at) AS BIGINT) AS at, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM commission_meetings WHERE created_at IS NOT NULL""")
def D07_utc(spark: SparkSession, d: str) -> DataFrame:
    """Times without a zone as UTC seconds and text, whatever the session's zone."""
    m = table(spark, d, "commission_meetings").where("created_at IS NOT NULL")
    return m.select("id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at) AS at"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).distinct()


@query("""SELECT country, count(*) FILTER (website IS NOT NULL) AS n, round(100.0 * count(*) FILTER (website IS NOT NULL) / count(*), 6) AS percent FROM organizations GROUP BY 1""")
def M07_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if(F.col("website").isNotNull())
    return table(spark, d, "organizations").groupBy("country").agg(n.alias("n"), F.round(100.0 * n / F.count("*"), 6).alias("percent"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS score FROM embeddings""")
def M06_rounded_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("embedding")), 6).alias("score"))


# -- incremental --


@query("""SELECT doc_id FROM documents WHERE ingested_at >= (SELECT max(ingested_at) - INTERVAL 30 DAY FROM documents)""")
def I02_feed_horizon(spark: SparkSession, d: str) -> DataFrame:
    """What a horizon of thirty days before the latest record still admits; the stream has the same bound as its watermark."""
    docs = table(spark, d, "documents").select("doc_id", "ingested_at")
    last = docs.agg(F.max("ingested_at").alias("t")).first()["t"]
    return docs.where(F.col("ingested_at") >= F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")).select("doc_id")


@query("""SELECT DISTINCT feedback_id, procedure_id FROM hys_feedback_bronze h WHERE NOT EXISTS (SELECT 1 FROM hys_feedback_bronze k WHERE k.attachment_count > 0 AND k.feedback_id = h.feedback_id AND k.procedure_id = h.procedure_id)""")
def I04_existing_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hys_feedback_bronze").select("feedback_id", "procedure_id", "attachment_count")
    return h.select("feedback_id", "procedure_id").distinct().join(h.where("attachment_count > 0").select("feedback_id", "procedure_id"), ["feedback_id", "procedure_id"], "left_anti")


@query("""SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS carried, o_orderkey % 3 = 0 AS fresh FROM orders""")
def I06_carried_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each run with what the run before had, and whether it adds something."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(w).alias("carried"), (F.col("o_orderkey") % 3 == 0).alias("fresh"))


@query("""SELECT doc_id, ingested_at >= (SELECT max(ingested_at) FROM documents) - INTERVAL 365 DAY AS fresh FROM documents""")
def I07_ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.connectors import fresh

    docs = table(spark, d, "documents").select("doc_id", "ingested_at")
    now = F.lit(docs.agg(F.max("ingested_at").alias("t")).first()["t"]).cast("timestamp_ntz")
    kept = fresh(docs, "ingested_at", now, 365).select("doc_id", F.lit(True).alias("f"))
    return docs.select("doc_id", "ingested_at").join(kept, "doc_id", "left").select("doc_id", F.when(F.col("ingested_at").isNotNull(), F.coalesce("f", F.lit(False))).alias("fresh"))


@query("""SELECT CAST((row_number() OVER (ORDER BY feedback_id) - 1) // 50 AS BIGINT) AS batch, feedback_id FROM (SELECT DISTINCT feedback_id FROM hys_feedback_bronze)""".replace("SELECT CAST", "SELECT min(feedback_id) AS first, count(*) AS n FROM (SELECT CAST").replace("FROM hys_feedback_bronze)", "FROM hys_feedback_bronze)) GROUP BY batch"))
def I08_rolling_flush(spark: SparkSession, d: str) -> DataFrame:
    """Batches of fifty rows in order: ranks come from counts of ranges, so that no single task sees all rows."""
    h = table(spark, d, "hys_feedback_bronze").select("feedback_id").distinct()
    ranges = h.repartitionByRange(16, "feedback_id").withColumn("p", F.spark_partition_id()).withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("feedback_id")))
    sizes = ranges.groupBy("p").agg(F.count("*").alias("c"))  # sixteen rows
    before = sizes.withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "b")
    placed = ranges.join(F.broadcast(before), "p").withColumn("batch", F.floor((F.col("b") + F.col("i") - 1) / 50))
    return placed.groupBy("batch").agg(F.min("feedback_id").alias("first"), F.count("*").alias("n")).drop("batch")


# -- classifiers --

_ITEMS = "it AS (SELECT o_custkey AS batch, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey AS item FROM orders)"


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items in batches of one customer, and answers: 'high' for every other place, of which odd customers give one too few."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("item"))
    items = o.withColumn("pos", F.row_number().over(Window.partitionBy("batch").orderBy("item")) - 1)
    sizes = o.groupBy("batch").agg(F.count("*").cast("int").alias("n")).withColumn("k", F.col("n") - F.col("batch").cast("int") % 2)
    answers = sizes.select("batch", F.when(F.col("k") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0))), lambda i: F.when(i % 2 == 0, "High").otherwise("low"))).otherwise(F.array().cast("array<string>")).alias("answers"))
    return items, answers


@query(f"""WITH {_ITEMS}, s AS (SELECT batch, count(*) AS n FROM it GROUP BY 1) SELECT it.batch, it.item, CASE WHEN pos % 2 = 0 AND pos < n - it.batch % 2 THEN 'file-' || CAST(item AS VARCHAR) ELSE 'no_match' END AS decision FROM it JOIN s ON s.batch = it.batch""")
def K01_confirmed_files(spark: SparkSession, d: str) -> DataFrame:
    """Answers padded or cut to their batch; what isn't certain is no match."""
    items, answers = _items(spark, d)
    out = K.lined_up(items, answers, "batch", "pos")
    return out.select("batch", "item", K.confirmed(F.col("answer"), F.concat(F.lit("file-"), F.col("item").cast("string"))).alias("decision"))


@query(f"""WITH {_ITEMS} SELECT batch, item, CASE WHEN pos % 2 = 0 AND batch % 2 = 0 THEN 'org-' || CAST(item AS VARCHAR) ELSE 'no_match' END AS decision FROM it""")
def K02_confirmed_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Answers of another length than their batch count for nothing."""
    items, answers = _items(spark, d)
    out = K.lined_up(items, answers, "batch", "pos", strict=True)
    return out.select("batch", "item", K.confirmed(F.col("answer"), F.concat(F.lit("org-"), F.col("item").cast("string"))).alias("decision"))


@query("""SELECT l_orderkey AS o, l_linenumber AS n, max(CASE l_returnflag WHEN 'A' THEN 'ALIGNED' WHEN 'R' THEN 'OPPOSING' ELSE 'NOISE' END) AS label FROM lineitem GROUP BY 1, 2""")
def K04_pair_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the domain; a failed or unknown one is noise."""
    answer = F.when(F.col("l_returnflag") == "A", " aligned").when(F.col("l_returnflag") == "R", "Opposing").when(F.col("l_linenumber") % 2 == 0, "maybe")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), K.labelled(answer).alias("label")).groupBy("o", "n").agg(F.max("label").alias("label"))


@query("""SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN ['costs', 'scope'] ELSE list_filter([CASE WHEN regexp_matches(text, '(?i)(yearly costs|burden)') THEN 'costs' END, CASE WHEN regexp_matches(text, '(?i)(data points|reporting template)') THEN 'data' END, CASE WHEN regexp_matches(text, '(?i)(weeks|transition period)') THEN 'timing' END, CASE WHEN regexp_matches(text, '(?i)(annex|exemption)') THEN 'scope' END], lambda x: x IS NOT NULL) END, ',') AS themes FROM documents""")
def K06_known_themes(spark: SparkSession, d: str) -> DataFrame:
    """Answered themes that the taxonomy has; where none is left, those that the text matches."""
    answers = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("scope"), F.lit("weather"), F.lit("costs"))).when(F.col("doc_id") % 3 == 0, F.array(F.lit("weather")))
    return table(spark, d, "documents").select("doc_id", F.array_join(K.known_themes(answers, F.col("text"), THEMES), ",").alias("themes"))


@query("""SELECT feedback_id, coalesce(nullif(trim(organisation_name), ''), country) AS actor FROM hys_feedback_bronze WHERE coalesce(attachment_count < 3, true)""")
def K07_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions that aren't said to be irrelevant, with their actor or, failing that, country."""
    h = table(spark, d, "hys_feedback_bronze").withColumn("relevant", F.col("attachment_count") < 3)
    return K.relevant(h, "relevant").select("feedback_id", F.coalesce(F.nullif(F.trim("organisation_name"), F.lit("")), "country").alias("actor"))


# -- resolution --


@query("""SELECT name, coalesce(told, 'org_' || substr(sha256('name_' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g')), 1, 16)) AS id, CASE WHEN told IS NOT NULL THEN 'High' ELSE 'Low' END AS transparency, meeting FROM (SELECT DISTINCT organization_name AS name, eu_transparency_register_id AS told, meeting_id AS meeting FROM commission_meeting_organizations WHERE organization_name IS NOT NULL)""")
def E06_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Links with a register id, or the stub of their name, and how transparent that is."""
    c = table(spark, d, "commission_meeting_organizations").where("organization_name IS NOT NULL").select(F.col("organization_name").alias("name"), F.col("eu_transparency_register_id").alias("told"), F.col("meeting_id").alias("meeting")).distinct()
    return c.select("name", F.coalesce("told", X.stub_id(X.ascii_key(F.col("name")))).alias("id"), F.when(F.col("told").isNotNull(), "High").otherwise("Low").alias("transparency"), "meeting")


@query("""SELECT vec_id, CASE WHEN s >= 96 THEN 'auto_accept' WHEN s >= 93 THEN 'to_decider' ELSE 'no_match' END AS band FROM (SELECT vec_id, 85 + vec_id % 16 AS s FROM embeddings)""")
def E09_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", L.decision_band(F.lit(85.0) + F.col("vec_id") % 16).alias("band"))


@query("""WITH m AS (SELECT c_custkey AS id, 'n' || CAST(c_custkey % 90 AS VARCHAR) AS name, c_acctbal > 0 AS registered FROM customer), best AS (SELECT name, min(id) AS best FROM m WHERE registered GROUP BY 1) SELECT m.id, coalesce(best.best, m.id) AS canonical FROM m LEFT JOIN best ON NOT m.registered AND best.name = m.name""")
def E10_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Stubs promoted to the registered body of their name."""
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), (F.col("c_custkey") % 90).cast("string")).alias("name"), (F.col("c_acctbal") > 0).alias("registered"))
    best = m.where("registered").groupBy("name").agg(F.min("id").alias("new"))
    mapping = m.where("NOT registered").join(best, "name").select(F.col("id").alias("old"), "new")
    return M.relinked(m.select("id", F.col("id").alias("canonical")), mapping, "canonical", "old", "new").select("id", "canonical")


@query("""WITH c AS (SELECT DISTINCT id, organization_name AS name, organization_id AS org FROM commission_meeting_organizations), known AS (SELECT lower(name) AS k, min(id) AS a FROM organizations GROUP BY 1), seen AS (SELECT lower(trim(name)) AS k, min(org) AS b FROM c WHERE org IS NOT NULL GROUP BY 1 HAVING count(DISTINCT org) = 1)
 SELECT c.id, coalesce(a, b) AS org, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'known' ELSE 'open' END AS method FROM c LEFT JOIN known ON known.k = lower(c.name) LEFT JOIN seen ON seen.k = lower(trim(c.name)) WHERE c.org IS NULL AND c.name IS NOT NULL""")
def E11_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Missing ids filled in turn: by the register's name, then by what the same name was linked to without exception; the rest stays open for fuzzy candidates."""
    c = table(spark, d, "commission_meeting_organizations").select("id", F.col("organization_name").alias("name"), F.col("organization_id").alias("org")).distinct()
    known = table(spark, d, "organizations").groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("a"))
    seen = J.unique_keys(c.where("org IS NOT NULL").select(F.lower(F.trim("name")).alias("k2"), "org"), "k2", "org").withColumnRenamed("org", "b")
    open_ = c.where("org IS NULL AND name IS NOT NULL").withColumns({"k": F.lower("name"), "k2": F.lower(F.trim("name"))})
    return open_.join(known, "k", "left").join(seen, "k2", "left").select("id", F.coalesce("a", "b").alias("org"), F.when(F.col("a").isNotNull(), "name").when(F.col("b").isNotNull(), "known").otherwise("open").alias("method"))


# -- statistics --


@query("""WITH t AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT a.r, b.c, a.n * b.n / (SELECT sum(n) FROM t) AS e FROM (SELECT r, sum(n) AS n FROM t GROUP BY 1) a, (SELECT c, sum(n) AS n FROM t GROUP BY 1) b)
 SELECT round(sum(pow(coalesce(t.n, 0) - e.e, 2) / e.e), 4) AS statistic, CAST((count(DISTINCT e.r) - 1) * (count(DISTINCT e.c) - 1) AS BIGINT) AS dof FROM e LEFT JOIN t ON t.r = e.r AND t.c = e.c""")
def X07_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return R.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("statistic", F.round("statistic", 4))


@query("""SELECT vec_id, prompt, temperature FROM embeddings, (VALUES ('A'), ('B')) p(prompt), (VALUES (CAST(0.0 AS DOUBLE)), (0.5), (1.0)) t(temperature)""")
def X08_parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    return R.parameter_grid(table(spark, d, "embeddings").select("vec_id"), prompt=["A", "B"], temperature=[0.0, 0.5, 1.0])


@query("""SELECT o_orderpriority AS stage, o_orderstatus AS status, count(*) AS n, round(CASE WHEN sum(v) = 0 THEN 0 ELSE 2.0 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*) END, 6) AS gini FROM (SELECT o_orderpriority, o_orderstatus, v, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY v) AS i FROM (SELECT o_orderpriority, o_orderstatus, o_custkey, count(*) AS v FROM orders GROUP BY 1, 2, 3)) GROUP BY 1, 2""")
def X05_gini_table(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status"), "o_custkey").agg(F.count("*").alias("v"))
    return S.gini(v, ["stage", "status"], "v").withColumn("gini", F.round("gini", 6))


@query("""SELECT vec_id % 3 AS source, count(*) FILTER (gold = pred) AS tp, count(*) AS n, round(count(*) FILTER (gold = pred) / count(*), 9) AS precision FROM (SELECT vec_id, label AS gold, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 8 ELSE label END AS pred FROM embeddings) GROUP BY 1""")
def X04_precision_per_source(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("source"), F.col("label").alias("gold"), F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 8).otherwise(F.col("label")).alias("pred"))
    c = e.groupBy("source").agg(F.count_if(F.col("gold") == F.col("pred")).alias("tp"), F.count("*").alias("n"))
    return c.withColumn("precision", F.round(S.safe_ratio(F.col("tp"), F.col("n")), 9))


# -- the rest --


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS target FROM customer""")
def Z02_active_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    branch = lambda rows, name: rows.select("id", F.lit(name).alias("target"))
    return branch(c.where("c_acctbal >= 0"), "active").unionByName(branch(c.where("c_acctbal < 0"), "inactive"))


@query("""SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal < 0""")
def Z03_outgoing_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of outgoing members from RDF in XML; a file that can't be read gives none."""
    import uuid

    from ..session import shared_dir
    from ..sources.connectors import read_xml

    path = f"{shared_dir(spark)}/outgoing-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("http://x/mep/"), F.col("c_custkey").cast("string")).alias("about"))
    rows.write.format("xml").option("rootTag", "RDF").option("rowTag", "Description").save(path)
    found = read_xml(spark, path, "Description", rows.schema)
    return found.select(F.regexp_extract("about", r"([0-9]+)$", 1).try_cast("long").alias("id")).where("id IS NOT NULL").distinct()


@query("""SELECT c_custkey AS id, c_name AS name, 'scraped' AS origin FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, NULL, 'minimal' FROM customer WHERE c_acctbal < 0 AND c_custkey % 4 <> 0""")
def Z04_validated_union(spark: SparkSession, d: str) -> DataFrame:
    """Full and minimal records together; those whose id is none are dropped."""
    c = table(spark, d, "customer")
    full = c.where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("scraped").alias("origin"))
    minimal = c.where("c_acctbal < 0").select(F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_custkey").cast("string")).alias("id"), F.lit("minimal").alias("origin"))
    return full.unionByName(minimal, allowMissingColumns=True).withColumn("id", F.col("id").try_cast("long")).where("id IS NOT NULL")


@query("""SELECT DISTINCT a.id, b.minutes_url AS url FROM commission_meetings a LEFT JOIN (SELECT DISTINCT strftime(meeting_date, '%Y-%m-%d') || '|' || lower(subject) AS k, min(minutes_url) OVER (PARTITION BY strftime(meeting_date, '%Y-%m-%d') || '|' || lower(subject)) AS minutes_url FROM commission_meetings WHERE minutes_url IS NOT NULL) b ON b.k = strftime(a.meeting_date, '%Y-%m-%d') || '|' || lower(a.subject)""")
def Z05_minutes_by_day_and_subject(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "commission_meetings").select("id", F.concat(F.date_format("meeting_date", "yyyy-MM-dd"), F.lit("|"), F.lower("subject")).alias("k"), "minutes_url")
    links = m.where("minutes_url IS NOT NULL AND k IS NOT NULL").groupBy("k").agg(F.min("minutes_url").alias("url"))
    return m.select("id", "k").join(links, "k", "left").select("id", "url").distinct()


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN 'cached' ELSE 'parsed' END AS origin FROM customer""")
def Z06_parse_cache(spark: SparkSession, d: str) -> DataFrame:
    """Parses kept for id and parser version; an empty parse counts as none."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(2).alias("version"), "c_acctbal")
    cache = c.select("id", F.when(F.col("id") % 3 == 0, 2).otherwise(1).alias("version"), F.when(F.col("c_acctbal") > 0, "x").alias("parsed")).where("parsed IS NOT NULL")
    return c.join(cache, ["id", "version"], "left").select("id", F.when(F.col("parsed").isNotNull(), "cached").otherwise("parsed").alias("origin"))


@query("""SELECT c_custkey AS k, 'Alpha Ltd|' || c_name AS bodies FROM customer""")
def Z07_cell_lines(spark: SparkSession, d: str) -> DataFrame:
    """A cell of organisations split at its lines, abbreviations behind the names removed."""
    cell = F.concat(F.lit("Alpha Ltd (AL)\n\n "), "c_name", F.lit(" (C) \n"))
    values = F.transform(packed.unpack(cell), lambda v: F.regexp_replace(v, r"\s*\([A-Z]+\)$", ""))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(values, "|").alias("bodies"))


@query("""SELECT id FROM legal_procedures WHERE id LIKE '%COD%'""")
def Z14_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").where(F.col("id").like("%COD%")).select("id")


@query("""SELECT DISTINCT procedure_id AS id FROM hys_feedback_bronze WHERE procedure_id IS NOT NULL EXCEPT SELECT procedure_id FROM documents WHERE procedure_id IS NOT NULL""")
def Z15_not_loaded(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hys_feedback_bronze").select(F.col("procedure_id").alias("id")).where("id IS NOT NULL").distinct()
    return M.unprocessed(h, table(spark, d, "documents").where("procedure_id IS NOT NULL").select(F.col("procedure_id").alias("id")), "id")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(upper(title), title) ELSE title END AS title, lang FROM documents""")
def Z16_keyed_upserts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "title", "lang")
    return M.upserted(docs, docs.where("doc_id % 2 = 0").select("doc_id", F.upper("title").alias("title")), ["doc_id"])


@query("""SELECT source, text_key, min(doc_id) AS doc FROM (SELECT coalesce(source, '') AS source, sha256(coalesce(source, '') || '::' || coalesce(text, '')) AS text_key, doc_id FROM documents) GROUP BY 1, 2""")
def Z17_load_once(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an id made of their content, each once: what a load writes."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit("::"), F.coalesce("text", F.lit(""))), 256).alias("text_key"), F.col("doc_id").alias("doc"))
    return J.first_of(docs, ["source", "text_key"], [F.col("doc")])


@query("""SELECT doc_id, coalesce(nullif(title, ''), 'document ' || CAST(doc_id AS VARCHAR)) AS title, coalesce(lang, 'und') AS language, length(text) AS n, text IS NOT NULL AND text <> '' AS extracted FROM documents""")
def Z18_document_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("document "), F.col("doc_id").cast("string"))).alias("title"), F.coalesce("lang", F.lit("und")).alias("language"), F.length("text").cast("long").alias("n"), (F.col("text").isNotNull() & (F.coalesce("text", F.lit("")) != "")).alias("extracted"))


@query("""SELECT id, CASE WHEN title IS NOT NULL AND NOT regexp_matches(title, '^[0-9]{4}/[0-9]{4}') AND length(title) > 40 THEN title ELSE id END AS title FROM legal_procedures""")
def Z19_catalogue_titles(spark: SparkSession, d: str) -> DataFrame:
    real = F.col("title").isNotNull() & ~F.col("title").rlike(r"^[0-9]{4}/[0-9]{4}") & (F.length("title") > 40)
    return table(spark, d, "legal_procedures").select("id", F.when(real, F.col("title")).otherwise(F.col("id")).alias("title"))


@query("""SELECT id FROM legal_procedures WHERE len(subjects) > 0 AND id NOT IN (SELECT procedure_id FROM procedure_aliases WHERE alias_type = 'nickname' AND procedure_id IS NOT NULL) ORDER BY id LIMIT 200""")
def Z21_not_yet_aliased(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").where(F.size("subjects") > 0).select("id")
    named = table(spark, d, "procedure_aliases").where("alias_type = 'nickname' AND procedure_id IS NOT NULL").select(F.col("procedure_id").alias("id"))
    return p.join(named, "id", "left_anti").orderBy("id").limit(200)


@query("""SELECT id, CASE WHEN commission_document LIKE 'COM(%' THEN 'documents' ELSE 'plenary-documents' END AS endpoint, 'https://x/' || replace(replace(coalesce(commission_document, id), '(', '-'), ')', '-') AS url FROM legal_procedures""")
def Z24_document_endpoints(spark: SparkSession, d: str) -> DataFrame:
    ref = F.coalesce("commission_document", "id")
    return table(spark, d, "legal_procedures").select("id", F.when(F.col("commission_document").startswith("COM("), "documents").otherwise("plenary-documents").alias("endpoint"), F.concat(F.lit("https://x/"), F.translate(ref, "()", "--")).alias("url"))


@query("""SELECT id, lower(commission_dg) AS tail, CASE commission_dg WHEN 'ENER' THEN 'energy' ELSE lower(commission_dg) END AS role FROM legal_procedures WHERE commission_dg IS NOT NULL AND NOT contains(commission_dg, '/')""")
def Z25_uri_tails(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").where("commission_dg IS NOT NULL AND NOT contains(commission_dg, '/')")
    tail = F.substring_index(F.concat(F.lit("https://x/role/"), "commission_dg"), "/", -1)
    roles = F.create_map(F.lit("ENER"), F.lit("energy"))
    return p.select("id", F.lower(tail).alias("tail"), F.coalesce(F.try_element_at(roles, tail), F.lower(tail)).alias("role"))


@query("""SELECT id, CASE WHEN n > 1 THEN 'joint_committee_responsible' ELSE 'committee_responsible' END AS role, n FROM (SELECT id, CAST(length(coalesce(responsible_committee, '')) % 2 + 1 AS INTEGER) AS n FROM legal_procedures)""")
def Z26_joint_roles(spark: SparkSession, d: str) -> DataFrame:
    """Committees become joint ones where there are several of them."""
    n = F.length(F.coalesce("responsible_committee", F.lit(""))) % 2 + 1
    actors = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("string").alias("name"), F.lit("committee_responsible").alias("role")))
    p = table(spark, d, "legal_procedures").select("id", actors.alias("a"))
    joint = F.transform("a", lambda x: x.withField("role", F.when((F.size("a") > 1) & (x["role"] == "committee_responsible"), "joint_committee_responsible").otherwise(x["role"])))
    return p.select("id", F.element_at(joint, 1)["role"].alias("role"), F.size("a").alias("n"))


@query("""SELECT o_custkey AS doc, 'u' || CAST(max(o_orderkey) AS VARCHAR) AS url FROM orders GROUP BY 1""")
def Z28_last_urls(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("day"), F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url")))).alias("files"))
    return o.select("doc", F.explode("files").alias("f")).groupBy("doc").agg(F.max_by("f.url", "f.o_orderkey").alias("url"))


@query("""SELECT id, 'Regulation (EU) ' || substr(id, 1, 4) || '/' || substr(id, 6, 4) AS act, coalesce(title, 'doc ' || substr(id, 6, 4)) AS title FROM legal_procedures""")
def Z29_act_references(spark: SparkSession, d: str) -> DataFrame:
    """References to acts out of a sentence; a title from the address where there is none."""
    p = table(spark, d, "legal_procedures")
    said = F.concat(F.lit("amending Regulation (EU) "), F.substring("id", 1, 4), F.lit("/"), F.substring("id", 6, 4), F.lit(" as regards it"))
    url = F.concat(F.lit("https://x/doc-"), F.substring("id", 6, 4), F.lit(".html"))
    return p.select("id", F.regexp_extract(said, r"((?:Regulation|Directive|Decision) \(E[UC]\) [0-9]{4}/[0-9]{1,4})", 1).alias("act"), F.coalesce("title", F.regexp_replace(F.regexp_extract(url, r"/([^/]+)\.html$", 1), "-", " ")).alias("title"))


@query("""SELECT id, responsible_committee AS committee, strftime(proposal_date, '%Y-%m-%d') AS day FROM legal_procedures WHERE responsible_committee IS NOT NULL AND proposal_date IS NOT NULL AND regexp_matches(responsible_committee, '^[A-Z]+$')""")
def Z31_opinion_heads(spark: SparkSession, d: str) -> DataFrame:
    """Committee and date out of the head of an opinion."""
    p = table(spark, d, "legal_procedures").where("responsible_committee IS NOT NULL AND proposal_date IS NOT NULL").where(F.col("responsible_committee").rlike("^[A-Z]+$"))
    head = F.concat(F.lit("OPINION of the Committee "), "responsible_committee", F.lit(" (INI)\n"), F.date_format("proposal_date", "d MMMM yyyy"))
    return p.select("id", F.regexp_extract(head, r"Committee ([A-Z]+)", 1).alias("committee"), F.date_format(D.any_date(F.regexp_extract(head, r"\n(.+)$", 1)), "yyyy-MM-dd").alias("day"))


@query("""SELECT l_orderkey AS o, string_agg(t, ' ' ORDER BY l_linenumber, t) AS text, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_shipmode AS t FROM lineitem) GROUP BY 1""".replace("l_shipmode", "l_returnflag"))
def Z32_section_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of sections put together in their order."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return rows.select("o", F.array_join(F.transform("x", lambda r: r["l_returnflag"]), " ").alias("text"), F.size("x").cast("long").alias("n"))


@query("""SELECT DISTINCT id, version, piece FROM (SELECT id, 'proposal' AS version, title AS piece FROM legal_procedures WHERE length(title) >= 11 UNION ALL SELECT id, 'final', substr(description, 1, 5000) FROM legal_procedures WHERE decision_date IS NOT NULL AND length(description) >= 11)""")
def Z33_versions(spark: SparkSession, d: str) -> DataFrame:
    """Provision rows of all versions of a file, short ones left out, long ones cut."""
    p = table(spark, d, "legal_procedures")
    versions = F.array(F.struct(F.lit("proposal").alias("version"), F.col("title").alias("piece")), F.struct(F.lit("final").alias("version"), F.when(F.col("decision_date").isNotNull(), F.col("description")).alias("piece")))
    return p.select("id", F.explode(versions).alias("v")).select("id", "v.version", F.substring("v.piece", 1, 5000).alias("piece")).where(F.length("piece") >= 11).distinct()


@query("""SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS first_day FROM (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT') WHERE n = 1""")
def Z37_first_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date of the first row, in the order of the table, that is of a kind."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.date_format(F.min_by("o_orderdate", "o_orderkey"), "yyyy-MM-dd").alias("first_day"))


@query("""SELECT h.feedback_id, EXISTS (SELECT 1 FROM legal_procedures p WHERE p.id = h.procedure_id AND p.commission_document IS NOT NULL AND regexp_replace(p.commission_document, '\\)0+', ')') = regexp_replace(h.com_number, '\\)0+', ')')) AS verified FROM (SELECT DISTINCT feedback_id, procedure_id, com_number FROM hys_feedback_bronze) h WHERE regexp_matches(h.com_number, '^COM\\([0-9]{4}\\)[0-9]{1,4}$')""")
def Z38_initiatives_verified(spark: SparkSession, d: str) -> DataFrame:
    """Whether any writing of a COM number is among a file's publications."""
    p = table(spark, d, "legal_procedures").select(F.col("id").alias("procedure_id"), X.com_variants(F.col("commission_document")).alias("pubs"))
    h = table(spark, d, "hys_feedback_bronze").where(F.col("com_number").rlike(r"^COM\([0-9]{4}\)[0-9]{1,4}$")).select("feedback_id", "procedure_id", "com_number").distinct()
    both = h.join(p, "procedure_id", "left")
    hit = F.exists(X.com_variants(F.col("com_number")), lambda v: F.array_contains("pubs", v))
    return both.select("feedback_id", F.coalesce(hit, F.lit(False)).alias("verified"))


@query("""SELECT DISTINCT ref, kind FROM (SELECT unnest(transparency_register_ids) AS ref, 'id' AS kind FROM commission_meetings UNION ALL SELECT organization_name, 'name' FROM commission_meeting_organizations) WHERE ref IS NOT NULL""")
def Z42_reference_list(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "commission_meetings").select(F.explode("transparency_register_ids").alias("ref"), F.lit("id").alias("kind"))
    names = table(spark, d, "commission_meeting_organizations").select(F.col("organization_name").alias("ref"), F.lit("name").alias("kind"))
    return ids.unionByName(names).where("ref IS NOT NULL").distinct()


@query("""SELECT id, 'File: ' || id || chr(10) || 'Title: ' || coalesce(title, 'none') || chr(10) || 'Answer with one word.' AS prompt FROM legal_procedures""")
def Z43_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", F.format_string("File: %s\nTitle: %s\nAnswer with one word.", "id", F.coalesce("title", F.lit("none"))).alias("prompt"))


@query("""WITH p AS (SELECT l_suppkey AS org, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT o.s_suppkey AS org, CASE WHEN a >= r AND a > 0 THEN 'supports' ELSE 'other' END AS bucket FROM supplier o LEFT JOIN p ON p.org = o.s_suppkey""")
def Z46_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Each organisation's dominant label, in two buckets; those without one are 'other'."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("org")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("org")).join(p, "org", "left").select("org", F.when((F.col("a") >= F.col("r")) & (F.col("a") > 0), "supports").otherwise("other").alias("bucket"))


@query("""WITH RECURSIVE p AS (SELECT id, min(p) AS p FROM (SELECT id, list_filter(list_transform(string_split(organizations_raw, ','), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '') AS p FROM commission_meetings WHERE organizations_raw IS NOT NULL) WHERE len(p) > 0 GROUP BY 1), n AS (SELECT DISTINCT lower(name) AS n FROM organizations WHERE name IS NOT NULL),
 h AS (SELECT s.id, s.i, max(v.k) AS k FROM (SELECT id, p, unnest(range(len(p))) AS i FROM p) s JOIN (VALUES (1), (2), (3), (4)) v(k) ON s.i + v.k <= len(s.p) JOIN n ON n.n = lower(array_to_string(s.p[s.i + 1:s.i + v.k], ', ')) GROUP BY 1, 2),
 f AS (SELECT p.id, CAST(0 AS BIGINT) AS i, p.p FROM p UNION ALL SELECT f.id, f.i + coalesce(h.k, 1), f.p FROM f LEFT JOIN h ON h.id = f.id AND h.i = f.i WHERE f.i + coalesce(h.k, 1) < len(f.p))
 SELECT f.id, CAST(row_number() OVER (PARTITION BY f.id ORDER BY f.i) AS INTEGER) AS pos, array_to_string(f.p[f.i + 1:f.i + coalesce(h.k, 1)], ', ') AS value, h.k IS NOT NULL AS resolved FROM f LEFT JOIN h ON h.id = f.id AND h.i = f.i""")
def C19_recombined(spark: SparkSession, d: str) -> DataFrame:
    """Fields cut at commas and put together again where neighbouring parts are a known name."""
    return packed.recombined(table(spark, d, "commission_meetings"), "id", "organizations_raw", table(spark, d, "organizations"), "name")

"""The queries of this subpackage, by name, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import register_hints, unpacked
from ..session import table
from . import bpe, encoding, language, matching, mixing, names, scans, spans, splitting

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "hys_feedback_bronze"), "feedback_id", "feedback_text").select("feedback_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    feedback = table(spark, d, "hys_feedback_bronze")
    return splitting.split_oversized(feedback, "feedback_id", "feedback_text").distinct()


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """Meetings with the files they dealt with; the minutes are read without the traces of their pages."""
    meetings, register = table(spark, d, "commission_meetings"), table(spark, d, "legal_procedures")
    model = scans.train(scans.statistics(_minutes(spark, d).select("text"), "text"))
    index = matching.build_index(register, table(spark, d, "procedure_aliases"), meetings, "subject", "points_raised")
    narrow = meetings.select("id", "subject", "meeting_date", "points_raised")
    return matching.match(narrow, register, index, "id", "subject", "points_raised", "meeting_date", pages=model)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select(F.col("id").alias("meeting_id"), "procedure_id").distinct()


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).withColumnRenamed("id", "meeting_id")


def _decoded_texts(spark: SparkSession, d: str) -> DataFrame:
    feedback = table(spark, d, "hys_feedback_bronze").select(F.lit("hys_feedback_bronze").alias("source_table"), F.col("feedback_id").cast("string").alias("record_id"), F.col("feedback_text").alias("text"))
    names_ = table(spark, d, "commission_meeting_organizations").select(F.lit("commission_meeting_organizations").alias("source_table"), F.col("id").alias("record_id"), F.col("organization_name").alias("text"))
    return feedback.unionByName(names_)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _decoded_texts(spark, d)
    scores = encoding.pair_scores(encoding.pair_counts(rows, "text"))
    texts = rows.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return texts.where(encoding.is_garbled(texts, F.col("text"), scores)).select("source_table", "record_id").distinct()


def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    texts = _decoded_texts(spark, d)
    scores = encoding.pair_scores(encoding.pair_counts(texts, "text"))
    return encoding.passages(texts, ["source_table", "record_id"], "text", scores).distinct()


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    """(meeting_id, field, text) of both fields of the minutes; meetings scraped twice have the same texts."""
    meetings = table(spark, d, "commission_meetings")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("points_raised", "conclusions")])
    return meetings.select(F.col("id").alias("meeting_id"), F.explode(fields).alias("f")).select("meeting_id", "f.field", "f.text").where(F.length("text") > 0)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = scans.repaired(_minutes(spark, d), ["meeting_id", "field"], "text", texts=False)
    return found.where(F.col("broken") + F.col("misread") + F.col("split") + F.col("furniture") > 0).select("meeting_id", "field").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_minutes(spark, d), ["meeting_id", "field"], "text").distinct()


def _typed_names(spark: SparkSession, d: str) -> DataFrame:
    """Every typed name: source_table, record_id, pos, name, told (a register id that came with it)."""
    register = table(spark, d, "organizations")
    meetings = table(spark, d, "commission_meetings")
    packed = unpacked(meetings, "id", "organizations_raw", register_hints(register), "name")
    one = table(spark, d, "commission_meeting_organizations").select(F.lit("commission_meeting_organizations").alias("source_table"), F.col("id").alias("record_id"), F.lit(1).alias("pos"), F.col("organization_name").alias("name"), F.col("eu_transparency_register_id").alias("told"))
    two = table(spark, d, "hys_feedback_bronze").select(F.lit("hys_feedback_bronze").alias("source_table"), F.col("feedback_id").cast("string").alias("record_id"), F.lit(1).alias("pos"), F.col("organisation_name").alias("name"), F.col("transparency_reg_id").alias("told"))
    three = packed.select(F.lit("commission_meetings").alias("source_table"), F.col("id").alias("record_id"), "pos", "name", F.lit(None).cast("string").alias("told"))
    return one.unionByName(two).unionByName(three).where(F.col("name").isNotNull())


def _linked_names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(names written exactly as in the register with their bodies, other names with theirs)."""
    register = table(spark, d, "organizations")
    typed = _typed_names(spark, d)
    fields = [register.select("name")] + [table(spark, d, t).select(F.col(c).alias("name")) for t, c in (("commission_meeting_organizations", "organization_name"), ("hys_feedback_bronze", "organisation_name"), ("commission_meetings", "organizations_raw"))]
    corpus = fields[0].unionByName(fields[1]).unionByName(fields[2]).unionByName(fields[3])
    scores = encoding.pair_scores(encoding.pair_counts(corpus, "name"))
    written = register.where(F.col("name").isNotNull()).groupBy("name").agg(F.collect_set("id").alias("ids"))
    exact = typed.join(written, "name").withColumn("body", F.when(F.array_contains("ids", F.col("told")), F.col("told")).otherwise(F.when(F.size("ids") == 1, F.array_min("ids"))))
    restore = lambda df, name: F.when(name.rlike(r"[^\x00-\x7f]"), encoding.restored(df, name, scores)).otherwise(name)
    other = typed.join(written.select("name"), "name", "left_anti")
    return exact, names.link(other, ["source_table", "record_id", "pos"], "name", names.lexicon(register), "told", restore)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _linked_names(spark, d)[1].select("source_table", "record_id", "pos", F.col("body").alias("organization_id")).distinct()


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Every name with its body, form and score in bits; an exact name says as much as the register has names, less its namesakes."""
    exact, other = _linked_names(spark, d)
    total = table(spark, d, "organizations").where(F.col("name").isNotNull()).agg(F.count("*").cast("double").alias("n"))
    rows = exact.where(F.col("body").isNotNull()).groupBy("source_table", "record_id", "pos", "name").agg(F.min(F.struct(F.size("ids").alias("n"), "body")).alias("b"))
    sure = rows.select("source_table", "record_id", "pos", "name", "b.body", F.lit("exact").alias("form"), F.log2(F.lit(total.first()["n"]) / F.col("b.n")).alias("score"))
    return sure.unionByName(other.select(*sure.columns))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(table(spark, d, "hys_feedback_bronze"), "feedback_id", "feedback_text", "language")


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    feedback = table(spark, d, "hys_feedback_bronze")
    model = language.train(language.training_rows(feedback, "feedback_id", "feedback_text", "language"))
    return language.segments(feedback, "feedback_id", "feedback_text", model).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]


def p9_order(spark: SparkSession, d: str) -> DataFrame:
    """The mix as it is read: every copy with its epoch, block and place."""
    chosen = mixing.mix(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]
    return mixing.ordered(chosen.where("repeats > 0"))


def p9_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The mix that is as large as the documents of its sources, where the exponent has to give way to the limits."""
    sizes = mixing.sized(table(spark, d, "documents"))
    targets = table(spark, d, "mix_targets")
    total = sizes.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.mix(sizes, targets, total_tokens=float(total))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}


#: Every run of 300 characters of every document by its place (from 0) and two hashes.
_RUNS = """r AS (SELECT doc_id, i, hash(x) AS h, md5(x) AS m FROM (SELECT doc_id, i, substr(text, CAST(i + 1 AS BIGINT), 300) AS x FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS i FROM documents WHERE length(text) >= 300)))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT feedback_id FROM hys_feedback_bronze WHERE length(feedback_text) > 1500",
        "p10_found": f"""WITH {_RUNS}, d AS (SELECT DISTINCT doc_id, h, m FROM r) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.h = b.h AND a.m = b.m AND a.doc_id < b.doc_id""",
        "p10_shares": f"""WITH {_RUNS}, k AS (SELECT h, m FROM r GROUP BY h, m HAVING min(doc_id) < max(doc_id)), s AS (SELECT DISTINCT r.doc_id, r.i FROM r JOIN k ON k.h = r.h AND k.m = r.m), c AS (SELECT doc_id, CAST(sum(least(300, coalesce(lead_i - i, 300))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM s) GROUP BY 1),
 p AS (SELECT a.doc_id, count(DISTINCT md5(db.text)) AS n FROM (SELECT DISTINCT doc_id, h, m FROM r) a JOIN (SELECT DISTINCT doc_id, h, m FROM r) b ON a.h = b.h AND a.m = b.m AND a.doc_id <> b.doc_id JOIN documents da ON da.doc_id = a.doc_id JOIN documents db ON db.doc_id = b.doc_id WHERE da.text <> db.text GROUP BY 1), t AS (SELECT text, count(*) - 1 AS n FROM documents WHERE length(text) >= 300 GROUP BY 1)
 SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INTEGER) AS n_chars, coalesce(c.n, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN coalesce(c.n, 0) / length(d.text) ELSE 0.0 END AS share, coalesce(t.n, 0) AS n_copies, coalesce(p.n, 0) AS n_sharing_texts FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.text = d.text LEFT JOIN p ON p.doc_id = d.doc_id""",
    }

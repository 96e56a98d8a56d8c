"""Queries of sources and sinks, pages and documents: files are written from the driver's tables into the shared folder and
read back, pages are built from rows and parsed, so that SQL over the tables says what must come out."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import documents as P
from ..operators.joins import first_of
from ..session import shared_dir, table
from ..sources import connectors as C
from ..sources import office as O
from ..sources import pages as W
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _html(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "&", "&amp;"), "<", "&lt;")


_PLAIN = "regexp_replace(regexp_replace({c}, '[\\x{{200B}}]', '', 'g'), '[\\s\\x{{0B}}\\x{{85}}\\x{{1C}}-\\x{{1F}}\\p{{Z}}]+', ' ', 'g')"


# -- files --


@query("""SELECT id, title, substr(id, 1, 4) AS year FROM legal_procedures""")
def S01_json_asset(spark: SparkSession, d: str) -> DataFrame:
    """An asset of one file, read with its schema where the partition asked for is missing; an asset that isn't there is None."""
    base = _folder(spark, "assets")
    p = table(spark, d, "legal_procedures").select("id", "title", F.substring("id", 1, 4).alias("year"))
    p.coalesce(1).write.json(f"{base}/procedures/data.json")
    assert C.read_asset(spark, base, "none", p.schema) is None
    return C.read_asset(spark, base, "procedures", p.schema, "2024-07-16", lines=True)


@query("""SELECT event_id, event_type, strftime(date_trunc('month', ts), '%Y-%m') AS month FROM events""")
def S02_json_partitions_written(spark: SparkSession, d: str) -> DataFrame:
    """Partitioned writing: a second write of one partition replaces that one only."""
    base = _folder(spark, "assets")
    e = table(spark, d, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM").alias("month"))
    C.write_asset(e.withColumn("event_type", F.lit("old")), base, "events", "month")
    C.write_asset(e, base, "events", "month")
    return spark.read.schema("event_id long, event_type string, month string").json(f"{base}/events")


@query("""SELECT id, 'p' || CAST(length(id) % 3 AS VARCHAR) AS folder FROM (SELECT DISTINCT id FROM commission_meetings)""")
def S03_partition_scan(spark: SparkSession, d: str) -> DataFrame:
    """All partitions of an asset with their name, records that can't be read left out; each meeting once."""
    base = _folder(spark, "assets")
    m = table(spark, d, "commission_meetings").select("id", F.concat(F.lit("p"), (F.length("id") % 3).cast("string")).alias("folder"))
    m.write.partitionBy("folder").json(f"{base}/meetings")
    m.limit(0).union(m.sparkSession.createDataFrame([("{broken", "p9")], "id string, folder string")).select("id").write.mode("append").text(f"{base}/meetings/folder=p9")
    raw = spark.read.schema("id string, folder string").option("mode", "DROPMALFORMED").json(f"{base}/meetings")
    return raw.where("folder <> 'p9'").distinct()


@query("""SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1""")
def S04_statistics_scan(spark: SparkSession, d: str) -> DataFrame:
    base = _folder(spark, "assets")
    table(spark, d, "events").select("event_id", "event_type").write.partitionBy("event_type").json(f"{base}/events")
    return C.read_partitions(spark, base, "events", T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())]), lines=True).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def S05_equality_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan with equality filters and a projection; both reach the files."""
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_totalprice BETWEEN 1000 AND 90000 OR o_custkey % 7 = 0""")
def S06_filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderdate >= DATE '1995-01-01' AND o_totalprice BETWEEN 1000 AND 90000 OR o_custkey % 7 = 0").select("o_orderkey")


@query("""SELECT feedback_id, procedure_id FROM hys_feedback_bronze WHERE feedback_id > (SELECT min(feedback_id) FROM hys_feedback_bronze)""")
def S07_keyset_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows behind a cursor, in one scan instead of pages."""
    h = table(spark, d, "hys_feedback_bronze").select("feedback_id", "procedure_id")
    return h.where(F.col("feedback_id") > (h.agg(F.min("feedback_id")).first()[0] or 0))


@query("""SELECT feedback_id FROM hys_feedback_bronze WHERE procedure_id IN (SELECT id FROM legal_procedures WHERE policy_area = 'Energy')""")
def S08_id_list(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "legal_procedures").where("policy_area = 'Energy'").select(F.col("id").alias("procedure_id"))
    return table(spark, d, "hys_feedback_bronze").join(ids, "procedure_id", "left_semi").select("feedback_id")


@query("""SELECT DISTINCT c.id, m.commissioner_name AS host, strftime(m.meeting_date, '%Y-%m-%d') AS day FROM commission_meeting_organizations c JOIN commission_meetings m ON m.id = c.meeting_id""")
def S09_embedded_parent(spark: SparkSession, d: str) -> DataFrame:
    """Each link with the columns of its meeting embedded, and read from there."""
    m = table(spark, d, "commission_meetings").select(F.col("id").alias("meeting_id"), F.struct("commissioner_name", "meeting_date").alias("commission_meetings"))
    rows = table(spark, d, "commission_meeting_organizations").select("id", "meeting_id").join(m, "meeting_id")
    return rows.select("id", F.col("commission_meetings.commissioner_name").alias("host"), F.date_format("commission_meetings.meeting_date", "yyyy-MM-dd").alias("day")).distinct()


def _register_xml(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "register")
    o = table(spark, d, "organizations")
    goals = F.repeat(F.coalesce("interests_represented", F.lit("x")), 40)
    entry = o.select(
        F.col("id").alias("identificationCode"), F.struct(F.col("name").alias("originalName")).alias("name"), "acronym", F.col("organization_type").alias("registrationCategory"), F.col("website").alias("webSiteURL"), F.struct("country", "city").alias("headOffice"), goals.alias("goals"),
        F.struct(F.filter(F.array(F.col("level_of_interest"), F.lit("global")), lambda x: x.isNotNull()).alias("levelOfInterest")).alias("levelsOfInterest"), F.struct(F.array(F.lit("Trade"), F.lit("Energy")).alias("interest")).alias("interests"), F.struct(F.lit(3).alias("members10FTE")).alias("members"),
    )
    entry.write.format("xml").option("rootTag", "register").option("rowTag", "interestRepresentative").save(path)
    return path


@query(f"""SELECT id, {_PLAIN.format(c="trim(name)")} AS name, organization_type AS kind, country, coalesce(level_of_interest || '|', '') || 'global' AS levels, 'Trade|Energy' AS interests, 3 AS members FROM organizations WHERE NOT regexp_matches(coalesce(level_of_interest, ''), '^\\s|\\s$|\\s\\s')""")
def S10_xml_register(spark: SparkSession, d: str) -> DataFrame:
    """The register in XML: nested names and offices, levels and interests as lists, members."""
    r = C.read_register(spark, _register_xml(spark, d), goals_cut=500)
    r = r.where(~F.coalesce(F.element_at("levels", 1), F.lit("")).rlike(r"^\s|\s$|\s\s"))
    return r.select(F.col("eu_transparency_register_id").alias("id"), F.regexp_replace(F.trim("name"), r"(?U)\s+", " ").alias("name"), F.col("organization_type").alias("kind"), "country", F.array_join("levels", "|").alias("levels"), F.array_join("interests", "|").alias("interests"), "members")


@query("""SELECT doc_id, 'a' || CAST(doc_id AS VARCHAR) || '&#65;b' AS t FROM documents""")
def S11_legal_xml(spark: SparkSession, d: str) -> DataFrame:
    bad = F.concat(F.lit("a&#0;"), F.col("doc_id").cast("string"), F.lit("&#x1F;&#65;&#xFFFE;b&#11;"))
    return table(spark, d, "documents").select("doc_id", C.legal_xml(bad).alias("t"))


@query("""SELECT id, least(length(repeat(coalesce(interests_represented, 'x'), 40)), 500) AS n_goals FROM organizations WHERE NOT regexp_matches(coalesce(interests_represented, ''), '^\\s|\\s$')""")
def S12_register_dump(spark: SparkSession, d: str) -> DataFrame:
    """The compact dump: seven fields, goals cut at 500 characters, kept for a day (`connectors.fresh`)."""
    kept = C.read_register(spark, _register_xml(spark, d)).withColumn("read_at", F.current_timestamp())
    odd = table(spark, d, "organizations").where(F.col("interests_represented").rlike(r"^\s|\s$")).select(F.col("id").alias("eu_transparency_register_id"))
    return C.fresh(kept, "read_at", F.current_timestamp(), 1).join(odd, "eu_transparency_register_id", "left_anti").select(F.col("eu_transparency_register_id").alias("id"), F.length("goals").cast("long").alias("n_goals"))


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, 'Unknown') AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE 'Unknown' END AS grp FROM customer""")
def S13_member_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of members in XML; what is missing is 'Unknown'."""
    path = _folder(spark, "members")
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("fullName"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("politicalGroup"))
    rows.write.format("xml").option("rootTag", "meps").option("rowTag", "mep").save(path)
    m = C.read_members(spark, path)
    return m.select(F.col("id").cast("long").alias("id"), "name", F.col("political_group").alias("grp"))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").where("proposal_date IS NOT NULL")
    entry = F.concat(F.lit("<entry><id>"), "id", F.lit("</id><title>"), _html(F.col("title")), F.lit("</title><updated>"), F.date_format("proposal_date", "yyyy-MM-dd'T'00:00:00'Z'"), F.lit('</updated><category scheme="http://x/types/'), X.file_type(F.col("id")), F.lit('"/><link rel="self" href="s"/><link rel="alternate" href="u/'), "id", F.lit('"/></entry>'))
    feeds = p.groupBy(F.substring("id", 1, 4).alias("year")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("xml"))
    return feeds.select(F.explode(C.feed_entries(F.col("xml"))).alias("e")).select("e.*")


@query("""SELECT id, regexp_extract(id, '\\(([A-Z]+)\\)$', 1) AS type, strftime(proposal_date, '%Y-%m-%d') AS day, 'u/' || id AS link FROM legal_procedures WHERE proposal_date IS NOT NULL""")
def S14_atom_feed(spark: SparkSession, d: str) -> DataFrame:
    return _feed(spark, d).select("id", "type", F.date_format("updated", "yyyy-MM-dd").alias("day"), "link")


@query("""SELECT id FROM legal_procedures WHERE proposal_date BETWEEN DATE '2015-01-01' AND DATE '2018-12-31'""")
def S15_feed_window(spark: SparkSession, d: str) -> DataFrame:
    return C.in_window(_feed(spark, d), "updated", F.lit("2015-01-01").cast("timestamp"), F.lit("2018-12-31").cast("timestamp")).select("id")


@query("""SELECT replace(regexp_replace(id, '\\([A-Z]+\\)$', ''), '/', '-') AS process_id, min(id) AS id FROM legal_procedures GROUP BY 1""")
def S16_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a catalogue, type by type: they are read until one is short, and the first entry of each id wins."""
    p = table(spark, d, "legal_procedures").select("id", X.file_type(F.col("id")).alias("type"), X.process_id(F.col("id")).alias("process_id"))
    paged = C.catalogue(p.sparkSession, p, "type", "process_id", page=20)
    return first_of(paged, ["process_id"], [F.col("id")]).select("process_id", "id")


@query("""SELECT id, title FROM legal_procedures WHERE starts_with(id, '2019/')""")
def S17_catalogue_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").where(F.col("id").startswith("2019/")).select("id", "title")


@query("""SELECT id, strftime(proposal_date, '%Y-%m-%d') AS first_event, CAST(1 + CASE WHEN decision_date IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_events, 'Rapporteur' AS role, CASE WHEN decision_date IS NULL THEN 'ongoing' ELSE 'closed' END AS status FROM legal_procedures WHERE proposal_date IS NOT NULL""")
def S18_json_ld_details(spark: SparkSession, d: str) -> DataFrame:
    """Details of a file from linked JSON: events in the order of their dates, participations, status."""
    p = table(spark, d, "legal_procedures").where("proposal_date IS NOT NULL")
    event = lambda day, label: F.struct(F.date_format(day, "yyyy-MM-dd").alias("activity_date"), F.lit(label).alias("had_activity_type"))
    events = F.filter(F.array(F.when(F.col("decision_date").isNotNull(), event("decision_date", "def/ep-activities/DECISION")), event("proposal_date", "def/ep-activities/PROPOSAL")), lambda e: e.isNotNull())
    document = F.to_json(F.struct(F.array(F.struct("id", events.alias("consists_of"), F.array(F.struct(F.lit("person/77").alias("had_participant_person"), F.lit("def/ep-roles/RAPPORTEUR").alias("participation_role"))).alias("had_participation"), F.when(F.col("decision_date").isNull(), "def/status/ongoing").otherwise("def/status/closed").alias("status"))).alias("data")))
    found = C.linked_details(p.select(document.alias("j")), "j")
    return found.select("id", F.col("events")[0]["date"].alias("first_event"), F.size("events").alias("n_events"), F.initcap(F.col("participations")[0]["role"]).alias("role"), "status")


@query("""SELECT id, 'Alpha|Beta' AS a, id || '-x' AS b FROM legal_procedures""")
def S21_excel_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of workbooks under the row that has the header word; a cell of several lines becomes a list."""

    @F.pandas_udf("binary")
    def book(ids: pd.Series) -> pd.Series:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        cell = lambda ref, x: f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'
        out = []
        for i in ids:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{cell('A1', 'Export')}</row><row>{cell('A2', 'Name')}{cell('C2', 'Bodies')}</row><row>{cell('A3', i + '-x')}{cell('C3', 'Alpha&#10;Beta')}</row></sheetData></worksheet>")
            out.append(data.getvalue())
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<struct<name:string,bodies:array<string>>>")
    def rows(books: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in books:
            yield pd.Series([[(r["name"], r["bodies"]) for r in O.records(O.sheet_rows(x), "name", "bodies")] for x in b], dtype=object)

    p = table(spark, d, "legal_procedures").select("id", book("id").alias("data"))
    return p.select("id", F.explode(rows("data")).alias("r")).select("id", F.array_join("r.bodies", "|").alias("a"), F.col("r.name").alias("b"))


@query("""SELECT id || '.txt' AS file, length(title) AS n FROM (SELECT replace(replace(replace(id, '/', '-'), '(', '-'), ')', '') AS id, title FROM legal_procedures) WHERE title IS NOT NULL""")
def S22_document_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of binary documents by a pluggable extractor; here the documents are plain text, one file each."""
    path = _folder(spark, "documents")
    p = table(spark, d, "legal_procedures").where("title IS NOT NULL").select(F.translate("id", "/(", "--").alias("id"), "title")
    p.select(F.regexp_replace("id", r"\)", "").alias("id"), F.col("title").alias("value")).write.partitionBy("id").text(path)
    got = C.documents_text(spark, f"{path}/*/*.txt", lambda b: b.decode().rstrip("\n"))
    return got.select(F.concat(F.regexp_extract("path", r"id=([^/]+)/", 1), F.lit(".txt")).alias("file"), F.length("text").cast("long").alias("n"))


@query("""SELECT id, title AS original, 'New ' || title AS amended FROM legal_procedures WHERE title IS NOT NULL""")
def S23_docx_amendments(spark: SparkSession, d: str) -> DataFrame:
    """Two-column tables of word-processor files as pairs of texts."""

    @F.pandas_udf("binary")
    def document(titles: pd.Series) -> pd.Series:
        from xml.sax.saxutils import escape

        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p></w:tc>"
        out = []
        for t in titles:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:tbl><w:tr>{cell('Text proposed')}{cell('Amendment')}</w:tr><w:tr>{cell(t)}{cell('New ' + t)}</w:tr></w:tbl></w:body></w:document>")
            out.append(data.getvalue())
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<struct<original:string,amended:string>>")
    def pairs(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in files:
            yield pd.Series([O.two_columns(O.docx_tables(x)) for x in b], dtype=object)

    p = table(spark, d, "legal_procedures").where("title IS NOT NULL").select("id", document("title").alias("data"))
    return p.select("id", F.explode(pairs("data")).alias("r")).select("id", "r.*")


@query("""SELECT DISTINCT substr(sha256(minutes_url), 1, 16) AS key, substr(sha256(minutes_url), 1, 2) AS shard FROM commission_meetings WHERE minutes_url IS NOT NULL AND updated_at >= (SELECT max(updated_at) - INTERVAL 400 DAY FROM commission_meetings)""")
def S24_document_cache(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of documents that are not older than so many days."""
    m = table(spark, d, "commission_meetings").where("minutes_url IS NOT NULL")
    now = table(spark, d, "commission_meetings").agg(F.max("updated_at").alias("now")).first()["now"]
    kept = C.fresh(m, "updated_at", F.lit(now).cast("timestamp_ntz"), 400)
    return kept.select(C.cache_key(F.col("minutes_url")).alias("key")).distinct().withColumn("shard", F.substring("key", 1, 2))


@query("""SELECT l_suppkey AS org, l_partkey AS provision, max(l_discount) AS similarity FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2""")
def S25_csv_harmonised(spark: SparkSession, d: str) -> DataFrame:
    """Results in CSV under other column names, read by a schema, renamed, and cut to one kind of row; the latest file counts (S26)."""
    folder = _folder(spark, "results")
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "other").otherwise("hys_feedback").alias("source_type")).agg(F.max("l_discount").alias("similarity"))
    out = li.select(F.col("l_suppkey").alias("org"), F.col("l_partkey").alias("preproposal_provision"), "similarity", "source_type")
    out.limit(1).write.option("header", True).csv(f"{folder}/x_2024-01-01_dyads.csv")
    out.write.option("header", True).csv(f"{folder}/x_2024-02-01_dyads.csv")
    got = C.read_results(spark, folder, "x", out.schema, {"preproposal_provision": "provision"})
    return got.where("source_type IS NULL OR source_type = 'hys_feedback'").drop("source_type")


@query("""SELECT 'x_' || strftime(max(o_orderdate), '%Y') || '_dyads.csv' AS latest, count(*) AS n FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)""")
def S26_latest_file(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "results")
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    years = sorted(r["y"] for r in o.select("y").distinct().collect())  # a handful
    for y in years:
        o.where(F.col("y") == y).select("o_orderkey").write.option("header", True).csv(f"{folder}/x_{y}_dyads.csv")
    got = C.read_results(spark, folder, "x", T.StructType([T.StructField("o_orderkey", T.LongType())]), {})
    return got.select(F.regexp_extract(F.input_file_name(), r"(x_[0-9]+_dyads\.csv)", 1).alias("latest")).groupBy("latest").agg(F.count("*").alias("n"))


@query("""SELECT vec_id, substr(sha256('e5|' || CAST(vec_id AS VARCHAR)), 1, 16) AS key, CASE WHEN vec_id % 2 = 0 THEN 'cached' ELSE 'new' END AS origin FROM embeddings""")
def S27_embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors looked up by the hash of model and text; the others have to be computed."""
    e = table(spark, d, "embeddings").select("vec_id", F.substring(F.sha2(F.concat(F.lit("e5|"), F.col("vec_id").cast("string")), 256), 1, 16).alias("key"))
    cache = e.where("vec_id % 2 = 0").select("key", F.lit("cached").alias("origin"))
    return e.join(cache, "key", "left").select("vec_id", "key", F.coalesce("origin", F.lit("new")).alias("origin"))


@query("""SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def S30_appended(spark: SparkSession, d: str) -> DataFrame:
    """Plain inserts: what is appended is there as often as it was appended."""
    path = _folder(spark, "inserts")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    o.drop("o_orderstatus").write.parquet(path)
    o.where("o_orderstatus = 'F'").drop("o_orderstatus").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("""SELECT id, title, subjects[1] AS first_subject FROM legal_procedures""")
def S33_exports(spark: SparkSession, d: str) -> DataFrame:
    """Results exported as JSON and CSV, read back together."""
    path = _folder(spark, "exports")
    p = table(spark, d, "legal_procedures")
    p.select("id", "subjects").write.json(f"{path}/json")
    p.select("id", "title").write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    titles = spark.read.schema("id string, title string").option("header", True).option("escape", '"').csv(f"{path}/csv")
    return titles.join(spark.read.schema("id string, subjects array<string>").json(f"{path}/json"), "id").select("id", "title", F.try_element_at("subjects", F.lit(1)).alias("first_subject"))


# -- pages --

_ASCII = "NOT regexp_matches(coalesce({c}, ''), '[^\\x21-\\x7e ]|^ | $|  ')"
_ascii = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"[^\x21-\x7e ]|^ | $|  ")


@query(f"""SELECT DISTINCT id, commissioner_name AS member, strftime(meeting_date, '%Y-%m-%d') AS day, nullif(location, '') AS location, 'Foo & Co|Bar' AS attendees, '123456789012-34' AS register_id FROM commission_meetings WHERE {_ASCII.format(c="location")} AND {_ASCII.format(c="commissioner_name")}""")
def S19_meeting_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a page of meetings."""
    m = table(spark, d, "commission_meetings").where(_ascii("location") & _ascii("commissioner_name"))
    span = lambda kind, x: F.concat(F.lit(f'<span class="es_document-subtitle-{kind}"> '), _html(x), F.lit("</span>"))
    day = F.when(F.col("meeting_date").isNotNull(), F.concat(F.lit('<time datetime="'), F.date_format("meeting_date", "yyyy-MM-dd"), F.lit('">x</time>'))).otherwise("")
    author = '<span class="es_document-subtitle-author"><a href="https://transparency-register.europa.eu/x?id=123456789012-34">Foo &amp; Co</a></span><span class="es_document-subtitle-author">Bar</span>'
    page = F.concat(F.lit('<div class="es_document"><h3 class="es_document-title"><span class="t-item">T</span></h3>'), span("member", F.col("commissioner_name")), day, span("location", F.col("location")), F.lit(author + "</div>"), F.lit('<div class="es_document"><h3>nobody</h3></div>'))
    return W.read_pages(m.select("id", page.alias("page")), "id", "page", W.meeting_cards, W.MEETING_CARD).select("id", "member", F.col("meeting_date").alias("day"), "location", "attendees", "register_id").distinct()


def _procedure_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").where("title IS NOT NULL")
    events = F.concat(*[F.when(F.col(c).isNotNull(), F.concat(F.lit("<tr><td>"), F.date_format(c, "dd/MM/yyyy"), F.lit(f"</td><td>{label}</td><td>"), F.when(F.col("commission_document").isNotNull(), F.concat(F.lit('<a href="/doc">'), "commission_document", F.lit("</a>"))).otherwise(""), F.lit('</td><td><a href="/document-summary?id=9">s</a></td></tr>'))).otherwise("") for c, label in (("proposal_date", "Legislative proposal published"), ("decision_date", "Final act signed"))])
    actors = F.concat(F.lit('<div><span class="t-x">European Parliament</span><table class="table"><thead><tr><th>Committee responsible</th><th>Rapporteur</th></tr></thead><tbody><tr><th><span class="es_badge-committee">'), F.coalesce("responsible_committee", F.lit("")), F.lit('</span><a href="/c">'), F.coalesce("responsible_committee", F.lit("")), F.lit('</a></th><td><a href="/meps/en/77/x">DOE Jane</a></td></tr></tbody></table></div><h2>European Commission</h2><table><thead><tr><th>Commission DG</th><th>Commissioner</th></tr></thead><tbody><tr><td>'), F.coalesce("commission_dg", F.lit("")), F.lit("</td><td>Roe</td></tr></tbody></table>"))
    subjects = F.array_join(F.transform("subjects", lambda x, i: F.concat(F.lit("3.1"), i.cast("string"), F.lit(" "), x)), "<br>")
    page = F.concat(F.lit("<h1>"), _html(F.col("title")), F.lit('</h1><p class="font-weight-bold mb-1">Status</p><p>'), _html(F.col("stage")), F.lit('</p><p class="font-weight-bold mb-1">Subject</p><p>'), F.coalesce(subjects, F.lit("")), F.lit('</p><table><tr><th scope="row">Legal basis</th><td><span class="d-block">TFEU 114</span><span class="d-block">TFEU 16</span></td></tr></table>'), actors, F.lit('<div id="section3"><table class="table"><tbody>'), events, F.lit("</tbody></table></div>"))
    return p.select("id", page.alias("page"))


@query(f"""SELECT id, trim({_PLAIN.format(c="title")}) AS title, nullif(trim(stage), '') AS status, nullif(regexp_extract(CASE WHEN proposal_date IS NOT NULL OR decision_date IS NOT NULL THEN commission_document END, 'COM\\([0-9]{{4}}\\)[0-9]{{4}}'), '') AS document,
 CAST(coalesce(len(subjects), 0) AS INTEGER) AS n_subjects, 'TFEU 114|TFEU 16' AS basis FROM legal_procedures WHERE title IS NOT NULL""")
def S20_procedure_pages(spark: SparkSession, d: str) -> DataFrame:
    """Heads of procedure pages: title, status, document, subjects with their codes, legal basis (Z35)."""
    got = W.read_pages(_procedure_pages(spark, d), "id", "page", W.procedure, W.PROCEDURE)
    return got.select("id", "title", "status", F.col("commission_document").alias("document"), F.size("subjects").alias("n_subjects"), F.array_join("legal_basis", "|").alias("basis"))


@query("""SELECT id, 'committee' AS kind, 'committee_responsible' AS role, responsible_committee AS code, responsible_committee AS name, NULL AS actor FROM legal_procedures WHERE title IS NOT NULL AND responsible_committee IS NOT NULL UNION ALL SELECT id, 'member', 'rapporteur', responsible_committee, 'DOE Jane', '77' FROM legal_procedures WHERE title IS NOT NULL UNION ALL SELECT id, 'department', 'dg', NULL, coalesce(commission_dg, ''), 'Roe' FROM legal_procedures WHERE title IS NOT NULL""")
def Z34_procedure_actors(spark: SparkSession, d: str) -> DataFrame:
    got = W.read_pages(_procedure_pages(spark, d), "id", "page", W.procedure_actors, W.ACTOR)
    return got.select("id", "kind", "role", "code", "name", F.col("actor_id").alias("actor"))


@query("""SELECT id, strftime(d, '%Y-%m-%d') AS day, what, document, '9' AS summary FROM (SELECT id, proposal_date AS d, 'Legislative proposal published' AS what, commission_document AS document FROM legal_procedures WHERE title IS NOT NULL UNION ALL SELECT id, decision_date, 'Final act signed', commission_document FROM legal_procedures WHERE title IS NOT NULL) WHERE d IS NOT NULL""")
def Z36_procedure_events(spark: SparkSession, d: str) -> DataFrame:
    got = W.read_pages(_procedure_pages(spark, d), "id", "page", W.procedure_events, W.EVENT)
    return got.select("id", F.col("event_date").alias("day"), F.col("event").alias("what"), F.try_element_at("documents", F.lit(1))["id"].alias("document"), F.col("summary_id").alias("summary"))


@query("""SELECT id, CAST(coalesce(len(list_filter(subjects, lambda x: x IS NOT NULL)), 0) AS INTEGER) AS n, '3.10 ' || subjects[1] AS first FROM legal_procedures WHERE title IS NOT NULL""")
def Z35_subject_codes(spark: SparkSession, d: str) -> DataFrame:
    """Subjects are the lines that begin with a code."""
    got = W.read_pages(_procedure_pages(spark, d), "id", "page", W.procedure, W.PROCEDURE)
    return got.select("id", F.size("subjects").alias("n"), F.try_element_at("subjects", F.lit(1)).alias("first"))


@query(f"""SELECT DISTINCT id, strftime(meeting_date, '%Y-%m-%d') AS day, coalesce(location, '') AS place, 'Foo' || chr(10) || 'Bar' AS bodies, CASE WHEN length(id) + ascii(id) > 0 AND ascii(id) % 2 = 0 THEN 60 ELSE 81 END AS n, CASE WHEN ascii(id) % 2 = 0 THEN 'Ann, Bob' END AS host FROM commission_meetings WHERE {_ASCII.format(c="location")}""")
def Z08_meeting_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of meetings with two layouts and two pagers."""
    m = table(spark, d, "commission_meetings").where(_ascii("location"))
    cells = F.concat(F.lit("<td>"), F.coalesce(F.date_format("meeting_date", "dd/MM/yyyy"), F.lit("")), F.lit("</td><td>"), _html(F.col("location")), F.lit("</td><td><ul><li>Foo</li><li>Bar</li></ul></td><td>S</td>"))
    new = F.concat(F.lit("<p>Page 2 of 3</p><table><tr><th>Commission\n Representative(s)</th></tr><tr><td>Ann<br>Bob</td>"), cells, F.lit("</tr></table>"))
    old = F.concat(F.lit("<span>1-10 of 81</span><table><tr>"), cells, F.lit("</tr></table>"))
    got = W.read_pages(m.select("id", F.when(F.ascii("id") % 2 == 0, new).otherwise(old).alias("page")), "id", "page", W.meeting_rows, W.MEETING_ROW)
    return got.select("id", F.col("meeting_date").alias("day"), F.col("location").alias("place"), F.col("organizations").alias("bodies"), F.col("rows_in_all").alias("n"), F.col("cabinet_member").alias("host")).distinct()


@query(f"""SELECT DISTINCT host_id, commissioner_name AS name, kind FROM commission_meetings, (VALUES ('commissioner'), ('cabinet')) k(kind) WHERE regexp_matches(host_id, '^[a-f0-9-]+$') AND commissioner_name IS NOT NULL AND {_ASCII.format(c="commissioner_name")}""")
def Z09_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that listings link to."""
    m = table(spark, d, "commission_meetings").where(F.col("host_id").rlike("^[a-f0-9-]+$") & F.col("commissioner_name").isNotNull() & _ascii("commissioner_name")).select("host_id", "commissioner_name").distinct()
    link = lambda kind, said: F.concat(F.lit(f'<a href="/meeting/{kind}?id='), "host_id", F.lit('" title="'), F.format_string(said, "commissioner_name"), F.lit('">x</a>'))
    page = F.concat(link("commissioner", "Information on meetings held by Commissioner %s."), link("cabinet", "Meetings held by members of %s's cabinet"), F.lit('<a href="/">no</a>'))
    got = W.read_pages(m.select(F.struct("host_id", "commissioner_name").alias("id"), page.alias("page")), "id", "page", W.hosts, W.HOST)
    return got.select("host_id", "name", F.col("meeting_type").alias("kind")).distinct()


@query("""SELECT c_custkey AS id, 'Declarations' AS section, 'document' AS kind, 'Declaration ' || c_name AS label, '/d/' || CAST(c_custkey AS VARCHAR) || '.pdf' AS value FROM customer UNION ALL SELECT c_custkey, 'Contacts', 'phone', c_mktsegment, c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 'Education', 'entry', '1990', c_name FROM customer UNION ALL SELECT c_custkey, 'profile', 'birth_date', NULL, '1970-01-02' FROM customer""")
def Z41_member_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    page = F.concat(F.lit('<time class="sln-birth-date" datetime="1970-01-02">2</time><h4>Education</h4><ul><li><strong>1990</strong>: '), "c_name", F.lit('</li></ul><h3>Contacts</h3><a href="tel:'), "c_mktsegment", F.lit('">'), "c_mktsegment", F.lit('</a><h4>Declarations</h4><a href="/d/'), F.col("c_custkey").cast("string"), F.lit('.pdf">Declaration '), "c_name", F.lit("</a>"))
    return W.read_pages(c.select(F.col("c_custkey").alias("id"), page.alias("page")), "id", "page", W.profile, W.PROFILE).drop("pos")


@query("""SELECT s_suppkey AS id, 'Team' AS section, 'entry' AS kind, 'Head' AS label, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'Contact', 'mail', 'Write', 'a' || CAST(s_suppkey AS VARCHAR) || '@x' FROM supplier UNION ALL SELECT s_suppkey, 'Speeches', 'link', 'Speech', '/s/' || CAST(s_suppkey AS VARCHAR) FROM supplier""")
def Z40_commissioner_profiles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    page = F.concat(F.lit("<h2>Team</h2><ul><li><b>Head</b> "), "s_name", F.lit('</li></ul><h2>Contact</h2><a href="mailto:a'), k, F.lit('@x">Write</a><h2>Speeches</h2><a href="/s/'), k, F.lit('">Speech</a>'))
    return W.read_pages(s.select(F.col("s_suppkey").alias("id"), page.alias("page")), "id", "page", W.profile, W.PROFILE).drop("pos")


@query("""SELECT doc_id, '/doc/' || CAST(doc_id AS VARCHAR) AS href, 'Doc ' || coalesce(lang, '?') AS label FROM documents""")
def Z13_page_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    page = F.concat(F.lit('<p><a href="/doc/'), F.col("doc_id").cast("string"), F.lit('">Doc <i>'), F.coalesce("lang", F.lit("?")), F.lit("</i></a></p>"))
    return C.pages_parsed(docs.select("doc_id", page.alias("page")), "doc_id", "page", P.html_links, "href:string,label:string").drop("pos")


# -- documents --


@query("""SELECT id, kind, number, context, text FROM (SELECT id, 'recital' AS kind, '1' AS number, '' AS context, 'Whereas ' || id AS text FROM legal_procedures UNION ALL SELECT id, 'article', '1', 'Chapter I', 'Scope' || chr(10) || 'It applies to ' || id FROM legal_procedures UNION ALL SELECT id, 'annex', 'I', '', 'List' FROM legal_procedures)""")
def DP07_html_structure(spark: SparkSession, d: str) -> DataFrame:
    """Recitals, articles with their chapter and annexes of a web page; deleted mark-up is gone."""
    p = table(spark, d, "legal_procedures")
    page = F.concat(F.lit("<p>(1) Whereas "), "id", F.lit("</p><h2>CHAPTER I</h2><p>Article 1 Scope</p><p>It <del>never</del> applies to "), "id", F.lit("</p><p>ANNEX I</p><p>List</p>"))
    return C.pages_parsed(p.select("id", page.alias("page")), "id", "page", P.html_structure, "kind:string,number:string,context:string,text:string").drop("pos")


@query("""SELECT doc_id, 'x' || chr(10) || 'a & b ' || CAST(doc_id AS VARCHAR) AS t FROM documents""")
def DP09_html_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    page = F.concat(F.lit("<p>x</p><script>no</script><div>a&nbsp;&amp; b "), F.col("doc_id").cast("string"), F.lit("<s>gone</s></div>"))

    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        return batch.map(P.html_text)

    return docs.select("doc_id", text(page).alias("t"))


@query("""SELECT id, 'Old ' || id AS original, 'New ' || id AS amended FROM legal_procedures""")
def DP10_html_amendments(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures")
    page = F.concat(F.lit("<table><tr><td>Text proposed</td><td>Amendment</td></tr><tr><td>Old "), "id", F.lit("</td><td>New "), "id", F.lit("</td></tr></table>"))
    return C.pages_parsed(p.select("id", page.alias("page")), "id", "page", P.html_amendments, "original:string,amended:string").drop("pos")


@query("""SELECT id, kind, number, piece FROM (SELECT id, 'article' AS kind, '1' AS number, 'Scope of ' || id AS piece FROM legal_procedures UNION ALL SELECT id, 'article', '2', 'Other' FROM legal_procedures UNION ALL SELECT id, 'annex', 'I', 'List' FROM legal_procedures)""")
def DP03_structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pieces by provision, annexes last."""
    p = table(spark, d, "legal_procedures")
    text = F.concat(F.lit("ANNEX I\nList\nArticle 1\nScope of "), "id", F.lit("\nArticle 2\nOther"))
    return C.pages_parsed(p.select("id", text.alias("page")), "id", "page", P.structural_chunks, "kind:string,number:string,piece:string").drop("pos")


@query("""SELECT id, CAST(12 AS INTEGER) AS number, 'Jane Doe, John Roe' AS authors, 'Article 3' AS target, title AS body FROM (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM legal_procedures WHERE title IS NOT NULL AND NOT contains(title, 'Justification'))""")
def DP13_amendment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Amendments of layout text as rows."""
    p = table(spark, d, "legal_procedures").where("title IS NOT NULL AND NOT contains(title, 'Justification')")
    text = F.concat(F.lit("Intro\nAmendment 12\nJane Doe, John Roe\n\nArticle 3\n"), F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("\nJustification\nBecause."))
    return P.amendment_rows(p.select("id", text.alias("t")), "id", "t").select("id", "number", "authors", "target", "body")


@query("""WITH RECURSIVE r AS (SELECT doc_id, i, length(x) AS s FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL))),
 f AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS bundle, s AS held FROM r WHERE i = 1 UNION ALL SELECT r.doc_id, r.i, CASE WHEN f.held > 0 AND (f.held + r.s > 1500 OR f.held >= 1125) THEN f.bundle + 1 ELSE f.bundle END, CASE WHEN f.held > 0 AND (f.held + r.s > 1500 OR f.held >= 1125) THEN r.s ELSE f.held + r.s END FROM f JOIN r ON r.doc_id = f.doc_id AND r.i = f.i + 1)
 SELECT doc_id, bundle, count(*) AS n_sections, CAST(sum(s) AS BIGINT) AS n_chars FROM f JOIN r USING (doc_id, i) GROUP BY 1, 2""")
def DP05_section_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Sections bundled to chunks: a chunk closes at three quarters of its size, or when the next section doesn't fit."""
    from ..operators.windows import bundled

    docs = table(spark, d, "documents").where("text IS NOT NULL")
    sections = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "x")).select("doc_id", F.col("i").cast("long").alias("i"), F.length("x").alias("s"))
    placed = bundled(sections, "doc_id", "i", "s", 1500).join(sections, ["doc_id", "i"])
    return placed.groupBy("doc_id", "bundle").agg(F.count("*").alias("n_sections"), F.sum("s").alias("n_chars"))


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(x, '^([0-9]+(?:\\.[0-9]+)*)\\.? +([A-Z].*)$', 1) AS number, CAST(len(string_split(regexp_extract(x, '^([0-9]+(?:\\.[0-9]+)*)\\.? +([A-Z].*)$', 1), '.')) AS INTEGER) AS level, regexp_extract(x, '^([0-9]+(?:\\.[0-9]+)*)\\.? +([A-Z].*)$', 2) AS title
 FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM (SELECT doc_id, string_split(text || chr(10) || '1.2. Scope ' || CAST(doc_id AS VARCHAR), chr(10)) AS p FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(x, '^([0-9]+(?:\\.[0-9]+)*)\\.? +([A-Z].*)$')""")
def DP08_contents(spark: SparkSession, d: str) -> DataFrame:
    """Numbered headings of working documents."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n1.2. Scope "), F.col("doc_id").cast("string")).alias("t"))
    return P.contents(docs, "doc_id", "t")


@query("""SELECT id, CAST(1 AS INTEGER) AS sort_order, 'article' AS kind, '1' AS number, substr('Scope of ' || id || chr(10) || repeat('word ', 30) || 'end.', 1, 60) AS text FROM legal_procedures""")
def DP12_provision_rows(spark: SparkSession, d: str) -> DataFrame:
    """Provisions of a text as rows: short ones are left out, long ones cut."""
    text = F.concat(F.lit("Short\nArticle 1 Scope of "), "id", F.lit("\n"), F.repeat(F.lit("word "), 30), F.lit("end.\nArticle 2\nToo short"))
    rows = P.provisions(table(spark, d, "legal_procedures").select("id", text.alias("t")), "id", "t", least=11, most=60)
    return rows.select("id", "sort_order", "kind", "number", "text")

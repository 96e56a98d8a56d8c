"""Queries of field functions over the driver's tables: cleaners, keys, identifiers, targets, nested records, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import records as R
from ..functions import stats as S
from ..functions import text as X
from ..operators import merge as M
from ..session import table
from .registry import query

#: Unicode's word characters and white space as regular expressions of SQL engines write them.
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x{0B}\x{85}\p{Z}"
_LEGAL = X.LEGAL_FORMS.replace("'", "''")
_BARE = f"regexp_replace(regexp_replace(trim(lower(coalesce({{c}}, ''))), '{_LEGAL}', '', 'g'), '\\s*\\(.*?\\)\\s*', ' ', 'g')"
_STRICT = f"regexp_replace(regexp_replace({_BARE}, '[^{_WORD}{_SPACE}]', '', 'g'), '[{_SPACE}]+', '', 'g')"
_LIGHT = f"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce({{c}}, ''))), '{_LEGAL}', '', 'g'), '[^{_WORD}{_SPACE}]', ' ', 'g'), '[{_SPACE}]+', ' ', 'g'))"
_FUZZY = f"trim(regexp_replace(regexp_replace({_BARE}, '[^{_WORD}{_SPACE}]', ' ', 'g'), '[{_SPACE}]+', ' ', 'g'))"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commission_meeting_organizations").where(F.col("organization_name").isNotNull()).select(F.col("organization_name").alias("name")).distinct()


_TYPED = "(SELECT DISTINCT organization_name AS name FROM commission_meeting_organizations WHERE organization_name IS NOT NULL)"


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents""")
def C02_without_controls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.without_controls(F.col("text")).alias("t"))


@query(f"SELECT name, {_STRICT.replace('{c}', 'name')} AS k FROM {_TYPED}")
def C03_strict_keys(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("name", X.name_key(F.col("name")).alias("k"))


@query(f"SELECT name, {_LIGHT.replace('{c}', 'name')} AS k FROM {_TYPED}")
def C04_display_keys(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("name", X.display_key(F.col("name")).alias("k"))


@query(f"SELECT name, {_FUZZY.replace('{c}', 'name')} AS k FROM {_TYPED}")
def C05_fuzzy_keys(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("name", X.fuzzy_key(F.col("name")).alias("k"))


@query(f"SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '(?i)\\b({X.SILVER_FORMS})\\b', '', 'g'), '[^{_WORD}{_SPACE}]', ' ', 'g'), '[{_SPACE}]+', ' ', 'g')) AS k FROM (SELECT name FROM organizations) WHERE NOT regexp_matches(name, '[^\\x00-\\x7f]')")
def C06_silver_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key with word boundaries; compared on names of ASCII, as engines differ on where words beyond it end."""
    return table(spark, d, "organizations").where(~F.col("name").rlike(r"[^\x00-\x7f]")).select("name", X.silver_key(F.col("name")).alias("k"))


@query(r"""WITH p AS (SELECT name, trim(split_part(name, '|', 1)) AS a FROM """ + _TYPED + r"""), q AS (SELECT name, regexp_extract(a, '(?s)^(.*?)(?:\s*(?:,\s*)?(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|M\.\s|Mme\.?\s)\s.*)?$', 1) AS b FROM p)
 SELECT name, regexp_replace(regexp_replace(b, '\s*,\s*[A-Z][a-z]+\s+[A-Z][a-z]+(?:,.*)?$', ''), '[, ]+$', '') AS k FROM q""")
def C08_clean_names(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("name", X.clean_name(F.col("name")).alias("k"))


@query(f"""WITH v AS (SELECT id, [trim(name), trim(regexp_replace(name, '{X.PLACES}', '', 'g')), trim(regexp_replace(name, '\\s*\\([^)]*\\)', '', 'g'))] AS v FROM organizations)
 SELECT id, array_to_string(list_filter(v, lambda x, i: x <> '' AND list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), '|') AS variants FROM v""")
def C09_search_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "organizations").select("id", F.array_join(X.search_variants(F.col("name")), "|").alias("variants"))


@query("""SELECT id, nullif(regexp_extract('Foo (' || coalesce(eu_transparency_register_id, 'none') || ') Bar', '([0-9]{10,}-[0-9]{2})', 1), '') AS inside, nullif(regexp_extract('https://x/y?a=1&id=' || coalesce(eu_transparency_register_id, '') || '&z', '[?&]id=([^&]*)', 1), '') AS linked FROM organizations""")
def C12_register_ids(spark: SparkSession, d: str) -> DataFrame:
    """Register ids out of a text and out of a link."""
    o, r = table(spark, d, "organizations"), F.col("eu_transparency_register_id")
    text, link = F.concat(F.lit("Foo ("), F.coalesce(r, F.lit("none")), F.lit(") Bar")), F.concat(F.lit("https://x/y?a=1&id="), F.coalesce(r, F.lit("")), F.lit("&z"))
    return o.select("id", X.register_id(text).alias("inside"), F.nullif(F.parse_url(link, F.lit("QUERY"), F.lit("id")), F.lit("")).alias("linked"))


_AT_ONLINE = "regexp_matches(s, '" + "|".join(X.ONLINE_WORDS) + "')"
_AT_BRUSSELS = "regexp_matches(s, '" + "|".join(X.BRUSSELS_WORDS) + "')"


@query(f"""SELECT DISTINCT location, CASE WHEN location IS NULL OR location = '' THEN location WHEN {_AT_BRUSSELS} AND {_AT_ONLINE} THEN 'Brussels (Online)' WHEN {_AT_BRUSSELS} THEN 'Brussels' WHEN {_AT_ONLINE} AND NOT regexp_matches(split_part(trim(location), ',', 1), '\\p{{Lu}}') THEN 'Online'
 WHEN s IN ({", ".join(f"'{x}'" for x in X.ONLINE_PLACES)}) THEN 'Online' WHEN c = 'Tokio' THEN 'Tokyo' WHEN c = 'NY' THEN 'New York' WHEN c = 'Brussles' THEN 'Brussels' ELSE c END AS place
 FROM (SELECT location, lower(trim(location)) AS s, regexp_replace(trim(regexp_replace(trim(location), '(?i),\\s*({"|".join(X.COUNTRIES)})\\s*$', '')), '\\.+$', '') AS c FROM commission_meetings)""")
def C15_locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commission_meetings").select("location", X.location(F.col("location")).alias("place")).distinct()


@query("""WITH g AS (SELECT c_custkey AS k, ['AlphaCo', 'BetaGmbH', 'AlphaCoUnion'] AS n FROM customer) SELECT k, 'AlphaCoUnion|x' || CAST(k AS VARCHAR) || '|BetaGmbH|AlphaCo' AS parts FROM g""")
def C17_glued_names(spark: SparkSession, d: str) -> DataFrame:
    """Names written without separators, cut at known ones, the longest first."""
    from ..operators.documents import glued_names

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("AlphaCoUnionx"), F.col("c_custkey").cast("string"), F.lit("BetaGmbHAlphaCo")).alias("raw"))
    return c.select("k", F.array_join(glued_names(F.col("raw"), ["AlphaCo", "BetaGmbH", "AlphaCoUnion"]), "|").alias("parts"))


@query("""SELECT DISTINCT commissioner_name AS name, regexp_replace(commissioner_name, '^(.*) ([^ ]+)$', '\\1 \\2') || ' (X)' AS flipped FROM commission_meetings WHERE regexp_matches(commissioner_name, '^[A-Z][a-z]+ [A-Z][a-z]+$')""")
def C21_name_order(spark: SparkSession, d: str) -> DataFrame:
    """'LASTNAME First (X)' comes back as 'First LASTNAME (X)'."""
    m = table(spark, d, "commission_meetings").where(F.col("commissioner_name").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$")).select(F.col("commissioner_name").alias("name")).distinct()
    first, last = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2))
    back = X.name_order(F.concat(F.upper(last), F.lit(" "), first, F.lit(" (X)")))
    return m.select("name", F.when(back == F.concat(first, F.lit(" "), F.upper(last), F.lit(" (X)")), F.concat("name", F.lit(" (X)"))).alias("flipped"))


@query("""SELECT id, array_to_string(list_sort(string_split_regex(trim(lower(regexp_replace(name, '<[^>]*>', '', 'g'))), ' +')), ' ') AS tokens FROM organizations""")
def C22_sorted_tokens(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.concat(F.lit("<b>"), F.col("name"), F.lit("</b>"))
    return table(spark, d, "organizations").select("id", X.sorted_tokens(F.regexp_replace(tagged, "<[^>]*>", "")).alias("tokens"))


@query("""SELECT id, replace(regexp_replace(id, '\\([A-Z]+\\)$', ''), '/', '-') AS process, regexp_extract(id, '\\(([A-Z]+)\\)$', 1) AS kind, id AS back FROM legal_procedures""")
def C24_process_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "legal_procedures").select("id", X.process_id(F.col("id")).alias("process"), X.file_type(F.col("id")).alias("kind"))
    return p.withColumn("back", X.file_id(F.col("process"), F.col("kind")))


_DOC = "CASE l_linenumber % 7 WHEN 0 THEN 'ITRE-AM-' WHEN 1 THEN 'ITRE-PR-' WHEN 2 THEN 'ITRE-AD-' WHEN 3 THEN 'COM(2021)' WHEN 4 THEN 'SWD(2021)' WHEN 5 THEN 'A9-' ELSE 'TA-9-' END || CAST(l_orderkey AS VARCHAR)"


@query(f"""SELECT DISTINCT {_DOC} AS doc, CASE l_linenumber % 7 WHEN 0 THEN 'amendments' WHEN 1 THEN 'draft_report' WHEN 2 THEN 'opinion' WHEN 3 THEN 'proposal' WHEN 4 THEN 'working_document' WHEN 5 THEN 'report' ELSE 'adopted_text' END AS class FROM lineitem""")
def C25_document_classes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.expr(_DOC.replace("VARCHAR", "STRING")).alias("doc")).distinct()
    return li.select("doc", X.document_class(F.col("doc")).alias("class"))


@query("""SELECT doc_id, 'https://x.example/doc/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '_EN.html' WHEN doc_id % 3 = 1 THEN '.html' ELSE '' END AS url FROM documents""")
def C26_html_urls(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.concat(F.when(i % 2 == 0, "http").otherwise("https"), F.lit("://x.example/doc/"), i.cast("string"), F.when(i % 3 == 0, "_EN.pdf#page=2").when(i % 3 == 1, ".pdf;jsessionid=AB").otherwise("#top"))
    return table(spark, d, "documents").select("doc_id", X.html_url(raw).alias("url"))


_TARGET = "CASE l_linenumber % 5 WHEN 0 THEN 'Recital ' WHEN 1 THEN 'article ' WHEN 2 THEN 'Annex ' WHEN 3 THEN 'Title ' ELSE 'Whole ' END || CAST(l_suppkey % 40 + 1 AS VARCHAR) || ' – paragraph 2'"


@query(f"""SELECT DISTINCT {_TARGET} AS target, CASE l_linenumber % 5 WHEN 0 THEN 'recital' WHEN 1 THEN 'article' WHEN 2 THEN 'annex' WHEN 3 THEN 'title' ELSE 'other' END AS kind FROM lineitem""")
def C27_target_types(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.expr(_TARGET.replace("VARCHAR", "STRING")).alias("target")).distinct()
    return t.select("target", R.target_type(F.col("target")).alias("kind"))


@query(f"""SELECT DISTINCT {_TARGET} AS target, CASE WHEN l_linenumber % 5 = 0 THEN 'Recital ' WHEN l_linenumber % 5 = 1 THEN 'Article ' WHEN l_linenumber % 5 = 2 THEN 'Annex ' END || CAST(l_suppkey % 40 + 1 AS VARCHAR) AS article FROM lineitem""")
def C28_target_articles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.expr(_TARGET.replace("VARCHAR", "STRING")).alias("target")).distinct()
    return t.select("target", X.target_article(F.col("target")).alias("article"))


_ACTIVITIES = {"purchase": "BUY", "sign": "REGISTER", "click": "CLICK"}


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'BUY' WHEN event_type LIKE '%sign%' THEN 'REGISTER' WHEN event_type = 'click' THEN 'CLICK' ELSE 'OTHER' END AS code FROM events""")
def C29_activity_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes by the exact text, else by the first key that it contains."""
    return table(spark, d, "events").select("event_id", R.keyed(F.col("event_type"), _ACTIVITIES, "OTHER").alias("code"))


_BODIES = {"company": "Companies", "ngo": "Organisations", "association": "Associations", "public": "Public bodies", "academic": "Research"}


@query("""SELECT id, CASE lower(trim(organization_type)) WHEN 'company' THEN 'Companies' WHEN 'ngo' THEN 'Organisations' WHEN 'association' THEN 'Associations' WHEN 'public' THEN 'Public bodies' WHEN 'academic' THEN 'Research'
 ELSE CASE WHEN lower(organization_type) LIKE '%company%' THEN 'Companies' WHEN lower(organization_type) LIKE '%ngo%' THEN 'Organisations' WHEN lower(organization_type) LIKE '%association%' THEN 'Associations' WHEN lower(organization_type) LIKE '%public%' THEN 'Public bodies' WHEN lower(organization_type) LIKE '%academic%' THEN 'Research' ELSE 'Other' END END AS kind FROM organizations""")
def C30_organisation_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "organizations").select("id", R.keyed(F.col("organization_type"), _BODIES, "Other").alias("kind"))


@query("""SELECT id, regexp_replace(id, '[^A-Za-z0-9_-]+', '_', 'g') AS safe, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM legal_procedures""")
def C31_safe_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", X.file_safe(F.col("id")).alias("safe"), F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug"))


@query("""SELECT feedback_id, array_to_string(list_filter([trim(organisation_name), trim(country), trim(feedback_text)], lambda x: x IS NOT NULL AND x <> ''), ' ') AS t FROM hys_feedback_bronze""")
def C32_joined_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hys_feedback_bronze").select("feedback_id", X.joined_texts(*[F.col(c) for c in ("organisation_name", "country", "feedback_text")]).alias("t"))


@query("""SELECT doc_id, substr(text, 1, 200) AS t200, length(substr(text, 1, 5000)) AS n5000 FROM documents""")
def C33_truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("t200"), F.length(F.substring("text", 1, 5000)).cast("long").alias("n5000"))


@query("""WITH x AS (SELECT id, trim(coalesce(title, '')) AS b, trim(coalesce(description, '')) AS a, title, description FROM legal_procedures)
 SELECT id, CASE WHEN b = '' AND a = '' OR a = b THEN NULL WHEN b = '' THEN 'NEW: ' || description WHEN a = '' THEN 'DELETED: ' || title ELSE 'BEFORE: ' || title || ' AFTER: ' || description END AS summary FROM x""")
def C34_diff_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", X.diff_summary(F.col("title"), F.col("description")).alias("summary"))


@query("""SELECT id, 'Article ' || substr(id, 6, 4) || CASE WHEN length(title) > 0 THEN ' – ' || title ELSE '' END || CASE WHEN description IS NOT NULL THEN chr(10) || description ELSE '' END AS t FROM legal_procedures""")
def C35_provision_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", R.provision_text(F.lit("article"), F.substring("id", 6, 4), F.col("title"), F.col("description")).alias("t"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{A0}\\x{2002}\\x{2003}\\x{2009}\\x{202F}]', ' ', 'g'), '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{258C}\\x{25C4}\\x{25BA}]', '', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')) AS t FROM documents""")
def C36_markup_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", R.markup_clean(F.col("text")).alias("t"))


@query("""SELECT DISTINCT id, nullif(trim(location), '') AS location, CASE WHEN n % 2 = 0 THEN 'First' || chr(10) || 'Second' END AS points FROM (SELECT id, location, length(id) + ascii(substr(id, 1, 1)) AS n FROM commission_meetings) WHERE location IS NULL OR NOT regexp_matches(location, '[^a-zA-Z ,]') AND lower(trim(location)) NOT IN ('n/a', 'na', 'none', '-')""")
def C37_minutes_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of minutes built from the meetings, read back by their labels."""
    m = table(spark, d, "commission_meetings").where(F.col("location").isNull() | (~F.col("location").rlike("[^a-zA-Z ,]") & ~F.lower(F.trim("location")).isin("n/a", "na", "none", "-")))
    even = (F.length("id") + F.ascii(F.substring("id", 1, 1))) % 2 == 0
    text = F.concat(F.lit("Location: "), F.coalesce("location", F.lit("N/A")), F.lit("\nPoints raised:\n"), F.when(even, "- First\n• Second").otherwise("n/a"), F.lit("\nConclusions: None"))
    return m.select("id", R.minutes_field(text, "location").alias("location"), R.minutes_field(text, "points").alias("points")).distinct()


@query("""SELECT id, proposal_date AS a, proposal_date AS b, proposal_date AS c, CAST(NULL AS DATE) AS none FROM legal_procedures WHERE proposal_date IS NOT NULL""")
def D02_formats(spark: SparkSession, d: str) -> DataFrame:
    """Dates in several writings come back as the same day."""
    p = table(spark, d, "legal_procedures").where("proposal_date IS NOT NULL")
    back = lambda f: D.any_date(F.date_format("proposal_date", f))
    return p.select("id", back("dd.MM.yyyy").alias("a"), back("d MMMM yyyy").alias("b"), back("MMMM d, yyyy").alias("c"), D.any_date(F.lit("soon")).alias("none"))


@query("""SELECT id, CAST(coalesce(list_min(list_filter([abs(datediff('day', proposal_date, DATE '2019-06-01')), abs(datediff('day', decision_date, DATE '2019-06-01'))], lambda x: x IS NOT NULL)), 1000000000) AS INTEGER) AS days FROM legal_procedures""")
def D03_nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", D.nearest_anchor(F.lit("2019-06-01").cast("date"), F.col("proposal_date"), F.col("decision_date")).alias("days"))


@query("""SELECT id, CAST(proposal_date - INTERVAL 18 MONTH AS DATE) AS before, CAST(proposal_date + INTERVAL 6 MONTH AS DATE) AS after FROM legal_procedures""")
def D04_months(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", F.add_months("proposal_date", -18).alias("before"), F.add_months("proposal_date", 6).alias("after"))


@query("""SELECT doc_id, date_trunc('month', published_at)::DATE AS month, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM documents""")
def D06_month_and_utc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.trunc(F.col("published_at").cast("date"), "month").alias("month"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))


@query("""SELECT id, CASE WHEN last_activity_date >= DATE '2024-01-01' - INTERVAL 28 DAY THEN 'recent' ELSE 'settled' END AS mode FROM legal_procedures""")
def D08_discovery_mode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", D.recent(F.col("last_activity_date"), F.lit("2024-01-01").cast("date")).alias("mode"))


@query("""SELECT a.vec_id, round(list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def M05_dot_products(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of neighbouring unit vectors, rounded as scores are stored (M06)."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("""SELECT feedback_id, CASE WHEN attachment_count > 0 THEN 1 ELSE 0 END AS dummy, ln(1 + attachment_count) AS log_n, ln(1 + attachment_count) * CASE WHEN pdf_extracted THEN 1 ELSE 0 END AS both FROM hys_feedback_bronze""")
def M02_logs_and_dummies(spark: SparkSession, d: str) -> DataFrame:
    n = F.log1p(F.col("attachment_count").cast("double"))
    return table(spark, d, "hys_feedback_bronze").select("feedback_id", F.when(F.col("attachment_count") > 0, 1).otherwise(0).alias("dummy"), n.alias("log_n"), (n * F.when(F.col("pdf_extracted"), 1).otherwise(0)).alias("both"))


@query("""SELECT sha256(coalesce(strftime(m.meeting_date, '%Y-%m-%d'), '') || '_' || c.meeting_id || '_' || coalesce(c.organization_id, '') || '_' || coalesce(c.organization_name, '')) AS id FROM (SELECT DISTINCT meeting_id, organization_id, organization_name FROM commission_meeting_organizations) c JOIN (SELECT DISTINCT id, meeting_date FROM commission_meetings) m ON m.id = c.meeting_id""")
def H02_lobby_meeting_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commission_meeting_organizations").select("meeting_id", "organization_id", "organization_name").distinct()
    m = table(spark, d, "commission_meetings").select(F.col("id").alias("meeting_id"), "meeting_date").distinct()
    return c.join(m, "meeting_id").select(F.sha2(F.concat_ws("_", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("meeting_date", "meeting_id", "organization_id", "organization_name")]), 256).alias("id"))


_EVENTS = "array<struct<title:string,date:string>>"


@query("""SELECT id, array_to_string([CASE WHEN title IS NOT NULL AND length(title) > 60 THEN 'one' ELSE 'two' END, 'two'], ',') AS sources FROM legal_procedures""")
def R04_tagged_events(spark: SparkSession, d: str) -> DataFrame:
    """Events tagged with the source that knows their title."""
    p = table(spark, d, "legal_procedures")
    events = F.array(F.struct(F.col("title").alias("title"), F.lit("1").alias("date")), F.struct(F.lit("zz").alias("title"), F.lit("2").alias("date")))
    known = F.when(F.length("title") > 60, F.array("title")).otherwise(F.array(F.lit("none")))
    return p.select("id", F.array_join(F.transform(R.tagged(events, known, "one", "two"), lambda e: F.coalesce(e["source"], F.lit("two"))), ",").alias("sources"))


@query("""SELECT DISTINCT id, array_to_string(list_transform(commission_representatives, lambda x: '{"name":"' || x.name || '"}'), '|') AS names FROM commission_meetings WHERE commission_representatives IS NOT NULL AND len(list_filter(commission_representatives, lambda x: x.name IS NULL OR contains(x.name, '"') OR contains(x.name, '\\'))) = 0""")
def R05_without_key(spark: SparkSession, d: str) -> DataFrame:
    """Nested records without one of their keys."""
    odd = F.exists("commission_representatives", lambda x: x["name"].isNull() | x["name"].contains('"') | x["name"].contains("\\"))
    m = table(spark, d, "commission_meetings").where(F.col("commission_representatives").isNotNull() & ~odd)
    return m.select("id", F.array_join(F.transform("commission_representatives", lambda x: F.to_json(x.dropFields("function"))), "|").alias("names")).distinct()


@query("""SELECT event_id, '[1, ' || CAST(event_id AS VARCHAR) || ']' AS found FROM events""")
def R07_json_in_prose(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Sure, here it is:\n```json\n[1, "), F.col("event_id").cast("string"), F.lit("]\n```\nAnything else?"))
    return table(spark, d, "events").select("event_id", X.json_in_prose(said).alias("found"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'docx' WHEN doc_id % 3 = 0 THEN 'html' ELSE 'pdf' END || CAST(doc_id AS VARCHAR) AS url FROM documents""")
def R09_preferred_files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    file = lambda f: F.struct(F.lit(f).alias("format"), F.concat(F.lit(f.lower()), i.cast("string")).alias("url"))
    files = F.filter(F.array(file("zip"), file("PDF"), F.when(i % 3 == 0, file("html")), F.when(i % 2 == 0, file("docx"))), lambda f: f.isNotNull())
    return table(spark, d, "documents").select("doc_id", R.preferred_file(files).alias("url"))


@query("""SELECT DISTINCT id, array_to_string(list_concat(list_transform(commission_representatives, lambda x: x.name), CASE WHEN list_contains(list_transform(commission_representatives, lambda x: x.name), 'Council') OR meeting_date IS NULL THEN [] ELSE ['Council'] END), '|') AS actors FROM commission_meetings WHERE commission_representatives IS NOT NULL AND len(list_filter(commission_representatives, lambda x: x.name IS NULL)) = 0""")
def R10_institutions(spark: SparkSession, d: str) -> DataFrame:
    """An institution added to the actors where a condition holds and it is missing."""
    m = table(spark, d, "commission_meetings").where(F.col("commission_representatives").isNotNull() & ~F.exists("commission_representatives", lambda x: x["name"].isNull()))
    actors = F.transform("commission_representatives", lambda x: F.struct(x["name"].alias("name"), x["function"].alias("role")))
    out = R.with_institution(actors, "Council", F.col("meeting_date").isNotNull())
    return m.select("id", F.array_join(F.transform(out, lambda x: x["name"]), "|").alias("actors")).distinct()


@query("""SELECT id, regexp_replace(title, chr(65533), '', 'g') AS t FROM legal_procedures""")
def Z12_utf8_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_procedures").select("id", X.utf8_clean(F.concat(F.lit("�"), F.col("title"))).alias("t"))


@query("""SELECT id, '<' || title || '>' AS title FROM legal_procedures WHERE title IS NOT NULL""")
def Z23_title_by_language(spark: SparkSession, d: str) -> DataFrame:
    """The English title where there is one, else the first."""
    p = table(spark, d, "legal_procedures").where("title IS NOT NULL")
    wrapped = F.concat(F.lit("<"), "title", F.lit(">"))
    titles = F.when(F.length("id") % 2 == 0, F.create_map(F.lit("fr"), F.lit("x"), F.lit("en"), wrapped)).otherwise(F.create_map(F.lit("de"), wrapped, F.lit("fr"), F.lit("y")))
    return p.select("id", R.by_language(titles).alias("title"))


@query("""SELECT id, '3' || substr(id, 1, 4) || 'R' || substr(id, 6, 4) AS celex FROM legal_procedures""")
def Z27_celex(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_replace(F.substring("id", 6, 4), "^0+(?=[0-9])", "")
    return table(spark, d, "legal_procedures").select("id", R.celex(F.concat(F.lit("Regulation (EU) "), F.substring("id", 1, 4), F.lit("/"), number)).alias("celex"))


@query("""SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n_urls, max(CAST(o_orderkey AS VARCHAR)) FILTER (i = 1) AS last_first FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS i FROM orders) WHERE r = 1 GROUP BY 1""")
def Z22_files_by_url(spark: SparkSession, d: str) -> DataFrame:
    """Nested file lists as a map by address, the last file of each winning."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    files = F.transform("x", lambda r: F.array(F.struct(r["o_orderpriority"].alias("url"), r["o_orderkey"].cast("string").alias("name"))))
    m = o.select("k", R.files_by_url(files).alias("m"))
    return m.select("k", F.size("m").cast("long").alias("n_urls"), F.element_at("m", F.array_min(F.map_keys("m"))).alias("last_first"))


@query("""SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'withdrawn' WHEN c_acctbal < 3000 THEN 'awaiting_council' ELSE 'completed' END AS stage FROM customer""")
def DP14_stages(spark: SparkSession, d: str) -> DataFrame:
    """The stage after all events, folded in their order."""
    e = lambda t: F.struct(F.lit(t).alias("title"), F.lit("").alias("date"))
    more = F.when(F.col("c_acctbal") < 0, F.array(e("Committee vote"), e("Proposal withdrawn"))).when(F.col("c_acctbal") < 3000, F.array(e("First reading held"), e("Unknown"))).otherwise(F.array(e("First reading held"), e("Act signed")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), R.stage(F.concat(F.array(e("Proposal published")), more)).alias("stage"))


@query("""SELECT x.id, x.kind, CASE WHEN n < 1 THEN '0' WHEN n < 2 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' WHEN n < 50 THEN '10-49' WHEN n < 250 THEN '50-249' WHEN n < 1000 THEN '250-999' ELSE '1000+' END AS bin
 FROM (SELECT id, coalesce(nullif(trim(organization_type), ''), 'other') AS kind, length(coalesce(interests_represented, '')) AS n FROM organizations) x""")
def E12_register_records(spark: SparkSession, d: str) -> DataFrame:
    """Register entries as organisations: kind with a default, and a bin of a count."""
    o = table(spark, d, "organizations")
    return o.select("id", F.coalesce(F.nullif(F.trim("organization_type"), F.lit("")), F.lit("other")).alias("kind"), X.headcount_bin(F.length(F.coalesce("interests_represented", F.lit("")))).alias("bin"))


@query("""WITH s AS (SELECT organization_id AS id, min(organization_name) AS name FROM commission_meeting_organizations WHERE organization_id IS NOT NULL GROUP BY 1) SELECT id, coalesce(o.name, s.name) AS name, CASE WHEN o.id IS NOT NULL THEN 'register' ELSE 'stub' END AS origin FROM (SELECT id, name FROM organizations) o FULL JOIN s USING (id)""".replace("SELECT id, coalesce", "SELECT coalesce(o.id, s.id) AS id, coalesce").replace("FULL JOIN s USING (id)", "FULL JOIN s ON s.id = o.id"))
def E07_canonical_and_stubs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "organizations").select("id", "name", F.lit("register").alias("origin"))
    stubs = table(spark, d, "commission_meeting_organizations").where("organization_id IS NOT NULL").groupBy(F.col("organization_id").alias("id")).agg(F.min("organization_name").alias("name")).withColumn("origin", F.lit("stub"))
    return M.canonical_with_stubs(known, stubs, "id").select("id", "name", "origin")


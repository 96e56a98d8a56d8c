"""Small fixtures for every operator: against brute force, exact round trips, or held-out accuracy."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, encoding, language, matching, mixing, names, scans, spans, splitting

VOCABULARY = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


# -- splitting --


def check_pieces(text, pieces, most=1500, overlap=200):
    at = 0
    for i, (start, end, o, _) in enumerate(pieces):
        assert 0 < end - start <= most and 0 <= o <= overlap and start + o == at
        at = end
    assert at == len(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 4000, "中。" * 3000, "Word " * 2000, "One sentence here. " * 400, ("Para.\n\n" + "x y z " * 50) * 30, "é" * 2500, "a" * 1499 + " b"])
def test_pieces_cover(text):
    pieces = splitting.split_points(text)
    check_pieces(text, pieces)
    if " " in text.strip() or "\n" in text:
        assert all(k != "none" for *_, k in pieces)


def test_pieces_of_short_texts():
    assert splitting.split_points("a" * 1500) == [] and splitting.split_points("") == []


def test_edits_stay_local():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "annex", "costs"]
    text = " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 15))).capitalize() + "." for _ in range(600))
    edited = text[:20000] + " One inserted sentence here." + text[20000:]
    a = [text[s:e] for s, e, *_ in splitting.split_points(text)]
    b = [edited[s:e] for s, e, *_ in splitting.split_points(edited)]
    assert len(a) - len(set(a) & set(b)) <= 6 < len(a)


def test_split_table(spark):
    text = "A sentence of words. " * 200
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "y"), (3, "", "z"), (None, text, "w")], "id int, t string, piece string")
    rows = splitting.split_oversized(df, "id", "t").collect()
    first = sorted((r for r in rows if r["id"] == 1), key=lambda r: r["piece"])
    assert {r["id"] for r in rows} == {1, None} and all(r["text"] == text[r["start"] : r["end"]] for r in rows)
    assert [r["piece"] for r in first][:4] == [1, 1, 2, 2]
    assert splitting.split_oversized(df.limit(0), "id", "t").count() == 0


# -- tokens --


@VOCABULARY
def test_encoder_against_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    theirs.encode_special_tokens = True
    mine, rng = bpe.Encoder(bpe.read_ranks()), random.Random(1)
    parts = ["a", "b", "é", "ł", " ", "  ", "\n", "中", "😀", "́", "²", "<|endoftext|>", "'s", "'S", "\xa0", " ", "x" * 40, "the", "ing", "٣", "½", "\x00", "​", "İ", "123456"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids, text


@VOCABULARY
def test_round_trip(spark):
    texts = [(1, "Hello world, ünïcode 中文\n\n", "x"), (2, "", "y"), (3, None, None), (3, "twice", "z"), (4, "long " * 20000, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    rows = bpe.encode_documents(df, "doc_id", "text").collect()
    ranks = bpe.read_ranks()
    assert sorted(bpe.decode_ids(r["ids"], ranks) for r in rows) == sorted(t or "" for _, t, _ in texts)
    counts = bpe.encode_documents(df, "doc_id", "text", counts_only=True, keep=("ids",)).collect()
    assert sorted(r["n_tokens"] for r in counts) == sorted(len(r["ids"]) for r in rows)
    assert bpe.encode_documents(df.limit(0), "doc_id", "text").count() == 0


# -- mixing --


def test_mix_reaches_targets(spark):
    sizes = spark.createDataFrame([(i, "a" if i < 700 else "b" if i < 990 else "c" if i < 999 else None, 10 + i % 7) for i in range(1000)] + [(1000, "a", 0), (1001, "a", None)], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.05, 5), ("none", 3.0, 2), (None, 1.0, 1), ("a", 1.0, 3), ("b", None, 1)], "source string, target_weight double, max_repeats int")
    docs, report = mixing.mix(sizes, targets)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"a", "b", "c"}
    for r in got.values():
        assert abs(r["actual_share"] - r["target_share"]) < 0.02 and r["most_repeats"] <= r["max_repeats"]
    assert abs(got["a"]["target_share"] - 2 / 3.05) < 1e-9
    rows = docs.collect()
    for s, r in got.items():
        assert sum(x["n_tokens"] * x["repeats"] for x in rows if x["source"] == s) == r["mixed_tokens"]
        assert max(x["repeats"] for x in rows if x["source"] == s) - min(x["repeats"] for x in rows if x["source"] == s) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(sizes, targets)[0].collect()))


def test_order_of_a_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 20)
    chosen = spark.createDataFrame([(i, "a", 5, 1 + i % 3) for i in range(90)], "doc_id long, source string, n_tokens int, repeats int")
    rows = mixing.ordered(chosen).collect()
    assert {(r["doc_id"], r["epoch"]) for r in rows} == {(i, k) for i in range(90) for k in range(1 + i % 3)} and len(rows) == 180
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block"], []).append(r["place"])
    assert set(blocks) == set(range(9)) and all(sorted(x) == list(range(1, len(x) + 1)) for x in blocks.values())
    assert mixing.ordered(chosen.limit(0)).count() == 0


def test_exponent_gives_way():
    sources = [mixing.Source("a", 0.5, 1, 900, 9), mixing.Source("b", 0.5, 2, 100, 1)]
    total, exponent, weights = mixing.plan(sources, total_tokens=1000)
    assert 0 < exponent < 1 and weights[1] * total <= 200 * (1 + 1e-6) and abs(weights[1] * total - 200) < 1
    total, exponent, weights = mixing.plan(sources, total_tokens=5000)
    assert total == 1100 and abs(weights[0] * total - 900) < 1e-6
    _, exponent, weights = mixing.plan(sources, target_entropy=0.5)
    assert abs(mixing.entropy(weights) - 0.5) < 1e-6
    assert mixing.plan([]) == (0.0, 0.0, [])


def test_empty_mix(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    docs, report = mixing.mix(sizes, targets)
    assert docs.count() == 0 and report.count() == 0


# -- encoding --

CLEAN = ["Les adhérents préfèrent une période d’essai à l’été.", "Die Übergangsfrist für Prüfer beträgt möglichst fünf Wochen – größer.", "Związek Drawińskich Młynarzy żąda większej ilości źródeł.", "Η Επιτροπή οφείλει να δημοσιεύσει τα στοιχεία.", "Plain ASCII text."] * 60


def test_repairs(spark):
    garbled = [CLEAN[0].encode("utf-8").decode("cp1252"), CLEAN[1].encode("cp1252").decode("mac_roman"), CLEAN[2].encode("cp1250").decode("latin_1"), CLEAN[3].encode("utf-8").decode("latin_1"), CLEAN[0].encode("utf-8").decode("cp1252").encode("utf-8").decode("cp1252")]
    lost = "Les adh�rents"
    rows = [(i, t) for i, t in enumerate([*CLEAN, *garbled, lost, "", None])] + [(300, garbled[0])]
    df = spark.createDataFrame(rows, "id int, t string")
    scores = encoding.pair_scores(encoding.pair_counts(df, "t"))
    flagged = {r["id"] for r in df.where(encoding.is_garbled(df, F.col("t"), scores)).collect()}
    assert flagged == set(range(300, 306))
    fixed = {r["id"]: r["r"] for r in df.select("id", encoding.restored(df, F.col("t"), scores).alias("r")).where("id >= 300 AND r IS NOT NULL").collect()}
    assert [fixed[300 + i] for i in range(5)] == [CLEAN[0], CLEAN[1], CLEAN[2], CLEAN[3], CLEAN[0]] and fixed[305] == lost
    found = encoding.passages(df, ["id"], "t", scores).where("id = 305").collect()
    assert found and all(r["restored"] is None for r in found)
    none = df.limit(0)
    assert none.where(encoding.is_garbled(none, F.col("t"), encoding.pair_scores(encoding.pair_counts(none, "t")))).count() == 0


def test_copies_of_a_garbled_name(spark):
    """A garbled name that holds a third of all rows is found and restored, as without its copies."""
    rng = random.Random(8)
    words = [w for t in CLEAN[:4] for w in t.rstrip(".").split()]
    clean = [" ".join(rng.sample(words, 6)) for _ in range(400)]
    right = "Übergangsfrist für Prüfer"
    garbled = right.encode("utf-8").decode("cp1252")
    for copies in (1, 200):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + [garbled] * copies)], "id int, t string")
        scores = encoding.pair_scores(encoding.pair_counts(df, "t"))
        assert [r["id"] for r in df.where(encoding.is_garbled(df, F.col("t"), scores)).orderBy("id").collect()] == list(range(400, 400 + copies))
        assert {r["r"] for r in df.where("id >= 400").select(encoding.restored(df, F.col("t"), scores).alias("r")).collect()} == {right}


def test_found_as_passages(spark):
    """A text counts as garbled if and only if it has a garbled passage; a lone ellipsis has none."""
    rng = random.Random(12)
    some = [" ".join(rng.sample([w for t in CLEAN[:4] for w in t.split()], 5)) for _ in range(200)]
    texts = some + [t.encode("utf-8").decode("cp1252", "replace") for t in some[:40]] + ["…", "\ufffd", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    scores = encoding.pair_scores(encoding.pair_counts(df, "t"))
    repairer = encoding.Repairer(scores)
    assert repairer.garbled(texts).tolist() == [bool(repairer.repair(t)) for t in texts]
    scores = encoding.Scores(*[x.copy() if hasattr(x, "copy") else x for x in (scores.bits, scores.improbable, scores.unseen)])
    scores.bits[encoding.place(*(np.array([x]) for x in (10, ord("…"))))] = -40.0  # an edge that is hardly ever seen
    scores.improbable[encoding.place(*(np.array([x]) for x in (10, ord("…"))))] = True
    assert encoding.Repairer(scores).garbled(["…"]).tolist() == [False] and encoding.Repairer(scores).repair("…") == []


def test_blocks_keep_segments():
    """Segments of texts are those of all pairs' scores at once, wherever texts are cut into blocks for it."""
    import numpy as np

    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("aaaabéñ") if rng.random() < 0.6 else rng.choice("abc") * rng.randint(1, 9) for _ in range(rng.randint(2, 60)))
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        improbable = np.zeros(encoding.PLACES, bool)
        improbable[encoding.place(np.arange(128), np.full(128, ord("é")))] = True
        improbable[encoding.place(np.full(128, ord("é")), np.arange(128))] = True
        improbable[encoding.place(np.array([233]), np.array([233]))] = True
        r = encoding.Repairer(encoding.Scores(np.zeros(encoding.PLACES, np.float32), improbable, -9.0))
        pairs = (c[:-1] > 127) | (c[1:] > 127)
        score = np.where(pairs, np.where(improbable[encoding.place(c[:-1], c[1:])], 1.0, -1.0), encoding.PLAIN)
        assert r.segments_of(c) == [(a, b + 1) for a, b in encoding.segments(score.tolist())], text


def test_segments_as_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        score = [rng.choice([1.0, -1.0, -1.5]) for _ in range(rng.randint(1, 12))]
        best = max(sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1))
        found = encoding.segments(score)
        if best > 0:
            assert max(sum(score[a:b]) for a, b in found) == best
        assert all(score[a] > 0 and score[b - 1] > 0 for a, b in found)


# -- languages --

WORDS = {
    "en": "the members of our association would like to know whether this proposal helps small workshops and public hospitals before winter begins".split(),
    "de": "die mitglieder unserer vereinigung möchten gerne wissen ob dieser vorschlag kleinen werkstätten und öffentlichen krankenhäusern vor dem winter hilft".split(),
    "fr": "les membres de notre association aimeraient savoir si cette proposition aide les petits ateliers et les hôpitaux publics avant que commence l’hiver".split(),
}


def sentence(rng, lang):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(14)).capitalize() + "."


def test_held_out_languages():
    rng = random.Random(7)
    rows = [(" ".join(sentence(rng, lang) for _ in range(4)), lang if rng.random() > 0.1 else rng.choice(list(WORDS))) for lang in WORDS for _ in range(60)]
    model = language.train(rows)
    right = total = 0
    for _ in range(150):
        langs = [rng.choice(list(WORDS)) for _ in range(rng.randint(1, 6))]
        text = " ".join(sentence(rng, x) for x in langs)
        (reading,) = list(language.readings(model, [text]))
        got = [s[4] for s in reading.segments(model.languages)]
        total += len(langs)
        right += sum(a == b for a, b in zip(got, langs)) if len(got) == len(langs) else 0
    assert right / total > 0.97


def test_mislabelled(spark):
    rng = random.Random(8)
    text = lambda lang, n=3: " ".join(sentence(rng, lang) for _ in range(n))
    rows = [(i, text(lang), code) for i, (lang, code) in enumerate([(x, c) for x, c in (("en", "en-GB"), ("de", "DEU"), ("fr", "French")) for _ in range(30)])]
    rows += [(100, text("de"), "en"), (101, text("fr"), None), (102, text("en"), "??"), (103, text("en") + " " + text("de"), "EN"), (104, "n/a", None), (105, None, "en"), (106, "", ""), (107, "12345", "de"), (103, rows[0][1], "EN")]
    df = spark.createDataFrame(rows, "id int, text string, language string")
    got = {tuple(r) for r in language.mislabelled(df, "id", "text", "language").collect()}
    assert got == {(100, "de"), (101, "fr"), (102, "en"), (103, "en"), (103, "de")}
    assert language.mislabelled(df.limit(0), "id", "text", "language").count() == 0
    model = language.train(language.training_rows(df, "id", "text", "language"))
    parts = [r for r in language.segments(df, "id", "text", model).collect() if r["id"] == 100]
    assert parts and all(r["confidence"] > 0.9 for r in parts)


# -- names --

REGISTER = [
    ("1", "Alpine Network of Seed Testers", "ANST", "association"), ("2", "Carpathian Association of Seed Testers", "CAST", "association"), ("3", "Verbidium Pharma Lda.", "VERP", "company"), ("4", "Robert Folmiano", None, "self_employed"),
    ("5", "Ormińska Izba Młynarzy", "OIM", "association"), ("6", "Jasvajup Paper & Board A/S", "DUP", "company"), ("7", "Dulsequil GmbH & Co. KG", "DUP", "company"), ("8", "Alpine Association of Seed Testers", "AAST", "association"), (None, "Nobody", None, "ngo"), ("9", None, None, "ngo"),
]
VARIANTS = [
    ("ALPINE NETWORK OF SEED TESTERS", "1"), ("the Alpine Netw. of Seed Testers", "1"), ("Alpnie Network of Seed Testrs", "1"), ("Seed Testers, Alpine Network of", "1"), ("Alpine Seed Testers Network", "1"), ("A.N.S.T.", "1"), ("anst", "1"), ("ANST – Alpine Network of Seed Testers", "1"),
    ("AlpineNetwork of Seed Testers", "1"), ("Alpine Assoc. of Seed Testers", "8"), ("Carpathian Association of Seed Testers HQ", "2"), ("verbidium pharma", "3"), ("Pharma Verbidium", "3"), ("Verbidum Pharma Lda. - Brussels office", "3"), ("Bob Folmiano", "4"), ("Folmiano, Robert", "4"), ("R. Folmiano", "4"),
    ("Mr Robert Folmiano", "4"), ("Orminska Izba Mlynarzy", "5"), ("Jasvajup Paper and Board AS", "6"), ("Dulsequil GmbH and Co. KG", "7"), ("Dulsequil", "7"), ("DUP", None), ("Carpathian Network of Seed Testers", None), ("Theodora Folmiano", None), ("University of Nowhere", None), ("", None), (None, None), ("-", None), ("x" * 3000, None),
]


def test_links(spark):
    reg = spark.createDataFrame(REGISTER, "id string, name string, acronym string, organization_type string")
    lex = names.lexicon(reg)
    df = spark.createDataFrame([(i, n, None) for i, (n, _) in enumerate(VARIANTS)] + [(100, "DUP", "7"), (101, "Bob Folmiano", None), (101, "Bob Folmiano", None)], "key int, name string, body string").withColumnRenamed("body", "told")
    got = {r["key"]: r["body"] for r in names.link(df, ["key"], "name", lex, "told").collect()}
    for i, (name, want) in enumerate(VARIANTS):
        assert got.get(i) == want, name
    assert got[100] == "7" and got[101] == "4"
    assert names.link(df.limit(0), ["key"], "name", lex).count() == 0
    assert names.link(df, ["key"], "name", names.lexicon(reg.limit(0))).count() == 0


def test_words_that_many_bodies_have():
    """A farther token is read where all its other words are common to hundreds of bodies."""
    words = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs" for d in "abei"]
    lex = names.Lexicon([(f"b{i}", f"European Federation {w.title()}ton Makers", None) for i, w in enumerate(words)] + [("g", "European Federation Glass Makers", None)])
    assert max(len(x) for x in lex.bodies.values()) > 400
    assert {f for f, *_ in lex.rewritings("European Federation Glosz Makers")} == {"european federation glass makers"}


def test_exact_names_are_links(spark, data):
    """Every exact name is among the links of p6_links, and none of p6_found."""
    from tessera.llm import queries
    from tessera.session import table

    links, found = queries.p6_links(spark, data).collect(), queries.p6_found(spark, data).count()
    exact = [r for r in links if r["form"] == "exact"]
    register = {(r["name"], r["id"]) for r in table(spark, data, "organizations").collect()}
    assert exact and all((r["name"], r["body"]) in register and r["score"] > 0 for r in exact)
    assert len({(r["source_table"], r["record_id"], r["pos"], r["body"]) for r in links if r["form"] != "exact"}) == found


def test_slips_as_brute_force():
    from functools import cache

    @cache
    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(plain(a[:-1], b) + 1, plain(a, b[:-1]) + 1, plain(a[:-1], b[:-1]) + (a[-1] != b[-1]))
        return min(d, plain(a[:-2], b[:-2]) + 1) if len(a) > 1 and len(b) > 1 and a[-2:] == b[-1] + b[-2] else d

    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert names.slips(a, b, 2) == min(plain(a, b), 3)


# -- shared spans --


def brute(docs, least):
    out = set()
    for i, a in docs.items():
        windows = {a[k : k + least] for k in range(len(a) - least + 1)}
        out |= {(i, j) for j, b in docs.items() if i < j and any(b[k : k + least] in windows for k in range(len(b) - least + 1))}
    return out


def test_spans_as_brute_force(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passages = [make(n) for n in (299, 300, 301, 340, 700)]
    docs = {i: make(rng.randint(0, 500)) + rng.choice(passages) + make(rng.randint(0, 500)) for i in range(40)}
    docs |= {50: "x" * 900, 51: "y" + "x" * 650, 52: "ab" * 400, 53: "ab" * 380 + "c", 54: docs[3], 55: make(310) + docs[3][5:320], 56: passages[1], 57: "z" * 299, 58: "z" * 299}
    rows = [(i, t, 0) for i, t in docs.items()] + [(60, None, 0), (61, "", 0), (3, docs[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s int")
    got = {tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text").collect()}
    assert got == brute(docs, 300)
    shares = {r["doc_id"]: r for r in spans.shared_share(df, "doc_id", "text").collect()}
    assert shares[54]["share"] == 1.0 and shares[60]["share"] == 0.0 and shares[61]["share"] == 0.0 and set(shares) == set(docs) | {60, 61}
    for i, t in list(docs.items())[:12]:
        covered = [False] * len(t)
        for k in range(len(t) - 299):
            if any(t[k : k + 300] in u for j, u in docs.items() if j != i):
                covered[k : k + 300] = [True] * 300
        assert shares[i]["shared_chars"] == sum(covered), i
    assert spans.sharing_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_full_filters_change_nothing(spark, monkeypatch):
    """The bitmap in front of the joins may let everything through."""
    rng = random.Random(2)
    part = "".join(rng.choice("abcdef ") for _ in range(400))
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(500)) + (part if i % 7 == 0 else "") + "x" * i) for i in range(60)]
    df = spark.createDataFrame(rows, "d int, t string")
    want = {tuple(r) for r in spans.sharing_pairs(df, "d", "t").collect()}
    monkeypatch.setattr(spans, "MOST_BITS", 6)
    assert {tuple(r) for r in spans.sharing_pairs(df, "d", "t").collect()} == want == {(a, b) for a in range(0, 60, 7) for b in range(a + 7, 60, 7)}


def test_spans_in_periodic_text(spark):
    """Periodic runs little longer than a span, with other phases than the long runs that hold them."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for j in range(60):
        period = rng.randint(2, 80)
        unit = noise(period)
        long = (unit * 2000)[rng.randrange(period) :][: rng.randint(900, 1500)]
        at, size = rng.randrange(period), rng.randint(301, 300 + period)
        rows += [(2 * j, noise(200) + long + noise(200)), (2 * j + 1, noise(200) + (unit * 400)[at : at + size] + noise(200))]
    got = {tuple(sorted(r[:2])) for r in spans.sharing_pairs(spark.createDataFrame(rows, "d int, t string"), "d", "t").collect()}
    assert got == {(2 * j, 2 * j + 1) for j in range(60)}


# -- scans --

BODY = ["The representatives explained the administrative consequences of the implementation calendar, and thanked the services for their availability.", "Participants discussed the competitiveness of medium-sized manufacturers, without prejudice to the position of its membership.", "The organisation recalled the harmonisation of enforcement practices across the Member States, and offered to supply further documentation."]


def wrapped(text, width, rng, hyphens=False):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) + 1 > width:
            if hyphens and len(w) > 9 and rng.random() < 0.6:
                cut = len(w) // 2
                lines.append(f"{line} {w[:cut]}-")
                line = w[cut:]
                continue
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def test_scanned_texts(spark):
    rng = random.Random(6)
    para = lambda: " ".join(rng.choice(BODY) for _ in range(4))
    rows = [(f"c{i}", "\n".join(wrapped(para(), rng.choice([60, 70, 80]), rng))) for i in range(120)] + [(f"p{i}", para()) for i in range(80)]
    want = {}
    for i in range(10):
        plain = para()
        lines = wrapped(plain, 62, rng)
        at = rng.randint(1, len(lines) - 1)
        rows.append((f"f{i}", "\n".join([*lines[:at], f"- {i + 3} -", "Cabinet Foo / 2014", "", *lines[at:]])))
        want[f"f{i}"] = plain
        rows.append((f"m{i}", plain.replace("administrative", "adrninistrative").replace("competitiveness", "compefitiveness").replace("harmonisation", "harmonisati0n")))
        want[f"m{i}"] = plain
        rows.append((f"h{i}", "\n".join(wrapped(plain, 62, rng, hyphens=True))))
        want[f"h{i}"] = plain
        rows.append((f"s{i}", plain.replace("consequences", "conse quences").replace("prejudice", "pr ejudice").replace("documentation", "docume ntation")))
        want[f"s{i}"] = plain
    rows += [("n", None), ("e", ""), ("c0", rows[0][1])]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: r for r in scans.repaired(df, ["id"], "text").collect()}
    traces = lambda r: r["broken"] + r["misread"] + r["split"] + r["furniture"]
    clean = {i for i, t in rows if i[0] in "cp"}
    assert not [i for i in clean if traces(got[i])] and all(got[i]["text"] == t for i, t in rows if i in clean or i in "ne")
    assert sum(traces(got[i]) > 0 for i in want) >= 0.95 * len(want)
    assert sum(got[i]["text"] == t for i, t in want.items()) >= 0.9 * len(want)
    assert scans.repaired(df.limit(0), ["id"], "text").count() == 0


def test_misreadings_at_any_scale(spark):
    """A misread word is found when all counts are a hundred times as large, and when its text has many copies."""
    rng = random.Random(9)
    plain = [" ".join(rng.sample(BODY, 3) + [f"Remark {chr(97 + i % 26)}{chr(97 + i // 26)}k."]) for i in range(120)]
    bad = plain[0].replace("administrative", "adrninistrative").replace("consequences", "conse quences")
    for copies in (1, 60):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(plain + [bad] * copies)], "id int, text string")
        model = scans.train(scans.statistics(df, "text"))
        for times in (1, 100):
            more = lambda counts: {k: n * times for k, n in counts.items()}
            large = scans.Model(more(model.words), more(model.follow), more(model.left), more(model.right), model.total * times, model.place, model.inner, model.outer, more(model.lines))
            r = scans.Reader(large).read(bad)
            assert (r.misread, r.split, r.text) == (1, 1, plain[0]), (copies, times)


def test_models_larger_than_memory(spark, monkeypatch):
    """A model of which memory holds next to nothing has the same counts and vectors, and reads texts in the same way."""
    rng = random.Random(8)
    rows = []
    for i in range(150):
        plain = " ".join(rng.choice(BODY) for _ in range(4)) + f" Remark {chr(97 + i % 26)}{chr(97 + i // 26)}k was noted."
        lines = wrapped(plain, rng.choice([60, 70]), rng, hyphens=i % 5 == 0)
        if i % 5 == 1:
            lines[3:3] = [f"- {i} -", "Cabinet Foo / 2014"]
        text = "\n".join(lines) if i % 2 else plain
        if i % 12 == 4:
            text = text.replace("harmonisation", "harmonisati0n").replace("prejudice", "pr ejudice").replace("consequences", "conse quences")
        rows.append((i, text))
    df = spark.createDataFrame(rows, "id int, text string")
    stats = scans.statistics(df, "text")
    want, read = scans.train(stats), {tuple(r) for r in scans.repaired(df, ["id"], "text").collect()}
    assert not any(isinstance(x, scans.Held) for x in vars(want).values())
    found = [sum(r[k] > 0 for r in read) for k in (1, 2, 3, 4)]
    assert min(found) >= 5, found
    for words, pairs, vectors, contexts, shapes in [(10, 10, 5, 10, 2), (10, 10**6, 10**6, 10**6, 10**6), (10**6, 10, 10**6, 10**6, 2), (10**6, 10**6, 5, 10**6, 10**6), (10**6, 10**6, 10**6, 10, 10**6)]:
        for name, n in {"MOST_WORDS": words, "MOST_PAIRS": pairs, "MOST_VECTORS": vectors, "MOST_CONTEXTS": contexts, "MOST_LINES": shapes}.items():
            monkeypatch.setattr(scans, name, n)
        model = scans.train(stats)
        assert len(model.words) <= words and len(model.follow) <= pairs and len(model.place) <= vectors and len(model.lines) <= shapes
        for name in ("words", "follow", "left", "right", "place", "lines"):
            all_ = getattr(want, name)
            assert {k: getattr(model, name).get(k) for k in all_} == all_, name
            assert ("no such" if name != "follow" else ("no", "such")) not in getattr(model, name)
        assert model.total == want.total and np.array_equal(model.inner[:], want.inner) and np.array_equal(model.outer[:], want.outer)
        assert {tuple(r) for r in scans.repaired(df, ["id"], "text", model).collect()} == read
    monkeypatch.setattr(scans, "FILED", 50)  # many files, vectors learnt file by file
    small = scans.train(stats)
    assert len(small.inner[:]) == len(want.place) and np.isfinite(small.inner[:]).all()
    monkeypatch.undo()
    assert {tuple(r) for r in scans.repaired(df, ["id"], "text", small).collect()} == read


# -- matching --

# A register in words of its own: nothing of it is in the code.
THINGS = {"stone quarries": ("rock pits", "open-cast stone works"), "garden lamps": ("outdoor lights", "lawn luminaires"), "river barges": ("inland vessels", "canal boats"), "paper bags": ("carrier sacks", "kraft pouches"), "sewing robots": ("stitching automata", "tailoring machines"), "glass jars": ("preserving containers", "canning vessels"), "school desks": ("pupil tables", "classroom furniture"), "wool blankets": ("fleece covers", "knitted throws"), "toy trains": ("model railways", "miniature locomotives"), "soup cubes": ("bouillon tablets", "stock concentrates")}
ASPECTS = {"noise limits": ("quiet operation", "sound ceilings"), "user manuals": ("instruction booklets", "printed guidance"), "recall duties": ("take-back from buyers", "withdrawal from sale"), "energy classes": ("power ratings", "efficiency grades"), "minimum durability": ("guaranteed lifetime", "years of service"), "anti-theft marking": ("serial engraving", "ownership stamps")}
FRAMES = ["On {r}: new obligations for makers of {p}", "{P} – {r} regime", "Act amending the code on {p} as regards {r}", "Common European approach to {r} where {p} are sold (codified)"]
BODIES = ["This initiative concerns {p2}, sometimes called {p3}; its subject is {r2}.", "Whoever sells {p3} or {p2} will have to respect {r2}, with {r3} to follow.", None, "Impact: {r3} and {r2}. Affected goods: {p2}, {p3}."]
FILES, ALIASES = [], [(None, "X"), ("f0", None), ("emfa", "EMFA"), ("emfa", "Press Liberty Act"), ("f7", "Silver Grybe package")]
_rng = random.Random(4)
for _i, (_p, _r) in [*enumerate((p, r) for p in THINGS for r in ASPECTS)] * 2:
    _new = "g" if len(FILES) >= len(THINGS) * len(ASPECTS) else "f"
    _w = {"p": _p, "P": _p.capitalize(), "r": _r, "p2": THINGS[_p][0], "p3": THINGS[_p][1], "r2": ASPECTS[_r][0], "r3": ASPECTS[_r][1]}
    FILES.append((f"{_new}{_i}", _rng.choice(FRAMES).format(**_w), (_rng.choice(BODIES) or "").format(**_w) or None, *(("2018-01-01", "2019-01-01") if _new == "f" else ("2021-01-01", "2021-06-01"))))
    ALIASES.append((f"{_new}{_i}", f"{_p.title()} {_r.split()[0].title()} Law"))
FILES += [("emfa", "European Media Freedom Act", None, "2022-01-01", None), ("again", "Toy trains – energy classes regime", None, "2023-06-01", None), ("none", None, None, None, None), ("amend", "Amending Regulation (EU) 2016/679 as regards zeppelin hangars", "", "2018-01-01", None)]
NUMBER = {(p, r): f"f{i}" for i, (p, r) in enumerate((p, r) for p in THINGS for r in ASPECTS)}
TEXTS = [
    ("a", "Quiet operation for outdoor lights", None, "2018-05-05", {NUMBER["garden lamps", "noise limits"]}), ("b", "Enrgy classes for toy trians", None, "2024-01-01", {"again"}), ("c", "ENERGY CLASSES FOR TOY TRAINS", "x", None, {NUMBER["toy trains", "energy classes"], "g" + NUMBER["toy trains", "energy classes"][1:], "again"}),
    ("d", "Courtesy visit", "Discussion centred on canal boats, in particular take-back from buyers.", "2018-05-05", {NUMBER["river barges", "recall duties"]}), ("e", "Pupil tables", "Nothing new. Most questions concerned ownership stamps.", "2018-05-05", {NUMBER["school desks", "anti-theft marking"]}), ("f", "Market for soup cubes", "They described a site.", "2018-05-05", set()),
    ("g", "Noise limits for aircraft", None, "2018-05-05", set()), ("h", "E.M.F.A.", None, "2022-05-05", {"emfa"}), ("i", "Sliver Grybe package, trilogue", None, "2018-05-05", {"f7"}), ("j", "Noise limits for glass jars", None, "2024-05-05", set()), ("k", None, None, None, set()),
    ("l", "", "", "2018-05-05", set()), ("m", "Talks", "They set out views on user manuals for sewing robots. They supported guaranteed lifetime where fleece covers are concerned.", "2018-01-05", {NUMBER["sewing robots", "user manuals"], NUMBER["wool blankets", "minimum durability"]}),
    ("n", "European Media Freedom Act: state of play", None, "2023-05-05", {"emfa"}), ("o", "Talks on zeppelin hangars", None, "2018-05-05", {"amend"}), ("p", "Common European approach", "as regards makers of goods", "2018-05-05", set()),
]


def test_matching(spark):
    reg = spark.createDataFrame(FILES, "id string, title string, description string, p string, q string").select("id", "title", "description", F.col("p").cast("date").alias("proposal_date"), F.col("q").cast("date").alias("decision_date"))
    aliases = spark.createDataFrame(ALIASES, "procedure_id string, alias string")
    df = spark.createDataFrame([(i, s, b, d, "x") for i, s, b, d, _ in TEXTS] + [("a", "Quiet operation for outdoor lights", None, "2018-05-05", "y")], "id string, subject string, body string, d string, confidence string").withColumn("d", F.col("d").cast("date"))
    index = matching.build_index(reg, aliases, df, "subject")
    rows = matching.match(df, reg, index, "id", "subject", "body", "d").collect()
    got = {}
    for r in rows:
        got.setdefault(r["id"], set()).add(r["procedure_id"])
        assert 0 < r["confidence"] <= 1
    assert len(rows) == len({(r["id"], r["procedure_id"]) for r in rows})
    for i, _, _, _, want in TEXTS:
        assert got.get(i, set()) == want, i
    assert matching.match(df.limit(0), reg, index, "id", "subject", "body", "d").count() == 0
    empty = matching.build_index(reg.limit(0), aliases.limit(0), df, "subject")
    assert matching.match(df, reg.limit(0), empty, "id", "subject", "body", "d").count() == 0


def test_concepts_of_a_register():
    """Concepts and wordings of a register whose sentences the code has never seen; every entry with a title is about something."""
    from tessera.llm.register import read_register

    read = read_register([f[:3] for f in FILES], [a for a in ALIASES if all(a)], matching._tokens, matching._STOP)
    plain = lambda x: " ".join(matching._tokens(x))
    want = {(plain(main), plain(w)) for main, more in [*THINGS.items(), *ASPECTS.items()] for w in (main, *more)}
    got = {(c, w) for c, x in read.wordings.items() for w in x}
    assert len(want & got) >= 0.95 * len(want) and len({x for x in got - want if x[0] in THINGS or x[0] in ASPECTS}) <= 0.05 * len(want)
    assert {read.kinds[plain(p)] for p in THINGS} == {"p"} and {read.kinds[plain(r)] for r in ASPECTS} == {"r"}
    right = [set(read.entries[k + i[1:]]) == {plain(p), plain(r)} for (p, r), i in NUMBER.items() for k in "fg"]
    assert sum(right) >= 0.95 * len(right)
    assert set(read.entries) == {f[0] for f in FILES if f[1]}


def test_one_and_three_concepts():
    """Entries with one concept need it alone; with three, each with the rarest."""
    files = [(f"x{i}", f"{a}, {b}, {c}", f"{a}; {b}; {c}") for i, (a, b, c) in enumerate([("maple syrup", "quota", "levy"), ("birch sap", "quota", "levy"), ("maple syrup", "permit", "levy")])] + [("y", "tar pits", "tar pits")]
    phrases, about = matching.phrases_of(files, [])
    ways = {}
    for key, id_, way, needs in about:
        ways.setdefault((id_, way, needs), set()).add(key)
    assert ways["y", "one", 1] == {"=tar pits"} and all(len(v) == n for (_, _, n), v in ways.items()) and {n for _, _, n in ways} == {1, 2}
    index = matching.Index(files, [], [])
    named = {k for k, _, _ in index.about_texts(["Levy and quota for birch sap"], [None])[0]}
    assert ways["x1", "all", 2] <= named and not ways["x0", "all", 2] <= named


def test_blocking_recall():
    """Hyperplane blocking against brute force over slipped phrases: at least 0.9 of what an exhaustive search finds."""
    import numpy as np

    index = matching.Index([f[:3] for f in FILES], [a for a in ALIASES if all(a)], [])
    rng, found, total = np.random.default_rng(9), 0, 0
    for _ in range(10):
        for i, p in enumerate(index.phrases):
            v = index.vector(matching._slipped(p.text, rng).split())
            if v is not None and index.matrix[i] @ v >= matching.LEAST_COSINE:
                total += 1
                found += i in index.candidates(v[None])[1]
    assert total and found / total >= 0.9


def test_links_of_all_texts(spark):
    """Walks pass through the texts of all rows and both fields, with shares that don't depend on how many rows there are."""
    vocabulary = ["bikes", "cargo", "heat", "labels", "pumps", "repair"]
    for most in (40, 3000):
        rows = [(i, f"cargo bikes {i}", f"labels for heat pumps {i}" if i % 2 else None) for i in range(most)] + [(most, "repair cargo", "")] * 5
        df = spark.createDataFrame(rows, "id int, subject string, points string")
        got = {(a, b): w for a, b, w in matching.token_links(df, ["subject", "points"], vocabulary)}
        n = most + most / 2 + 1
        want = {(a, b): matching.WALK_TEXTS / n * (most / 2 * (a in vocabulary[:2] and b in vocabulary[:2]) + most / 6 * (a in vocabulary[2:5] and b in vocabulary[2:5]) + 0.5 * (a in ("cargo", "repair") and b in ("cargo", "repair"))) for a in vocabulary for b in vocabulary}
        assert got == pytest.approx({k: w for k, w in want.items() if w})


def test_label_writings(spark):
    cases = {"EN": "en", "en-GB": "en", "el_GR": "el", "English (UK)": "en", " deutsch ": "de", "Français": "fr", "ΕΛΛΗΝΙΚΆ": "el", "POR": "pt", "und": None, "XX": None, "?": None, "": None, "unknown": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", language.label_code(F.col("x")).alias("c")).collect()
    assert {r["x"]: r["c"] for r in rows} == cases

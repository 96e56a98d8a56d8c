import pytest
from pyspark.sql import types as T

from tessera.operators.packed import Hints, register_hints, unpacked

HINTS = Hints(["małgorzata", "robert"], [("food", "feed"), ("coatings", "inks")])

CASES = [
    ("A Ltd; B Ltd", ["A Ltd", "B Ltd"]),
    ("A | B // C\tD\nE", ["A", "B", "C", "D", "E"]),
    ('"a; b"; c', ["a; b", "c"]),
    ("“Foo”;\"Bar\"", ["Foo", "Bar"]),
    ('"Initiative ""Mel"" für G e.V."; x', ['Initiative "Mel" für G e.V.', "x"]),
    ('Initiative "Mel" für G e.V.; b', ['Initiative "Mel" für G e.V.', "b"]),
    ("- A\n- B\n", ["A", "B"]),
    ("• A\n• B", ["A", "B"]),
    ("(1) x; (2) y", ["x", "y"]),
    ("1. x\n2. y", ["x", "y"]),
    ("A, B, , C,", ["A", "B", "C"]),
    ("Candzak, Małgorzata, B Ltd", ["Candzak, Małgorzata", "B Ltd"]),
    ("Candzak, Malgorzata; B", ["Candzak, Malgorzata", "B"]),
    ("A plc, EU Liaison Office, B", ["A plc, EU Liaison Office", "B"]),
    ("Brasozeno, Mardelli & Partners, B Ltd", ["Brasozeno, Mardelli & Partners", "B Ltd"]),
    ("Council of Food, Feed and Fibre Traders, B", ["Council of Food, Feed and Fibre Traders", "B"]),
    ("Seed Testers, Alpine Network of; B", ["Seed Testers, Alpine Network of", "B"]),
    ('"A", "B, C"', ["A", "B, C"]),
    ('"A\n  B", C', ["A B", "C"]),
    ('"open; x', ["open", "x"]),
    ('""; x', ["x"]),
    ("-", []),
    ("", []),
    ("  ", []),
    (None, []),
    ("Costs 1,5 million; B", ["Costs 1,5 million", "B"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "id int, raw string")
    got = {}
    for r in unpacked(df, "id", "raw", HINTS).collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["value"]
    for i, (raw, want) in enumerate(CASES):
        values = got.get(i, {})
        assert [values[k] for k in sorted(values)] == want, raw
        assert sorted(values) == list(range(1, len(want) + 1))


def test_least_and_clashing_columns(spark):
    df = spark.createDataFrame([("m", "A;B", "x", 1), ("n", "A", "y", 2), ("m", "A;B", "x", 1)], "id string, raw string, value string, pos int")
    rows = unpacked(df, "id", "raw", value="organization", least=2).collect()
    assert sorted((r["id"], r["pos"], r["organization"]) for r in rows) == [("m", 1, "A"), ("m", 1, "A"), ("m", 2, "B"), ("m", 2, "B")]


def test_long_and_empty(spark):
    df = spark.createDataFrame([("a", ";".join(f"Body {i}" for i in range(2000)))], "id string, raw string")
    rows = unpacked(df, "id", "raw").collect()
    assert len(rows) == 2000 and {r["value"] for r in rows if r["pos"] == 2000} == {"Body 1999"}
    assert unpacked(df.limit(0), "id", "raw").count() == 0


def test_hints(spark):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("organization_type", T.StringType())])
    reg = spark.createDataFrame([("Robert Foo", "self_employed"), ("Council of Food, Feed Traders", "association"), (None, "company")], schema)
    hints = register_hints(reg)
    assert hints.given == ["robert"] and hints.around == [("food", "feed")]


@pytest.mark.parametrize("n", [0, 1])
def test_register_without_rows(spark, n):
    reg = spark.createDataFrame([("Foo", "company")] * n, "name string, organization_type string")
    assert register_hints(reg).given == []


def test_hints_of_too_large_registers(spark, monkeypatch):
    import pytest

    from tessera.operators import packed

    register = spark.createDataFrame([("Foo, Bar", "company"), ("Moo, Baz", "company")], "name string, organization_type string")
    assert len(packed.register_hints(register).around) == 2
    for bound in ("MOST_REGISTER", "MOST_WORDS"):
        with monkeypatch.context() as m:
            m.setattr(packed, bound, 1)
            with pytest.raises(ValueError):
                packed.register_hints(register)


def test_large_register(spark):
    """A register of 60,000 rows with thousands of given names gives the same answers as a small one."""
    from pyspark.sql import functions as F

    names = [f"{a}{b}{c}ik" for a in "bcdfghjklmnprstv" for b in "aeiou" for c in "bcdfghjklmnprstvwxz"]
    small = [("Małgorzata Foo", "self_employed"), ("Council of Food, Feed Traders", "association")]
    people = spark.createDataFrame([(f"{n} Foo", "self_employed") for n in names] + small, "name string, organization_type string")
    bodies = spark.range(60_000).select(F.concat(F.lit("Body "), F.col("id").cast("string")).alias("name"), F.lit("company").alias("organization_type"))
    raws = ["Candzak, Malgorzata, B Ltd", "A of Food, Feed and Fibre, B", "X, Y"]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    answers = [sorted(map(tuple, unpacked(df, "id", "raw", register_hints(reg)).collect())) for reg in (people.unionByName(bodies), spark.createDataFrame(small, "name string, organization_type string"))]
    assert answers[0] == answers[1] and (0, 1, "Candzak, Malgorzata") in answers[0] and (1, 1, "A of Food, Feed and Fibre") in answers[0]


def test_recombined(spark):
    from tessera.operators.packed import recombined

    known = spark.createDataFrame([("Foo, Bar and Baz",), ("Bar and Baz",), ("Foo",), (None,)], "name string")
    df = spark.createDataFrame([("a", "X, foo , Bar and Baz,Y"), ("a", "X, foo , Bar and Baz,Y"), ("b", "Bar and Baz"), ("c", None), ("d", " , "), ("e", "Foo,Foo")], "id string, raw string")
    got = sorted(map(tuple, recombined(df, "id", "raw", known, "name").collect()))
    assert got == [("a", 1, "X", False), ("a", 2, "foo, Bar and Baz", True), ("a", 3, "Y", False), ("b", 1, "Bar and Baz", True), ("e", 1, "Foo", True), ("e", 2, "Foo", True)]
    assert recombined(df, "id", "raw", known.limit(0), "name").where("resolved").count() == 0

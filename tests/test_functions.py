import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import stats as S
from tessera.functions import text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values) or "x string")
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("name, strict, light", [
    ("Foo Ltd", "foo", "foo"), ("foo ltd bar", "foobar", "foobar"), ("Foo (Bar) GmbH", "foo", "foo bar"), ("Énergie & Co", "énergieco", "énergie co"), ("", "", ""), (None, "", ""),
])
def test_keys(spark, name, strict, light):
    assert one(spark, X.name_key(F.col("x")), x=name) == strict
    assert one(spark, X.display_key(F.col("x")), x=name) == light


def test_names(spark):
    assert one(spark, X.clean_name(F.col("x")), x="TotalFoo Mr. Eric Bar, M. Gio Baz") == "TotalFoo"
    assert one(spark, X.clean_name(F.col("x")), x="A|B|C") == "A"
    assert one(spark, X.search_variants(F.col("x")), x="Foo (Bar) Brussels") == ["Foo (Bar) Brussels", "Foo (Bar)", "Foo Brussels"]
    assert one(spark, X.name_order(F.col("x")), x="DUPONT Marie (PPE)") == "Marie DUPONT (PPE)"
    assert one(spark, X.without_filler(F.col("x")), x="Exchange of views on the Foo Act") == "Foo Act"
    assert one(spark, X.without_filler(F.col("x")), x="Riunione sull’energia") == "energia"
    assert one(spark, X.location(F.col("x")), x="Bruxelles, Belgium") == "Brussels"
    assert one(spark, X.location(F.col("x")), x="") == "" and one(spark, X.location(F.col("x")), x="Paris, France.") == "Paris, France" and one(spark, X.location(F.col("x")), x="Tokio, Japan") == "Tokyo"
    assert one(spark, X.location(F.col("x")), x="Berlaymont / webex") == "Brussels (Online)" and one(spark, X.location(F.col("x")), x="video call") == "Online" and one(spark, X.location(F.col("x")), x=None) is None
    assert one(spark, X.target_article(F.col("x")), x="article 5 – paragraph 2") == "Article 5"
    assert one(spark, X.com_variants(F.col("x")), x="COM(2021)0206") == ["COM(2021)206", "COM(2021)0206", "COM/2021/206", "COM 2021 206"]
    assert one(spark, X.file_ids(F.col("x")), x="2021/0106(COD), 2021/0106(COD), 2020/1(cod)") == ["2021/0106(COD)"]
    assert one(spark, X.diff_summary(F.col("a"), F.col("b")), a="x", b="y") == "BEFORE: x AFTER: y"
    assert one(spark, X.json_in_prose(F.col("x")), x="Here: ```json\n[1, 2]\n```") == "[1, 2]"
    assert one(spark, X.html_url(F.col("x")), x="http://a.example/doc_EN.pdf#page=2") == "https://a.example/doc_EN.html"


def test_uuid5(spark):
    rows = spark.createDataFrame([("a::b",), ("ü",), ("",)], "x string").select("x", X.uuid5(F.col("x")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["x"])) for r in rows)


def test_dates(spark):
    assert str(one(spark, D.any_date(F.col("x")), x="21.04.2021")) == "2021-04-21"
    assert one(spark, D.any_date(F.col("x")), x="soon") is None
    day = lambda c: F.col(c).cast("date")
    fits = D.in_force(day("d"), day("p"), day("q"), day("l"))
    assert one(spark, fits, d="2021-01-01", p="2022-06-01", q="2023-01-01", l=None)
    assert not one(spark, fits, d="2020-01-01", p="2022-06-01", q="2023-01-01", l=None)
    assert not one(spark, fits, d="2024-01-01", p="2022-06-01", q="2023-01-01", l="2024-01-01")
    assert one(spark, fits, d="2024-01-01", p="2022-06-01", q=None, l="2023-12-01")
    assert one(spark, fits, d=None, p="2022-06-01", q="2023-01-01", l=None)
    assert one(spark, D.nearest_anchor(day("d"), day("p"), day("q")), d="2021-01-05", p="2021-01-01", q=None) == 4
    assert one(spark, D.nearest_anchor(day("d"), day("p")), d="2021-01-05", p=None) == D.NO_ANCHOR


def test_gini(spark):
    rows = [("a", 0), ("a", 0), ("b", 1), ("b", 1), ("c", 0), ("c", 10), ("d", None), ("e", 1), ("e", 2), ("e", 3), ("e", 3)]
    got = {r["g"]: round(r["gini"], 9) for r in S.gini(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    v = np.sort([1, 2, 3, 3])
    want = (len(v) + 1 - 2 * np.sum(np.cumsum(v)) / v.sum()) / len(v)
    assert got == {"a": 0.0, "b": 0.0, "c": 0.5, "e": round(want, 9)}


def test_regressions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 1))
    mu = np.exp(0.5 + 0.7 * x[:, 0])
    y = rng.poisson(rng.gamma(2.0, mu / 2.0))
    fit = S.negative_binomial(y.astype(float), x, np.ones(400))
    assert abs(fit["coefficients"][1] - 0.7) < 0.15 and 0.2 < fit["alpha"] < 1.0 and 0 < fit["pseudo_r2"] < 1
    low, high = S.bootstrap_f1([True] * 8 + [False] * 2, [True] * 7 + [False] * 3, 500)
    assert 0.6 < low < high <= 1

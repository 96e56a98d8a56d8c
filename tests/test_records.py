import numpy as np
from pyspark.sql import functions as F

from tessera.functions import records as R


def val(spark, column, schema="x string", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def test_lookups(spark):
    m = {"company": "Companies", "trade": "Associations"}
    assert val(spark, R.keyed(F.col("x"), m, "Other"), row=("Company",)) == "Companies"
    assert val(spark, R.keyed(F.col("x"), m, "Other"), row=("a trade company",)) == "Companies"
    assert val(spark, R.keyed(F.col("x"), m, "Other")) == "Other"
    assert val(spark, R.target_type(F.col("x")), row=("Article 5 – point a",)) == "article"
    assert val(spark, R.celex(F.col("x")), row=("Regulation (EU) 2021/694",)) == "32021R0694" and val(spark, R.celex(F.col("x")), row=("letter",)) is None
    assert val(spark, R.markup_clean(F.col("x")), row=("a ​b ▌ \n  c",)) == "a b\nc"


def test_minutes(spark):
    text = "Location: Brussels\nPoints raised:\n- First\n- Second\nConclusions: N/A"
    assert val(spark, R.minutes_field(F.col("x"), "points"), row=(text,)) == "First\nSecond"
    assert val(spark, R.minutes_field(F.col("x"), "conclusions"), row=(text,)) is None
    assert val(spark, R.minutes_field(F.col("x"), "location"), row=(text,)) == "Brussels"
    assert val(spark, R.minutes_field(F.col("x"), "points")) is None


def test_nested(spark):
    files = "x array<struct<format:string,url:string>>"
    assert val(spark, R.preferred_file(F.col("x")), files, ([("pdf", "p"), ("HTML", "h"), ("zip", "z")],)) == "h"
    assert val(spark, R.preferred_file(F.col("x")), files, ([("zip", "z"), (None, "n")],)) == "z"
    events = "x array<struct<title:string,date:string>>"
    assert val(spark, R.stage(F.col("x")), events, ([("Proposal published", "1"), (None, "2"), ("Act signed", "3"), ("Other", "4")],)) == "completed"
    assert val(spark, R.stage(F.col("x")), events, ([],)) is None
    assert [e["source"] for e in val(spark, R.tagged(F.col("x"), F.array(F.lit("a")), "one", "two"), events, ([("a", "1"), ("b", "2")],))] == ["one", "two"]
    actors = "x array<struct<name:string,role:string>>"
    assert len(val(spark, R.with_institution(F.col("x"), "Council", F.lit(True)), actors, ([("Parliament", "r")],))) == 2
    assert len(val(spark, R.with_institution(F.col("x"), "Parliament", F.lit(True)), actors, ([("Parliament", "r")],))) == 1
    assert val(spark, R.files_by_url(F.col("x")), "x array<array<struct<url:string,name:string>>>", ([[("u", "a"), ("v", "b")], [("u", "c")]],)) == {"u": "c", "v": "b"}
    assert val(spark, R.by_language(F.col("x")), "x map<string,string>", ({"fr": "F"},)) == "F"


def test_chi_square_and_grid(spark):
    rows = [("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "z")] * 4 + [(None, "x")]
    df = spark.createDataFrame(rows, "r string, c string")
    t = np.array([[8, 2, 0], [3, 0, 4]], float)
    e = t.sum(1, keepdims=True) * t.sum(0) / t.sum()
    got = R.chi_square(df, "r", "c").first()
    assert abs(got["statistic"] - ((t - e) ** 2 / e).sum()) < 1e-9 and got["dof"] == 2
    assert R.parameter_grid(df.limit(2), prompt=["A", "B"], temperature=[0.0, 0.5, 1.0]).count() == 12


def test_streams(spark, tmp_path):
    from pyspark.sql import types as T

    from tessera.streaming import incremental as I

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType())])
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 02:00:00")], "id long, t string").select("id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = I.events_stream(spark, f"file://{tmp_path}/in", schema)
    for name, df, mode in (("once", I.first_in_time(stream, "ts", ["id"]), "append"), ("wins", I.counts_in_windows(stream, "ts", "1 hour", "1 hour"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["id"] for r in spark.table("once").collect()) == [1, 2]
    assert sorted(r["n"] for r in spark.table("wins").collect()) == [1, 2]

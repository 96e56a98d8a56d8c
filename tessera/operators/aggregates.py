"""Aggregations: access counts, dyads, organisation level, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import f1, safe_ratio

LABELS = ["ALIGNED", "OPPOSING", "UNDETECTABLE", "NOISE"]


def access_counts(one: DataFrame, two: DataFrame, key: str, names: tuple[str, str] = ("n_one", "n_two")) -> DataFrame:
    """Rows of two sources for each key that either has, and their sum; null keys are left out."""
    a = one.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(names[0]))
    b = two.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(names[1]))
    both = a.join(b, key, "full").fillna(0, list(names))
    return both.withColumn("n_total", F.col(names[0]) + F.col(names[1]))


def label_rank(label: Column) -> Column:
    out = F.when(label == LABELS[0], 0)
    for i, x in enumerate(LABELS[1:], 1):
        out = out.when(label == x, i)
    return out.otherwise(len(LABELS))


def collapse_dyads(pairs: DataFrame, keys: list[str], label: str, score: str, order: str, keep: list[str]) -> DataFrame:
    """One row a dyad: the best label by rank, then the best score; n_chunks; whether labels conflict. Null keys stay."""
    best = F.min(F.struct(label_rank(F.col(label)).alias("r"), (-F.col(score)).alias("s"), F.col(order).alias("o"), F.col(label).alias("label"), F.col(score).alias("score"), *[F.col(k).alias(f"k_{k}") for k in keep])).alias("__b")
    both = F.bool_or(F.col(label) == "ALIGNED") & F.bool_or(F.col(label) == "OPPOSING")
    out = pairs.groupBy(*keys).agg(best, F.count("*").alias("n_chunks"), F.coalesce(both, F.lit(False)).alias("conflict"))
    return out.select(*keys, F.col("__b.label").alias(label), F.col("__b.score").alias(score), *[F.col(f"__b.k_{k}").alias(k) for k in keep], "n_chunks", "conflict")


def organisation_level(dyads: DataFrame, org: str, label: str, item: str, meetings: str, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Each organisation: meetings, rows of each label, distinct items. Null organisations are left out."""
    counts = [F.count_if(F.col(label) == x).alias(f"n_{x.lower()}") for x in LABELS]
    return dyads.where(F.col(org).isNotNull()).groupBy(org, *extra).agg(F.coalesce(F.max(meetings), F.lit(0)).alias("meetings_total"), *counts, F.count("*").alias("n_rows"), F.count_distinct(item).alias("n_items"))


def plurality(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """The most frequent label of each key; of equals the one met first."""
    counts = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", F.upper(label).alias("label"), F.col("n").alias("n"))).alias("__b"))
    return best.select(key, F.col("__b.label").alias("label"), F.col("__b.n").alias("n"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0)


def monthly(df: DataFrame, day: Column, category: str, values: list[str]) -> DataFrame:
    """Rows a month and category, zero where there are none."""
    return df.withColumn("month", F.trunc(day.cast("date"), "month")).groupBy("month").pivot(category, values).agg(F.count(F.lit(1))).fillna(0, values)


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts for links: a wrong link is a false positive and a false negative. Nulls mean no link."""
    g, p = F.col(gold), F.col(predicted)
    return df.agg(
        F.count_if(g.isNotNull() & p.isNotNull() & (g == p)).alias("tp"), F.count_if(p.isNotNull() & (g.isNull() | (g != p))).alias("fp"), F.count_if(g.isNotNull() & (p.isNull() | (g != p))).alias("fn"), F.count_if(g.isNull() & p.isNull()).alias("tn")
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def per_class(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class; zero where a division fails."""
    both = df.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = both.select(F.col("g").alias("label"), "n", (F.col("g") == F.col("p")).alias("hit"), F.lit("g").alias("side")).unionByName(both.select(F.col("p").alias("label"), "n", (F.col("g") == F.col("p")).alias("hit"), F.lit("p").alias("side")))
    c = sides.where(F.col("label").isNotNull()).groupBy("label").agg(F.sum(F.when(F.col("side") == "g", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when((F.col("side") == "g") & F.coalesce(F.col("hit"), F.lit(False)), F.col("n")).otherwise(0)).alias("tp"))
    p, r = safe_ratio(F.col("tp"), F.col("predicted")), safe_ratio(F.col("tp"), F.col("support"))
    return c.select("label", "support", "predicted", "tp", p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def stability(df: DataFrame, item: str, label: str) -> DataFrame:
    """Each item's majority label (of equals the smaller), and whether all its labels agree."""
    n = df.groupBy(item, label).agg(F.count("*").alias("n"))
    return n.groupBy(item).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label"))).alias("__b"), F.sum("n").alias("n_runs"), (F.count("*") == 1).alias("stable")).select(item, F.col("__b.label").alias("majority"), "n_runs", "stable")


def top_with_ties_first(df: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """The n most frequent keys; of equals those met first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n).select(key, "n")


def summary(df: DataFrame, groups: list[str], item: str, value: str) -> DataFrame:
    """Distinct items, median, mean, maximum and the share of positive values of each group."""
    v = F.col(value).cast("double")
    return df.groupBy(*groups).agg(F.count_distinct(item).alias("n_items"), F.percentile(v, 0.5).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("largest"), (F.count_if(v > 0) / F.count("*")).alias("share_positive"))


def nth(df: DataFrame, key: str, order: list[str], n: int, value: str) -> DataFrame:
    """The value of each key's n-th row."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == n).select(key, value)


def themes_of(text: Column, themes: dict[str, list[str]]) -> Column:
    """The themes whose keyword patterns a text matches, in their order."""
    found = [F.when(F.coalesce(text.rlike("(?i)(" + "|".join(p) + ")"), F.lit(False)), F.lit(t)) for t, p in themes.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def theme_paragraphs(text: Column, patterns: list[str], most: int = 2000) -> Column:
    """The paragraphs that match, else the whole text; cut at `most` characters."""
    rx = "(?i)(" + "|".join(patterns) + ")"
    hits = F.array_join(F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(rx)), "\n\n")
    return F.substring(F.when(hits == "", text).otherwise(hits), 1, most)

"""Windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_of


def content_dedupe(df: DataFrame, id_col: str, content: list[str], order: list[str]) -> DataFrame:
    """Two passes: the first row of each id, then the first of each content (lowered, trimmed, collapsed)."""
    o = [F.col(c) for c in order]
    once = first_of(df, [id_col], o)
    keys = {f"__k{i}": F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"\s+", " ")) for i, c in enumerate(content)}
    return first_of(once.withColumns(keys), list(keys), [*o, F.col(id_col)]).drop(*keys)


def ranked_by_distance(df: DataFrame, group: str, distance: str, order: str, rank: str = "rank") -> DataFrame:
    """Rank 1 is the nearest; of equals the one that comes first is."""
    w = Window.partitionBy(group).orderBy(distance, order)
    return df.withColumn(rank, F.row_number().over(w)).withColumn("is_primary", F.col(rank) == 1)


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last value seen up to each row, its own included."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def blocks(df: DataFrame, group: list[str], order: list[str], is_header, out: str = "block") -> DataFrame:
    """Numbers blocks that header rows open; rows before the first header are block 0."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(is_header, 1).otherwise(0)).over(w))


def neighbours(df: DataFrame, group: list[str], index: str, text: str) -> DataFrame:
    """The texts before and after each row, only where the index has no gap."""
    w = Window.partitionBy(*group).orderBy(index)
    before = F.when(F.lag(index).over(w) == F.col(index) - 1, F.lag(text).over(w))
    after = F.when(F.lead(index).over(w) == F.col(index) + 1, F.lead(text).over(w))
    return df.withColumn("previous_text", before).withColumn("next_text", after)


def top_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bundled(df: DataFrame, group: str, order: str, size: str, most: int, close_at: float = 0.75) -> DataFrame:
    """Greedy bundles: a bundle closes when it holds close_at of `most`, or when the next row doesn't fit.

    The fold runs over an array of each group's sizes, inside the JVM.
    """
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("__rows"))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<o:bigint,b:bigint>>").alias("out"))

    def step(acc, r):
        fresh = (acc["held"] > 0) & ((acc["held"] + r["s"] > most) | (acc["held"] >= close_at * most))
        b = F.when(fresh, acc["b"] + 1).otherwise(acc["b"])
        held = F.when(fresh, r["s"]).otherwise(acc["held"] + r["s"])
        return F.struct(b.alias("b"), held.alias("held"), F.concat(acc["out"], F.array(F.struct(r["o"].cast("long").alias("o"), b.alias("b")))).alias("out"))

    folded = rows.select(group, F.explode(F.aggregate("__rows", start, step)["out"]).alias("__x"))
    return folded.select(group, F.col("__x.o").alias(order), F.col("__x.b").alias("bundle"))

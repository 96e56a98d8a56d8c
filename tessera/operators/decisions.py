"""What becomes of an outside classifier's answers: batches lined up with their items, labels checked, fallbacks taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import LABELS, themes_of


def lined_up(items: DataFrame, answers: DataFrame, batch: str, pos: str, strict: bool = False) -> DataFrame:
    """items with the answer of their place in their batch (column `answer`), null where there is none.

    `answers` has one array a batch (column `answers`). Arrays that are too short are padded with nulls and longer ones
    cut; with strict, an array of another length than its batch's counts for nothing. Places count from 0.
    """
    a = answers.select(batch, F.col("answers").alias("__a"))
    if strict:
        sizes = items.groupBy(batch).agg(F.count("*").alias("__n"))
        a = a.join(sizes, batch).where(F.size("__a") == F.col("__n")).drop("__n")
    return items.join(a, batch, "left").withColumn("answer", F.try_element_at("__a", (F.col(pos) + 1).cast("int"))).drop("__a")


def confirmed(answer: Column, candidate: Column) -> Column:
    """The candidate where the answer is a certain one, else 'no_match'."""
    return F.when(F.coalesce(F.lower(F.trim(answer)) == "high", F.lit(False)), candidate).otherwise("no_match")


def labelled(answer: Column, fallback: str | None = "NOISE") -> Column:
    """A label of the domain, else the fallback (null: the row is to be dropped)."""
    label = F.upper(F.trim(answer))
    return F.when(label.isin(LABELS), label).otherwise(F.lit(fallback).cast("string"))


def known_themes(answers: Column, text: Column, themes: dict[str, list[str]]) -> Column:
    """The answered themes that the taxonomy has, in its order; those that the text matches where none is left."""
    kept = F.filter(F.array(*[F.lit(t) for t in themes]), lambda t: F.coalesce(F.array_contains(answers, t), F.lit(False)))
    return F.when(F.size(kept) > 0, kept).otherwise(themes_of(text, themes))


def relevant(df: DataFrame, flag: str) -> DataFrame:
    """Rows that aren't said to be irrelevant."""
    return df.where(F.coalesce(F.col(flag), F.lit(True)))

"""Linking dated titles to register entries in three exact steps, and fuzzy candidates for names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..session import bounded_rows
from .joins import alias_in_text

#: Different keys of a register that names are compared with; a larger one is refused.
MOST_REGISTER = 200_000


def link_titles(titles: DataFrame, entries: DataFrame, aliases: DataFrame, id_col: str, title_col: str, day_col: str) -> DataFrame:
    """(record, entry, method, rank, is_primary): links of each title, nearest entry first.

    Steps, the first that yields links wins: ids cited in the title, an alias that equals the title (with and without
    its opening phrase), the longest alias that the title contains; dates must fit in the last two. Generic and very
    short titles give nothing. The longest alias is chosen before its dates are looked at.
    """
    squeezed = X.squeezed(F.col(title_col))
    t = titles.select(F.col(id_col).alias("record"), F.col(day_col).alias("day"), F.col(title_col).alias("title"), squeezed.alias("k")).where(F.col("title").isNotNull()).distinct()
    e = entries.select(F.col("id").alias("entry"), "proposal_date", "decision_date", "last_activity_date")
    cited = t.select("record", "day", F.explode(X.file_ids(F.col("title"))).alias("entry")).join(e, "entry").withColumn("step", F.lit(1)).withColumn("method", F.lit("cited"))
    usable = t.where((F.length("k") >= 3) & ~F.col("k").isin(X.GENERIC_TITLES))
    a = aliases.select(F.col("procedure_id").alias("entry"), X.squeezed(F.col("alias")).alias("k")).where(F.col("k") != "").distinct().join(e, "entry")
    keys = usable.select("record", "day", F.explode(F.array_distinct(F.array("k", X.squeezed(X.without_filler(F.col("k")))))).alias("k"))
    exact = keys.join(a, "k").drop("k").withColumn("step", F.lit(2)).withColumn("method", F.lit("alias_exact"))
    held = alias_in_text(usable.select("record", "title"), aliases, "record", "title").withColumnRenamed("alias", "w")
    words = F.trim(F.regexp_replace("k", "[^a-z0-9]+", " "))
    inside = usable.select("record", "day").distinct().join(held, "record").join(a.withColumn("w", words), "w").drop("w", "k").withColumn("step", F.lit(3)).withColumn("method", F.lit("alias_substring"))
    fits = D.in_force(F.col("day"), F.col("proposal_date"), F.col("decision_date"), F.col("last_activity_date"))
    both = cited.unionByName(exact.where(fits)).unionByName(inside.where(fits)).distinct()
    first = both.withColumn("__s", F.min("step").over(Window.partitionBy("record"))).where(F.col("step") == F.col("__s"))
    far = D.nearest_anchor(F.col("day"), F.col("proposal_date"), F.col("decision_date"), F.col("last_activity_date"))
    near = Window.partitionBy("record").orderBy(far, "entry")
    return first.withColumn("rank", F.row_number().over(near)).select("record", "entry", "method", "rank", (F.col("rank") == 1).alias("is_primary"))


def _counts(keys: list[str], q: int) -> np.ndarray:
    """How often runs of q characters occur in each key; runs may share a place, which only makes keys look more alike."""
    out = np.zeros((len(keys), 256), np.uint8)
    for i, k in enumerate(keys):
        for j in range(len(k) - q + 1):
            at = ord(k[j]) if q == 1 else (37 * ord(k[j]) + ord(k[j + 1])) % 256
            out[i, at] += out[i, at] < 255
    return out


def near_keys(key: str, singles: np.ndarray, doubles: np.ndarray, lengths: np.ndarray, floor: float) -> np.ndarray:
    """Places of all keys that can score `floor` against this one, and some that don't. With d edits to the longer length n,
    at least n - d characters are common, and n - 1 - 2 d pairs of neighbours."""
    n = np.maximum(lengths, len(key))
    edits = np.floor(n * (1 - (floor - 0.001) / 100))
    at = np.flatnonzero(np.minimum(lengths, len(key)) >= n - edits)
    at = at[np.minimum(singles[at], _counts([key], 1)).sum(1, dtype=np.int32) >= np.minimum(n - edits, 255)[at]]
    return at[np.minimum(doubles[at], _counts([key], 2)).sum(1, dtype=np.int32) >= np.minimum(n - 1 - 2 * edits, 255)[at]]


def fuzzy_candidates(names: DataFrame, register: DataFrame, name_col: str, reg_name: str, reg_id: str, top: int = 3, floor: float = 60.0, reg_acronym: str | None = None) -> DataFrame:
    """(name, id, score, rank): exact keys score 100, a name of up to ten characters that is an acronym 95, others by edit distance over the longer key.

    Every pair that can reach the floor is compared: only lengths and common characters rule pairs out (`near_keys`).
    The register has at most MOST_REGISTER keys, else the call is refused.
    """
    key = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]", "")
    n = names.select(F.col(name_col).alias("name"), key(name_col).alias("k")).distinct()
    r = register.select(F.col(reg_id).alias("id"), key(reg_name).alias("rk")).where(F.length("rk") >= 3)
    rows = bounded_rows(r.select("rk").distinct(), MOST_REGISTER)
    if rows is None:
        raise ValueError(f"the register has more than {MOST_REGISTER} keys")
    keys = sorted(x["rk"] for x in rows)
    shared = names.sparkSession.sparkContext.broadcast((_counts(keys, 1), _counts(keys, 2), np.array([len(k) for k in keys], np.int64)))  # bounded by MOST_REGISTER

    @F.pandas_udf("array<int>")
    def near(batch: pd.Series) -> pd.Series:
        return pd.Series([near_keys(k, *shared.value, floor).tolist() for k in batch], dtype=object)

    places = names.sparkSession.createDataFrame(list(enumerate(keys)), "place int, rk string")
    typed = n.where(F.length("k") >= 3)
    pairs = typed.select("k").distinct().select("k", F.explode(near("k")).alias("place")).join(F.broadcast(places), "place")
    score: Column = F.when(F.col("k") == F.col("rk"), 100.0).otherwise(100.0 * (1 - F.levenshtein("k", "rk") / F.greatest(F.length("k"), F.length("rk"))))
    pairs = pairs.select("k", "rk", F.round(score, 4).alias("score")).where(F.col("score") >= floor)
    scored = typed.join(pairs, "k").join(r, "rk").select("name", "id", "score")
    if reg_acronym:
        short = register.select(F.col(reg_id).alias("id"), key(reg_acronym).alias("k")).where(F.length("k") > 0)
        scored = scored.unionByName(n.where(F.length("k") <= 10).join(short, "k").select("name", "id", F.lit(95.0).alias("score")))
    scored = scored.groupBy("name", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("name", "id", "score", "rank")


def decision_band(score: Column, accept: float = 96.0, floor: float = 93.0) -> Column:
    """What happens to a candidate: accepted as it is, sent to a decider, or dropped."""
    return F.when(score >= accept, "auto_accept").when(score >= floor, "to_decider").otherwise("no_match")

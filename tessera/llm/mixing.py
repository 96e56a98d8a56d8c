"""Mixing sources to target shares of tokens under limits on repetition.

The family of weights is w_i(a) ~ target_i^(1-a) * share_i^a, where share_i is the source's own share of the tokens:
a = 0 gives the targets, a = 1 the sources as they are. The exponent is bisected until the repetition limits (or a
given entropy) are met; the weights then become token budgets, and each budget becomes whole passes over the source
plus the beginning of one more pass in a fixed random order that is laid out in blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_rows, stored

#: Most rows that the table of targets may have; it is read by the driver.
MOST_TARGETS = 10_000
#: Documents that a block of a source's order holds on average.
BLOCK_DOCUMENTS = 20_000


@dataclass
class Source:
    name: str
    target: float
    repeats: int
    tokens: int
    docs: int


def tempered(sources: list[Source], exponent: float) -> list[float]:
    total = sum(s.tokens for s in sources)
    raw = [s.target ** (1 - exponent) * (s.tokens / total) ** exponent for s in sources]
    return [r / sum(raw) for r in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisected(fits, steps: int = 60) -> float:
    """The smallest exponent in [0, 1] that fits, where larger ones fit too; 1 if none does."""
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def plan(sources: list[Source], total_tokens: float | None = None, target_entropy: float | None = None) -> tuple[float, float, list[float]]:
    """(total, exponent, weights). Without a total: the largest one at which the limits allow the targets exactly."""
    if not sources:
        return 0.0, 0.0, []
    exponent = 0.0
    if target_entropy is not None:
        h0, h1 = entropy(tempered(sources, 0.0)), entropy(tempered(sources, 1.0))
        exponent = bisected(lambda a: (entropy(tempered(sources, a)) - target_entropy) * (h1 - h0) >= 0)
    most = lambda w: min(s.repeats * s.tokens / x for s, x in zip(sources, w) if x > 0)
    if total_tokens is None:
        weights = tempered(sources, exponent)
        return most(weights), exponent, weights
    exponent = max(exponent, bisected(lambda a: most(tempered(sources, a)) >= total_tokens * (1 - 1e-12)))
    weights = tempered(sources, exponent)
    full: set[int] = set()  # a total beyond what even the sources' own shares allow: full sources stay full, the rest shares the rest
    while len(full) < len(sources):
        over = [i for i, s in enumerate(sources) if i not in full and weights[i] * total_tokens > s.repeats * s.tokens * (1 + 1e-9)]
        if not over:
            break
        full |= set(over)
        for i in over:
            weights[i] = sources[i].repeats * sources[i].tokens / total_tokens
        left, raw = max(0.0, 1 - sum(weights[i] for i in full)), sum(weights[i] for i in range(len(sources)) if i not in full)
        weights = [w if i in full or not raw else w / raw * left for i, w in enumerate(weights)]
    total_tokens = min(total_tokens, sum(s.repeats * s.tokens for s in sources))
    return total_tokens, exponent, [w / sum(weights) for w in weights]


def mix(sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", total_tokens: float | None = None, target_entropy: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents with their number of repeats, one report row a source).

    `targets` has source, target_weight and max_repeats. Weights are divided by their sum over sources that have
    tokens; sources without a target, null sources and documents of size null or 0 stay out. Target rows of the same
    source add their weights and take the smallest limit; rows with a null, zero or negative weight or limit count
    for nothing. Repeated document ids are separate documents. Empty inputs give empty results.
    """
    spark = sizes.sparkSession
    rows = bounded_rows(targets.select("source", "target_weight", "max_repeats"), MOST_TARGETS)
    if rows is None:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted: dict[str, tuple[float, int]] = {}
    for name, weight, repeats in rows:
        if name is not None and (weight or 0) > 0 and (repeats or 0) > 0:
            had = wanted.get(name, (0.0, repeats))
            wanted[name] = (had[0] + weight, min(had[1], repeats))
    docs = sizes.select(F.col(id_col), F.col(source_col).alias("__source"), F.col(size_col).cast("long").alias("__size")).where((F.col("__size") > 0) & F.col("__source").isin(sorted(wanted)))
    totals = {r[0]: (r[1], r[2]) for r in docs.groupBy("__source").agg(F.sum("__size"), F.count("*")).collect()}  # a row a target at most
    scale = sum(wanted[s][0] for s in totals)
    sources = [Source(s, wanted[s][0] / scale, wanted[s][1], *totals[s]) for s in sorted(totals)]
    total, exponent, weights = plan(sources, total_tokens, target_entropy)

    quota = []
    for s, w in zip(sources, weights):
        budget = min(w * total, s.repeats * s.tokens) * (1 + 1e-12)
        passes = min(s.repeats, int(budget // s.tokens))
        rest = 0.0 if passes >= s.repeats else budget - passes * s.tokens
        quota.append((s.name, s.target, w, s.repeats, s.tokens, s.docs, passes, rest, max(1, math.ceil(s.docs / BLOCK_DOCUMENTS))))
    schema = "__source string, target_share double, weight double, max_repeats int, available_tokens long, available_docs long, __passes int, __rest double, __blocks int"
    plan_df = F.broadcast(spark.createDataFrame(quota, schema))  # no more rows than targets, which are counted above

    placed = docs.join(plan_df.select("__source", "__passes", "__rest", "__blocks"), "__source")
    placed = placed.withColumn("__place", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("__block", F.pmod(F.shiftright("__place", 7), F.col("__blocks")))
    order = Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("__source", "__block").agg(F.sum("__size").alias("__in_block")).withColumn("__before", F.coalesce(F.sum("__in_block").over(order), F.lit(0)))
    placed = placed.join(blocks, ["__source", "__block"])
    whole = F.col("__before") + F.col("__in_block") <= F.col("__rest")
    inside = (F.col("__before") < F.col("__rest")) & ~whole  # one block a source: only it is sorted
    in_block = Window.partitionBy("__source", "__block").orderBy("__place", id_col).rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where(inside).withColumn("__extra", (F.col("__before") + F.sum("__size").over(in_block) <= F.col("__rest")).cast("int"))
    rest = placed.where(~inside).withColumn("__extra", whole.cast("int"))
    chosen = cut.unionByName(rest).select(F.col(id_col), F.col("__source").alias(source_col), F.col("__size").alias(size_col), (F.col("__passes") + F.col("__extra")).alias("repeats"))

    used = chosen.groupBy(F.col(source_col).alias("__source")).agg(
        F.sum(F.col(size_col) * F.col("repeats")).alias("mixed_tokens"), F.sum("repeats").alias("mixed_docs"), F.count_if(F.col("repeats") > 0).alias("distinct_docs"), F.max("repeats").alias("most_repeats"),
    )
    together = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # over no more rows than targets
    report = (
        plan_df.join(used, "__source")
        .select(
            F.col("__source").alias("source"), "target_share", "weight", (F.col("mixed_tokens") / together).alias("actual_share"), "available_docs", "available_tokens", "mixed_docs", "distinct_docs", "mixed_tokens",
            (F.col("mixed_tokens") / F.col("available_tokens")).alias("mean_repeats"), "most_repeats", "max_repeats", F.lit(float(exponent)).alias("exponent"),
        )
    )
    return chosen.where("repeats > 0"), report


def ordered(chosen: DataFrame, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """Every copy of a mix with its epoch (from 0), block (from 0) and place in the block (from 1), beside chosen's columns.

    Copies fall into blocks by hash, so each block has the mix's shares but for chance and copies of one document lie
    apart; reading blocks in order of number and each by place gives the permutation. Blocks hold BLOCK_DOCUMENTS copies
    on average, whatever the mix, so only blocks are sorted. An empty mix gives no row.
    """
    copies = chosen.select("*", F.explode(F.sequence(F.lit(0), F.col("repeats").cast("int") - 1)).alias("epoch"))
    n = chosen.agg(F.sum("repeats")).first()[0] or 0
    key = lambda k: F.xxhash64(F.col(id_col), F.col("epoch"), F.lit(k))
    placed = copies.withColumn("block", F.pmod(key(seed), F.lit(max(1, math.ceil(n / BLOCK_DOCUMENTS)))))
    inside = Window.partitionBy("block").orderBy(key(seed + 1), id_col, "epoch")
    return placed.withColumn("place", F.row_number().over(inside))


def sized(documents: DataFrame, **options) -> DataFrame:
    """Every document's number of tokens, stored once because a mix reads it several times."""
    from .bpe import encode_documents

    return stored(encode_documents(documents, "doc_id", "text", counts_only=True, keep=("source",), **options), "mix-sizes")

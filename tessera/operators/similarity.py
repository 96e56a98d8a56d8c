"""Reciprocal nearest neighbours over embeddings, and retrieval measures."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one side of a block: two such sides and their scores fit into a task whatever the table.
BLOCK = 4_096


def block_pairs(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str, vector: str, find: Callable[..., dict], schema: str, extra: str | None = None) -> DataFrame:
    """What `find` says of each pair of blocks of queries and corpus, both cut by the hash of their ids.

    A stated query set against all rows, in blocks: every query block meets every corpus block once, in a cogroup, so
    nothing goes through the driver but the two counts. find(q_ids, q_extra, q_matrix, c_ids, c_extra, c_matrix) returns
    a dict of columns; rows with a null vector don't take part. `extra` names a column that both sides bring along.
    """
    kept = lambda df, i, n: df.where(F.col(n).isNotNull() & F.col(vector).isNotNull()).select(F.col(n).cast("long").alias("id"), (F.col(extra) if extra else F.lit(None)).cast("long").alias("x"), F.transform(vector, lambda v: v.cast("double")).alias("v"), F.lit(i).alias("side"))
    q, c = kept(queries, 0, q_id), kept(corpus, 1, c_id)
    n_q, n_c = (max(1, -(-df.count() // BLOCK)) for df in (q, c))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = q.select("id", "x", "v", own(n_q).alias("qb"), every(n_c).alias("cb"))
    right = c.select("id", "x", "v", every(n_q).alias("qb"), own(n_c).alias("cb"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = []
        for t in (a, b):
            values = t.column("v").combine_chunks()
            flat = values.flatten().to_numpy(zero_copy_only=False)
            sides += [t.column("id").to_numpy(), t.column("x").to_pylist(), flat.reshape(len(values), -1) if len(values) else np.zeros((0, 1))]
        found = find(*sides) if len(sides[0]) and len(sides[3]) else {}
        return pa.table({f.name: pa.array(found.get(f.name, []), f.type) for f in target})

    target = _arrow(schema)
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.split() for x in schema.split(","))])


def scored_pairs(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str, vector: str, floor: float, same: bool = False) -> DataFrame:
    """(q, c, score) of every pair at or above the floor, in double precision. Null vectors give nothing.

    A pair below the floor never becomes a row. With same, a vector isn't its own neighbour.
    """

    def find(q, _qx, a, c, _cx, b):
        scores = a @ b.T
        i, j = np.nonzero(scores >= floor)
        other = q[i] != c[j] if same else np.ones(len(i), bool)
        i, j = i[other], j[other]
        return {"q": q[i], "c": c[j], "score": scores[i, j]}

    return block_pairs(queries, corpus, q_id, c_id, vector, find, "q long, c long, score double")


def label_ranks(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str, vector: str, label: str, digits: int = 6) -> DataFrame:
    """(q, rank): the rank of the nearest item with the query's own label among all others; of equal scores the smaller id is first.

    Two passes over blocks: the best item of its label in each block, then how many items come before it. No pair becomes a row.
    """

    def best(q, ql, a, c, cl, b):
        scores = np.round(a @ b.T, digits)
        scores[(np.array(ql, object)[:, None] != np.array(cl, object)[None, :]) | (q[:, None] == c[None, :])] = -np.inf
        order = np.argsort(c, kind="stable")
        at = order[scores[:, order].argmax(axis=1)]
        top = scores[np.arange(len(q)), at]
        ok = np.isfinite(top)
        return {"q": q[ok], "c": c[at[ok]], "score": top[ok]}

    gold = block_pairs(queries.where(F.col(label).isNotNull()), corpus, q_id, c_id, vector, best, "q long, c long, score double", label)
    gold = gold.groupBy("q").agg(F.max(F.struct("score", (-F.col("c")).alias("c"))).alias("g"))
    asked = queries.join(gold.select(F.col("q").alias(q_id), F.col("g.score").alias("__score"), (-F.col("g.c")).alias("__c")), q_id)
    # the gold item's score and id travel behind the query's vector
    longer = asked.withColumn(vector, F.concat(F.transform(vector, lambda v: v.cast("double")), F.array(F.col("__score"), F.col("__c").cast("double"))))

    def before(q, _ql, a, c, _cl, b):
        a, top, own = a[:, :-2], a[:, -2:-1], a[:, -1:]
        scores = np.round(a @ b.T, digits)
        ahead = ((scores > top) | ((scores == top) & (c[None, :] < own))) & (q[:, None] != c[None, :])
        return {"q": q, "n": ahead.sum(axis=1)}

    counts = block_pairs(longer, corpus, q_id, c_id, vector, before, "q long, n long")
    return counts.groupBy("q").agg((F.sum("n") + 1).alias("rank"))


def nearest_queries(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """(q, c, score, place): of each item its k nearest queries, a vector not being its own; of equals the smaller id. Each block yields k a item."""

    def find(q, _qx, a, c, _cx, b):
        scores = np.round(b @ a.T, digits)
        scores[c[:, None] == q[None, :]] = -np.inf
        order = np.argsort(q, kind="stable")
        near = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
        i = np.repeat(np.arange(len(c)), near.shape[1])
        s = scores[i, near.ravel()]
        ok = np.isfinite(s)
        return {"q": q[near.ravel()[ok]], "c": c[i[ok]], "score": s[ok]}

    w = Window.partitionBy("c").orderBy(F.desc("score"), "q")
    return block_pairs(queries, corpus, q_id, c_id, vector, find, "q long, c long, score double").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest_items(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str, vector: str, digits: int = 6) -> DataFrame:
    """(q, c): each query's nearest item; of equals the smaller id."""

    def find(q, _qx, a, c, _cx, b):
        scores = np.round(a @ b.T, digits)
        scores[q[:, None] == c[None, :]] = -np.inf
        order = np.argsort(c, kind="stable")
        at = order[scores[:, order].argmax(axis=1)]
        top = scores[np.arange(len(q)), at]
        ok = np.isfinite(top)
        return {"q": q[ok], "c": c[at[ok]], "score": top[ok]}

    best = block_pairs(queries, corpus, q_id, c_id, vector, find, "q long, c long, score double")
    return best.groupBy("q").agg(F.max(F.struct("score", (-F.col("c")).alias("c"))).alias("b")).select("q", (-F.col("b.c")).alias("c"))


def reciprocal(pairs: DataFrame, n_queries: int, k: int = 5, k_reverse: int = 10, digits: int = 6) -> DataFrame:
    """Of scored pairs those where the query is among the item's k_reverse best and the item among the query's k best.

    The reverse filter comes first, and only if there are at least k_reverse queries; of equals the smaller id wins.
    Scores are rounded first, so that engines that add in another order agree.
    """
    s = pairs.withColumn("score", F.round("score", digits))
    if n_queries >= k_reverse:
        back = Window.partitionBy("c").orderBy(F.desc("score"), "q")
        s = s.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= k_reverse).drop("__r")
    forth = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return s.withColumn("rank", F.row_number().over(forth)).where(F.col("rank") <= k)


def gold_ranks(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """The rank of each query's gold item (columns q, c) among its scored items; null if it isn't among them."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return gold.join(pairs.withColumn("rank", F.row_number().over(w)).select("q", "c", "rank"), ["q", "c"], "left")


def retrieval(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Mean reciprocal rank and recall at k; items that weren't found count as 0."""
    r = F.col("rank")
    return ranks.agg(F.count("*").alias("n"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks])

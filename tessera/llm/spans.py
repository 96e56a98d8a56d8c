"""Long spans of text that occur word for word in more than one record.

Records become walks in a sparse de Bruijn graph. Its nodes are anchors: character k-mers whose hash is the smallest in
some window; an edge is the text from one anchor to the end of the next, known by its hash. Their sizes are such that
any span of LEAST characters holds two anchors that are chosen in every record that has the span, and so an edge that
all of them have (see `anchors`). Edges of two or more records are kept; where every record that takes one edge takes
the same next one, and the other way round, the path is compacted, and only its first edge is compared. The records'
coordinates on the compacted paths then verify the spans, character by character where a path alone is too short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, stored

LEAST = 300
#: Bits of the filter that keeps records without a path from being joined, as a power of two.
MOST_BITS = 26

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0xD6E8FEB86659FD93)


def sizes(least: int) -> tuple[int, int]:
    """(k, w): length of an anchor and number of neighbouring k-mers among which the smallest is one.

    A span of `least` characters has least - k + 1 k-mers, at least 2 * w: two windows that don't overlap lie inside.
    The smallest of the first and of the second are anchors wherever the span occurs, and windows that reach beyond
    the span can add anchors before the first or behind the second, but none between them.
    """
    k = max(4, least * 4 // 25)
    return k, max(1, (least - k + 1) // 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _SEED
    return h ^ (h >> np.uint64(29))


def _windows(x: np.ndarray, size: int, least) -> np.ndarray:
    """The least (or largest) of each window of that size, from windows of half the size."""
    done = 1
    while done * 2 <= size:
        x = least(x[:-done], x[done:])
        done *= 2
    return least(x[: len(x) - (size - done)], x[size - done :]) if size > done else x


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, 2 * len(_POWERS)), _INVERSE, np.uint64))))
    return _POWERS


def edges_of(texts: list[str], k: int, w: int, least: int) -> tuple[np.ndarray, ...]:
    """(text's number, hash, start, end, left, right) of every edge of some texts, in order. Runs of one edge are kept by two edges at each end.

    left and right are hashes of half of what the edge lacks of `least` characters, before and behind it; 0 where the
    text has no such half. A longer edge lacks nothing: its left is 1 and its right 0.
    """
    none = np.zeros(0, np.int64)
    joined = "\0".join(texts)
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n = len(c)
    if n < k + w:
        return none, none, none, none, none, none
    with np.errstate(over="ignore"):
        c = _mixed(c + _BASE)
        power = _powers(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * power[:n])))
        # a k-mer's hash from its place's sum, moved to place 0: dividing by the place's power means multiplying by the base's
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
        h = _mixed((sums[k:] - sums[:-k]) * back[: n - k + 1])
        for a, size in zip(first, lengths):  # k-mers that reach into the next text are no anchors
            h[max(a, a + size - k + 1) : a + size + 1] = np.uint64(0xFFFFFFFFFFFFFFFF)
        if len(h) < w:
            return none, none, none, none, none, none
        lowest = _windows(h, w, np.minimum)
        padded = np.concatenate((np.zeros(w - 1, np.uint64), lowest, np.zeros(w - 1, np.uint64)))
        at = np.flatnonzero((_windows(padded, w, np.maximum) == h) & (h != np.uint64(0xFFFFFFFFFFFFFFFF)))
        if len(at) < 2:
            return none, none, none, none, none, none
        owner = np.searchsorted(first, at, side="right") - 1
        same = owner[1:] == owner[:-1]
        a, b, own = at[:-1][same], at[1:][same] + k, owner[:-1][same]
        e = _mixed((sums[b] - sums[a]) * back[a]) + (b - a).astype(np.uint64)
        repeat = (e[1:] == e[:-1]) & (own[1:] == own[:-1])
        ahead = np.concatenate((repeat, [False]))  # the next edge is the same
        after_ = np.concatenate(([False], repeat))
        inner = ahead & np.append(ahead[1:], False) & after_ & np.append(False, after_[:-1])
        keep = ~inner
        own, a, b, e = own[keep], a[keep], b[keep], e[keep]
        half = np.maximum((least - (b - a) + 1) // 2, 0)
        one = np.uint64(1)
        before, behind = np.maximum(a - half, 0), np.minimum(b + half, n)
        left = np.where(half == 0, one, np.where(a - half >= first[own], _mixed((sums[a] - sums[before]) * back[before]) | one, np.uint64(0)))
        right = np.where((half > 0) & (b + half <= first[own] + lengths[own]), _mixed((sums[behind] - sums[b]) * back[b]) | one, np.uint64(0))
    return own, e.view(np.int64), a - first[own], b - first[own], left.view(np.int64), right.view(np.int64)


def edges(df: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(e, doc, s, t, left, right): every edge of every text of at least `least` characters; see edges_of."""
    k, w = sizes(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            lo, size = 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t)
                if size >= 400_000 or hi == len(texts):
                    own, e, s, t_, left, right = edges_of(texts[lo:hi], k, w, least)
                    columns = [pa.array(e, pa.int64()), ids.take(pa.array(own + lo, pa.int64())), pa.array(s.astype(np.int32)), pa.array(t_.astype(np.int32)), pa.array(left, pa.int64()), pa.array(right, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["e", "doc", "s", "t", "left", "right"])
                    lo, size = hi, 0

    schema = T.StructType([T.StructField("e", T.LongType()), T.StructField("doc", df.schema[id_col].dataType), T.StructField("s", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("left", T.LongType()), T.StructField("right", T.LongType())])
    return df.where((F.length(df[text_col]) >= least) & df[id_col].isNotNull()).select(df[id_col], df[text_col]).mapInArrow(run, schema)


def _one_of(df: DataFrame, key: Column) -> Callable[[Column], Column]:
    """A test that every key of df passes, and few others: a bit for each key's hash. It only saves a join from shuffling
    rows without partner. The bits are ten a key, 2^MOST_BITS at most; the more keys there are beyond that, the less is saved."""
    n = df.agg(F.approx_count_distinct(key)).first()[0] or 0
    bits = 1 << min(MOST_BITS, max(10, (10 * n).bit_length()))
    place = F.pmod(key, F.lit(bits))
    held = df.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 AS int))) AS b")).toPandas()
    words = np.zeros(bits >> 5, np.uint32)
    words[held["w"].to_numpy(np.int64)] = held["b"].to_numpy(np.int64).astype(np.uint32)
    shared = df.sparkSession.sparkContext.broadcast(words)  # 2^MOST_BITS bits at most

    @F.pandas_udf("boolean")
    def passes(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy(np.int64) % bits
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0)

    return passes


def repeated(all_edges: DataFrame) -> DataFrame:
    """(e, doc, s, t): edges that two or more records have, with half of what the edge lacks of a span on one side.

    The edges are written once. Who shares an edge, and then a half of one, is told by the least and the largest record
    of each, which are combined before the exchange; the joins back have one row a key on one side, so that a hot edge's
    rows can be split over tasks.
    """
    edge_table = stored(all_edges, "edges")
    shared = lambda df, keys: df.groupBy(*keys).agg(F.min("doc").alias("__a"), F.max("doc").alias("__b")).where(F.col("__a") < F.col("__b")).select(*keys)
    often = stored(shared(edge_table, ["e"]), "often")
    few = edge_table.where(_one_of(often, often["e"])(edge_table["e"]))
    kept = stored(few.join(often, "e", "left_semi"), "shared-edges")
    discard(edge_table, often)
    halves = kept.select("e", "doc", "s", "t", F.posexplode(F.array("left", "right")).alias("side", "half")).where(F.col("half") != 0)
    return halves.join(shared(halves, ["e", "side", "half"]), ["e", "side", "half"], "left_semi").select("e", "doc", "s", "t").distinct()


def compacted(occurrences: DataFrame, k: int) -> DataFrame:
    """(head, doc, s, t): each record's nonbranching paths, named by their first edge."""
    along = Window.partitionBy("doc").orderBy("s", "t", "e")  # no more rows than a record has edges
    walk = occurrences.withColumn("__next", F.when(F.lead("s").over(along) == F.col("t") - k, F.lead("e").over(along)))
    count = walk.groupBy("e").agg(F.count("*").alias("n"))
    links = walk.where(F.col("__next").isNotNull()).groupBy("e", "__next").agg(F.count("*").alias("n_link"))
    plain = links.join(count.select("e", F.col("n").alias("n_e")), "e").join(count.select(F.col("e").alias("__next"), F.col("n").alias("n_next")), "__next")
    plain = plain.where((F.col("n_link") == F.col("n_e")) & (F.col("n_link") == F.col("n_next")) & (F.col("e") != F.col("__next"))).select("e", "__next", F.lit(True).alias("__goes_on"))
    marked = walk.join(plain, ["e", "__next"], "left")
    path = marked.withColumn("__head", ~F.coalesce(F.lag("__goes_on").over(along), F.lit(False))).withColumn("__path", F.sum(F.col("__head").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return path.groupBy("doc", "__path").agg(F.min_by("e", "s").alias("head"), F.min("s").alias("s"), F.max("t").alias("t")).select("head", "doc", "s", "t")


@F.pandas_udf(T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())]))
def _common(a_left: pd.Series, b_left: pd.Series, a_right: pd.Series, b_right: pd.Series) -> pd.DataFrame:
    """How many characters two contexts have in common, to the left (from the end) and to the right."""
    from os.path import commonprefix

    left = [len(commonprefix((x[::-1], y[::-1]))) for x, y in zip(a_left, b_left)]
    right = [len(commonprefix((x, y))) for x, y in zip(a_right, b_right)]
    return pd.DataFrame({"left": left, "right": right}, dtype="int32")


def _near(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(head, doc, copy, s, t, left, right): every record's paths with what is around them; copies of a text share `copy`."""
    k, _ = sizes(least)
    found = stored(compacted(repeated(edges(df, id_col, text_col, least)), k), "paths")
    texts = df.where(F.length(df[text_col]) >= least).select(df[id_col].alias("doc"), df[text_col].alias("__text"))
    texts = texts.where(_one_of(found, F.xxhash64(found["doc"]))(F.xxhash64(texts["doc"])))
    # a context of `least` characters on both sides; only records with a path are joined to their texts
    near = found.join(texts, "doc").select(
        "head", "doc", F.sha2("__text", 256).alias("copy"), "s", "t",
        F.expr(f"substring(__text, greatest(s - {least}, 0) + 1, least(s, {least}))").alias("left"), F.expr(f"substring(__text, t + 1, {least})").alias("right"),
    )
    out = stored(near, "near")
    discard(found)
    return out


def _text_spans(near: DataFrame, least: int) -> DataFrame:
    """(a, b, start_a, end_a, start_b, end_b), a < b: spans that two different texts share; a text counts once, whatever its copies."""
    size = F.col("t") - F.col("s")
    once = near.groupBy("head", "copy", "s", "t").agg(F.first("left").alias("left"), F.first("right").alias("right"))
    # what a path lacks of a span must follow on one side by half at least: texts meet only where that half is the same
    once = once.withColumn("__lack", F.greatest(F.ceil((F.lit(least) - size) / 2), F.lit(0)).cast("int"))
    left = F.when(F.length("left") >= F.col("__lack"), F.xxhash64(F.lit("left"), "head", F.expr("substring(left, -__lack, __lack)")))
    right = F.when((F.col("__lack") > 0) & (F.length("right") >= F.col("__lack")), F.xxhash64(F.lit("right"), "head", F.expr("substring(right, 1, __lack)")))
    once = once.withColumn("__key", F.explode(F.array(left, right))).where(F.col("__key").isNotNull())
    a, b = once.alias("a"), once.alias("b")
    pairs = a.join(b, (F.col("a.__key") == F.col("b.__key")) & (F.col("a.head") == F.col("b.head")) & (F.col("a.copy") < F.col("b.copy"))).select(
        F.col("a.copy").alias("a"), F.col("b.copy").alias("b"), F.col("a.s").alias("s"), F.col("a.t").alias("t"), F.col("b.s").alias("b_s"), F.col("b.t").alias("b_t"),
        _common(F.col("a.left"), F.col("b.left"), F.col("a.right"), F.col("b.right")).alias("__c"),
    )
    spans = pairs.where(size + F.col("__c.left") + F.col("__c.right") >= least)
    return spans.select(
        "a", "b", (F.col("s") - F.col("__c.left")).alias("start_a"), (F.col("t") + F.col("__c.right")).alias("end_a"), (F.col("b_s") - F.col("__c.left")).alias("start_b"), (F.col("b_t") + F.col("__c.right")).alias("end_b")
    )


def sharing_pairs(df: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(doc_id_a, doc_id_b): each pair of records with a common span of at least `least` characters, once.

    Exact up to collisions of 64-bit hashes of edges. Texts are compared once, whatever their copies; pairs of records
    are written out only at the end. Case and white space count. Null, empty and short texts give nothing; several
    rows with one id count as one record.
    """
    near = _near(df, id_col, text_col, least)
    copies = near.select("copy", "doc").distinct()
    pairs = _text_spans(near, least).select("a", "b").distinct()
    across = pairs.join(copies.select(F.col("copy").alias("a"), F.col("doc").alias("x")), "a").join(copies.select(F.col("copy").alias("b"), F.col("doc").alias("y")), "b").where(F.col("x") != F.col("y"))
    within = copies.select("copy", F.col("doc").alias("x")).join(copies.select("copy", F.col("doc").alias("y")), "copy").where(F.col("x") < F.col("y"))
    both = across.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).unionByName(within.select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b")))
    return both.distinct()


def shared_share(df: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """One row a record: n_chars, shared_chars, share of its text that also occurs in another record, n_copies, n_sharing_texts.

    n_copies counts records with the same text, n_sharing_texts other texts that share a span; no pairs of records are
    made. Texts under `least` characters, null and empty ones share nothing. Several rows with one id count as one
    record, with the longest text.
    """
    near = _near(df, id_col, text_col, least)
    copies = near.select("copy", "doc").distinct()
    number = copies.groupBy("copy").agg((F.count("*") - 1).alias("n_copies"))
    spans = _text_spans(near, least)
    one = spans.select(F.col("a").alias("copy"), F.col("b").alias("other"), F.col("start_a").alias("s"), F.col("end_a").alias("t"))
    both = one.unionByName(spans.select(F.col("b").alias("copy"), F.col("a").alias("other"), F.col("start_b").alias("s"), F.col("end_b").alias("t")))
    partners = both.groupBy("copy").agg(F.count_distinct("other").alias("n_sharing_texts"))
    cover = both.groupBy("copy", "s").agg(F.max("t").alias("t"))
    before = Window.partitionBy("copy").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # no more rows than a text has characters
    reach = F.coalesce(F.max("t").over(before), F.lit(0))
    covered = cover.withColumn("__new", F.greatest(F.col("t") - F.greatest(F.col("s"), reach), F.lit(0))).groupBy("copy").agg(F.sum("__new").alias("shared_chars"))
    by_text = number.join(covered, "copy", "left").join(partners, "copy", "left")
    by_doc = copies.join(by_text, "copy").groupBy("doc").agg(F.max("n_copies").alias("n_copies"), F.max("shared_chars").alias("shared_chars"), F.max("n_sharing_texts").alias("n_sharing_texts"))
    docs = df.groupBy(df[id_col].alias("doc")).agg(F.max(F.coalesce(F.length(df[text_col]), F.lit(0))).alias("n_chars"))
    zero: Column = F.lit(0).cast("long")
    chars = F.when(F.col("n_copies") > 0, F.col("n_chars").cast("long")).otherwise(F.coalesce("shared_chars", zero))
    joined = docs.join(by_doc, "doc", "left").withColumn("shared_chars", chars)
    return joined.select(
        F.col("doc").alias(id_col), "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("share"), F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("n_sharing_texts", zero).alias("n_sharing_texts")
    )

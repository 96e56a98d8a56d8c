"""Text that was decoded with the wrong character encoding: where it is, and what it was.

Every pair of neighbouring characters gets a score from the corpus's mutual information: a pair that contributes little
of it is improbable. Maximum-scoring segments over these scores isolate improbable runs; only inside them are inverse
mappings (encode with the supposed wrong encoding, decode with the right one) tried, and one counts when it makes the
run and its neighbours far more probable. Replacement characters mark what is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

#: Pair tables have this many places, whatever the corpus.
PLACES = 1_048_573
#: Share of all pairs with a character beyond ASCII that counts as improbable: the rarest by contribution.
IMPROBABLE = 0.35
#: Share of all rows that copies of one text count for at most.
MOST_SHARE = 0.001
#: Bits that an inverse mapping must gain over a run and its two neighbours.
MARGIN = 9.0
#: Score of a pair of ASCII characters in the search for segments; probable and improbable pairs have -1 and +1.
PLAIN = -1.5

# Encodings that text was in, and that it was read with.
RIGHT = ["utf-8", "cp1252", "cp1250", "cp1253", "mac_roman", "cp850", "cp437", "iso8859_2", "iso8859_7", "mac_greek", "cp852", "cp737"]
WRONG = ["cp1252", "latin_1", "cp1250", "mac_roman", "cp850", "cp437", "cp1253", "iso8859_2", "iso8859_7", "iso8859_15", "cp852", "cp737"]

LOST = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")


def _bytes_of(encoding: str) -> dict[str, int]:
    """Characters as bytes; where the encoding has no character for a byte, the control character of that number."""
    out = {}
    for b in range(255, 127, -1):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


_BYTES = {w: _bytes_of(w) for w in WRONG}
_CHARS = {r: {b: c for c, b in _bytes_of(r).items()} for r in RIGHT if r != "utf-8"}


def inverses(run: str) -> list[tuple[str, str, str]]:
    """(wrong, right, text) for each mapping that can have made this run of characters beyond ASCII."""
    out, seen = [], {run}
    for wrong in WRONG:
        table = _BYTES[wrong]
        try:
            data = bytes([table[c] for c in run])
        except KeyError:
            continue
        for right in RIGHT:
            if right == wrong:
                continue
            if right == "utf-8":
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    continue
            else:
                chars = _CHARS[right]
                text = "".join([chars[b] for b in data])
            if text not in seen:
                seen.add(text)
                out.append((wrong, right, text))
    return out


_GREEK = re.compile(r"[\u0370-\u03ff\u1f00-\u1fff]+")
_CYRILLIC = re.compile(r"[\u0400-\u052f]+")
_NOT_TEXT = re.compile(r"[\x80-\x9f\ue000-\uf8ff�]")


def believable(before: str, run: str, after: str, text: str) -> bool:
    """Whether an inverse's text can be an original: no control or private characters, and a run that is all of one script,
    and no part of a Latin word, can only come from that script."""
    if _NOT_TEXT.search(text):
        return False
    for script in (_GREEK, _CYRILLIC):
        if len(run) > 1 and script.fullmatch(run) and not (before.isascii() and before.islower()) and not (after.isascii() and after.islower()):
            return bool(script.fullmatch(text))
    return True


def place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * 1_000_003 + b) % PLACES


def most_copies(df: DataFrame, text_col: str) -> int:
    """How often one text may count: MOST_SHARE of all rows, or as many copies as the text of the middle row has, with rows
    in the order of how many copies their text has. A group of less than half of all rows can't raise either by its copies."""
    copies = df.where(df[text_col].isNotNull()).groupBy(F.xxhash64(df[text_col]).alias("h")).agg(F.count("*").alias("c"))
    middle, rows = copies.agg(F.expr("percentile(c, 0.5, c)"), F.sum("c")).first()
    return int(max(middle or 1, MOST_SHARE * (rows or 0)))


def pair_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(a, b, n): how often neighbouring characters occur where one of them is beyond ASCII. Counted within each task first.

    A text counts as often as it has copies, but no more often than `most_copies`: else a garbled text with many
    copies makes its own pairs probable. For that, df has all rows, those of plain ASCII too.
    """
    most = most_copies(df, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            c = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
            times = np.repeat(batch.column(1).to_numpy(), [len(t) + 1 for t in texts])
            at = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127)) if len(c) > 1 else np.zeros(0, np.int64)
            found, of = np.unique((c[at].astype(np.int64) << 32) | c[at + 1], return_inverse=True)
            n = np.bincount(of, times[at], len(found)).astype(np.int64)
            keys, inverse = np.unique(np.concatenate((keys, found)), return_inverse=True)
            sizes = np.bincount(inverse, np.concatenate((sizes, n)), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sizes)], names=["a", "b", "n"])

    texts = df.where(df[text_col].rlike(r"[^\x00-\x7f]")).groupBy(df[text_col].alias("t")).agg(F.least(F.count("*"), F.lit(most)).alias("times"))
    return texts.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass
class Scores:
    """Two tables of PLACES places: log2 of a pair's probability, and whether it is improbable."""

    bits: np.ndarray
    improbable: np.ndarray
    unseen: float


def pair_scores(counts: DataFrame) -> Scores:
    """Scores of all pairs. A pair's contribution to the mutual information is n * log2(n * N / (n_a * n_b)).

    The result has a fixed size: pairs that share a place count together, and no more than PLACES rows come to the driver.
    """
    counts = stored(counts, "pair-counts")  # a row for each pair of characters; read several times
    left = counts.groupBy("a").agg(F.sum("n").alias("n_a"))
    right = counts.groupBy("b").agg(F.sum("n").alias("n_b"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    bits, improbable = np.full(PLACES, np.nan, np.float32), np.ones(PLACES, bool)
    unseen = float(np.log2(0.02 / max(total, 1)))
    if total:
        worth = F.col("n") * F.greatest(F.log2(F.col("n") * F.lit(float(total)) / F.col("n_a") / F.col("n_b")), F.lit(0.05))
        rows = counts.join(left, "a").join(right, "b").select(F.pmod(F.col("a").cast("long") * 1_000_003 + F.col("b"), F.lit(PLACES)).alias("p"), "n", worth.alias("w"))
        got = rows.groupBy("p").agg(F.sum("n").alias("n"), F.max("w").alias("w")).toPandas()
        at, n = got["p"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
        bits[at] = np.log2(n / total)
        order = np.argsort(got["w"].to_numpy(), kind="stable")
        improbable[at[order[np.cumsum(n[order]) > IMPROBABLE * total]]] = False
    bits[np.isnan(bits)] = unseen
    discard(counts)
    return Scores(bits, improbable, unseen)


def segments(score: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) (Ruzzo and Tompa's definition), from left to right, in linear time."""
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum up to, the nearest earlier one with a smaller sum before
    total = 0.0
    for i, s in enumerate(score):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, j = i, before, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((start, i + 1, low, total, j))
                break
            start, _, low, _, earlier = kept[j]
            del kept[j:]
            j = earlier
    return [(a, b) for a, b, *_ in kept]


def _clusters(loss: list[float]) -> list[tuple[int, int]]:
    """Maximum-scoring segments of improbable pairs that score 1 each, as [first, last + 1), with what is lost between them."""
    if not loss:
        return [(0, 1)]
    score, back = [1.0], [0]
    for k, x in enumerate(loss, 1):
        if x > 0:
            score.append(-x)
            back.append(-1)
        score.append(1.0)
        back.append(k)
    return [(back[a], back[b - 1] + 1) for a, b in segments(score)]


class Repairer:
    """Finds and repairs runs; remembers what it has seen, as the same words come again and again."""

    def __init__(self, scores: Scores, memory: int = 200_000):
        self.scores, self.memory = scores, memory
        self.known: dict[str, tuple[str, float, tuple[str, str] | None]] = {}

    def bits(self, text: str) -> float:
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        pairs = (c[:-1] > 127) | (c[1:] > 127)
        return float(self.scores.bits[place(c[:-1][pairs], c[1:][pairs])].sum())

    def best(self, before: str, run: str, after: str) -> tuple[str, float, tuple[str, str] | None]:
        """(text, bits gained, mapping) of the best inverse; once more on its result, for text garbled twice."""
        key = f"{before}\0{run}\0{after}"
        if (found := self.known.get(key)) is None:
            now = self.bits(before + run + after)
            found = (run, 0.0, None)
            tried = [(w, r, t) for w, r, t in inverses(run)]
            for w, r, t in list(tried):
                if r == "utf-8" and len(t) > 0 and any(c > "\x7f" for c in t):
                    tried += [(f"{w}+{w2}", r2, "".join(x)) for w2, r2, x in self.again(t) if r2 == "utf-8"]
            for w, r, t in tried:
                if believable(before, run, after, t) and (gain := self.bits(before + t + after) - now) > found[1]:
                    found = (t, gain, (w, r))
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[key] = found
        return found

    @staticmethod
    def again(text: str) -> list[tuple[str, str, str]]:
        """The inverses of a text whose runs all take the same mapping."""
        runs = _RUN.findall(text)
        out = []
        for w, r, _ in inverses(runs[0]) if runs else []:
            try:
                out.append((w, r, _RUN.sub(lambda m: bytes([_BYTES[w][c] for c in m[0]]).decode("utf-8") if r == "utf-8" else m[0], text)))
            except (KeyError, UnicodeDecodeError):
                continue
        return out

    def segments_of(self, c: np.ndarray) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs, as [start, end) of characters."""
        at = np.flatnonzero((c[:-1] > 127) | (c[1:] > 127)) if len(c) > 1 else np.zeros(0, np.int64)
        if not len(at):
            return [(0, len(c))] if len(c) == 1 and c[0] == 0xFFFD else []
        bad = self.scores.improbable[place(c[at], c[at + 1])] | (c[at] == 0xFFFD) | (c[at + 1] == 0xFFFD)
        b = np.flatnonzero(bad)
        if not len(b):
            return []
        # between two improbable pairs lie probable ones and plain ones; together they only lower the sum
        others = np.diff(b) - 1
        loss = (others - PLAIN * (np.diff(at[b]) - 1 - others)).tolist()
        starts = at[b].tolist()  # a segment begins and ends with an improbable pair
        out, first = [], 0
        for i in range(1, len(starts) + 1):
            # no segment reaches over what loses at least as much as all improbable pairs before gain: its beginnings have positive sums
            if i == len(starts) or i - first <= loss[i - 1]:
                out += [(starts[first + lo], starts[first + hi - 1] + 2) for lo, hi in _clusters(loss[first : i - 1])]
                first = i
        return out

    def repair(self, text: str) -> list[tuple[int, int, str | None, float, str | None]]:
        """(start, end, restored text or None where it is lost, bits gained, mapping) of every garbled run, in order."""
        out: list[tuple[int, int, str | None, float, str | None]] = []
        runs = [m.span() for m in _RUN.finditer(text)]
        if not runs:
            return out
        k = 0
        for a, b in self.segments_of(np.frombuffer(text.encode("utf-32-le"), np.uint32)):
            while k < len(runs) and runs[k][0] < b:
                s, e = runs[k]
                if e > a:
                    if LOST in text[s:e]:
                        out.append((s, e, None, 0.0, None))
                    else:
                        new, gain, how = self.best(text[s - 1 : s] if s else "\n", text[s:e], text[e : e + 1] or "\n")
                        if gain > MARGIN:
                            out.append((s, e, new, gain, "->".join(how)))
                    k += 1
                elif e <= a:
                    k += 1
        return out

    def garbled(self, texts: list[str | None]) -> np.ndarray:
        """Which texts have a garbled run, by the same segments as `repair`."""
        return np.array([bool(t) and not t.isascii() and bool(self.repair(t)) for t in texts], bool)

    def restored(self, text: str) -> str:
        for s, e, new, _, _ in reversed(self.repair(text)):
            if new is not None:
                text = text[:s] + new + text[e:]
        return text


_REPAIRERS: dict[str, Repairer] = {}


def _repairer(scores, key: str) -> Repairer:
    if key not in _REPAIRERS:
        _REPAIRERS.clear()
        _REPAIRERS[key] = Repairer(scores.value)
    return _REPAIRERS[key]


def _shared(df: DataFrame, scores: Scores):
    import uuid

    return df.sparkSession.sparkContext.broadcast(scores), uuid.uuid4().hex  # two tables of PLACES places


def _groups(texts: list[str | None], most: int = 300_000) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def is_garbled(df: DataFrame, text: Column, scores: Scores) -> Column:
    """Whether a text has a wrongly decoded passage, restorable or not. False for null, empty and plain ASCII texts."""
    shared, key = _shared(df, scores)

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        repairer = _repairer(shared, key)
        for batch in batches:
            yield pd.Series(np.concatenate([repairer.garbled(g) for g in _groups(batch.tolist())] or [np.zeros(0, bool)]))

    return test(text)


def restored(df: DataFrame, text: Column, scores: Scores) -> Column:
    """The text with every restorable passage restored; null stays null, and what is lost stays as it is."""
    shared, key = _shared(df, scores)

    @F.pandas_udf("string")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        repairer = _repairer(shared, key)
        for batch in batches:
            yield pd.Series([t if t is None or t.isascii() else repairer.restored(t) for t in batch], dtype=object)

    return fix(text)


def passages(df: DataFrame, keys: list[str], text_col: str, scores: Scores) -> DataFrame:
    """One row a garbled run: the keys, start, end (code points, from 0), found, restored (null where lost), bits, mapping."""
    shared, key = _shared(df, scores)

    @F.pandas_udf("array<struct<start:int,end:int,found:string,restored:string,bits:double,mapping:string>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        repairer = _repairer(shared, key)
        for batch in batches:
            yield pd.Series([[] if not t or t.isascii() else [(s, e, t[s:e], new, gain, how) for s, e, new, gain, how in repairer.repair(t)] for t in batch], dtype=object)

    beyond = df.where(df[text_col].rlike(r"[^\x00-\x7f]"))
    return beyond.select(*[beyond[k] for k in keys], F.explode(find(beyond[text_col])).alias("__p")).select(*keys, "__p.*")

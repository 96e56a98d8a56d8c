"""Content-defined splitting of oversized texts.

A rolling hash over a window of characters marks landmarks that depend on nothing but the characters around them; each
landmark snaps to the nearest natural boundary; a piece ends at the first snapped landmark between the minimum and the
maximum size. So an edit changes the pieces it touches and leaves the others as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOST, OVERLAP, LEAST = 1500, 200, 500
#: Characters that the hash sees, a landmark's mean distance, how far a landmark may move to a boundary.
WINDOW, SPACING, REACH = 32, 256, 120

_KNOWN = 0x3100
_SPACE = np.array([chr(i).isspace() for i in range(_KNOWN)])
_ENDS = set(map(ord, ".!?…;:"))  # a sentence, or an item of a list, can end with these
_WIDE_ENDS = np.array([0x3002, 0xFF01, 0xFF1F], np.uint32)  # end a sentence without white space after it
_CLOSING = set(map(ord, ")]}\"'’”»"))

PIECES = "array<struct<piece:int,start:int,end:int,overlap:int,boundary:string>>"
_KINDS = np.array(["none", "word", "sentence", "paragraph"])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def boundaries(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, ranks, starts): where words end, 3 for paragraph, 2 for sentence, 1 for word ends; where words start."""
    solid = np.flatnonzero(~_SPACE[np.minimum(c, _KNOWN - 1)])
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    gap = np.flatnonzero(np.diff(solid) > 1)
    before, after = solid[gap], solid[gap + 1]
    lines = np.concatenate(([0], np.cumsum(c == 10)))
    breaks = lines[after] - lines[before + 1]
    last = c[before]
    closing = np.isin(last, list(_CLOSING)) & (before > 0)
    last = np.where(closing, c[np.maximum(before - 1, 0)], last)
    following = c[after]
    lower_or_digit = ((following >= 48) & (following <= 57)) | ((following >= 97) & (following <= 122)) | ((following >= 0xDF) & (following <= 0xFF)) | ((following >= 0x3AC) & (following <= 0x3CE))
    sentence = (np.isin(last, list(_ENDS)) & ~lower_or_digit) | (breaks >= 1)
    ends, ranks = before + 1, 1 + sentence.astype(np.int8) + (breaks >= 2)
    wide = np.flatnonzero(np.isin(c, _WIDE_ENDS)) + 1
    if len(wide):
        ends, ranks = np.concatenate((ends, wide)), np.concatenate((ranks, np.full(len(wide), 2, np.int8)))
        order = np.argsort(ends, kind="stable")
        ends, ranks = ends[order], ranks[order]
    return ends, ranks.astype(np.int8), after


def landmarks(c: np.ndarray) -> np.ndarray:
    """Positions behind windows whose hash is a multiple of SPACING."""
    if len(c) < WINDOW:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        factor, size = np.uint32(0x01000193), 1
        while size < WINDOW:  # the hash of twice the window from two of this size
            h = h[:-size] * factor + h[size:]
            factor, size = factor * factor, size * 2
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero((h >> np.uint32(13)) % np.uint32(SPACING) == 0) + WINDOW


def snapped(marks: np.ndarray, ends: np.ndarray, ranks: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Each landmark's nearest boundary of the best rank within reach; landmarks without one are left out."""
    out = marks.copy()
    open_ = np.ones(len(marks), bool)
    for least in (3, 2, 1):
        of = ends[ranks >= least]
        if not len(of) or not open_.any():
            continue
        right = np.searchsorted(of, marks)
        a, b = of[np.maximum(right - 1, 0)], of[np.minimum(right, len(of) - 1)]
        near = np.where(np.abs(marks - a) <= np.abs(b - marks), a, b)
        hit = open_ & (np.abs(near - marks) <= reach)
        out[hit] = near[hit]
        open_ &= ~hit
    return np.unique(out[~open_])


def split_points(text: str, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int, str]]:
    """(start, end, overlap, kind of boundary) of each piece; nothing for texts within the limit."""
    c = _points(text)
    n, core = len(c), most - overlap
    if n <= most:
        return []
    ends, ranks, starts = boundaries(c)
    marks = landmarks(c)
    cuts = snapped(marks, ends, ranks)
    rank_at = dict(zip(ends.tolist(), ranks.tolist()))
    out, s = [], 0
    while True:
        if n - s <= core:
            e = n
        else:
            i, j = np.searchsorted(cuts, (s + least, s + core + 1))
            if i < j:
                e = int(cuts[i])
            else:
                lo, hi = np.searchsorted(ends, (s + least, s + core + 1))
                if lo == hi:
                    lo = np.searchsorted(ends, s + 1)
                if lo < hi:
                    k = lo + int(np.flatnonzero(ranks[lo:hi] == ranks[lo:hi].max())[-1])
                    e = int(ends[k])
                elif (lo := np.searchsorted(ends, s + core + 1)) < np.searchsorted(ends, s + most + 1):
                    e = int(ends[lo])  # a long word: its end is within the limit if the overlap is smaller
                else:  # no word ends within reach: cut inside it, at a landmark if there is one
                    i, j = np.searchsorted(marks, (s + least, s + core + 1))
                    e = int(marks[i]) if i < j else s + core
        begin = 0
        if s:
            room = min(overlap, most - (e - s))
            k = np.searchsorted(starts, s - room)
            begin = int(starts[k]) if k < len(starts) and starts[k] <= s else s - room
        out.append((begin, e, s - begin, "end" if e == n else str(_KINDS[rank_at.get(e, 0)])))
        if e >= n:
            return out
        s = e


def pieces_column(text: Column, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """The pieces of a text as an array; empty for null texts and texts within the limit."""
    if not 0 <= overlap < least <= most - overlap:
        raise ValueError("needs overlap < least <= most - overlap")

    @F.pandas_udf(PIECES)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[(k + 1, b, e, o, kind) for k, (b, e, o, kind) in enumerate(split_points(t, most, overlap, least))] if t else [] for t in batch])

    return cut(text)


def split_oversized(df: DataFrame, id_col: str, text_col: str, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """One row for each piece of every text longer than `most` characters: id, piece, start, end, overlap, boundary, text.

    Characters are code points; start counts from 0. The pieces together hold every character: piece k + 1 begins up to
    `overlap` characters before the end of piece k, at the start of a word where there is one. Short and null texts
    give no row; texts without any white space are cut at the hash's landmarks. Repeated ids give repeated pieces.
    One narrow pass; a reader that doesn't want the text never cuts it.
    """
    long = df.where(F.length(df[text_col]) > most).select(df[id_col].alias("__id"), df[text_col].alias("__text"))
    cut = long.select("__id", "__text", F.explode(pieces_column(F.col("__text"), most, overlap, least)).alias("__p"))
    return cut.select(
        F.col("__id").alias(id_col), F.col("__p.piece").alias("piece"), F.col("__p.start").alias("start"), F.col("__p.end").alias("end"), F.col("__p.overlap").alias("overlap"),
        F.col("__p.boundary").alias("boundary"), F.expr("substring(__text, __p.start + 1, __p.end - __p.start)").alias("text"),
    )

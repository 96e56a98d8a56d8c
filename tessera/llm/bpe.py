"""Byte-pair encoding with a given public vocabulary by dynamic programming over prefixes.

For a piece of text (the vocabulary's pattern cuts text into pieces first) every non-empty prefix has exactly one
correct encoding, and hence one last token. A token t that ends at byte e is that last token iff the prefix before it
is empty and t encodes itself, or t and the last token of the prefix before it stay apart when their joint bytes are
merged. So one sweep over the automaton's matches, with a test of neighbouring pairs, fills the table of last tokens,
and walking it backwards gives the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie, unless the caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that belongs to the public vocabulary byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces that one worker remembers; beyond it the memory starts anew, which changes no result.
MEMORY = 400_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder(dict):
    """Maps a piece of text to the tuple of its token ids; computes what it hasn't seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memory: int = MEMORY):
        import ahocorasick
        import regex

        super().__init__()
        self.ranks, self.memory = ranks, memory
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.matches.add_word(b.decode("latin-1"), (len(b), i))
        self.matches.make_automaton()

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost among equals. Only for the few bytes of one or two tokens."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_whole(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = len(self.merged(self.bytes_of[token])) == 1
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        if (known := self.apart.get((left, right))) is None:
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self.apart[left, right] = self.merged(a + b) == [a, b]
            if len(self.apart) > 4 * self.memory:
                self.apart.clear()
        return known

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        if not data:
            return ()
        n = len(data)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        ending: list[tuple[int, int]] = []
        at = -1

        def settle(end: int) -> None:
            for size, token in sorted(ending, reverse=True):  # long tokens are the likely ones; exactly one fits
                start = end - size
                if (start == 0 and self.stays_whole(token)) or (start > 0 and last[start] >= 0 and self.stay_apart(last[start], token)):
                    last[end], length[end] = token, size
                    return

        for end, found in self.matches.iter(data.decode("latin-1")):
            if end != at:
                if at >= 0:
                    settle(at + 1)
                at = end
                ending.clear()
            ending.append(found)
        settle(at + 1)
        if last[n] < 0:
            raise ValueError("the vocabulary doesn't cover every byte")
        out, e = [], n
        while e > 0:
            out.append(last[e])
            e -= length[e]
        return tuple(reversed(out))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.memory:
            self.clear()
        ids = self.encode_piece(piece.encode("utf-8"))
        self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for ids in map(self.__getitem__, self.pieces(text)) for i in ids]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(ranks_of, key: tuple[str, str]) -> Encoder:
    """One encoder a worker process, however many tasks it runs."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks_of(), key[1])
    return _ENCODERS[key]


def _flat(encoder: Encoder, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    from itertools import chain

    offsets, parts, total = [0], [], 0
    get, pieces, join = encoder.__getitem__, encoder.pieces, chain.from_iterable
    for t in texts:
        if t:
            ids = np.fromiter(join(map(get, pieces(t))), np.int32)
            parts.append(ids)
            total += len(ids)
        offsets.append(total)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.asarray(offsets, np.int32)


def _small(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of few rows, so that a batch of very long texts doesn't make one huge array."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def encode_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids (column `ids`) or, with counts_only, the number of tokens (`n_tokens`) of every row's text, without special tokens.

    One narrow pass: no shuffle. The vocabulary (bounded: a public file of some 50,000 tokens) is broadcast.
    Null and empty texts give an empty list and 0; the text isn't changed, and any text can be encoded, as every
    byte is a token. Repeated ids give repeated rows. Columns in `keep` are passed on, others don't matter.
    """
    spark = df.sparkSession
    table = read_ranks(vocabulary)
    digest = hashlib.sha256(b"\n".join(sorted(table, key=table.__getitem__))).hexdigest()
    ranks = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lambda: ranks.value, (digest, pattern))
        for b in _small(batches, 2000):
            values, offsets = _flat(encoder, b.column(b.num_columns - 1).to_pylist())
            got = pa.array(np.diff(offsets), pa.int32()) if counts_only else pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], names=[*b.schema.names[:-1], name])

    name = "n_tokens" if counts_only else "ids"
    narrow = df.select(*(df[c] for c in (id_col, *keep)), df[text_col].cast("string").alias("__text"))
    result = T.IntegerType() if counts_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in (id_col, *keep)), T.StructField(name, result)])
    return narrow.mapInArrow(run, schema)


def decode_ids(ids: Iterable[int], ranks: dict[bytes, int]) -> str:
    bytes_of = {i: b for b, i in ranks.items()}
    return b"".join(bytes_of[i] for i in ids).decode("utf-8")

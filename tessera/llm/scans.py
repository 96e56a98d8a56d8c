"""Repair of text from scanned pages.

From the corpus: how often words occur inside lines, how often tokens follow one another, and skip-gram vectors of the
frequent words. In a text: rare words are linked to frequent ones that a plausible misreading of glyphs leads to, and
the link counts when the vectors of the neighbouring words agree; words broken at a line's end or by a space are put
together; page numbers and running headers are lines between which the text goes on as if they weren't there. The
rest is reflowed into paragraphs. Texts without such traces stay as they are.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, islice
from urllib.parse import quote, unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, shared_dir, stored

#: What a model holds in memory: the most frequent words, token pairs, words with vectors, pairs they learn from, and lines. All others are read from files, see `Files`.
MOST_WORDS, MOST_PAIRS, MOST_VECTORS, MOST_CONTEXTS, MOST_LINES = 300_000, 1_000_000, 20_000, 1_000_000, 200_000
#: About how many entries one of those files has.
FILED = 500_000
WIDTH, REACH = 24, 4

#: A frequent word must occur so many times as often as the rare one, and so often at all.
RATIO, LEAST = 8, 4
#: Share of all words up to which a piece of a word counts as unknown.
RARE = 2e-7
#: A line is a template if it comes so often, and so large a part of its tokens' occurrences are in it.
TEMPLATE, ALWAYS = 3, 0.5
#: Bits by which tokens must attract one another to follow naturally.
NATURAL = 2.5

# What a glyph or two are taken for when a page is read; each holds in both directions unless a digit or symbol is read for a letter.
LOOK_ALIKE = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("lc", "k"), ("f", "t"), ("c", "e"), ("q", "g"), ("l", "i"), ("í", "i"), ("ì", "i"), ("ï", "i"), ("ı", "i"), ("h", "b"), ("j", "i"), ("tl", "d"), ("in", "m"), ("ni", "m"), ("o", "e"), ("u", "n"), ("y", "v"), ("nn", "m"), ("o", "c")]
READ_FOR = [("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("@", "a"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("$", "s"), ("€", "e"), ("2", "z"), ("4", "a"), ("3", "e"), ("7", "t"), ("ß", "b"), ("©", "c"), ("£", "e"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("#", "o")]
GLYPHS = [(a, b) for x, y in LOOK_ALIKE for a, b in ((x, y), (y, x))] + READ_FOR

_HYPHENS = "-‐­¬"
_WORD = re.compile(r"[^\W_]+(?:[’'@|!$€©£#\-‐][^\W_]+)*")
_DIGITS = re.compile(r"\d+")
_EDGE = ".,;:!?…()[]{}\"“”„«»’‘'"
_NUMBER = re.compile(r"^[\W_]*(?:(?:page|pag|p|pg|seite|s|página|pagina|strona|str|blz|σελ)\.?\s*)?(?:#+|[ivxlc]{1,6})(?:\s*(?:/|of|von|de|di|van|z|από)\s*#+)?[\W_]*$", re.I)


def _ends(text: str) -> bool:
    """Whether a text ends with the end of a sentence."""
    return text.rstrip("\"”’»)]")[-1:] in tuple(".!?…:;")


def _bare(token: str) -> str:
    return token.strip(_EDGE)


def _masked(text: str) -> str:
    return _DIGITS.sub("#", text)


def _tokens(text: str) -> list[str]:
    return _masked(text).split()


def _shape(line: str) -> str | None:
    """A line without its digits and case, if it is short and doesn't end a sentence."""
    tokens = _tokens(line)
    return " ".join(tokens).casefold() if 0 < len(tokens) <= 12 and not _ends(tokens[-1]) and tokens[-1][-1] not in "," + _HYPHENS else None


def counted(text: str) -> tuple[list[str], list[tuple[str, str]], list[tuple[str, str]], list[str]]:
    """(words inside lines, pairs of tokens that follow one another, pairs of words near one another, shapes of lines): what `Counts` counts, for one text."""
    words: list[str] = []
    lines = [x for line in text.split("\n") if "\n" in text and (x := _shape(line))]
    for line in text.split("\n"):
        parts = line.split()
        for p in parts if len(text) == len(line) else parts[1:-1]:
            words += _WORD.findall(p.casefold())
    raw = _tokens(text)
    follow, near = [], []
    bare = [_bare(t) for t in raw]
    before = "<s>"
    folded = [b.casefold() for b in bare]
    for i, t in enumerate(raw):
        if bare[i]:
            follow.append((before, bare[i]))
            for j in range(max(0, i - REACH), i):
                if folded[j]:
                    near.append((folded[j], folded[i]))
        before = "<s>" if _ends(t) else bare[i] or before
    return words, follow, near, lines


class _Numbers(dict):
    """Strings by number, in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class _Tokens(dict):
    """Raw tokens by number; what a token is made of is looked at once."""

    def __init__(self) -> None:
        self.names = _Numbers({"": 0, "<s>": 1})
        self.shown: list[str] = []  # without digits and case
        self.words: list[list[str]] = []
        self.rows: list[tuple[int, int, bool, bool]] = []  # bare, folded, ends a sentence, may end a line that has a shape

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        masked = _masked(token)
        bare = _bare(masked)
        ends = _ends(masked)
        self.shown.append(masked.casefold())
        self.words.append(_WORD.findall(token.casefold()))
        self.rows.append((self.names[bare], self.names[bare.casefold()], ends, not ends and masked[-1] not in "," + _HYPHENS))
        return n


def _summed(codes: np.ndarray, sums: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes with their counts, and those of some more codes."""
    new, n = np.unique(more, return_counts=True)
    both, at = np.unique(np.concatenate((codes, new)), return_inverse=True)
    return both, np.bincount(at, np.concatenate((sums, n)), len(both)).astype(np.int64)


class Counts:
    """Counts of a task's texts; pairs are counted as arrays of numbers."""

    def __init__(self) -> None:
        self.tokens = _Tokens()
        self.inner: Counter = Counter()  # tokens by number
        self.lines: Counter = Counter()
        self.follow = self.near = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    @property
    def size(self) -> int:
        return len(self.tokens) + len(self.lines) + len(self.follow[0]) + len(self.near[0])

    def add(self, texts: list[str]) -> None:
        t, flat, owner, shapes = self.tokens, [], [], []
        inner: list[int] = []
        for k, text in enumerate(texts):
            rows = text.split("\n")
            for row in rows:
                ids = list(map(t.__getitem__, row.split()))
                flat += ids
                owner.append((k, len(ids)))
                inner += ids if len(rows) == 1 else ids[1:-1]
                if 0 < len(ids) <= 12 and len(rows) > 1 and t.rows[ids[-1]][3]:
                    shapes.append(" ".join([t.shown[i] for i in ids]))
        self.lines.update(shapes)
        self.inner.update(inner)
        if not flat:
            return
        of = np.repeat([k for k, _ in owner], [n for _, n in owner])
        at = np.array(flat, np.int64)
        bare, fold, ends, _ = np.array(t.rows, np.int64).T
        said, cut = bare[at] > 0, np.concatenate(([0], np.cumsum(ends[at])))
        i = np.flatnonzero(said)
        last = np.concatenate(([-1], i[:-1]))
        start = (last < 0) | (of[last] != of[i]) | (cut[i] > cut[last])
        self.follow = _summed(*self.follow, (np.where(start, 1, bare[at[last]]) << 32) | bare[at[i]])
        near = []
        for d in range(1, min(REACH, len(at) - 1) + 1):
            ok = said[d:] & said[:-d] & (of[d:] == of[:-d])
            near.append((fold[at[:-d][ok]] << 32) | fold[at[d:][ok]])
        self.near = _summed(*self.near, np.concatenate(near) if near else np.zeros(0, np.int64))

    def rows(self) -> Iterator[pd.DataFrame]:
        names = np.array(list(self.tokens.names), object)
        words: Counter = Counter()
        for i, n in self.inner.items():
            for w in self.tokens.words[i]:
                words[w] += n
        for kind, counts in (("w", words), ("l", self.lines)):
            yield pd.DataFrame({"kind": kind, "a": pd.Series(list(counts), dtype=object), "b": "", "n": pd.Series(list(counts.values()), dtype="int64")})
        for kind, (codes, n) in (("f", self.follow), ("c", self.near)):
            yield pd.DataFrame({"kind": kind, "a": names[codes >> 32], "b": names[codes & 0xFFFFFFFF], "n": n})


def statistics(df: DataFrame, text_col: str) -> DataFrame:
    """(kind, a, b, n): counts over all distinct texts, counted within each task first; copies of a text say nothing about what is usual."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Counts()
        for batch in batches:
            texts = batch.iloc[:, 0].tolist()
            for lo in range(0, len(texts), 500):
                found.add(texts[lo : lo + 500])
                if found.size > 3_000_000:
                    yield from found.rows()
                    found = Counts()
        yield from found.rows()

    part = df.where(F.length(df[text_col]) > 0).select(df[text_col].alias("t")).distinct().mapInPandas(run, "kind string, a string, b string, n long")
    return part.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as Python opens it."""
    found = urlparse(shared_dir(spark))
    if found.scheme not in ("", "file"):
        raise ValueError(f"the model of this corpus is larger than memory: spark.checkpoint.dir must be a folder that is mounted everywhere, not {shared_dir(spark)}")
    path = f"{unquote(found.path)}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


class Files:
    """Numbers that memory doesn't hold, by kind and key: in the shared folder, one sorted table for each remainder of the keys' checksums."""

    def __init__(self, folder: str, parts: int, written: frozenset[int]):
        self.folder, self.parts, self.written = folder, parts, written
        self.tables: dict[int, sqlite3.Connection] = {}

    def __getstate__(self) -> dict:
        return vars(self) | {"tables": {}}

    def get(self, kind: str, a: str, b: str = "") -> int | None:
        part = zlib.crc32(f"{kind}\0{a}\0{b}".encode()) % self.parts
        if part not in self.written:
            return None
        if part not in self.tables:
            if len(self.tables) >= 500:  # open files
                for t in self.tables.values():
                    t.close()
                self.tables.clear()
            self.tables[part] = t = sqlite3.connect(f"file:{quote(self.folder)}/{part}?immutable=1", uri=True, check_same_thread=False)
            t.execute("PRAGMA mmap_size = 1099511627776")
        row = self.tables[part].execute("SELECT n FROM numbers WHERE kind = ? AND a = ? AND b = ?", (kind, a, b)).fetchone()
        return row and row[0]


def filed(entries: DataFrame, size: int) -> Files:
    """Entries (kind, a, b, n) as files, about `size` of them; each file is written by one task, row by row."""
    folder, parts = _folder(entries.sparkSession, "scan-files"), max(1, -(-size // FILED))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = db = None
        path = f"{folder}/{uuid.uuid4().hex}"

        def closed() -> Iterator[pd.DataFrame]:
            if db:
                db.commit()
                db.close()
                os.replace(path, f"{folder}/{now}")
                yield pd.DataFrame({"part": [now]})

        for batch in batches:
            for part, rows in batch.groupby("part", sort=False):
                if part != now:
                    yield from closed()
                    now, db = int(part), sqlite3.connect(path)
                    db.execute("PRAGMA journal_mode = OFF")
                    db.execute("PRAGMA synchronous = OFF")
                    db.execute("CREATE TABLE numbers (kind TEXT, a TEXT, b TEXT, n INTEGER, PRIMARY KEY (kind, a, b)) WITHOUT ROWID")
                db.executemany("INSERT INTO numbers VALUES (?, ?, ?, ?)", zip(rows["kind"], rows["a"], rows["b"], rows["n"].tolist()))
        yield from closed()

    keyed = entries.select(F.pmod(F.crc32(F.concat_ws("\0", "kind", "a", "b").cast("binary")), F.lit(parts)).alias("part"), "kind", "a", "b", "n")
    done = keyed.repartition(parts, "part").sortWithinPartitions("part", "kind", "a", "b").mapInPandas(run, "part long").collect()
    return Files(folder, parts, frozenset(r["part"] for r in done))


class Held(dict):
    """Numbers by key: those in memory, and the others, which are less than `floor` if they are counts, in files."""

    def __init__(self, entries: dict, kind: str, files: Files, floor: float = 0):
        super().__init__(entries)
        self.kind, self.files, self.floor = kind, files, floor
        self.seen: dict = {}

    def get(self, key, default=None):
        n = dict.get(self, key)
        if n is None:
            if key not in self.seen:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                self.seen[key] = self.files.get(self.kind, *key) if isinstance(key, tuple) else self.files.get(self.kind, key)
            n = self.seen[key]
        return default if n is None else n

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __missing__(self, key) -> int:
        n = self.get(key)
        if n is None:
            raise KeyError(key)
        return n


class Rows:
    """An array in a file of the shared folder, of which only the rows asked for are read."""

    def __init__(self, path: str):
        self.path = path

    def __getstate__(self) -> dict:
        return {"path": self.path}

    def __getitem__(self, at):
        if not hasattr(self, "array"):
            self.array = np.load(self.path, mmap_mode="r")
        return self.array[at]

    def mean(self, axis: int) -> np.ndarray:
        return np.asarray(self[:].mean(axis=axis))


@dataclass
class Model:
    words: dict[str, int]
    follow: dict[tuple[str, str], int]
    left: dict[str, int]
    right: dict[str, int]
    total: int
    place: dict[str, int]
    inner: np.ndarray | Rows
    outer: np.ndarray | Rows
    lines: dict[str, int]
    spoken: int = 0  # occurrences of all words; 0: of those in `words`

    def attraction(self, a: str, b: str) -> float:
        """Bits by which b follows a more often than by chance, drawn to 0 where little is known."""
        chance = self.left.get(a, 0) * self.right.get(b, 0) / max(self.total, 1)
        return float(np.log2((self.follow.get((a, b), 0) + 0.5) / (chance + 0.5)))

    def agreement(self, word: str, context: list[str]) -> float | None:
        """How much better a word goes with the words around it than the average word does, by their vectors; None if too little is known."""
        if word not in self.place:
            return None
        at = [self.place[c] for c in context if c in self.place and c != word]
        return float((self.inner[at] @ (self.outer[self.place[word]] - self.average())).mean()) if at else None

    def average(self) -> np.ndarray:
        if not hasattr(self, "_average"):
            self._average = self.outer.mean(axis=0)
        return self._average

    def alike(self, a: str, b: str) -> float | None:
        """Cosine of two words' vectors; None if one has none."""
        if a not in self.place or b not in self.place:
            return None
        x, y = self.inner[self.place[a]], self.inner[self.place[b]]
        return float(x @ y / max(1e-9, float(np.linalg.norm(x) * np.linalg.norm(y))))


def _add(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Rows added to a table's rows at places that may repeat."""
    if len(table) > len(at):  # only the rows that occur
        held, at = np.unique(at, return_inverse=True)
        part = table[held]
    else:
        held, part = slice(None), table
    for d in range(part.shape[1]):
        part[:, d] += np.bincount(at, rows[:, d], len(part)).astype(np.float32)
    if part is not table:
        table[held] = part


def _hits(at: np.ndarray, size: int) -> np.ndarray:
    """How often each of some places below size occurs."""
    if size > len(at):
        _, at, n = np.unique(at, return_inverse=True, return_counts=True)
        return n[at]
    return np.bincount(at, minlength=size)[at]


def skip_gram(pairs: list[tuple[int, int, int]] | np.ndarray | list[str], size: int, width: int = WIDTH, rounds: int = 6, negatives: int = 4, seed: int = 5, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of words and of contexts by skip-gram with negative sampling over counted pairs.

    Pairs too many for memory are paths of arrays, of which one at a time is read; vectors are then files `inner.npy` and `outer.npy` of a folder.
    """
    rng = np.random.default_rng(seed)
    table = lambda name: np.lib.format.open_memmap(f"{folder}/{name}.npy", "w+", np.float32, (size, width)) if folder else np.zeros((size, width), np.float32)
    inner, outer = table("inner"), table("outer")
    for lo in range(0, size, 100_000):
        part = inner[lo : lo + 100_000]
        part[:] = rng.normal(0, 0.1, part.shape)
    if not len(pairs):
        return inner, outer
    parts = pairs if isinstance(pairs[0], str) else [pairs]

    def both_ways(part) -> np.ndarray:
        data = np.load(part) if isinstance(part, str) else np.asarray(part, np.int64)
        return np.concatenate((data, data[:, [1, 0, 2]]))

    noise = np.zeros(size)
    for part in parts:
        both = both_ways(part)
        noise += np.bincount(both[:, 1], both[:, 2], size)
    noise **= 0.75
    noise = np.cumsum(noise / noise.sum())
    for r in range(rounds):
        rate = 0.3 * (1 - r / rounds) + 0.02
        for p in rng.permutation(len(parts)) if len(parts) > 1 else [0]:
            both = both_ways(parts[p])
            weight = np.minimum(both[:, 2], 1000) ** 0.5
            for part in np.array_split(rng.permutation(len(both)), max(1, len(both) // 4096)):
                i, j, w = both[part, 0], both[part, 1], weight[part]
                w = (w / w.mean()).astype(np.float32)
                js = np.concatenate((j[:, None], np.searchsorted(noise, rng.random((len(part), negatives))).clip(0, size - 1)), axis=1)
                x, y = inner[i], outer[js]
                label = np.zeros(js.shape, np.float32)
                label[:, 0] = 1
                g = (label - 1 / (1 + np.exp(-np.einsum("nd,nkd->nk", x, y).clip(-20, 20)))) * w[:, None] * rate
                dx, dy = np.einsum("nk,nkd->nd", g, y), g[:, :, None] * x[:, None, :]
                at = js.ravel()
                _add(inner, i, dx / np.sqrt(_hits(i, size))[:, None])
                _add(outer, at, dy.reshape(-1, width) / np.sqrt(_hits(at, size))[:, None])
    return inner, outer


def _floors(counts: DataFrame, most: dict[str, int], group: str = "kind", steps: int = 8) -> dict[str, float]:
    """The count from which on the entries of each kind fit into `most`, from the numbers of entries in steps of the
    logarithm: no global sort, and all entries of one count stay or go together."""
    sizes = counts.groupBy(group, F.floor(F.log2("n") * steps).alias("step")).agg(F.count("*").alias("entries")).collect()  # some hundred rows
    out = dict.fromkeys(most, 0.0)
    for kind, limit in most.items():
        held = 0
        for step, entries in sorted(((r["step"], r["entries"]) for r in sizes if r[group] == kind), reverse=True):
            held += entries
            if held > limit:
                out[kind] = 2 ** ((step + 1) / steps)
                break
    return out


def _numbered(known: DataFrame) -> DataFrame:
    """(a, place): words by their place from the most frequent on, without all of them in one task."""
    rows = stored(known.orderBy(F.desc("n"), "a").select("a", F.monotonically_increasing_id().alias("m")), "scan-words")
    sizes = dict(rows.groupBy(F.shiftright("m", 33).alias("p")).count().collect())  # a row a partition
    starts = [(p, sum(n for q, n in sizes.items() if q < p)) for p in sizes]
    starts = known.sparkSession.createDataFrame(starts, "p long, start long")
    out = stored(rows.join(F.broadcast(starts), F.shiftright("m", 33) == F.col("p")).select("a", (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")), "scan-places")
    discard(rows)
    return out


def _pair_files(near: DataFrame, places: DataFrame, size: int, folder: str) -> list[str]:
    """Counted pairs of words that have places as arrays (place, place, n) in files of a folder."""
    parts = max(1, -(-size // FILED))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []

        def closed() -> Iterator[pd.DataFrame]:
            if rows:
                path = f"{folder}/{uuid.uuid4().hex}.npy"
                np.save(path, np.concatenate(rows))
                os.replace(path, f"{folder}/{now}.npy")
                yield pd.DataFrame({"part": [now]})

        for batch in batches:
            for part, some in batch.groupby("part", sort=False):
                if part != now:
                    yield from closed()
                    now, rows = int(part), []
                rows.append(some[["i", "j", "n"]].to_numpy(np.int64))
        yield from closed()

    first, second = (places.select(F.col("a").alias(k), F.col("place").alias(p)) for k, p in (("a", "i"), ("b", "j")))
    keyed = near.select("a", "b", "n").join(first, "a").join(second, "b").withColumn("part", F.pmod(F.crc32(F.concat_ws("\0", "a", "b").cast("binary")), F.lit(parts)))
    done = keyed.repartition(parts, "part").sortWithinPartitions("part", F.desc("n"), "a", "b").select("part", "i", "j", "n").mapInPandas(run, "part long").collect()
    return [f"{folder}/{r}.npy" for r in sorted(r["part"] for r in done)]


def train(stats: DataFrame) -> Model:
    """A model from the statistics of all texts. Only the most frequent entries come to the driver; the others are in files of the shared folder,
    as are the vectors if words or pairs are too many, so that a model of any size has every count, and a vector of every frequent word learnt from all its pairs.
    """
    stats = stored(stats, "scan-statistics")
    spark = stats.sparkSession
    floor = _floors(stats, {"w": MOST_WORDS, "f": MOST_PAIRS, "c": MOST_CONTEXTS, "l": MOST_LINES})
    entries = {r["kind"]: (r["n"], r["entries"]) for r in stats.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("entries")).collect()}
    of = lambda kind, least=1: stats.where((F.col("kind") == kind) & (F.col("n") >= least))
    top = lambda kind, least=1: of(kind, max(floor[kind], least)).select("a", "b", "n").toPandas().sort_values(["n", "a", "b"], ascending=[False, True, True])
    words, follow, lines = top("w"), top("f"), top("l", TEMPLATE)
    rest = [of(kind, least).where(F.col("n") < floor[kind]) for kind, least in (("w", 1), ("f", 1), ("l", TEMPLATE)) if floor[kind] > least]
    frequent = words[words["n"] >= LEAST]
    passing = []
    if floor["w"] > LEAST or floor["c"] > 0 and len(frequent) or len(frequent) > MOST_VECTORS:
        places = _numbered(of("w", LEAST))
        passing.append(places)
        folder = _folder(spark, "scan-vectors")
        files = _pair_files(of("c"), places, entries["c"][1] if "c" in entries else 0, folder)
        size = places.count()
        skip_gram(files, size, folder=folder)
        for f in files:
            os.remove(f)
        inner, outer = Rows(f"{folder}/inner.npy"), Rows(f"{folder}/outer.npy")
        some = places.where(F.col("place") < MOST_VECTORS).toPandas()
        place = dict(zip(some["a"], map(int, some["place"])))
        if size > MOST_VECTORS:
            rest.append(places.where(F.col("place") >= MOST_VECTORS).select(F.lit("place").alias("kind"), "a", F.lit("").alias("b"), F.col("place").alias("n")))
    else:
        near = top("c")
        place = {w: i for i, w in enumerate(frequent["a"])}
        size = len(place)
        near = pd.DataFrame({"a": near["a"].map(place), "b": near["b"].map(place), "n": near["n"]}).dropna().astype("int64")
        inner, outer = skip_gram(near.to_numpy(), size)
    sides = stats.where("kind = 'f'").select("n", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("a").alias("x")), F.struct(F.lit("r").alias("side"), F.col("b").alias("x")))).alias("s")).groupBy("s.side", "s.x").agg(F.sum("n").alias("n"))
    sides = stored(sides, "scan-sides")
    least = _floors(sides, {"l": MOST_WORDS, "r": MOST_WORDS}, "side")
    enough = F.col("n") >= F.when(F.col("side") == "l", F.lit(least["l"])).otherwise(F.lit(least["r"]))
    kept = sides.where(enough).toPandas()
    left, right = (dict(zip(x["x"], map(int, x["n"]))) for x in (kept[kept["side"] == "l"], kept[kept["side"] == "r"]))
    if any(least.values()):
        rest.append(sides.where(~enough).select(F.concat(F.lit("side "), "side").alias("kind"), F.col("x").alias("a"), F.lit("").alias("b"), "n"))
    files = None
    if rest:
        rest = stored(reduce(DataFrame.unionByName, [x.select("kind", "a", "b", "n") for x in rest]), "scan-rest")
        files = filed(rest, rest.count())
        passing.append(rest)
    discard(stats, sides, *passing)
    held = lambda found, kind, below: Held(found, kind, files, below) if below else found
    model = Model(
        held(dict(zip(words["a"], map(int, words["n"]))), "w", floor["w"]),
        held(dict(zip(zip(follow["a"], follow["b"]), map(int, follow["n"]))), "f", floor["f"]),
        held(left, "side l", least["l"]),
        held(right, "side r", least["r"]),
        int(entries["f"][0]) if "f" in entries else 0,
        held(place, "place", max(0, size - MOST_VECTORS)),
        inner,
        outer,
        held(dict(zip(lines["a"], map(int, lines["n"]))), "l", floor["l"] if floor["l"] > TEMPLATE else 0),
        int(entries["w"][0]) if "w" in entries else 0,
    )
    if size:
        model.average()
    return model


def misreadings(word: str) -> Iterator[tuple[str, int]]:
    """Words that `word` may have been before one or two glyphs were misread, with their number."""
    spots = [(i, a, b) for a, b in GLYPHS for i in range(len(word)) if word.startswith(a, i)]
    for i, a, b in spots:
        yield word[:i] + b + word[i + len(a) :], 1
    if len(word) >= 6:
        for (i, a, b), (j, c, d) in combinations(sorted(spots), 2):
            if i + len(a) <= j:
                yield word[:i] + b + word[i + len(a) : j] + d + word[j + len(c) :], 2


@dataclass
class Reading:
    broken: int = 0
    misread: int = 0
    split: int = 0
    furniture: int = 0
    text: str = ""

    @property
    def traces(self) -> int:
        return self.broken + self.misread + self.split + self.furniture


class _Bares(dict):
    """A token without the marks around it, and what the next token follows: that, or a sentence's end."""

    def __missing__(self, token: str) -> tuple[str, str]:
        if len(self) > 200_000:
            self.clear()
        bare = _bare(token)
        self[token] = out = (bare, "<s>" if _ends(token) else bare)
        return out


class _Flags(dict):
    """What a word as typed can be part of, as bits; see Reader.flags_of."""

    def __init__(self, reader: Reader):
        self.reader = reader

    def __missing__(self, typed: str) -> int:
        if len(self) > self.reader.memory:
            self.clear()
        self[typed] = bits = self.reader.flags_of(typed.casefold())
        return bits


class Reader:
    def __init__(self, model: Model, memory: int = 200_000):
        self.m, self.memory = model, memory
        self.links: dict[str, list[tuple[str, int]]] = {}
        self.joins: dict[tuple[str, str], str | None] = {}
        self.flags, self.bares = _Flags(self), _Bares()
        known = [w for w, n in model.words.items() if n >= LEAST]
        self.rare = RARE * (model.spoken or sum(model.words.values()))
        self.floor = getattr(model.words, "floor", 0)  # words that occur less often are in files
        self.forth, self.back = sorted(known), sorted(w[::-1] for w in known)

    def flags_of(self, word: str) -> int:
        """1: it has a likely reading. 2 and 4: a frequent word begins or ends with it. 8: it is as good as unknown."""
        begins = lambda words, w: (i := bisect_left(words, w)) + (i < len(words) and words[i] == w) < len(words) and words[i + (words[i] == w)].startswith(w)
        part = 6 if self.floor > LEAST else 2 * begins(self.forth, word) + 4 * begins(self.back, word[::-1])  # frequent words in files aren't searched: any word may be part of one
        return bool(self.likely(word)) + part + 8 * (self.count(word) <= self.rare)

    def spots(self, typed: list[str]) -> list[int]:
        """Places of words that have another reading or may be one word with the next (see _joined), by what each can be part of."""
        flags = list(map(self.flags.__getitem__, typed))
        return [i for i, (a, b) in enumerate(zip(flags, [*flags[1:], 0])) if a & 1 or (a & 2 and b & 4) or a & b & 8]

    def count(self, word: str, least: float = 0) -> int:
        """How often a word occurs; may be 0 for one that occurs less than `least` times."""
        return dict.get(self.m.words, word, 0) if least >= self.floor else self.m.words.get(word, 0)

    def likely(self, word: str) -> list[tuple[str, int]]:
        """Frequent words that a rare one can be a misreading of, the best first."""
        if word in self.links:
            return self.links[word]
        found: list[tuple[str, int]] = []
        n = self.count(word)
        if len(word) >= 3 and not word.isdigit():
            seen: dict[str, int] = {}
            for other, edits in misreadings(word):
                least = max(LEAST, RATIO * max(n, 1) * (1 if edits == 1 else 3))
                if self.count(other, least) >= least and other != word and edits < seen.get(other, 9):
                    seen[other] = edits
            found = sorted(seen.items(), key=lambda x: (x[1], -self.count(x[0])))
        if len(self.links) > self.memory:
            self.links.clear()
        self.links[word] = found
        return found

    def corrected(self, words: list[str], i: int, typed: list[str]) -> str | None:
        """What the i-th word was before it was misread, if the words around it agree."""
        word = words[i]
        options = self.likely(word)
        if not options:
            return None
        context = words[max(0, i - REACH) : i] + words[i + 1 : i + 1 + REACH]
        for other, edits in options:
            fit, alike = self.m.agreement(other, context), self.m.alike(word, other)
            if (fit is None and edits == 1) or (fit is not None and fit > 0) or (alike is not None and alike > 0.5):
                return other
            shown = other[:1].upper() + other[1:] if typed[i][:1].isupper() else other
            if i and self.m.attraction(_masked(typed[i - 1]), shown) >= NATURAL or i + 1 < len(typed) and self.m.attraction(shown, _masked(typed[i + 1])) >= NATURAL:
                return other
        return None

    def one_word(self, a: str, b: str) -> str | None:
        """a and b as the one word that a space has split, if they are."""
        if (a, b) not in self.joins:
            if len(self.joins) > self.memory:
                self.joins.clear()
            self.joins[a, b] = self._joined(a, b)
        return self.joins[a, b]

    def _joined(self, a: str, b: str) -> str | None:
        joined = a + b
        n = self.count(joined)
        if n < LEAST or not (a and b):
            rarest = max(n, self.count(a), self.count(b))
            options = self.likely(joined) if len(joined) >= 6 and rarest <= self.rare else []
            return options[0][0] if options and 3 * RATIO * rarest <= self.count(options[0][0]) else None
        if min(self.count(a), self.count(b)) * RATIO <= n and self.m.follow.get((a, b), 0) * RATIO <= n and (min(self.count(a), self.count(b)) < LEAST or max(self.count(a), self.count(b)) * 2 <= n or self.m.attraction(a, b) < 0):
            return joined
        return None

    def furniture(self, lines: list[str]) -> list[bool]:
        """Which lines aren't part of the text: page numbers, and lines that neither follow nor are followed naturally."""
        out = [False] * len(lines)
        lines = [x.strip() for x in lines]
        text = list(map(bool, lines))
        if sum(text) < 2:
            return out
        masked = list(map(_masked, lines))
        number = [bool(x and _NUMBER.match(x)) for x in masked]
        out[:] = number
        for i, line in enumerate(lines):
            if not text[i] or out[i]:
                continue
            raw = masked[i].split()
            if len(raw) > 12:
                continue
            bares = list(map(self.bares.__getitem__, raw))
            if bares[0][0][:1].islower():
                continue
            shape = _shape(line)
            if shape is None:
                continue
            mine = [t for t, _ in bares if t] or [line]
            often = self.m.lines.get(shape, 1)
            follow = self.m.follow
            seen = [follow.get((x, y), 0) for (_, x), (y, _) in zip(bares, bares[1:]) if y]
            inside = min(seen) if seen else self.m.right.get(mine[0], 0)
            if often < ALWAYS * inside or mine[0][:1].islower():
                continue
            if often >= TEMPLATE:
                out[i] = True
                continue
            if sum(not t[:1].islower() for t in mine) < 0.6 * len(mine):  # seen once or twice: only what looks like a title
                continue
            earlier = list(islice((lines[j] for j in range(i - 1, -1, -1) if text[j] and not out[j]), 2))
            later = list(islice((lines[j] for j in range(i + 1, len(lines)) if text[j] and not number[j]), 2))
            ends = ["<s>" if _ends(x.rstrip()) else _bare(_tokens(x)[-1]) for x in earlier] or ["<s>"]
            begins = [_bare(_tokens(x)[0]) for x in later]
            # natural with the next line, or with the one behind it (the next may be a header itself)
            if any(self.m.attraction(mine[-1], q) >= NATURAL for q in begins):
                continue
            if any(p != "<s>" and self.m.attraction(p, mine[0]) >= NATURAL for p in ends):
                continue
            if not begins:  # a text's last line ends a sentence; this one doesn't
                out[i] = bool(earlier)
                continue
            broken = bool(earlier) and earlier[0].rstrip()[-1] in _HYPHENS
            bridge = broken or ends[0] == "<s>" or self.m.attraction(ends[0], begins[0]) >= NATURAL
            out[i] = bridge and (mine[0][:1].isupper() or not mine[0][:1].isalpha())
        return out

    def read(self, text: str) -> Reading:
        lines = text.replace("\r\n", "\n").split("\n")
        away = self.furniture(lines)
        r = Reading(furniture=sum(away))
        paragraphs: list[str] = []
        current, gap = "", False
        for line, gone in zip(lines, away):
            s = line.strip()
            if gone:
                continue
            if not s:
                gap = True
                continue
            open_ = bool(current) and not _ends(current)
            if current and (not gap or open_ and (s[:1].islower() or current[-1] in _HYPHENS or self.m.attraction(_bare(_tokens(current)[-1]), _bare(_tokens(s)[0])) >= NATURAL)):
                current, broken = self.join(current, s)
                r.broken += broken
            else:
                if current:
                    paragraphs.append(current)
                current = s
            gap = False
        if current:
            paragraphs.append(current)
        fixed = [self.words_fixed(p, r) for p in paragraphs]
        r.text = "\n\n".join(fixed) if r.traces else text
        return r

    def join(self, current: str, line: str) -> tuple[str, int]:
        """A line put behind another one: (text, 1 if a word was broken between them)."""
        if current[-1] not in _HYPHENS or len(current) < 2 or not current[-2].isalnum() or not line[:1].isalnum():
            return f"{current} {line}", 0
        a = re.search(r"[^\W_]+(?:[-‐’'][^\W_]+)*$", current[:-1].rsplit(None, 1)[-1])
        b = _WORD.match(line)
        if not a or not b:
            return f"{current} {line}", 0
        whole, compound = (a[0] + b[0]).casefold(), f"{a[0]}-{b[0]}".casefold()
        n, m = self.count(whole), self.count(compound)
        if current[-1] in "­¬" or n > m or (n == m and not (self.count(a[0].casefold()) >= LEAST and self.count(b[0].casefold()) >= LEAST) and line[0].islower()):
            return current[:-1] + line, 1
        return current + line, 0

    def words_fixed(self, paragraph: str, r: Reading) -> str:
        typed = _WORD.findall(paragraph)
        spots = self.spots(typed)
        if not spots:
            return paragraph
        words = [w.casefold() for w in typed]
        spans: list[re.Match] = []
        out, at, free = [], 0, 0
        for i in spots:
            if i < free:  # put together with the word before
                continue
            new, last = None, i
            joined = self.one_word(words[i], words[i + 1]) if i + 1 < len(words) else None
            if joined:
                spans = spans or list(_WORD.finditer(paragraph))
                if paragraph[spans[i].end() : spans[i + 1].start()] == " ":
                    new, last = joined, i + 1
                    r.split += 1
            if new is None and (new := self.corrected(words, i, typed)):
                r.misread += 1
            if new is not None:
                spans = spans or list(_WORD.finditer(paragraph))
                old = typed[i]
                new = new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new
                out += [paragraph[at : spans[i].start()], new]
                at = spans[last].end()
            free = last + 1
        return "".join(out) + paragraph[at:]


_READERS: dict[str, Reader] = {}


def page_reader(shared, key: str) -> Reader:
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(shared.value)
    return _READERS[key]


def readings(df: DataFrame, text: Column, model: Model, texts: bool = True) -> Column:
    """struct(broken, misread, split, furniture, text): how many traces of each kind a text has, and the text without them
    (null with texts=False, where only the counts are wanted).

    Null and empty texts have no traces and stay as they are, as do texts without any trace.
    """
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # of bounded size, see MOST_WORDS; the rest is in files

    @F.pandas_udf("struct<broken:int,misread:int,split:int,furniture:int,text:string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = page_reader(shared, key)
        for batch in batches:
            found = [reader.read(t) if t else Reading(text=t) for t in batch]
            yield pd.DataFrame({"broken": [x.broken for x in found], "misread": [x.misread for x in found], "split": [x.split for x in found], "furniture": [x.furniture for x in found], "text": pd.Series([x.text if texts else None for x in found], dtype=object)})

    return read(text)


def repaired(df: DataFrame, keys: list[str], text_col: str, model: Model | None = None, texts: bool = True) -> DataFrame:
    """keys, broken, misread, split, furniture and text for every row. Repeated rows give repeated rows."""
    model = model or train(statistics(df, text_col))
    return df.select(*[df[k] for k in keys], readings(df, df[text_col], model, texts).alias("__r")).select(*keys, "__r.*")

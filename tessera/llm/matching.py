"""Matching records of two tables that share no key: dated texts and the register entries that they are about.

What register entries are about, and in which wordings, is read from the register itself (register.py). Entries, their
attributes (phrases), tokens and letter trigrams, and the tokens of all texts, form a graph; random walks over it train
skip-gram vectors. Windows of a text's tokens are blocked against the register's phrases by several tables of random
hyperplanes, reranked by exact cosine, and cosine and spelling are calibrated to a probability that decides; an exact
bound on the slips of the spelling follows. A text is about an entry if it names all concepts of the entry and they
belong to each other, or one of the entry's other names; an interval of dates must fit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows
from .names import allowed, deletes, slips
from .register import read_register
from .scans import Model, page_reader, skip_gram

#: Rows of the register (its index is broadcast), and texts that take part in the walks.
MOST_REGISTER, WALK_TEXTS = 100_000, 2_000  # the texts that all of them together weigh as in the walks
WIDTH, WALKS, STEPS, NEAR = 32, 8, 6, 3
TABLES, BITS = 12, 10
#: Tokens and windows that a task remembers; when there are more it begins anew.
MEMORY = 300_000
LEAST_COSINE, LEAST_CONFIDENCE = 0.75, 0.5
#: Slips of the keyboard that a phrase may hold at most.
MOST_SLIPS = 2

_STOP = set("a an and at by for from in into its of on or re s the to with where would are is be how".split())
_TOKEN = re.compile(r"[^\W_]+")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){3,}")
_PART = re.compile(r"(?<=[.!?;])\s+(?=[^a-z])|\n\s*\n")


_PLAIN = str.maketrans("’‘´“”„«»–—‐‑…•\u00a0", "'''\"\"\"\"\"----.* ")


def _folded(text: str) -> str:
    if text.count(".") >= 3:
        text = _DOTTED.sub(lambda m: m[0].replace(".", "") + " ", text)
    if text.isascii() or (text := text.translate(_PLAIN)).isascii():  # marks say nothing here
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(_folded(text))


@dataclass
class Phrase:
    kind: str  # p, r or a
    text: str
    concepts: tuple[str, ...]
    vector: np.ndarray | None = None


def phrases_of(entries: list[tuple[str, str | None, str | None]], aliases: list[tuple[str, str]]) -> tuple[list[Phrase], list[tuple[str, str, str, int]]]:
    """The phrases of a register, and (key, entry, way, keys that this way needs): what a text must name to be about an entry.

    An entry with one concept needs it ("=concept"), one with more needs each of them together with the rarest
    ("rarest|other"); another name is a way of its own.
    """
    read = read_register(entries, aliases, _tokens, _STOP)
    concepts: dict[tuple[str, str], set[str]] = defaultdict(set)
    about: list[tuple[str, str, str, int]] = []
    for c, wordings in read.wordings.items():
        for w in wordings:
            concepts[read.kinds[c], w].add(c)
    for id_, mine in read.entries.items():
        if len(mine) == 1:
            about.append((f"={mine[0]}", id_, "one", 1))
        about += [(_pair(mine[0], x, read.kinds), id_, "all", len(mine) - 1) for x in mine[1:]]
    for id_, alias in aliases:
        if words := " ".join(_tokens(alias)):
            concepts["a", words].add(words)
            about.append((f"~{words}", id_, f"~{words}", 1))
    return [Phrase(k, w, tuple(sorted(v))) for (k, w), v in sorted(concepts.items())], about


def _pair(a: str, b: str, kinds: dict[str, str]) -> str:
    """The key of two concepts: the thing first; two of one kind in the order of the alphabet."""
    return f"{a}|{b}" if (kinds[a], a) < (kinds[b], b) else f"{b}|{a}"


def vocabulary_of(phrases: list[Phrase]) -> list[str]:
    return sorted({t for p in phrases for t in p.text.split()})


class _Like(dict):
    """Whether a token can be one of the register's, by token; stop words are None."""

    def __init__(self, index: Index):
        self.index = index

    def __missing__(self, token: str) -> bool | None:
        if len(self) > MEMORY:
            self.clear()
        self[token] = out = None if token in _STOP else self.index.like(token)
        return out


class Index:
    """Phrases of the register with their vectors and hyperplane tables; what a text names is looked up here."""

    def __init__(self, entries: list[tuple[str, str | None, str | None]], aliases: list[tuple[str, str]], near: list[tuple[str, str, float]], seed: int = 17):
        self.phrases, self.about = phrases_of(entries, aliases)
        self.keys = {k for k, *_ in self.about}
        kinds = {c: p.kind for p in self.phrases for c in p.concepts if p.kind != "a"}
        self.same = {k for k in self.keys if "|" in k and len({kinds[c] for c in k.split("|")}) == 1}
        self.vocabulary = vocabulary_of(self.phrases)
        self.by_deletes: dict[str, list[str]] = defaultdict(list)
        for w in self.vocabulary:
            for d in deletes(w, allowed(w)):
                self.by_deletes[d].append(w)
        self.longest = max((len(p.text.split()) for p in self.phrases), default=0) + 1  # a space too many is a slip
        self._walk(near, seed)
        self._hash(seed)
        self._calibrate(seed)
        self.memory: dict[str, tuple[list[Phrase], float, int] | None] = {}
        self.liked = _Like(self)

    # -- vectors --

    def _walk(self, near: list[tuple[str, str, float]], seed: int) -> None:
        """Walks over entries, phrases, tokens, trigrams and, through texts, from token to token; their neighbourhoods train the vectors."""
        links: dict[str, set[str]] = defaultdict(set)

        def link(a: str, b: str) -> None:
            links[a].add(b)
            links[b].add(a)

        by_concept: dict[str, list[str]] = defaultdict(list)
        for i, p in enumerate(self.phrases):
            for c in p.concepts:
                by_concept[c].append(f"attribute {i}")
            for t in p.text.split():
                link(f"attribute {i}", f"token {t}")
        for key, id_, _, _ in self.about:
            for c in key.lstrip("=~").split("|"):
                for a in by_concept[c]:
                    link(f"record {id_}", a)
        for t in self.vocabulary:
            for g in _trigrams(t):
                link(f"token {t}", f"gram {g}")
        weights = {x: dict.fromkeys(ys, 1.0) for x, ys in links.items()}
        for a, b, w in near:
            weights[f"token {a}"][f"token {b}"] = w
        nodes = sorted(links)
        self.place = {x: i for i, x in enumerate(nodes)}
        around = [sorted((self.place[y], w) for y, w in weights[x].items()) for x in nodes]
        first = np.concatenate(([0], np.cumsum([len(x) for x in around]))).astype(np.int64)
        flat = np.array([y for x in around for y, _ in x], np.int64)
        sums = np.concatenate(([0.0], np.cumsum([w for x in around for _, w in x])))
        rng = np.random.default_rng(seed)
        at = np.repeat(np.arange(len(nodes)), WALKS)
        walks = [at]
        for _ in range(STEPS if len(nodes) else 0):  # all walks take each step together
            lo, hi = first[at], first[at + 1]
            at = flat[(np.searchsorted(sums, sums[lo] + rng.random(len(at)) * (sums[hi] - sums[lo]), side="right") - 1).clip(lo, hi - 1)]
            walks.append(at)
        pairs = [walks[i] * len(nodes) + walks[j] for i in range(len(walks)) for j in range(max(0, i - NEAR), i)]
        codes, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        most = max(1, len(nodes))
        self.vectors, _ = skip_gram(np.stack((codes // most, codes % most, n), axis=1), len(nodes), WIDTH, rounds=3, seed=seed)
        self.parts: dict[str, np.ndarray | None] = {}
        for p in self.phrases:
            p.vector = self.vector(p.text.split())

    def part(self, token: str) -> np.ndarray | None:
        """What a token adds to a window's vector: its letters, and, where it is known, what it stands with."""
        if token not in self.parts:
            if len(self.parts) > MEMORY:
                self.parts.clear()
            grams = [self.place[f"gram {g}"] for g in _trigrams(token) if f"gram {g}" in self.place]
            v = None
            if grams:
                v = _unit(self.vectors[grams].mean(axis=0))
                if (at := self.place.get(f"token {token}")) is not None:
                    v = v + 0.5 * _unit(self.vectors[at])
                v = _unit(v) * (0.2 if token in _STOP else 1.0)
            self.parts[token] = v
        return self.parts[token]

    def vector(self, tokens: list[str]) -> np.ndarray | None:
        parts = [v for t in tokens if (v := self.part(t)) is not None]
        return _unit(np.sum(parts, axis=0)) if parts else None

    # -- blocking --

    def _hash(self, seed: int) -> None:
        rng = np.random.default_rng(seed + 1)
        self.planes = rng.normal(size=(TABLES * BITS, WIDTH)).astype(np.float32)
        self.squeezed = [p.text.replace(" ", "") for p in self.phrases]
        self.lengths = np.array([len(x) for x in self.squeezed], np.int64)
        self.sizes = np.array([len(p.text.split()) for p in self.phrases], np.int64)
        self.letters = _letters(self.squeezed)
        # short phrases must be written exactly, and other names of one token, such as acronyms
        self.bounds = [0 if len(x) < 5 or (p.kind == "a" and " " not in p.text) else min(MOST_SLIPS, 1 + (len(x) >= 8)) for p, x in zip(self.phrases, self.squeezed)]
        self.matrix = np.array([p.vector if p.vector is not None else np.zeros(WIDTH) for p in self.phrases], np.float32).reshape(-1, WIDTH)
        self.buckets: list[dict[int, np.ndarray]] = []
        with_vector = np.flatnonzero([p.vector is not None for p in self.phrases])
        bits, _ = self.signatures(self.matrix[with_vector])
        for t in range(TABLES):
            held: dict[int, list[int]] = defaultdict(list)
            for i, s in zip(with_vector.tolist(), bits[:, t].tolist()):
                held[s].append(i)
            self.buckets.append({s: np.array(x, np.int64) for s, x in held.items()})

    def signatures(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each vector in each table, and the bucket that differs in the least certain bit."""
        sides = (v @ self.planes.T).reshape(len(v), TABLES, BITS)
        bits = (sides > 0) @ (1 << np.arange(BITS))
        return bits, bits ^ (1 << np.abs(sides).argmin(axis=2))

    def candidates(self, v: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, phrase) of phrases in one of the buckets of each vector, in any table; with lengths, only of those that slips can make as long."""
        found = [np.zeros(0, np.int64)]
        for sides in self.signatures(v):
            for t, buckets in enumerate(self.buckets):
                order = np.argsort(sides[:, t], kind="stable")
                marks, starts = np.unique(sides[order, t], return_index=True)
                for s, lo, hi in zip(marks.tolist(), starts.tolist(), [*starts.tolist()[1:], len(order)]):
                    if (held := buckets.get(s)) is not None:
                        rows = order[lo:hi, None]
                        codes = rows * len(self.phrases) + held
                        found.append(codes.ravel() if lengths is None else codes[np.abs(lengths[rows] - self.lengths[held]) <= MOST_SLIPS])
        codes = np.unique(np.concatenate(found))
        return codes // max(1, len(self.phrases)), codes % max(1, len(self.phrases))

    # -- calibration --

    def _calibrate(self, seed: int) -> None:
        """A logistic curve over cosine and slips: phrases with none to MOST_SLIPS slips of the keyboard against the nearest of their candidates."""
        rng = np.random.default_rng(seed + 2)
        known = [i for i, p in enumerate(self.phrases) if p.vector is not None and self.bounds[i]]
        typed = [self.phrases[i].text for i in known]
        for n in range(MOST_SLIPS):
            typed = [_slipped(t, rng) if min(k % (MOST_SLIPS + 1), self.bounds[i]) > n else t for k, (i, t) in enumerate(zip(known, typed))]
        ok = [k for k, t in enumerate(typed) if self.vector(t.split()) is not None]
        self.curve = np.array([-6.0, 10.0, -1.0])
        if not ok:
            return
        v = np.array([self.vector(typed[k].split()) for k in ok], np.float32)
        own = np.array([known[k] for k in ok], np.int64)
        words = [typed[k].replace(" ", "") for k in ok]
        xs = [(float(v[r] @ self.matrix[i]), self._slips(words[r], i)) for r, i in enumerate(own.tolist())]
        ys = [1.0] * len(xs)
        row, phrase = self.candidates(v)
        row, phrase = row[phrase != own[row]], phrase[phrase != own[row]]
        cosines = np.einsum("nd,nd->n", v[row], self.matrix[phrase])
        for r in range(len(ok)):
            lo, hi = np.searchsorted(row, (r, r + 1))
            if hi > lo:
                k = lo + int(cosines[lo:hi].argmax())
                if self.squeezed[phrase[k]] != self.squeezed[own[r]] and self.bounds[int(phrase[k])]:
                    xs.append((float(cosines[k]), self._slips(words[r], int(phrase[k]))))
                    ys.append(0.0)
        x, y = np.array([(1.0, a, b) for a, b in xs]), np.array(ys)
        w = np.zeros(3)
        for _ in range(30):  # Newton's steps with a little shrinkage
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (p - y) + 1e-2 * w)
        self.curve = w

    def _slips(self, word: str, phrase: int) -> int:
        return slips(word, self.squeezed[phrase], MOST_SLIPS)

    def confidence(self, cosine: float, n: int) -> float:
        """The calibrated probability that a window with this cosine and so many slips writes the phrase."""
        return float(1 / (1 + np.exp(-np.clip(self.curve @ (1.0, cosine, n), -30, 30))))

    # -- texts --

    def like(self, token: str) -> bool:
        """Whether a token can be one of the register's."""
        return any(slips(token, w, allowed(w)) <= allowed(w) for d in deletes(token, allowed(token)) for w in self.by_deletes.get(d, ()) if w not in _STOP)

    def windows(self, tokens: list[str]) -> list[tuple[int, int, str]]:
        """(start, end, text) of windows that can write a phrase: they begin and end with a token like one of the register's,
        and no more tokens inside than a split word has are unlike any."""
        like = list(map(self.liked.__getitem__, tokens))
        out = []
        for i in [i for i, x in enumerate(like) if x]:
            strange = 0
            for j in range(i + 1, min(len(tokens), i + self.longest) + 1):
                if like[j - 1]:
                    out.append((i, j, " ".join(tokens[i:j])))
                elif like[j - 1] is False and (strange := strange + 1) > 2:
                    break
        return out

    def look_up(self, windows: list[str]) -> None:
        """Puts into the memory which phrases windows write, with confidence and number of slips: blocked, reranked, calibrated."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        new = [w for w in dict.fromkeys(windows) if w not in self.memory]
        self.memory.update(dict.fromkeys(new))
        split = [w.split() for w in new]
        v = np.zeros((len(new), WIDTH), np.float32)
        parts = [(k, x) for k, ts in enumerate(split) for t in ts if (x := self.part(t)) is not None]
        if not parts:
            return
        np.add.at(v, [k for k, _ in parts], np.array([x for _, x in parts], np.float32))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        words, sizes = [w.replace(" ", "") for w in new], np.array([len(x) for x in split])
        lengths, letters = np.array([len(w) for w in words]), _letters(words)
        row, phrase = self.candidates(v, lengths)
        # a slip changes no more than two counts of letters
        fits = (np.abs(sizes[row] - self.sizes[phrase]) <= 1) & (np.abs(letters[row] - self.letters[phrase]).sum(axis=1, dtype=np.int32) <= 2 * MOST_SLIPS)
        row, phrase = row[fits], phrase[fits]
        cosines = np.einsum("nd,nd->n", v[row], self.matrix[phrase])
        near = cosines >= LEAST_COSINE
        best: dict[int, dict[int, list[tuple[float, int]]]] = defaultdict(lambda: defaultdict(list))
        for r, i, cosine in zip(row[near].tolist(), phrase[near].tolist(), cosines[near].tolist()):
            most = self.bounds[i]
            if (n := slips(words[r], self.squeezed[i], most)) <= most and abs(len(split[r]) - int(self.sizes[i])) <= (n > 0):
                best[r][n].append((cosine, i))
        for r, by_slips in best.items():
            n = min(by_slips)
            confidence = self.confidence(max(c for c, _ in by_slips[n]), n)
            if confidence >= LEAST_CONFIDENCE:
                self.memory[new[r]] = ([self.phrases[i] for _, i in by_slips[n]], confidence, n)

    def mentions(self, windows: list[tuple[int, int, str]]) -> list[tuple[int, int, str, tuple[str, ...], float]]:
        """(start, end, kind, concepts, confidence) of a sentence's windows; longer and better mentions first, none overlap."""
        found = []
        for i, j, text in windows:
            if hit := self.memory[text]:
                for kind in sorted({p.kind for p in hit[0]}):
                    found.append((i, j, kind, tuple(sorted({c for p in hit[0] if p.kind == kind for c in p.concepts})), hit[1], hit[2]))
        taken: set[int] = set()
        out = []
        for i, j, kind, concepts, conf, n in sorted(found, key=lambda x: (-(x[1] - x[0] - x[5] * 0.4), x[5], x[0])):
            if taken.isdisjoint(range(i, j)) and not (kind == "a" and len(concepts) > 1 and n > 0):
                taken.update(range(i, j))
                out.append((i, j, kind, concepts, conf))
        return sorted(out)

    def about_texts(self, subjects: list[str | None], bodies: list[str | None]) -> list[list[tuple[str, float, str]]]:
        """(key, confidence, how) of everything that each text names; see phrases_of for keys."""
        read = []
        for subject, body in zip(subjects, bodies):
            parts = [(True, _tokens(subject))] if subject else []
            parts += [(False, _tokens(x)) for x in _PART.split(body or "") if x]
            read.append([(x, t, w) for x, t in parts if (w := self.windows(t))])
        self.look_up([text for parts in read for _, _, windows in parts for _, _, text in windows])
        return [self._about([(x, t, self.mentions(w)) for x, t, w in parts]) for parts in read]

    def _about(self, parts: list[tuple[bool, list[str], list[tuple]]]) -> list[tuple[str, float, str]]:
        out: dict[str, tuple[float, str]] = {}

        def put(key: str, conf: float, how: str) -> None:
            if key in self.keys and conf > out.get(key, (0.0, ""))[0]:
                out[key] = (conf, how)

        loose_p: dict[str, float] = {}
        loose_r: dict[str, float] = {}
        for is_subject, tokens, found in parts:
            for _, _, kind, concepts, conf in found:
                for c in concepts:
                    put(f"~{c}" if kind == "a" else f"={c}", conf, "other name" if kind == "a" else "one concept")
            products, rules = [m for m in found if m[2] == "p"], [m for m in found if m[2] == "r"]
            if self.same:  # entries whose concepts are of one kind
                for x, y in ((x, y) for side in (products, rules) for x in side for y in side):
                    for a, b in ((a, b) for a in x[3] for b in y[3]):
                        put(f"{a}|{b}", x[4] * y[4], "one sentence")
            if products and rules:
                for p, r in _belonging(products, rules):
                    for a in p[3]:
                        for b in r[3]:
                            put(f"{a}|{b}", p[4] * r[4], "one sentence")
            elif products:
                for m in products:
                    for c in m[3]:
                        loose_p[c] = max(m[4], loose_p.get(c, 0))
            else:
                for m in rules:
                    tail = tokens[m[1] : m[1] + 2]
                    bound = len(tail) == 2 and tail[0] in ("for", "of", "in", "on") or is_subject and len([t for t in tokens if t not in _STOP]) > m[1] - m[0] + 1
                    if not bound:
                        for c in m[3]:
                            loose_r[c] = max(m[4], loose_r.get(c, 0))
        if len(loose_p) == 1:
            for a, x in loose_p.items():
                for b, y in loose_r.items():
                    put(f"{a}|{b}", 0.9 * x * y, "read together")
        return [(k, c, how) for k, (c, how) in out.items()]


def _belonging(products: list, rules: list) -> list[tuple]:
    """Products and rules of one sentence in pairs: with one of either, all; else each rule with its nearest product."""
    if len(products) == 1 or len(rules) == 1:
        return [(p, r) for p in products for r in rules]
    gap = lambda p, r: max(p[0], r[0]) - min(p[1], r[1])
    return [(min(products, key=lambda p: gap(p, r)), r) for r in rules]


def _letters(words: list[str]) -> np.ndarray:
    """How often each letter occurs in each word; letters may share a place, which only makes words look more alike."""
    out = np.zeros((len(words), 32), np.int16)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % 32
    np.add.at(out, (np.repeat(np.arange(len(words)), [len(w) for w in words]), flat), 1)
    return out


def _trigrams(token: str) -> list[str]:
    t = f"<{token}>"
    return [t[i : i + 3] for i in range(max(1, len(t) - 2))]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(1e-9, float(np.linalg.norm(v)))


def _slipped(text: str, rng: np.random.Generator) -> str:
    i = int(rng.integers(0, max(1, len(text) - 1)))
    return [text[:i] + text[i + 1 :], text[:i] + text[i : i + 1] + text[i:], text[:i] + text[i + 1 : i + 2] + text[i : i + 1] + text[i + 2 :], text[:i] + "aeions"[int(rng.integers(6))] + text[i + 1 :]][int(rng.integers(4))]


def token_links(texts: DataFrame, text_cols: list[str], vocabulary: list[str]) -> list[tuple[str, str, float]]:
    """(token, token, weight): how a walk gets from token to token through the distinct texts of all rows, where it leaves a
    text by any of its tokens alike. All texts together weigh as WALK_TEXTS would, however many they are. Counted within
    each task first; no more pairs than the vocabulary, which is bounded with the register, has."""
    known = {t: i for i, t in enumerate(t for t in vocabulary if t not in _STOP)}
    names, size = list(known), len(known)
    shared = texts.sparkSession.sparkContext.broadcast(known)  # bounded with the register

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        codes, sums, n = np.zeros(0, np.int64), np.zeros(0), 0
        for batch in batches:
            found, shares, new, parts = [codes], [sums], [], []
            for text in batch.iloc[:, 0]:
                if at := {known[t] for t in _tokens(text) if t in known}:
                    n += 1
                    new += [i * size + j for i in at for j in at]
                    parts += [1 / len(at)] * len(at) ** 2
            found.append(np.array(new, np.int64))
            shares.append(np.array(parts, np.float64))
            codes, inverse = np.unique(np.concatenate(found), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate(shares), len(codes))
        yield pd.DataFrame({"code": np.append(codes, -1), "w": np.append(sums, float(n))})

    each = texts.select(F.explode(F.array(*[F.col(c) for c in text_cols])).alias("t")).where(F.length("t") > 0).distinct()
    got = each.mapInPandas(run, "code long, w double").groupBy("code").agg(F.sum("w").alias("w")).orderBy("code").toPandas()
    total = float(got["w"].iloc[0]) if len(got) else 0.0
    return [(names[c // size], names[c % size], w * WALK_TEXTS / total) for c, w in zip(got["code"].tolist(), got["w"].round(9).tolist()) if c >= 0]


def build_index(register: DataFrame, aliases: DataFrame, texts: DataFrame, *text_cols: str) -> Index:
    """An index of a register of bounded size; the texts of all rows take part in the walks."""
    entries = bounded_rows(register.select("id", "title", "description").where(F.col("id").isNotNull()), MOST_REGISTER)
    names = bounded_rows(aliases.select("procedure_id", "alias").where(F.col("alias").isNotNull() & F.col("procedure_id").isNotNull()), 10 * MOST_REGISTER)
    if entries is None or names is None:
        raise ValueError(f"the register has more than {MOST_REGISTER} entries")
    rows, pairs = [tuple(r) for r in sorted(entries)], sorted((r[0], r[1]) for r in names)
    return Index(rows, pairs, token_links(texts, list(text_cols), vocabulary_of(phrases_of(rows, pairs)[0])))


_INDEXES: dict[str, Index] = {}


def _index(shared, key: str) -> Index:
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = shared.value
    return _INDEXES[key]


def concepts(df: DataFrame, subject: Column, body: Column, index: Index, pages: Model | None = None) -> Column:
    """array<struct<concept, confidence, how>> of what a subject and a body, read together, name. Nulls name nothing.

    With a model of scanned pages, bodies are read without the traces of their pages.
    """
    import uuid

    shared, key = df.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex  # bounded with the register
    scanned = df.sparkSession.sparkContext.broadcast(pages) if pages else None  # of bounded size

    @F.pandas_udf("array<struct<concept:string,confidence:double,how:string>>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        idx = _index(shared, key)
        for subjects, bodies in batches:
            a, b = subjects.tolist(), bodies.tolist()
            if scanned is not None:
                reader = page_reader(scanned, key)
                b = [reader.read(x).text if x else x for x in b]
            yield pd.Series(list(chain.from_iterable(idx.about_texts(a[lo : lo + 2000], b[lo : lo + 2000]) for lo in range(0, len(a), 2000))), dtype=object)

    return find(subject, body)


def match(records: DataFrame, register: DataFrame, index: Index, id_col: str, subject_col: str, body_col: str, date_col: str, before_days: int = 540, after_days: int = 180, pages: Model | None = None) -> DataFrame:
    """(record id, procedure_id, confidence, how): each record with every register entry that it is about, once.

    One narrow pass over the records; the keys it yields are equi-joined with the register, whose rows are bounded (see
    MOST_REGISTER), and an entry counts where all keys of one of its ways are there. The record's date must lie between
    proposal_date - before_days and decision_date + after_days; null dates leave that side open. Records that name
    nothing give no row; repeated records one.
    """
    spark = records.sparkSession
    about = spark.createDataFrame(sorted(set(index.about)) or [("", "", "", 1)], "concept string, procedure_id string, way string, needs int")
    entries = register.groupBy(F.col("id").alias("procedure_id")).agg(F.min("proposal_date").alias("__from"), F.max(F.coalesce("decision_date", F.lit("9999-01-01").cast("date"))).alias("__to"))
    files = F.broadcast(about.join(entries, "procedure_id"))
    named = records.select(records[id_col].alias("__id"), records[date_col].alias("__date"), F.explode(concepts(records, records[subject_col], records[body_col], index, pages)).alias("__c")).select("__id", "__date", "__c.*")
    found = named.join(files, "concept").where(
        F.col("__date").isNull() | ((F.col("__from").isNull() | (F.col("__date") >= F.date_sub("__from", before_days))) & (F.col("__to") >= F.date_sub("__date", after_days)))
    )
    by_key = found.groupBy("__id", "procedure_id", "way", "needs", "concept").agg(F.max(F.struct("confidence", "how")).alias("__b"))
    by_way = by_key.groupBy("__id", "procedure_id", "way", "needs").agg(F.count("*").alias("__n"), F.min("__b.confidence").alias("confidence"), F.min("__b.how").alias("how")).where(F.col("__n") == F.col("needs"))
    return by_way.groupBy(F.col("__id").alias(id_col), "procedure_id").agg(F.max(F.struct("confidence", "how")).alias("__b")).select(id_col, "procedure_id", "__b.*")

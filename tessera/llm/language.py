"""Languages of documents and of their segments.

Each language is a distribution over hashed character trigrams, learned from labelled rows and cleaned by a few rounds
of re-labelling their sentences. A document is a mixture: expectation-maximisation estimates the languages' proportions
from the likelihoods of its sentences, and a language joins the set only if the penalised likelihood grows. Every
sentence then takes the language with the largest posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Writings of languages in labels (ISO 639-1; 639-2/T and /B; English names; own names).
CODES = {
    "bg": "bul bulgarian български", "cs": "ces cze czech čeština", "da": "dan danish dansk", "de": "deu ger german deutsch", "el": "ell gre greek ελληνικά", "en": "eng english", "es": "spa spanish español castellano", "et": "est estonian eesti",
    "fi": "fin finnish suomi", "fr": "fra fre french français", "ga": "gle irish gaeilge", "hr": "hrv croatian hrvatski", "hu": "hun hungarian magyar", "it": "ita italian italiano", "lt": "lit lithuanian lietuvių", "lv": "lav latvian latviešu",
    "mt": "mlt maltese malti", "nl": "nld dut dutch nederlands", "pl": "pol polish polski", "pt": "por portuguese português", "ro": "ron rum romanian română", "sk": "slk slo slovak slovenčina", "sl": "slv slovenian slovenščina", "sv": "swe swedish svenska",
}
WRITINGS = {w: code for code, names in CODES.items() for w in [code, *names.split()]}

#: Labelled rows read for training, a language at most about this many; a language with fewer than LEAST_ROWS isn't learned.
TRAINING_ROWS, LEAST_ROWS = 300, 5
BUCKETS = 1 << 16
#: Nats a further language must gain: PENALTY and half the logarithm of the number of letters.
PENALTY = 14.0
#: Neighbouring trigrams share letters; their joint likelihood is tempered by this.
TEMPER = 1 / 3

_KNOWN = 0x3100


def _letters() -> np.ndarray:
    """Lower-case letters as they are, all other characters as a space."""
    out = np.full(_KNOWN, 32, np.uint32)
    for i in range(_KNOWN):
        x = chr(i).lower()
        if x.isalpha() and len(x) == 1:
            out[i] = ord(x)
    return out


_LETTERS = _letters()
_SENTENCE = re.compile(r"""[.!?…;·。！？]["'”’»)\]]*(?:[ \t]*\r?\n\s*|\s+(?![a-zà-öø-ÿά-ώ0-9\s])|(?<=[。！？]))|\n\s*\n\s*|\n\s*(?=[-•*·–]\s)""")
_ENDS = re.compile(r"""[.!?…;。！？]["'”’»)\]]*\s*$""")
_THREE_WORDS = re.compile(r"[^\W\d_]{2,}(?:[^\w]+(?:\w+[^\w]+){0,30}?[^\W\d_]{2,}){2}")


def label_code(label: Column) -> Column:
    """A label in any usual writing as a two-letter code; null if it is missing or says nothing."""
    known = F.create_map(*[F.lit(x) for pair in sorted(WRITINGS.items()) for x in pair])
    return F.element_at(known, F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts between sentence ends, blank lines and list marks; together they cover the text."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def is_sentence(part: str) -> bool:
    return bool(_ENDS.search(part[-8:])) and bool(_THREE_WORDS.search(part))


def trigrams(text: str) -> np.ndarray:
    """One bucket for each position of the text: the hash of the three characters that begin there, 0 where they hold no word."""
    c = _LETTERS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), _KNOWN - 1)]
    c = np.concatenate((c, np.full(2, 32, np.uint32)))
    a, b, d = c[:-2], c[1:-1], c[2:]
    with np.errstate(over="ignore"):
        h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + d * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
    h = (h >> np.uint32(16)).astype(np.int64)
    h[(b == 32)] = 0
    return h


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: log-probabilities, row 0 zeros


def _estimate(counts: np.ndarray) -> np.ndarray:
    counts = counts + 0.02
    table = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)
    table[0] = 0
    return table


def train(rows: list[tuple[str, str]], rounds: int = 3) -> Model:
    """From (text, code) rows; wrong labels and mixed texts are taken care of by labelling the sentences again."""
    sizes: dict[str, int] = {}
    for _, code in rows:
        sizes[code] = sizes.get(code, 0) + 1
    languages = sorted(code for code, n in sizes.items() if n >= LEAST_ROWS)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    at = {code: i for i, code in enumerate(languages)}
    prepared = [(trigrams(t), [a for a, _ in sentences(t)], at[code]) for t, code in rows if code in at and t]
    counts = np.zeros((BUCKETS, len(languages)))
    for grams, _, k in prepared:
        counts[:, k] += np.bincount(grams, minlength=BUCKETS)
    for _ in range(rounds):
        counts[0] = 0
        table = _estimate(counts)
        counts = np.zeros_like(counts)
        for grams, starts, _ in prepared:
            best = np.add.reduceat(table[grams], starts, axis=0).argmax(axis=1)
            owner = np.repeat(best, np.diff([*starts, len(grams)]))
            for k in np.unique(best):
                counts[:, k] += np.bincount(grams[owner == k], minlength=BUCKETS)
    counts[0] = 0
    return Model(languages, _estimate(counts))


def penalty(characters: int) -> float:
    return PENALTY + 0.5 * float(np.log(max(characters, 2)))


def mixture(scores: np.ndarray, letters: int, steps: int = 25) -> tuple[list[int], np.ndarray]:
    """(languages, proportions) of a document from its sentences' log-likelihoods."""
    totals = scores.sum(axis=0)
    chosen = [int(totals.argmax())]
    least = penalty(letters)
    best, share = float(totals[chosen[0]]), np.ones(1)
    while len(chosen) < scores.shape[1]:
        have = scores[:, chosen].max(axis=1, keepdims=True)
        gain = np.maximum(scores - have, 0).sum(axis=0)  # no mixture can gain more by this language
        gain[chosen] = -1
        new = int(gain.argmax())
        if gain[new] <= least:
            break
        sub = scores[:, [*chosen, new]]
        top = sub.max(axis=1, keepdims=True)
        like = np.exp(sub - top)
        theta = np.full(sub.shape[1], 1 / sub.shape[1])
        for _ in range(steps):
            post = like * theta
            total = post.sum(axis=1, keepdims=True)
            nxt = (post / total).mean(axis=0)
            if np.abs(nxt - theta).max() < 1e-4:
                break
            theta = nxt
        value = float((np.log((like * theta).sum(axis=1)) + top[:, 0]).sum())
        if value - best <= least:
            break
        chosen, best, share = [*chosen, new], value, theta
    return chosen, share


@dataclass
class Reading:
    text: str
    parts: list[tuple[int, int]]
    scores: np.ndarray  # parts x languages: tempered log-likelihoods
    chosen: list[int]
    share: np.ndarray

    def best(self) -> np.ndarray:
        if len(self.chosen) == 1:
            return np.full(len(self.parts), self.chosen[0])
        return np.array(self.chosen)[(self.scores[:, self.chosen] + np.log(np.maximum(self.share, 1e-9))).argmax(axis=1)]

    def segments(self, languages: list[str]) -> list[tuple[int, int, int, bool, str | None, float]]:
        """(number, start, end, whole sentence, language, confidence) of every part; no language where there are no words."""
        if not languages:
            return [(k + 1, a, b, is_sentence(self.text[a:b]), None, 0.0) for k, (a, b) in enumerate(self.parts)]
        best = self.best()
        mine = self.scores[np.arange(len(best)), best][:, None]
        sure = 1 / np.exp(np.clip(self.scores - mine, -50, 50)).sum(axis=1)
        words = self.scores.any(axis=1)
        return [(k + 1, a, b, is_sentence(self.text[a:b]), languages[best[k]] if words[k] else None, float(sure[k]) if words[k] else 0.0) for k, (a, b) in enumerate(self.parts)]

    def whole_languages(self, languages: list[str]) -> list[str]:
        """The languages that have a whole sentence in the text."""
        if not languages:
            return []
        best, found = self.best(), []
        for k in self.chosen:
            for i in np.flatnonzero(best == k):
                a, b = self.parts[i]
                if self.scores[i].any() and is_sentence(self.text[a:b]):
                    found.append(languages[k])
                    break
        return sorted(found)


def read_batch(model: Model, texts: list[str]) -> list[Reading]:
    """Readings of some texts; their characters are looked up together."""
    n = len(model.languages)
    parts = [sentences(t) for t in texts]
    if not n:
        return [Reading(t, p, np.zeros((len(p), 0)), [], np.ones(0)) for t, p in zip(texts, parts)]
    grams = trigrams("\n".join(texts))
    starts, at = [], 0
    for t, p in zip(texts, parts):
        starts.extend(at + a for a, _ in p)
        at += len(t) + 1
    if not starts:
        return [Reading(t, p, np.zeros((0, n)), [0], np.ones(1)) for t, p in zip(texts, parts)]
    scores = np.add.reduceat(np.take(model.table, grams, axis=0), starts, axis=0).astype(np.float64) * TEMPER
    sizes = [len(p) for p in parts]
    some = np.flatnonzero(sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    totals = np.add.reduceat(scores, first[some], axis=0)
    single = totals.argmax(axis=1)
    own = scores[np.arange(len(scores)), np.repeat(single, np.array(sizes)[some])]
    gains = np.add.reduceat(np.maximum(scores - own[:, None], 0), first[some], axis=0).max(axis=1)
    out, place = [], dict(zip(some.tolist(), range(len(some))))
    for i, (t, p) in enumerate(zip(texts, parts)):
        s = scores[first[i] : first[i + 1]]
        if not p:
            out.append(Reading(t, p, s, [0], np.ones(1)))
        elif gains[place[i]] <= penalty(len(t)):  # no mixture can be worth it
            out.append(Reading(t, p, s, [int(single[place[i]])], np.ones(1)))
        else:
            out.append(Reading(t, p, s, *mixture(s, len(t))))
    return out


def readings(model: Model, texts: list[str | None], most: int = 400_000) -> Iterator[Reading | None]:
    """read_batch over groups of about `most` characters; None for null and empty texts."""
    group: list[str] = []
    filled: list[bool] = []
    size = 0

    def flush() -> Iterator[Reading | None]:
        found = iter(read_batch(model, group)) if group else iter(())
        for x in filled:
            yield next(found) if x else None

    for t in texts:
        filled.append(bool(t))
        if t:
            group.append(t)
            size += len(t)
        if size >= most:
            yield from flush()
            group, filled, size = [], [], 0
    yield from flush()


def training_rows(df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = TRAINING_ROWS) -> list[tuple[str, str]]:
    """About per_language labelled rows of each language, chosen by the hash of their id; never more than twice that in all."""
    labelled = df.select(F.xxhash64(df[id_col]).alias("__h"), df[text_col].alias("__text"), label_code(df[label_col]).alias("__code")).where(F.col("__code").isNotNull() & (F.length("__text") > 40))
    sizes = {r[0]: r[1] for r in labelled.groupBy("__code").count().collect()}  # no more rows than there are codes
    if not sizes:
        return []
    keep = F.create_map(*[F.lit(x) for code, n in sorted(sizes.items()) for x in (code, min(1.0, per_language / n))])
    part = labelled.where(F.pmod(F.col("__h"), F.lit(1_000_003)) < F.element_at(keep, F.col("__code")) * 1_000_003)
    return [(r[0], r[1]) for r in part.orderBy("__h", "__text", "__code").select("__text", "__code").limit(2 * per_language * len(sizes)).collect()]


SEGMENTS = "array<struct<segment:int,start:int,end:int,whole:boolean,language:string,confidence:double>>"


def _reader(df: DataFrame, text: Column, model: Model, kind: str, make) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the data's size

    @F.pandas_udf(kind)
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in texts:
            yield pd.Series([[] if x is None else make(x, model.languages) for x in readings(model, batch.tolist())], dtype=object)

    return read(text)


def segments(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """One row a part of every text: id, segment, start, end (code points, from 0), whole, language, confidence.

    Null and empty texts give no row; a part without words has no language. Repeated ids give repeated rows.
    """
    found = df.select(df[id_col].alias("__id"), F.explode(_reader(df, df[text_col], model, SEGMENTS, Reading.segments)).alias("__s"))
    return found.select(F.col("__id").alias(id_col), "__s.*")


def whole_languages(df: DataFrame, text_col: str, model: Model) -> Column:
    """The languages with at least one whole sentence in a text, as a sorted array; empty for null and empty texts."""
    return _reader(df, df[text_col], model, "array<string>", Reading.whole_languages)


def mislabelled(df: DataFrame, id_col: str, text_col: str, label_col: str, model: Model | None = None) -> DataFrame:
    """(id, language), a row for each language of the texts whose label is missing, says nothing or is wrong, or that hold several.

    Texts without a whole sentence give nothing. Ids that come more than once give one set of rows. One pass over the
    texts after the bounded training read; only the ids of the rows found are shuffled.
    """
    if model is None:
        model = train(training_rows(df, id_col, text_col, label_col))
    read = df.where(F.length(df[text_col]) > 0).select(df[id_col].alias("__id"), label_code(df[label_col]).alias("__code"), whole_languages(df, text_col, model).alias("__found"))
    wrong = F.col("__code").isNull() | ~F.array_contains("__found", F.col("__code"))
    cases = read.where((F.size("__found") > 1) | ((F.size("__found") == 1) & wrong))
    return cases.select(F.col("__id").alias(id_col), F.explode("__found").alias("language")).distinct()

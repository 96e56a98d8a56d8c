"""What the entries of a register are about, from their titles, descriptions and other names, in whatever wording.

Nothing is known of how titles are worded. Texts are cut where what may come next and what may have come before both
vary (successor and predecessor variety), which leaves phrases. A walk from a phrase of the descriptions over a record
that has it to a phrase of that record's title ends nearly always at the same one if both mean the same thing, and
anywhere if the phrase is only form. Phrases of titles that no description and no other name takes up again are form
too. What is left are concepts with their wordings, and each entry is about one or more of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

#: Tokens of a context, how often a context of two or more must occur to be looked at, and bits of variety: on the poorer and on the richer side of a cut.
REACH, SEEN, POOR, RICH = 3, 8, 0.5, 2.15
#: Share of walks from a wording that end at its concept, and of a concept's descriptions that have the wording.
SURE, TAKEN_UP = 0.8, 0.3
#: Share of the entries that have a phrase up to which it says something, where an entry has neither description nor other name.
RARE_ENOUGH = 0.1

_APART = re.compile(r"[^\w\s\-’'/&.]+|\.(?=\s|$)")


@dataclass
class Concepts:
    wordings: dict[str, set[str]] = field(default_factory=dict)  # concept -> phrases, itself among them
    kinds: dict[str, str] = field(default_factory=dict)  # concept -> p (a thing) or r (what is said of it)
    entries: dict[str, tuple[str, ...]] = field(default_factory=dict)  # entry -> its concepts, the rarest first


def _contexts(chunks: list[list[str]]) -> tuple[dict[tuple[str, ...], Counter], dict[tuple[str, ...], Counter]]:
    """What follows and what precedes each run of up to REACH tokens."""
    after: dict[tuple[str, ...], Counter] = defaultdict(Counter)
    before: dict[tuple[str, ...], Counter] = defaultdict(Counter)
    for c in chunks:
        for k in range(len(c) + 1):
            for m in range(1, REACH + 1):
                if k >= m:
                    after[tuple(c[k - m : k])][c[k] if k < len(c) else "</s>"] += 1
                if k + m <= len(c):
                    before[tuple(c[k : k + m])][c[k - 1] if k else "<s>"] += 1
    return after, before


def _bits(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(v / n * math.log2(v / n) for v in counts.values())


def _cut(chunk: list[str], after: dict, before: dict, known: dict[tuple[str, ...], float]) -> list[str]:
    """A chunk cut where both sides vary; the longest context that occurs often enough is looked at."""

    def variety(side: dict, runs: list[tuple[str, ...]], mark: str) -> float:
        run = next((r for r in runs if len(r) == 1 or sum(side[r].values()) >= SEEN))
        if (mark, run) not in known:
            known[mark, run] = _bits(side[run])
        return known[mark, run]

    out = [[chunk[0]]]
    for k in range(1, len(chunk)):
        a = variety(after, [tuple(chunk[k - m : k]) for m in range(min(REACH, k), 0, -1)], "a")
        b = variety(before, [tuple(chunk[k : k + m]) for m in range(min(REACH, len(chunk) - k), 0, -1)], "b")
        if min(a, b) >= POOR and max(a, b) >= RICH:
            out.append([])
        out[-1].append(chunk[k])
    return [" ".join(x) for x in out]


def _parts(phrase: str, counts: Counter) -> list[str] | None:
    """A phrase as the fewest phrases that are all more frequent than itself, or with a more frequent phrase of several tokens cut out."""
    words, n = phrase.split(), counts[phrase]
    best: list[list[str] | None] = [[]] + [None] * len(words)
    for j in range(1, len(words) + 1):
        for i in range(j):
            part = " ".join(words[i:j])
            if best[i] is not None and j - i < len(words) and counts.get(part, 0) > n and (best[j] is None or len(best[i]) + 1 < len(best[j])):
                best[j] = [*best[i], part]
    if best[-1]:
        return best[-1]
    for size in range(len(words) - 1, 1, -1):  # the longest first
        for i in range(len(words) - size + 1):
            if counts.get(" ".join(words[i : i + size]), 0) > n:
                return [" ".join(x) for x in (words[:i], words[i : i + size], words[i + size :]) if x]
    return None


def phrases(texts: dict[str, str | None], tokens: Callable[[str], list[str]]) -> dict[str, list[str]]:
    """The phrases of each record's text, in order."""
    chunks = {i: [t for c in _APART.split(x or "") if (t := tokens(c))] for i, x in texts.items()}
    after, before = _contexts([c for x in chunks.values() for c in x])
    known: dict = {}
    out = {i: [s for c in x for s in _cut(c, after, before, known)] for i, x in chunks.items()}
    for _ in range(4):  # what is cut off lets others be cut
        counts = Counter(s for x in out.values() for s in x)
        memo = {s: _parts(s, counts) or [s] for s in counts}
        out = {i: [p for s in x for p in memo[s]] for i, x in out.items()}
    return out


def _akin(a: str, b: str) -> bool:
    """Whether two tokens are one word or forms of one."""
    n = min(len(a), len(b))
    return a == b or (n >= 5 and a[:5] == b[:5])


def read_register(entries: list[tuple[str, str | None, str | None]], aliases: list[tuple[str, str]], tokens: Callable[[str], list[str]], stop: set[str]) -> Concepts:
    """Concepts of (id, title, description) entries with (id, other name) pairs. Every entry that has a token in its title gets one or more."""
    titles = {i: list(dict.fromkeys(x)) for i, x in phrases({i: t for i, t, _ in entries}, tokens).items()}
    bodies = {i: set(x) for i, x in phrases({i: d for i, _, d in entries}, tokens).items()}
    other: dict[str, set[str]] = defaultdict(set)
    for i, name in aliases:
        other[i] |= {t for t in tokens(name) if t not in stop}
    holders: dict[str, list[str]] = defaultdict(list)  # phrase of titles -> entries
    for i, x in titles.items():
        for s in x:
            holders[s].append(i)
    said: dict[str, list[str]] = defaultdict(list)  # phrase of descriptions -> entries
    for i, x in bodies.items():
        for s in x:
            said[s].append(i)
    described = {s: sum(bool(bodies[i]) for i in x) for s, x in holders.items()}

    wordings: dict[str, set[str]] = defaultdict(set)
    for y, records in said.items():
        ends = Counter(s for i in records for s in titles[i])  # where walks phrase - record - phrase end
        sure = [(n * math.log(n / len(records) * len(entries) / len(holders[x])), -len(holders[x]), x) for x, n in ends.items() if n >= SURE * len(records) and n >= TAKEN_UP * described[x]]
        if sure and (best := max(sure))[0] > 0 and any(t not in stop for t in y.split()):
            wordings[best[2]].add(y)
    named = {s: [any(_akin(t, a) for t in s.split() if t not in stop for a in other[i]) for i in x if other[i]] for s, x in holders.items()}
    topical = {s for s in holders if s in wordings or (named[s] and 2 * sum(named[s]) >= len(named[s]))}

    out = Concepts()
    for i, x in titles.items():
        mine = [s for s in x if s in topical]
        if not mine:  # neither description nor other name says more
            rare = [s for s in x if len(holders[s]) <= max(1, RARE_ENOUGH * len(entries))] or x
            mine = sorted(rare, key=lambda s: (len(holders[s]), -sum(t not in stop for t in s.split()), -x.index(s)))[:1]
        if mine:
            out.entries[i] = tuple(sorted(mine, key=lambda s: (len(holders[s]), s)))
    for c in {c for x in out.entries.values() for c in x}:
        out.wordings[c] = {c} | wordings[c]
    _colour(out)
    return out


def _colour(c: Concepts) -> None:
    """Two kinds of concepts: those of one entry are of different kinds. Begins with the rarer one of each entry as the thing."""
    votes: Counter = Counter()
    partners: dict[str, Counter] = defaultdict(Counter)
    for x in c.entries.values():
        for a in x:
            for b in x:
                partners[a][b] += a != b
        if len(x) > 1:
            votes[x[0]] += 1
            for r in x[1:]:
                votes[r] -= 1
    sign = {a: 1 if votes[a] >= 0 else -1 for a in c.wordings}
    for _ in range(5):
        for a in sorted(sign):
            if against := sum(n * sign[b] for b, n in partners[a].items()):
                sign[a] = -1 if against > 0 else 1
    c.kinds = {a: "p" if s > 0 else "r" for a, s in sign.items()}

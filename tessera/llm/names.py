"""Variant spellings of names, linked to a register.

Every name is rewritten to canonical forms: letters are folded, titles, offices and legal forms are set aside, tokens
are read as register tokens (as they are, as an abbreviation, a nickname, an initial or with slips of the keyboard)
and sorted. The forms are exploded and equi-joined with the register's own forms; the rarer the rewriting that leads
to a body, the more it says: forms that several bodies share, and forms reached over costly rewritings, score less.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows

#: Rows that a register may have: its lexicon is broadcast.
MOST_REGISTER = 200_000

# Legal forms as they look folded and without dots, by what they stand for.
LEGAL = {
    "ltd": "ltd limited", "plc": "plc", "llc": "llc", "inc": "inc incorporated", "corp": "corp corporation", "llp": "llp", "gmbh & co kg": "gmbh co kg|gmbh and co kg|gmbh und co kg|gmbh cokg|gmbh and cokg",
    "gmbh": "gmbh|gesmbh|g m b h", "ag": "ag|aktiengesellschaft|a g", "ev": "ev|e v|eingetragener verein", "kg": "kg|k g", "ohg": "ohg", "se": "se", "sa": "sa|s a|societe anonyme", "sas": "sas|s a s", "sarl": "sarl|sa rl|s a rl|s a r l|s arl|sa r l",
    "sl": "sl|s l", "slu": "slu", "spa": "spa|s p a|sp a", "srl": "srl|s r l|s rl", "lda": "lda|l d a|limitada", "bv": "bv|b v", "nv": "nv|n v", "bvba": "bvba", "vzw": "vzw", "asbl": "asbl", "aisbl": "aisbl|ivzw", "ab": "ab|a b|aktiebolag",
    "oy": "oy|o y|osakeyhtio", "oyj": "oyj", "as": "as|a s|aktieselskab", "aps": "aps", "ae": "ae|a e", "epe": "epe", "zoo": "sp z oo|sp zoo|spzoo|sp z o o|spolka z oo", "sro": "sro", "doo": "doo", "kft": "kft", "zrt": "zrt", "ood": "ood", "eood": "eood",
}
# Words that say nothing about which body is meant.
STOP = set("of the and for a an & fur pour de des du d l la le les do da dos das di del della dei degli e et y und van von het der den die das i im in na w z o".split())
TITLES = set("mr mrs ms miss dr prof professor m mme mlle herr frau ing sir dame sr sra don dona re".split())
OFFICES = set("hq headquarters group office liaison eu brussels bruxelles brussel bureau representation holding".split())
# Given names people use for one another.
NICKNAMES = {
    "aleksander": "olek alek sasha alex", "alexander": "alex sasha sandro", "andreas": "andi", "anthony": "tony", "antonio": "toni tonio", "barbara": "basia babs", "catherine": "cathy kate", "charles": "charlie chuck", "christopher": "chris",
    "daniel": "dan danny", "david": "dave", "edward": "ed eddie ted ned", "elisabeth": "liz lisa beth betty lizzie sissi elise liesl lisl lisbeth bettina elsa", "elizabeth": "liz lisa beth betty", "francisco": "paco pancho curro fran kiko", "francesco": "franco cecco",
    "friedrich": "fritz", "giovanni": "gianni vanni", "giuseppe": "beppe peppe pino peppino", "guillermo": "memo", "heinrich": "heinz", "henry": "harry hank", "ignacio": "nacho", "james": "jim jimmy jamie", "johannes": "hans hannes", "john": "jack johnny",
    "jose": "pepe chepe pepito", "joseph": "joe", "jurgen": "jorg jogi", "katarzyna": "kasia", "katharina": "kathi kati kathe kathy katja kat trina", "krzysztof": "krzys", "lawrence": "larry", "malgorzata": "gosia malgosia goska", "margaret": "maggie meg peggy marge greta madge margie",
    "maria": "mia", "matthew": "matt", "michael": "mike mick", "nicholas": "nick", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "richard": "dick rick", "robert": "bob rob bobby robbie bert", "samuel": "sam", "stephen": "steve", "susan": "sue",
    "theodora": "dora thea theo teddy", "theodore": "ted theo", "thomas": "tom", "wilhelm": "willi", "william": "bill will billy liam willy", "wojciech": "wojtek",
}
# Short writings that neither begin like the word nor keep its consonants.
SHORT = {"bv": "bundesverband", "bvb": "bundesverband", "arge": "arbeitsgemeinschaft", "fdn": "foundation", "intl": "international", "natl": "national", "govt": "government", "dept": "department", "fv": "fachverband", "osterr": "osterreichischer", "int": "international"}

_FOLD = str.maketrans({"ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ı": "i", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "’": " ", "'": " ", "`": " ", "´": " ", "&": " and ", "/": "", "’": " "})
_DOTTED = re.compile(r"\b(?:\w\.){2,}(?:\w\b)?")
_TOKEN = re.compile(r"[^\W_�]*�[^\W_]*\.?|[^\W_]+\.?")


def folded(name: str) -> str:
    text = unicodedata.normalize("NFKD", name.translate(_FOLD)).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"\bs\W{0,2}�\W{0,2}r\W{0,2}l\b", "sarl", text)
    return _DOTTED.sub(lambda m: m[0].replace(".", ""), text)


_LEGAL_BY_FIRST: dict[str, list[tuple[list[str], str]]] = defaultdict(list)
for _form, _writings in LEGAL.items():
    for _w in re.split(r"\|", _writings) if "|" in _writings else _writings.split():
        _LEGAL_BY_FIRST[_w.split()[0]].append((_w.split(), _form))
for _v in _LEGAL_BY_FIRST.values():
    _v.sort(key=lambda x: -len(x[0]))


def parsed(name: str) -> tuple[list[str], str | None]:
    """(tokens in order, legal form). A token that was written with a dot keeps it. Stop words, titles and offices are left out."""
    raw = _TOKEN.findall(folded(name))
    bare = [t.rstrip(".") for t in raw]
    out: list[str] = []
    legal, i = None, 0
    while i < len(raw):
        hit = None
        for words, form in _LEGAL_BY_FIRST.get(bare[i], ()) if out else ():
            if bare[i : i + len(words)] == words:
                hit = (len(words), form)
                break
        if hit:
            legal, i = hit[1], i + hit[0]
            continue
        out.append(raw[i])
        i += 1
    kept = [t for t in out if (b := t.rstrip(".")) not in STOP or (t.endswith(".") and len(b) == 1)]
    kept = [t for t in kept if t.rstrip(".") not in TITLES and t.rstrip(".") not in OFFICES or (len(t) == 2 and t[1] == ".")] or kept
    return kept, legal


def deletes(word: str, most: int) -> set[str]:
    found, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found |= edge
    return found


def slips(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; more than `most` counts as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(word: str) -> int:
    return 0 if len(word) <= 3 else 1 if len(word) <= 5 else 2


#: What a rewriting costs: the rarer it is among real variants, the less certain the link.
COST = {"same": 0.0, "short": 1.0, "nick": 1.0, "initial": 2.0, "split": 0.5, "slip": 1.5, "acronym": 1.0}


class Lexicon:
    """The register's tokens and forms. Built from (id, name, acronym) rows."""

    def __init__(self, rows: list[tuple[str, str, str | None]], persons: set[str] = frozenset(), memory: int = 300_000):
        self.forms: dict[str, list[tuple[str, str | None]]] = defaultdict(list)  # key -> bodies with their legal forms
        self.acronyms: dict[str, list[str]] = defaultdict(list)
        self.bodies: dict[str, list[int]] = defaultdict(list)  # token -> keys
        self.keys: list[tuple[str, ...]] = []
        self.given: set[str] = set()
        known: dict[tuple[str, ...], int] = {}
        for id_, name, acronym in rows:
            tokens, legal = parsed(name)
            key = tuple(sorted(t.rstrip(".") for t in tokens))
            if not key:
                continue
            if id_ in persons:
                self.given.add(tokens[0].rstrip("."))
            if key not in known:
                known[key] = len(self.keys)
                self.keys.append(key)
                for t in set(key):
                    self.bodies[t].append(known[key])
            self.forms[" ".join(key)].append((id_, legal))
            if acronym and (a := re.sub(r"\W", "", folded(acronym))):
                self.acronyms[a].append(id_)
        self.vocabulary = set(self.bodies)
        self.by_deletes: dict[str, list[str]] = defaultdict(list)
        self.by_prefix: dict[str, list[str]] = defaultdict(list)
        self.by_first: dict[str, list[str]] = defaultdict(list)
        self.by_ends: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.vocabulary):
            for d in deletes(w, allowed(w)):
                self.by_deletes[d].append(w)
            self.by_prefix[w[:2]].append(w)
            self.by_first[w[0]].append(w)
            self.by_ends[w[0] + w[-1]].append(w)
        self.by_begin: dict[int, dict[str, list[str]]] = {}
        self.given_by_first: dict[str, list[str]] = defaultdict(list)
        for g in sorted(self.given):
            self.given_by_first[g[0]].append(g)
        self.near_acronyms: dict[str, list[str]] = defaultdict(list)
        for a in sorted(self.acronyms):
            for d in deletes(a, 1):
                self.near_acronyms[d].append(a)
        self.formal: dict[str, set[str]] = defaultdict(set)
        for formal, nicks in NICKNAMES.items():
            for n in nicks.split():
                self.formal[n].add(formal)
        self.memory = memory
        self.readings: dict[str, dict[str, float]] = {}
        self.answers: dict[str, list[tuple[str, float, str]]] = {}

    def near(self, word: str, most: int | None = None) -> dict[str, int]:
        most = allowed(word) if most is None else most
        out: dict[str, int] = {}
        for d in deletes(word, most):
            for w in self.by_deletes.get(d, ()):
                if w not in out and (n := slips(word, w, min(2, max(most, allowed(w))))) <= max(most, min(allowed(w), 1)):
                    out[w] = n
        return out

    def read(self, token: str) -> dict[str, float]:
        """Register tokens that a token can stand for, with the cost."""
        if (known := self.readings.get(token)) is not None:
            return known
        word, dotted = token.rstrip("."), token.endswith(".")
        out: dict[str, float] = {}

        def put(w: str, cost: float) -> None:
            if w in self.vocabulary and cost < out.get(w, math.inf):
                out[w] = cost

        put(word, COST["same"])
        if word not in self.vocabulary:
            if len(word) == 1:
                for g in self.given_by_first.get(word, ()):
                    put(g, COST["initial"])
            for f in self.formal.get(word, ()):
                put(f, COST["nick"])
            if word in SHORT:
                put(SHORT[word], COST["short"])
            if len(word) >= 2:
                vowels = sum(c in "aeiouy" for c in word)
                for w in self.by_prefix.get(word[:2], ()):
                    if len(w) > len(word) + 1 and w.startswith(word) and (dotted or len(word) >= 4):
                        put(w, COST["short"])
                if vowels <= max(1, len(word) // 4):
                    for w in self.by_first.get(word[0], ()) if dotted and len(word) >= 4 else self.by_ends.get(word[0] + word[-1], ()):
                        if len(w) >= len(word) + 2 and _subsequence(word, w):
                            put(w, COST["short"] + 0.5)
                if dotted and not out and len(word) >= 4:
                    for w in self.beginning(word):  # a short writing with a slip in it
                        put(w, COST["short"] + COST["slip"])
            for w, n in self.near(word).items():
                put(w, n * COST["slip"])
        if len(self.readings) > self.memory:
            self.readings.clear()
        self.readings[token] = out
        return out

    def beginning(self, word: str) -> set[str]:
        """Words that are longer by two letters at least and begin like a word, with one slip; through an index for each length of beginning."""
        size = len(word)
        if size not in self.by_begin:
            index: dict[str, list[str]] = defaultdict(list)
            for w in self.vocabulary:
                if len(w) > size + 1:
                    for d in deletes(w[:size], 1):
                        index[d].append(w)
            self.by_begin[size] = index
        return {w for d in deletes(word, 1) for w in self.by_begin[size].get(d, ()) if slips(word, w[:size], 1) <= 1}

    def splits(self, token: str) -> list[list[str]]:
        """The token as two, where a space is missing."""
        word = token.rstrip(".")
        out = []
        for i in range(2, len(word) - 1):
            a, b = word[:i], word[i:] + ("." if token.endswith(".") else "")
            if (a in self.vocabulary or b.rstrip(".") in self.vocabulary or a in STOP) and (a in STOP or self.read(a)) and (b in STOP or self.read(b)):
                out.append([x for x in (a, b) if x not in STOP])
        return out

    def matches(self, tokens: list[str]) -> dict[tuple[str, ...], float]:
        """Register keys that these tokens can be read as: each token one of the key's, none left over."""
        read = [self.read(t) for t in tokens]
        if not read or not all(read):
            return {}
        rarest = min(range(len(read)), key=lambda i: sum(len(self.bodies[w]) for w in read[i]))
        out: dict[tuple[str, ...], float] = {}
        for k in {k for w in read[rarest] for k in self.bodies[w]}:
            key = self.keys[k]
            if len(key) == len(tokens) and (cost := _assigned(read, list(key))) is not None and cost < out.get(key, math.inf):
                out[key] = cost
        return out

    def rewritings(self, name: str) -> list[tuple[str, float, str | None]]:
        """(form, cost, legal form) of every canonical rewriting that the register has; acronyms are forms of their own."""
        if (known := self.answers.get(name)) is not None:
            return known
        found: dict[str, tuple[float, str | None]] = {}

        def put(form: str, cost: float, legal: str | None) -> None:
            if form not in found or cost < found[form][0]:
                found[form] = (cost, legal)

        tokens, legal = parsed(name)
        squeezed = re.sub(r"\W", "", folded(name))
        if squeezed in self.acronyms:
            put("=" + squeezed, COST["acronym"], None)
        if len({t.rstrip(".") for t in tokens}) == 1 and (a := tokens[0].rstrip(".")) in self.acronyms:
            put("=" + a, COST["acronym"] + 0.1, None)
        for option in self.options(tokens):
            for key, cost in self.matches(option).items():
                put(" ".join(key), cost, legal)
        if not found:  # a space is missing somewhere, a legal form has a slip in it, or a single letter stands around
            for option in [*self.options(tokens), *self.shorter(tokens)]:
                for key, cost, form in self.loose(option):
                    put(" ".join(key), cost, legal or form)
            if not found:
                for option in [tokens, *self.shorter(tokens)]:
                    for key, cost in {**self.relaxed(option), **(self.matches(option) if option is not tokens else {})}.items():
                        put(" ".join(key), cost + COST["slip"], legal)
            if not found and len(squeezed) >= 6 and len(tokens) == 1:
                for a in {a for d in deletes(squeezed, 1) for a in self.near_acronyms.get(d, ()) if slips(squeezed, a, 1) <= 1}:
                    put("=" + a, COST["acronym"] + 2 * COST["slip"], None)
        out = [(f, c, x) for f, (c, x) in found.items()]
        if len(self.answers) > self.memory:
            self.answers.clear()
        self.answers[name] = out
        return out

    def shorter(self, tokens: list[str]) -> Iterator[list[str]]:
        """The tokens without one at either end that looks like their initials or like an office with slips in it."""
        for i in {0, len(tokens) - 1} if len(tokens) > 1 else ():
            word = tokens[i].rstrip(".")
            if _like_acronym(word, tokens) or any(len(o) >= 6 and slips(word, o, 2) <= 2 for o in OFFICES):
                yield tokens[:i] + tokens[i + 1 :]

    def relaxed(self, tokens: list[str]) -> dict[tuple[str, ...], float]:
        """Keys of as many tokens where a word that only one body has is certain and the others are near, or all but one are certain."""
        out: dict[tuple[str, ...], float] = {}
        if len(tokens) < 2:
            return out
        words = [t.rstrip(".") for t in tokens]
        read = [self.read(t) for t in tokens]
        # a key that counts has a word of its own, or all tokens but one are words of it: then one of any two tokens is
        held = [sum(len(self.bodies[w]) for w in r) for r in read]
        rarest = sorted(range(len(read)), key=held.__getitem__)[:2]
        seen = {self.bodies[w][0] for r in read for w in r if len(self.bodies[w]) == 1}
        seen |= {k for i in rarest for w in read[i] for k in self.bodies[w]}
        for k in seen:
            key = self.keys[k]
            if len(key) != len(tokens):
                continue
            left, open_, cost, own = list(key), [], 0.0, False
            for i in sorted(range(len(tokens)), key=lambda i: sum(w in read[i] for w in key)):
                best = min((w for w in left if w in read[i]), key=read[i].__getitem__, default=None)
                if best is None:
                    open_.append(i)
                else:
                    left.remove(best)
                    cost += read[i][best]
                    own |= len(self.bodies[best]) == 1 and len(best) >= 5 and read[i][best] <= COST["slip"]
            if not open_ or (len(open_) > 1 and not own) or (not own and len(tokens) < 3):
                continue
            for i in open_:
                word = words[i]
                near = sorted((slips(word, w, 4), w) for w in left)
                n, w = near[0]
                if n > ((max(len(w), len(word)) + 1) // 2 if own else 2) or n > 4 or (not own and min(len(w), len(word)) < 4):
                    break
                left.remove(w)
                cost += n * COST["slip"]
            else:
                if cost < out.get(key, math.inf):
                    out[key] = cost
        return out

    def loose(self, tokens: list[str]) -> Iterator[tuple[tuple[str, ...], float, str | None]]:
        """Keys reached by putting a missing space in, or by leaving out a short token that nothing explains."""
        for i, t in enumerate(tokens):
            for parts in self.splits(t) if len(t) >= 5 else ():
                again, form = parsed(" ".join([*tokens[:i], *parts, *tokens[i + 1 :]]))
                for key, cost in self.matches(again).items():
                    yield key, cost + COST["split"], form
            if i == 0 or self.read(t):
                continue
            word = t.rstrip(".")
            if len(word) <= 4:
                for key, cost in self.matches(tokens[:i] + tokens[i + 1 :]).items():
                    yield key, cost + COST["slip"], None
            for form in LEGAL:
                if word.endswith(form) and self.read(word[: -len(form)]):
                    for key, cost in self.matches([*tokens[:i], word[: -len(form)], *tokens[i + 1 :]]).items():
                        yield key, cost + COST["split"], form

    def options(self, tokens: list[str]) -> Iterator[list[str]]:
        """The tokens, and the tokens without a known acronym in them."""
        yield tokens
        without = [t for t in tokens if t.rstrip(".") not in self.acronyms]
        if 0 < len(without) < len(tokens) - 1:
            yield without
        for i, t in enumerate(tokens):
            if len(tokens) > 1 and (t.rstrip(".") in self.acronyms or not self.read(t) and len(t) <= 8 and i in (0, len(tokens) - 1) and _like_acronym(t, tokens)):
                yield tokens[:i] + tokens[i + 1 :]

    def register_forms(self) -> list[tuple[str, str, str | None, float]]:
        """(form, body, legal form, rarity in bits): the fewer bodies share a form, the more it says."""
        total = max(1, sum(len(v) for v in self.forms.values()))
        out = [(f, b, legal, math.log2(total / len(v))) for f, v in self.forms.items() for b, legal in v]
        return out + [("=" + a, b, None, math.log2(total / len(v))) for a, v in self.acronyms.items() for b in v]


def _like_acronym(token: str, tokens: list[str]) -> bool:
    """Whether a token looks like the initials of the others, a slip allowed: most of its letters begin one of them."""
    initials = {t[0] for t in tokens if t != token}
    return 3 <= len(token) and sum(c in initials for c in token) >= 0.6 * len(token) and sum(c in "aeiouy" for c in token) <= len(token) // 2


def _subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def _assigned(read: list[dict[str, float]], key: list[str]) -> float | None:
    """The cost of giving every token its own word of the key, or None; tokens with few readings first."""
    left, cost = list(key), 0.0
    for options in sorted(read, key=lambda r: sum(w in r for w in key)):
        best = min((w for w in left if w in options), key=options.__getitem__, default=None)
        if best is None:
            return None
        left.remove(best)
        cost += options[best]
    return cost


def lexicon(register: DataFrame, id_col: str = "id", name_col: str = "name", acronym_col: str = "acronym", type_col: str = "organization_type", person_type: str = "self_employed") -> Lexicon:
    rows = bounded_rows(register.select(id_col, name_col, acronym_col, type_col).where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull()), MOST_REGISTER)
    if rows is None:
        raise ValueError(f"the register has more than {MOST_REGISTER} rows; split it, link each part, and take each name's best link")
    return Lexicon([(r[0], r[1], r[2]) for r in rows], {r[0] for r in rows if r[3] == person_type})


def candidates(names: DataFrame, name_col: str, lex: Lexicon, text_col: str | None = None) -> DataFrame:
    """(name, body, form, score): every body that a distinct name can stand for, with its best form; `text_col` is
    what is read in its place. Score: the form's rarity less the costs of the rewriting, less 2 where both have a legal
    form and they differ. Null, empty and senseless names give no row.

    Each name is rewritten where it lies, its forms are exploded and equi-joined with the register's forms (a table
    bounded with the register).
    """
    spark = names.sparkSession
    shared = spark.sparkContext.broadcast(lex)

    @F.pandas_udf("array<struct<form:string,cost:double,legal:string>>")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lex = shared.value
        for batch in batches:
            yield pd.Series([[] if not n else lex.rewritings(n) for n in batch], dtype=object)

    rows = names.select(names[name_col].alias("name"), F.explode(rewrite(names[text_col or name_col])).alias("__w")).select("name", "__w.*")
    forms = spark.createDataFrame(lex.register_forms(), "form string, body string, its_legal string, rarity double")
    scored = rows.join(F.broadcast(forms), "form").withColumn(  # as many rows as the register, which is bounded
        "score", F.col("rarity") - 2 * F.col("cost") - F.when(F.col("legal") != F.col("its_legal"), 2.0).when(F.col("legal").isNull() & F.col("its_legal").isNotNull(), 0.2).otherwise(0.0)
    )
    return scored.groupBy("name", "body").agg(F.max(F.struct("score", "form")).alias("__b")).select("name", "body", "__b.form", "__b.score")


def link(names: DataFrame, keys: list[str], name_col: str, lex: Lexicon, evidence_col: str | None = None, restore: Callable[[DataFrame, Column], Column] | None = None) -> DataFrame:
    """The body that each name stands for: keys, name, body, form, score (bits); names of no body give no row.

    Distinct names are linked once (`candidates`); a register id in `evidence_col` decides between bodies that share a
    form, for each distinct name and id. If two bodies still score the same, the name stands for neither. Null, empty and
    senseless names give no row; keys that are repeated come out once for each name. What `restore` makes of a name is read
    in its place.
    """
    told = names[evidence_col] if evidence_col else F.lit(None).cast("string")
    rows = names.where(names[name_col].isNotNull()).select(*[names[k] for k in keys], names[name_col].alias("__name"), F.coalesce(told, F.lit("")).alias("__told"))
    asked = rows.select(F.col("__name").alias("name"), "__told").distinct()
    once = asked.select("name").distinct()
    found = candidates(once.withColumn("__text", restore(once, once["name"])) if restore else once, "name", lex, "__text" if restore else None)
    scored = asked.join(found, "name").withColumn("score", F.col("score") + F.when(F.col("body") == F.col("__told"), 8.0).otherwise(0.0))
    best = scored.groupBy("name", "__told").agg(F.max(F.struct("score", "body", "form")).alias("__b"), F.max("score").alias("__top"), F.collect_list("score").alias("__all"))
    clear = best.where(F.size(F.filter("__all", lambda s: s > F.col("__top") - 0.1)) == 1).select(F.col("name").alias("__name"), "__told", "__b.*")
    best = rows.join(clear, ["__name", "__told"]).groupBy(*keys, F.col("__name").alias(name_col)).agg(F.max(F.struct("score", "body", "form")).alias("__b"))
    return best.select(*keys, name_col, "__b.body", "__b.form", "__b.score")

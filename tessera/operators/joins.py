"""Joins that the relational ones don't give directly. All are equi-joins at heart: no cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def first_of(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row a key: the first (or last) by `order`, which must be total. Null keys form a group of their own.

    An aggregate, not a window: a hot key's rows are reduced within each task before the exchange.
    """
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*[df[c] for c in df.columns]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__best"))
    return best.select("__best.*")


def unique_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that exactly one value has; ambiguous and null keys are left out."""
    by_key = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__other"))
    return by_key.where(F.col(value) == F.col("__other")).drop("__other")


def resolve_cascade(names: DataFrame, register: DataFrame, name_col: str, told_col: str, id_col: str = "id", reg_name: str = "name", acronym: str = "acronym", reg_id: str = "eu_transparency_register_id", compat: bool = False, only: set[str] | None = None) -> DataFrame:
    """Each distinct (name, told register id) with the body it resolves to and the rung that did it.

    Rungs, the first that hits wins: register id, strict key, strict key of the cleaned name, acronym of the cleaned
    name, acronym, either side of trailing parentheses (key, then acronym), a prefix with one continuation, a
    register id inside the name, else a stub. Every distinct name is exploded to its keys, which meet one index of all
    kinds of keys in one equi-join; the lowest rung is taken by an aggregate. With compat an empty name becomes the
    unknown stub before its register id is looked at. `only` names the methods that are tried, all by default.
    """
    reg = register.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), X.name_key(F.col(reg_name)).alias("__key"), F.lower(F.trim(F.col(acronym))).alias("__acr"), F.col(reg_id).alias("__tr"))
    by_key = reg.where(F.col("__key") != "").groupBy("__key").agg(F.max("__id").alias("__id"))
    by_acr = unique_keys(reg, "__acr", "__id")
    by_tr = reg.where(F.col("__tr").isNotNull()).groupBy("__tr").agg(F.max("__id").alias("__id"))

    n = names.select(F.trim(F.coalesce(F.col(name_col), F.lit(""))).alias("name"), F.trim(F.col(told_col)).alias("told")).distinct()
    clean = X.clean_name(F.col("name"))
    outer, inner = F.trim(F.regexp_extract("name", r"^(.*?)\s*\(([^)]+)\)\s*$", 1)), F.trim(F.regexp_extract("name", r"^(.*?)\s*\(([^)]+)\)\s*$", 2))
    changed = clean != F.col("name")
    # rung, method, which index, key: the first rung that hits wins
    rungs = [
        ("tr_id_exact", "t", F.col("told")), ("name_exact", "k", X.name_key(F.col("name"))), ("cleaned_name", "k", F.when(changed, X.name_key(clean))), ("cleaned_acronym", "a", F.when(changed, F.lower(clean))), ("acronym", "a", F.lower("name")), ("parenthetical", "k", X.name_key(outer)), ("parenthetical_acronym", "a", F.lower(outer)),
        ("parenthetical", "k", X.name_key(inner)), ("parenthetical_acronym", "a", F.lower(inner)), ("prefix", "p", F.when((F.length("name") >= 5) & (F.length(X.name_key(clean)) >= 4), X.name_key(clean))), ("tr_id_extracted", "t", X.register_id(F.col("name"))),
    ]
    rungs = [(m if not only or m in only else None, kind, key) for m, kind, key in rungs]
    named = F.col("name") != ""
    forms = n.select("name", "told", F.explode(F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(m).alias("method"), F.lit(kind).alias("kind"), (key if i == 0 else F.when(named, key)).alias("key")) for i, (m, kind, key) in enumerate(rungs) if m])).alias("f")).select("name", "told", "f.*")
    forms = forms.where(F.length("key") > 0)  # keys that are missing go nowhere
    cut = lambda c: F.substring(c, 1, 4)
    runs = forms.where("kind = 'p'").select("key").distinct().join(by_key.select(cut("__key").alias("__cut"), "__key", "__id"), cut("key") == F.col("__cut")).where(F.expr("startswith(__key, key)"))
    runs = runs.groupBy("key").agg(F.min("__id").alias("__id"), F.count("*").alias("__c")).where("__c = 1").select(F.lit("p").alias("kind"), "key", "__id")
    index = by_key.select(F.lit("k").alias("kind"), F.col("__key").alias("key"), "__id").unionByName(by_acr.select(F.lit("a").alias("kind"), F.col("__acr").alias("key"), "__id")).unionByName(by_tr.select(F.lit("t").alias("kind"), F.col("__tr").alias("key"), "__id")).unionByName(runs)
    hits = forms.join(index, ["kind", "key"]).select("name", "told", "rung", "method", F.col("__id").alias("resolved_id"))
    empty = F.struct(X.stub_id(F.lit("unknown")).alias("id"), F.lit("stub_empty").alias("method"))
    stub = F.struct(X.stub_id(X.name_key(F.col("name"))).alias("id"), F.lit("stub").alias("method"))
    last = n.select("name", "told", F.lit(-1 if compat else len(rungs)).alias("rung"), F.when(named, stub).otherwise(empty).alias("__s"))
    last = last.select("name", "told", F.when(named, len(rungs)).otherwise(F.col("rung")).alias("rung"), F.col("__s.method").alias("method"), F.col("__s.id").alias("resolved_id"))
    best = hits.unionByName(last).groupBy("name", "told").agg(F.min(F.struct("rung", "method", "resolved_id")).alias("__b"))
    return best.select("name", "told", "__b.resolved_id", "__b.method")


def prefix_join(left: DataFrame, right: DataFrame, prefix: str, key: str, least: int = 4) -> DataFrame:
    """Rows of left whose prefix begins exactly one key of right, with that key. Blocked by the first `least` letters."""
    l = left.where(F.length(prefix) >= least).withColumn("__cut", F.substring(prefix, 1, least))  # noqa: E741
    r = right.select(F.col(key), F.substring(key, 1, least).alias("__cut")).distinct()
    hits = l.select(prefix, "__cut").distinct().join(r, "__cut").where(F.expr(f"startswith({key}, {prefix})")).groupBy(prefix).agg(F.min(key).alias(key), F.count("*").alias("__n")).where("__n = 1")
    return left.join(hits.drop("__n"), prefix)


def alias_in_text(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, alias_col: str = "alias") -> DataFrame:
    """Each text with the longest alias that it contains as words (ties: the smaller alias): id, alias.

    Blocked by the word of each alias that fewest aliases have (of equals the longest): an equi-join instead of a nested
    loop over all aliases. What is exploded carries no text, only the words around each word that an alias can reach.
    """
    words = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    a = aliases.select(words(F.col(alias_col)).alias(alias_col)).where(F.length(alias_col) >= 3).distinct()
    parts = a.select(alias_col, F.explode(F.array_distinct(F.split(alias_col, " "))).alias("__w"))
    common = parts.groupBy("__w").agg(F.count("*").alias("__n"))
    rarest = parts.join(common, "__w").groupBy(alias_col).agg(F.min_by("__w", F.struct("__n", -F.length("__w"), "__w")).alias("__w"))
    reach = rarest.agg(F.max(F.size(F.split(alias_col, " ")))).first()[0] or 1
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.split(words(F.col(text_col)), " ").alias("__t"))
    around = F.array_join(F.slice("__t", F.greatest(F.col("__p") - (reach - 2), F.lit(1)), F.least(F.col("__p"), F.lit(reach - 1)) + reach), " ")
    near = t.select(id_col, "__t", F.posexplode("__t").alias("__p", "__w")).select(id_col, "__w", around.alias("__around")).join(rarest, "__w")
    hits = near.where(F.expr(f"contains(concat(' ', __around, ' '), concat(' ', {alias_col}, ' '))"))
    return hits.groupBy(id_col).agg(F.min(F.struct((-F.length(alias_col)).alias("n"), F.col(alias_col).alias("a"))).alias("__b")).select(id_col, F.col("__b.a").alias(alias_col))


def previous(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, value: str) -> DataFrame:
    """As-of join: each left row with the value of the latest earlier right row of its key, null if there is none.

    One union and one window instead of a range join: rows of both sides are sorted together once.
    """
    l = left.withColumn("__side", F.lit(1)).withColumn("__t", F.col(time)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))  # noqa: E741
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.lit(0).alias("__side"), F.col(right_time).alias("__t"), F.struct(F.col(value)).alias("__s"))
    both = l.drop("__v").withColumn("__s", F.lit(None).cast(r.schema["__s"].dataType)).unionByName(r, allowMissingColumns=True)
    # at equal times the left row comes first: it sees only what is earlier
    w = Window.partitionBy(*keys).orderBy("__t", F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(f"previous_{value}", F.last("__s", ignorenulls=True).over(w)[value]).where("__side = 1").drop("__side", "__t", "__s")


def null_missing(df: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    """df with the foreign key set to null where its parent doesn't exist."""
    p = parents.select(F.col(pk).alias("__p")).where(F.col("__p").isNotNull()).distinct()
    return df.join(p, F.col(fk) == F.col("__p"), "left").withColumn(fk, F.col("__p")).drop("__p")


def any_shared(left: DataFrame, right: DataFrame, left_id: str, right_id: str, array_col: str) -> DataFrame:
    """Pairs that share any element of an array column, once, with the number of shared elements."""
    l = left.select(left_id, F.explode(F.array_distinct(array_col)).alias("__x"))  # noqa: E741
    r = right.select(right_id, F.explode(F.array_distinct(array_col)).alias("__x"))
    return l.join(r, "__x").groupBy(left_id, right_id).agg(F.count("*").alias("shared"))


def merged_events(known: DataFrame, found: DataFrame, keys: list[str], docs: str = "documents") -> DataFrame:
    """Events of two sources on their keys: documents of both, the known ones first; events of one source as they are."""
    k, f = known.groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list(docs))).alias("__k")), found.groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list(docs))).alias("__f"))
    both = k.join(f, keys, "full")
    none = F.array().cast("array<string>")
    return both.select(*keys, F.array_union(F.coalesce("__k", none), F.coalesce("__f", none)).alias(docs), F.when(F.col("__k").isNull(), "new").when(F.col("__f").isNull(), "known").otherwise("both").alias("origin"))


def overridden(base: DataFrame, better: DataFrame, key: str, role: str) -> DataFrame:
    """Roles of the better source replace those of the base; ids only it has are added; (id, role) once."""
    kept = base.select(key, role).join(better.select(key).distinct(), key, "left_anti")
    return kept.unionByName(better.select(key, role)).distinct()


def sections_diff(old: DataFrame, new: DataFrame, number: str, text: str) -> DataFrame:
    """Sections by number: added, removed, modified or unchanged."""
    o, n = old.select(number, F.col(text).alias("__o")), new.select(number, F.col(text).alias("__n"))
    j = o.withColumn("__ho", F.lit(1)).join(n.withColumn("__hn", F.lit(1)), number, "full")
    same = F.col("__o").eqNullSafe(F.col("__n"))
    return j.select(number, F.when(F.col("__ho").isNull(), "added").when(F.col("__hn").isNull(), "removed").when(same, "unchanged").otherwise("modified").alias("change"))


def either_key(df: DataFrame, by_id: DataFrame, by_name: DataFrame, id_col: str, name_col: str, value: str) -> DataFrame:
    """A value looked up by id, else by lowered name."""
    i = by_id.select(F.col(id_col), F.col(value).alias("__i"))
    n = by_name.select(F.col(name_col).alias("__name"), F.col(value).alias("__n"))
    return df.join(i, id_col, "left").join(n, F.lower(F.trim(F.col(name_col))) == F.col("__name"), "left").withColumn(value, F.coalesce("__i", "__n")).drop("__i", "__n", "__name")

"""Keyed writes as DataFrame operations: what a table holds after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import first_of


def upserted(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """current with rows inserted or, where the key exists, their non-null values taken. New rows must have unique keys."""
    values = [c for c in current.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in values if c in rows.columns])
    both = current.withColumn("__had", F.lit(1)).join(new.withColumn("__got", F.lit(1)), keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c) if c in rows.columns else F.col(c) for c in values])


def children_replaced(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Children of the parents that come again are replaced; the others stay."""
    again = fresh.select(parent).distinct()
    return children.join(again, parent, "left_anti").unionByName(fresh.select(*children.columns))


def statuses_set(df: DataFrame, key: str, status: str, changes: DataFrame) -> DataFrame:
    """A keyed status update; keys without a change keep what they have."""
    c = changes.select(F.col(key), F.col(status).alias("__new"))
    return df.join(c, key, "left").withColumn(status, F.coalesce("__new", status)).drop("__new").select(*df.columns)


def relinked(children: DataFrame, mapping: DataFrame, fk: str, old: str, new: str) -> DataFrame:
    """Foreign keys moved from old to new parents."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return children.join(m, F.col(fk) == F.col("__old"), "left").withColumn(fk, F.coalesce("__new", fk)).drop("__old", "__new")


def without_orphans(parents: DataFrame, pk: str, removable: Column, *children: tuple[DataFrame, str]) -> DataFrame:
    """Parents less the removable ones that no child table refers to."""
    used = None
    for df, fk in children:
        ids = df.select(F.col(fk).alias("__id")).where(F.col("__id").isNotNull())
        used = ids if used is None else used.unionByName(ids)
    kept = parents.join(used.distinct().withColumn("__used", F.lit(True)), F.col(pk) == F.col("__id"), "left")
    return kept.where(~(removable & F.col("__used").isNull())).select(*parents.columns)


def placeholders(refs: DataFrame, known: DataFrame, key: str, **literals: str) -> DataFrame:
    """known with a placeholder row for each key that is referred to and missing."""
    missing = refs.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    return known.unionByName(missing.withColumns({k: F.lit(v) for k, v in literals.items()}), allowMissingColumns=True)


def split_for_write(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """rows marked 'update' where their key exists and 'insert' where it doesn't."""
    e = existing.select(F.col(key)).distinct().withColumn("__e", F.lit(True))
    return rows.join(e, key, "left").withColumn("action", F.when(F.col("__e"), "update").otherwise("insert")).drop("__e")


def canonical_with_stubs(canonical: DataFrame, stubs: DataFrame, key: str) -> DataFrame:
    """Canonical rows and stubs, one row an id; a canonical row wins."""
    both = canonical.withColumn("__o", F.lit(0)).unionByName(stubs.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    return first_of(both, [key], [F.col("__o"), *[F.col(c) for c in stubs.columns if c != key]]).drop("__o")


def real_titles_kept(current: DataFrame, rows: DataFrame, key: str, title: str) -> DataFrame:
    """New titles, except that a placeholder (the key itself, or empty) doesn't replace a real one."""
    new = rows.select(F.col(key), F.col(title).alias("__t"))
    placeholder = F.col("__t").isNull() | (F.trim("__t") == "") | (F.col("__t") == F.col(key))
    return current.join(new, key, "left").withColumn(title, F.when(placeholder, F.col(title)).otherwise(F.col("__t"))).drop("__t").select(*current.columns)


def unprocessed(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """What the ledger doesn't have yet; failed rows aren't in it and come again."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti")

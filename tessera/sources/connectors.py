"""Reading and writing: partitioned JSON assets, registers and feeds in XML, CSV results, pages, binary documents, caches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_asset(spark: SparkSession, base: str, asset: str, schema: T.StructType, partition: str | None = None, lines: bool = False) -> DataFrame | None:
    """base/asset/partition.json, else base/asset/data.json, else None. Arrays of records and single records are read alike;
    with lines, files of a record a line, which can be split."""
    for name in ([f"{partition}.json"] if partition else []) + ["data.json"]:
        path = f"{base}/{asset}/{name}"
        if _exists(spark, path):
            return spark.read.schema(schema).option("multiLine", not lines).json(path)
    return None


def read_partitions(spark: SparkSession, base: str, asset: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """All partitions of an asset with the partition each row is from; records that can't be read are dropped."""
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(f"{base}/{asset}")
    return raw.withColumn("partition", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def write_asset(df: DataFrame, base: str, asset: str, partition_col: str | None = None) -> None:
    """Dynamic overwrite: only the partitions that the rows belong to are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(partition_col) if partition_col else w).json(f"{base}/{asset}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def legal_xml(text: Column) -> Column:
    """XML text without references to characters that XML 1.0 doesn't allow."""
    hexadecimal = r"&#[xX]0*(?:[0-8bBcCeEfF]|1[0-9a-fA-F]|[dD][89abAB][0-9a-fA-F]{2}|[dD][c-fC-F][0-9a-fA-F]{2}|[fF]{3}[eEfF]);"
    return F.regexp_replace(F.regexp_replace(text, hexadecimal, ""), r"&#0*(?:[0-8]|1[124-9]|2[0-9]|3[01]);", "")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Rows of an XML file by their tag, with malformed rows dropped."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(schema).load(path)


REGISTER = T.StructType([
    T.StructField("identificationCode", T.StringType()), T.StructField("name", T.StructType([T.StructField("originalName", T.StringType())])), T.StructField("acronym", T.StringType()), T.StructField("registrationCategory", T.StringType()),
    T.StructField("webSiteURL", T.StringType()), T.StructField("headOffice", T.StructType([T.StructField("country", T.StringType()), T.StructField("city", T.StringType())])), T.StructField("goals", T.StringType()),
    T.StructField("levelsOfInterest", T.StructType([T.StructField("levelOfInterest", T.ArrayType(T.StringType()))])), T.StructField("interests", T.StructType([T.StructField("interest", T.ArrayType(T.StringType()))])), T.StructField("members", T.StructType([T.StructField("members10FTE", T.IntegerType())])),
])
MEMBER = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "fullName", "country", "politicalGroup", "nationalPoliticalGroup")])


def read_register(spark: SparkSession, path: str, goals_cut: int = 500) -> DataFrame:
    """A register of organisations: one row an entry, goals cut, levels and fields of interest as arrays, number of members."""
    x = read_xml(spark, path, "interestRepresentative", REGISTER)
    return x.select(
        F.col("identificationCode").alias("eu_transparency_register_id"), F.col("name.originalName").alias("name"), "acronym", F.col("registrationCategory").alias("organization_type"),
        F.col("webSiteURL").alias("website"), F.col("headOffice.country").alias("country"), F.col("headOffice.city").alias("city"), F.substring("goals", 1, goals_cut).alias("goals"),
        F.col("levelsOfInterest.levelOfInterest").alias("levels"), F.col("interests.interest").alias("interests"), F.col("members.members10FTE").alias("members"),
    )


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """A list of members: id, name, country, group, party; what is missing is 'Unknown'."""
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown"))
    m = read_xml(spark, path, "mep", MEMBER)
    return m.select("id", known("fullName").alias("name"), known("country").alias("country"), known("politicalGroup").alias("political_group"), known("nationalPoliticalGroup").alias("party"))


DETAILS = "data array<struct<id:string,status:string,consists_of:array<struct<activity_date:string,had_activity_type:string>>,had_participation:array<struct<had_participant_person:string,participation_role:string>>>>"


def linked_details(df: DataFrame, json_col: str) -> DataFrame:
    """id, events (by date), participations and status from linked JSON documents; of every address only its last part is kept. Text that is no such document gives no row."""
    tail = lambda x: F.substring_index(x, "/", -1)
    x = df.select(F.explode(F.from_json(df[json_col], DETAILS)["data"]).alias("x")).select("x.*")
    events = F.array_sort(F.transform("consists_of", lambda e: F.struct(e["activity_date"].alias("date"), tail(e["had_activity_type"]).alias("type"))))
    people = F.transform("had_participation", lambda p: F.struct(tail(p["had_participant_person"]).alias("person"), F.lower(tail(p["participation_role"])).alias("role")))
    return x.select("id", events.alias("events"), people.alias("participations"), tail(F.col("status")).alias("status"))


def catalogue(spark: SparkSession, entries: DataFrame, kind: str, id_col: str, page: int) -> DataFrame:
    """A paged catalogue read through a Python data source: one partition a kind of entry, page after page until one is short.

    The pages are served from `entries` (a table of bounded size, as a catalogue's listing is), in place of the service.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    rows = [tuple(r) for r in entries.orderBy(kind, id_col).limit(1_000_001).collect()]
    if len(rows) > 1_000_000:
        raise ValueError("more than 1000000 entries in a catalogue's listing")
    names, schema = entries.columns, entries.schema
    at = names.index(kind)

    class Kind(InputPartition):
        pass

    class Reader(DataSourceReader):
        def partitions(self):
            return [Kind(k) for k in sorted({r[at] for r in rows if r[at] is not None})]

        def read(self, partition):
            mine = [r for r in rows if r[at] == partition.value]
            offset = 0
            while True:
                got = mine[offset : offset + page]
                yield from got
                offset += page
                if len(got) < page:
                    return

    class Catalogue(DataSource):
        @classmethod
        def name(cls):
            return "paged_catalogue"

        def schema(self):
            return schema

        def reader(self, schema):  # noqa: ARG002
            return Reader()

    spark.dataSource.register(Catalogue)
    return spark.read.format("paged_catalogue").load()


def feed_entries(xml: Column) -> Column:
    """Entries of an Atom feed given as text: id, title, type (last part of the scheme), updated (UTC), link."""
    schema = "entry array<struct<id:string,title:string,updated:string,category:struct<_scheme:string>,link:array<struct<_rel:string,_href:string>>>>"
    e = F.from_xml(xml, schema)["entry"]
    return F.transform(e, lambda x: F.struct(
        x["id"].alias("id"), x["title"].alias("title"), F.substring_index(x["category"]["_scheme"], "/", -1).alias("type"), F.to_timestamp(x["updated"]).alias("updated"),
        F.filter(x["link"], lambda l: l["_rel"] == "alternate")[0]["_href"].alias("link"),
    ))


def in_window(df: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    return df.where(F.col(time).between(start, end))


def read_results(spark: SparkSession, folder: str, prefix: str, schema: T.StructType, renames: dict[str, str]) -> DataFrame | None:
    """The latest prefix_*_dyads.csv of a folder (by name), with its columns renamed; None if there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}_*_dyads.csv")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    names = sorted(f.getPath().toString() for f in found) if found else []
    return spark.read.schema(schema).option("header", True).csv(names[-1]).withColumnsRenamed(renames) if names else None


def pages_parsed(pages: DataFrame, id_col: str, page_col: str, parse: Callable[[str | None], list[tuple]], row_schema: str) -> DataFrame:
    """Rows that a parser finds in each page: any of the HTML readers, or one of the caller's own."""
    kind = f"array<struct<{row_schema}>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([parse(x) for x in b], dtype=object)

    return pages.select(pages[id_col].alias("__id"), F.posexplode(run(pages[page_col])).alias("pos", "__r")).select(F.col("__id").alias(id_col), "pos", "__r.*")


def documents_text(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """path, text of binary documents by a pluggable extractor (PDF, DOCX, ...); a failure gives null text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for x in b:
                try:
                    out.append(extract(x))
                except Exception:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", run("content").alias("text"))


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def fresh(cache: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Cache rows that are not older than `days`."""
    return cache.where(F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS"))


def decided(pairs: DataFrame, decisions: DataFrame, key: str, value: str, default: str | None) -> DataFrame:
    """Decisions of an outside classifier joined to their pairs by key; pairs without one get the default, or go."""
    d = decisions.select(F.col(key), F.col(value))
    return pairs.join(d, key, "left").fillna({value: default}) if default is not None else pairs.join(d, key)


def local_path(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)

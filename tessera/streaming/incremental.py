"""Incremental processing: what batch bookkeeping becomes with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def events_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def first_in_time(stream: DataFrame, time: str, keys: list[str], late: str = "30 days") -> DataFrame:
    """Each key once, whichever batch it comes in; what is later than the watermark is dropped, with its state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def weekly(df: DataFrame, time: Column, first: str = "2024-07-16") -> Column:
    """The weekly partition of a time; partitions begin on the weekday of `first`."""
    return F.window(time, "7 days", "7 days", f"{_offset(first)} days")["start"]


def _offset(first: str) -> int:
    from datetime import date

    return (date.fromisoformat(first) - date(1970, 1, 1)).days % 7


def counts_in_windows(stream: DataFrame, time: str, length: str, late: str, *groups: str) -> DataFrame:
    """Rows a tumbling window and group; not part of the pipeline this library re-expresses, but what a feed of events needs."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *groups).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *groups, "n")


def ledger_sink(stream: DataFrame, ledger: str, key: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs `process` over each batch's rows whose key isn't in the ledger, appends results, then the keys.

    A batch that is replayed after a failure finds its keys in the ledger, or, if it failed in between, writes the same
    results again under the same keys; readers take each key once (see `merge.unprocessed`, `joins.first_of`).
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            rows = rows.join(spark.read.parquet(ledger).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows = rows.persist()
        process(rows).write.mode("append").parquet(out)
        rows.select(key).write.mode("append").parquet(ledger)  # also of rows that gave nothing
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

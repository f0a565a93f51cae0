"""Structured Streaming over event tables: windowed counts with late data, topics with wildcards, results in batches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Versions


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the events table's files."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    if table.inputFiles()[0].rstrip("/").endswith("events.parquet"):
        # a stream reads directories: a table of one file is picked out of the data directory by its name
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of values by event type and tumbling or sliding window; rows later than `late` may be dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each user's sessions, which a gap ends."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), "user_id", "n")


def topic(pattern: str) -> str:
    """A regular expression of a channel pattern: * is one segment, ** any number."""
    return "^" + ".*".join(r"[^.]+".join(map(re.escape, part.split("*"))) for part in pattern.split("**")) + "$"


def batches(df: DataFrame, size: int = 100):
    """Rows of a finished query in lists of `size`, fetched partition by partition."""
    out = []
    for row in df.toLocalIterator():
        out.append(row)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now; its result as a written table.

    Each batch is written beside the others: in complete mode the last one is the result, in append mode all are.
    """
    tables, done = Versions(stream.sparkSession, name), []

    def write(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            done.clear()
        done.append(tables.write(batch, f"batch-{number}"))

    stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return reduce(DataFrame.unionByName, done) if done else stream.sparkSession.createDataFrame([], stream.schema)

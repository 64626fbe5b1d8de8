"""Incremental ingestion: file streams, filter, dedup with state, exactly-once parquet sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textlake.functions.text import hash_prefix
from textlake.functions.validity import accepted


def read(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def accepted_once(stream: DataFrame, text: str = "text", event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Accepted texts, each prefix hash once. State grows with the hashes; with an event time it is kept for the delay only."""
    hashed = stream.where(accepted(text)).withColumn("hash", hash_prefix(text))
    if event_time:
        return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["hash"])
    return hashed.dropDuplicates(["hash"])


def to_parquet(stream: DataFrame, path: str, checkpoint: str, by: str | None = None) -> StreamingQuery:
    """All that is there now, then ends. Started again with the same checkpoint, it goes on where it stopped."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(by) if by else writer).start(path)


def flush(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 100_000) -> StreamingQuery:
    """As :func:`to_parquet`, in files of at most so many rows."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file).trigger(availableNow=True).start(path)


def polled(spark: SparkSession, made: Callable[[Column], Column], rows_per_batch: int = 7) -> DataFrame:
    """A generator that is asked again and again: (id, text) of the calls of each round, without empty answers.

    made: the text for a call's number. How often a round runs is the trigger's to say, e.g. every 15 seconds.
    """
    calls = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", 1).load()
    return calls.select(F.col("value").alias("id"), made(F.col("value")).alias("text")).where("text is not null and text <> ''")


def each_alone(runs: dict[str, Callable[[], StreamingQuery]]) -> dict[str, str | None]:
    """Runs a query for each source and waits for it; a source that fails has its error here and leaves the others alone."""
    out: dict[str, str | None] = {}
    for name, start in runs.items():
        try:
            start().awaitTermination()
            out[name] = None
        except Exception as error:  # whatever a source does
            out[name] = str(error).splitlines()[0]
    return out


def counts_by(stream: DataFrame, key: str, event_time: str, width: str, delay: str) -> DataFrame:
    """Tumbling windows with late rows dropped after the delay. The corpus has no event time of its own; for event tables."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")

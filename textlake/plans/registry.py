"""What the query modules share: the catalogue of queries and their SQL, the standard tables, and classes of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.operators.lineage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return f"{shared_folder(spark)}/textlake-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if the input is so small that it has fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("label", F.when(F.col("doc_id") % 2 == 0, "human").otherwise("ai"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns as classes, with a key."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return rows.select((F.col("conv_id") * TURNS_MOST + F.col("turn")).alias("id"), "conv_id", "turn", F.when(F.col("role") == "user", "human").otherwise("ai").alias("label"), "text")


#: More turns than a conversation has.
TURNS_MOST = 1 << 20
CLASSED = "(SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'ai' END AS label FROM documents)"
TURNS = f"(SELECT conv_id * {TURNS_MOST} + turn AS id, conv_id, turn, CASE WHEN role = 'user' THEN 'human' ELSE 'ai' END AS label, text FROM conversations WHERE role IN ('user', 'assistant'))"
TEXT = "coalesce(text, '')"


def text() -> Column:
    return F.coalesce("text", F.lit(""))

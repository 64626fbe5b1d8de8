"""Rows and figures as people and files want them: ids, samples, bars, percentages, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import col, n_words
from textlake.operators.ranking import positions


def sample_id(number: Column) -> Column:
    return F.format_string("sample_%08d", number)


def bar(share: Column | str, width: int = 50) -> Column:
    """A bar of blocks for a share from 0 to 1."""
    return F.repeat(F.lit("█"), F.floor(col(share) * width).cast("int"))


def percent(share: Column | str, digits: int = 2) -> Column:
    """A share from 0 to 1 as text."""
    return F.format_string(f"%.{digits}f%%", F.round(col(share) * 100, digits))


def samples(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """id, text, label, source, length, word_count and metadata of each row; what is missing has a default.

    An id that is missing is made of the row's place before any row is dropped.
    """
    have = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in df.columns else F.lit(default).cast(kind)
    rows = positions(df, (order,))
    own = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    length = F.length(text)
    metadata = F.struct(
        (F.coalesce("original_length", length) if "original_length" in df.columns else length).alias("original_length"),
        (F.coalesce("cleaned_length", length) if "cleaned_length" in df.columns else length).alias("cleaned_length"),
        have("timestamp", "string", "").alias("timestamp"),
    )
    return rows.select(F.coalesce(own, sample_id(F.col("position"))).alias("id"), F.col(text).alias("text"), F.col("label"), have("source", "string", "unknown").alias("source"), length.alias("length"), n_words(text).alias("word_count"), metadata.alias("metadata"))


def cleaned_ids(df: DataFrame, order: str, label: str = "label") -> DataFrame:
    """``id``: the label and the row's number among its label's rows, which are the valid ones."""
    rows = positions(df, (order,), (label,))
    return rows.withColumn("id", F.format_string("%s_%08d", F.col(label), F.col("position"))).drop("position")


def from_json(c: Column | str, schema: str) -> Column:
    """Null for what isn't JSON of that schema."""
    return F.from_json(col(c), schema, {"mode": "PERMISSIVE"})

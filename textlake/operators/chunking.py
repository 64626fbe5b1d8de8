"""Chunks: fixed word counts, wrapped lines, joined rows, windows of tokens, nested rows."""

from __future__ import annotations

import textwrap

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import col, let, sentences, words
from textlake.operators.ranking import positions


def word_chunks(c: Column | str, n: int) -> Column:
    """Chunks of n words; the last may be shorter."""

    def cut(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(n))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i + 1, F.lit(n)), " "))

    return F.filter(let(words(c), cut), lambda x: x != "")


def explode_chunks(df: DataFrame, text: str, n: int, least_chars: int = 0) -> DataFrame:
    made = df.select("*", F.posexplode(word_chunks(text, n)).alias("chunk_no", "chunk"))
    return made.where(F.length("chunk") >= least_chars)


def wrapped(c: Column | str, width: int = 200) -> Column:
    """Lines of at most ``width`` characters as ``textwrap`` makes them."""

    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if x is None else textwrap.wrap(x, width=width) for x in text.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(c)


def joined_rows(df: DataFrame, text: str, order: str, k: int, by: tuple[str, ...], keep_rest: bool = False) -> DataFrame:
    """Each k rows in order as one text, within the columns ``by``; the rest, fewer than k, goes unless kept.

    A group holds k rows at most, and no task all rows of a value of ``by``.
    """
    grouped = positions(df, (order,), by).withColumn("group_no", F.floor(F.col("position") / k)).groupBy(*by, "group_no")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    made = grouped.agg(F.count("*").alias("n_rows"), joined.alias("text"))
    return made if keep_rest else made.where(F.col("n_rows") == k)


def explode_sentences(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", F.posexplode(sentences(text)).alias("sentence_no", "sentence"))


def paragraphs(c: Column | str, first: int | None = None) -> Column:
    """Parts between blank lines, stripped, without empty ones; the first few if wanted."""
    own = F.split(col(c), "\n\n")
    own = F.slice(own, 1, first) if first else own
    return F.filter(F.transform(own, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def token_windows(n: Column, width: int, stride: int) -> Column:
    """Windows over n tokens: (begin, end, fresh), where fresh tokens are those that no window before has."""
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    made = F.transform(starts, lambda b: F.struct(b.alias("begin"), F.least(b + width, n).alias("end")))
    shown = F.transform(made, lambda w, i: F.struct(w["begin"].alias("begin"), w["end"].alias("end"), (w["end"] - F.when(i == 0, F.lit(0)).otherwise(F.least(w["begin"] - stride + width, n))).alias("fresh")))
    return F.filter(shown, lambda w: w["fresh"] > 0)

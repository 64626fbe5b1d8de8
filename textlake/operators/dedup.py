"""Exact and prefix dedup, overlaps of classes, unions. Only keys and ordinals are shuffled before rows are chosen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.operators.ranking import positions


def first_wins(df: DataFrame, key: Column, order: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The first row, by ``order``, of each key (within the columns ``also``). Minima are aggregated before the shuffle."""
    keyed = df.withColumn("_key", key)
    first = keyed.groupBy("_key", *also).agg(F.min(order).alias("_first")).select("_key", *also, "_first")
    same = [keyed["_key"].eqNullSafe(first["_key"]), keyed[order] == first["_first"], *(keyed[c].eqNullSafe(first[c]) for c in also)]
    return keyed.join(first, reduce(lambda a, b: a & b, same), "left_semi").drop("_key")


def groups(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Keys that several rows have: how often, and the first and last of them."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("copies"), F.min(order).alias("first"), F.max(order).alias("last")).where("copies > 1")


def overlap(a: DataFrame, b: DataFrame, on: str = "text") -> DataFrame:
    """Distinct values that are in both."""
    return a.select(on).intersect(b.select(on))


def without_overlap(df: DataFrame, label: str, on: str = "text") -> DataFrame:
    """Rows whose value occurs under one label only. One aggregation by hash and one semi-join; no label side is broadcast."""
    hashed = df.withColumn("_hash", F.xxhash64(on))
    single = hashed.groupBy("_hash", on).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a = _b").select(F.col("_hash").alias("_h"), F.col(on).alias("_on"))
    return hashed.join(single, (F.col("_hash") == F.col("_h")) & (F.col(on) == F.col("_on")), "left_semi").drop("_hash")


def new_only(fresh: DataFrame, known: DataFrame, on: str = "text") -> DataFrame:
    """Distinct fresh values that aren't known."""
    return fresh.select(on).distinct().join(known.select(on), on, "left_anti")


def resume(df: DataFrame, accepted: DataFrame, key: Column, order: str) -> DataFrame:
    """First rows of keys that no earlier run has accepted; accepted has a column ``key``."""
    kept = first_wins(df, key, order).withColumn("_key", key)
    return kept.join(accepted.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_key")


def by_priority(*frames: DataFrame) -> DataFrame:
    """All rows, with the place of their frame as ``priority``."""
    return reduce(DataFrame.unionByName, (x.withColumn("priority", F.lit(i)) for i, x in enumerate(frames)))


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, with its copy's number."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def unpivot(df: DataFrame, key: str, **labels: str) -> DataFrame:
    """A row for each named column, with its label."""
    parts = ", ".join(f"'{label}', `{name}`" for name, label in labels.items())
    return df.select(key, F.expr(f"stack({len(labels)}, {parts}) as (label, text)"))


def interleave(df: DataFrame, label: str, first: str, order: str) -> DataFrame:
    """The classes in turn: ``position`` is even for one and odd for the other."""
    return positions(df, (order,), (label,)).withColumn("position", 2 * F.col("position") + F.when(F.col(label) == first, 0).otherwise(1))

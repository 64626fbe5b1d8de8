"""Balancing, sampling and splits, by a seeded md5 rank: exact sizes, the same rows each time.

Ranks within a label are numbered in two levels: rows are counted in md5 ranges, so that no label's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import rank_hash
from textlake.operators.ranking import numbered, positions


def ranked(df: DataFrame, key: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``rank`` (from 1) by seeded hash, and ``total``, within the columns ``by`` or over all rows."""
    hashed = df.withColumn("_hash", rank_hash(key, seed))
    hashed = hashed.withColumn("_range", F.conv(F.substring("_hash", 1, 2), 16, 10).cast("int"))
    return numbered(hashed, "_range", ("_hash", key), by).drop("_hash", "_range")


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the smallest has."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    return ranked(df, key, seed, (label,)).crossJoin(F.broadcast(least)).where("rank <= _least").drop("_least", "rank", "total")  # one row


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """All rows, and smaller labels' rows again, in rank order, up to the largest's count; ``copy`` is 0 for originals."""
    most = df.groupBy(label).count().agg(F.max("count").alias("_most"))
    rows = ranked(df, key, seed, (label,)).crossJoin(F.broadcast(most))  # one row
    extra = F.floor((F.col("_most") - F.col("rank")) / F.col("total")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), extra))).drop("_most", "rank", "total")


def to_size(df: DataFrame, label: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of each label: without replacement if it has as many, else again in rank order."""
    rows = ranked(df, key, seed, (label,)).where(F.col("rank") <= size)
    extra = F.greatest(F.floor((F.lit(size) - F.col("rank")) / F.col("total")), F.lit(0)).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), extra))).drop("rank", "total")


def balanced(df: DataFrame, label: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """min(``most``, smallest label) rows of each label."""
    least = df.groupBy(label).count().agg(F.least(F.min("count"), F.lit(most)).alias("_least"))
    return ranked(df, key, seed, (label,)).crossJoin(F.broadcast(least)).where("rank <= _least").drop("_least", "rank", "total")  # one row


def head_balanced(df: DataFrame, label: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each label by ``order``."""
    return positions(df, (order,), (label,)).where(F.col("position") < most).drop("position")


def drawn(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by chance, in their seeded order; the limit is the feature."""
    return df.orderBy(rank_hash(key, seed), key).limit(n)


def check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1) > 0.001:
        raise ValueError(f"the ratios sum to {sum(ratios)}, not 1")


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``split`` in each label: ceil(test * n) rows are test, then ceil(val / (train + val) * rest) val, the others train."""
    check_ratios(train, val, test)
    rows = ranked(df, key, seed, (label,))
    tests = F.ceil(F.round(F.col("total") * test, 9))
    vals = F.ceil(F.round((F.col("total") - tests) * (val / (train + val)), 9))
    split = F.when(F.col("rank") <= tests, "test").when(F.col("rank") <= tests + vals, "val").otherwise("train")
    return rows.withColumn("split", split).drop("rank", "total")


def plain_split(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``split`` over all rows: floor(train * n), floor(val * n), the rest test."""
    check_ratios(train, val, test)
    rows = ranked(df, key, seed)
    trains, vals = F.floor(F.round(F.col("total") * train, 9)), F.floor(F.round(F.col("total") * val, 9))
    split = F.when(F.col("rank") <= trains, "train").when(F.col("rank") <= trains + vals, "val").otherwise("test")
    return rows.withColumn("split", split).drop("rank", "total")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a seeded order, by range partitioning; for sinks."""
    return df.orderBy(rank_hash(key, seed))


def remix(df: DataFrame, stratum: Column, key: str, cut: str = "short", share: int = 3, seed: int = 42) -> DataFrame:
    """All rows, but of stratum ``cut`` only the first ``1 / share``."""
    rows = ranked(df.withColumn("stratum", stratum), key, seed, ("stratum",))
    return rows.where((F.col("stratum") != cut) | (F.col("rank") <= F.floor(F.col("total") / share))).drop("rank", "total")

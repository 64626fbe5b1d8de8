"""Row numbers without a task that holds a whole group: rows are numbered in parts, after the counts of the parts before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.operators.lineage import cut


def numbered(df: DataFrame, part: str, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``rank`` (from 1) and ``total`` within the columns ``by``; the column ``part`` goes up with the order.

    A window holds one part of one group; the groups' counts by part are as many rows as there are parts and groups.
    """
    names = [f"_by{i}" for i in range(len(by))]
    counts = df.groupBy(*by, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    first = counts.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col(part).alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    own = df.withColumn("_own", F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)))
    same = [own[part] == first["_part"], *(own[c].eqNullSafe(first[n]) for c, n in zip(by, names, strict=True))]
    made = own.join(first, reduce(lambda a, b: a & b, same)).withColumn("rank", F.col("_before") + F.col("_own"))
    return made.select(*df.columns, "rank", "total")


def positions(df: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``position`` (from 0) of each row by ``order`` within the columns ``by``; parts are ranges of the sorted rows.

    The ranges are drawn from a sample, so the parted rows are kept before they are counted.
    """
    parted = cut(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    return numbered(parted, "_range", order, by).withColumn("position", F.col("rank") - 1).drop("rank", "total", "_range")

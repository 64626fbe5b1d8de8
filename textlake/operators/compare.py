"""Before and after: changes of metrics, their summary, and pairwise differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics that are compared, and whether higher is better.
METRICS = (("perplexity", True), ("burstiness", True), ("reading_ease", True), ("grammar_errors", False), ("cv", True), ("human_score", True))
LEAST_GAIN = 5


def pair(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row for each key, with the structs before and after."""
    side = lambda df, name: df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name))
    return side(before, "before").join(side(after, "after"), key)


def changes(better: bool) -> Column:
    """An array of (name, percent) of the metrics that got better, or worse; those that were 0 or aren't finite are left out."""
    parts = []
    for name, higher in METRICS:
        old, new = F.col(f"before.{name}").cast("double"), F.col(f"after.{name}").cast("double")
        change = new - old
        wanted = change > 0 if higher == better else change < 0
        fits = (old != 0) & ~F.isnan(change) & wanted
        parts.append(F.when(fits, F.struct(F.lit(name).alias("name"), F.round(F.abs(change / F.abs(old) * 100), 2).alias("pct"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def top_three(c: Column) -> Column:
    """The three largest changes; equal ones in the metrics' order."""
    order = lambda x, y: F.when(x["pct"] > y["pct"], -1).when(x["pct"] < y["pct"], 1).otherwise(F.when(x["i"] < y["i"], -1).otherwise(1))
    numbered = F.transform(c, lambda x, i: F.struct(x["name"].alias("name"), x["pct"].alias("pct"), i.alias("i")))
    return F.slice(F.array_sort(numbered, order), 1, 3)


def listed(c: Column, sign: str) -> Column:
    return F.array_join(F.transform(top_three(c), lambda x: F.concat(x["name"], F.lit(f" ({sign}"), F.format_string("%.1f", x["pct"]), F.lit("%)"))), ", ")


def compare(pairs: DataFrame) -> DataFrame:
    """improvements and degradations (maps), overall_improvement, success and a summary of each pair."""
    rows = pairs.withColumn("better", changes(True)).withColumn("worse", changes(False))
    gain = F.col("after.human_score") - F.col("before.human_score")
    shown = F.format_string("%.1f", F.round(gain, 1))  # rounded first: it has no negative zero
    opening = F.when(gain > LEAST_GAIN, F.concat(F.lit("✅ Humanization successful! Overall human score improved by "), shown, F.lit(" points.")))
    opening = opening.otherwise(F.concat(F.lit("⚠️ Humanization had limited impact. Overall change: "), shown, F.lit(" points.")))
    moved = F.col("before.likely_source") != F.col("after.likely_source")
    summary = F.concat_ws(
        " ",
        opening,
        F.when(F.size("better") > 0, F.concat(F.lit("Main improvements: "), listed(F.col("better"), "+"))),
        F.when(F.size("worse") > 0, F.concat(F.lit("Areas of concern: "), listed(F.col("worse"), "-"))),
        F.when(moved, F.concat(F.lit("Classification changed: "), F.col("before.likely_source"), F.lit(" → "), F.col("after.likely_source"))),
    )
    rows = rows.withColumn("improvements", F.map_from_entries("better")).withColumn("degradations", F.map_from_entries("worse"))
    return rows.withColumn("overall_improvement", F.round(gain, 2)).withColumn("success", gain > LEAST_GAIN).withColumn("summary", summary).drop("better", "worse")


def difference(a: Column, b: Column) -> Column:
    return F.round(F.abs(a - b), 4)


def more_human(a: Column, b: Column, first: str, second: str) -> Column:
    """The label of the higher value; equal values are the second's."""
    return F.when(a > b, first).otherwise(second)


def percent_change(a: Column, b: Column) -> Column:
    return F.when(a != 0, F.round((b - a) / F.abs(a) * 100, 2)).otherwise(0.0)

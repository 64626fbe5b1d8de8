"""Reports as aggregations: counts by reason, label, source and bin, with shares; JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions.text import n_words


def share(c: str = "n") -> Column:
    """Percent of the total over all rows of a small result."""
    return F.round(F.col(c) / F.sum(c).over(Window.partitionBy()) * 100, 2)


def by_reason(df: DataFrame, reason: str, duplicate: str) -> DataFrame:
    """Rows by reason; valid rows that repeat an earlier one are ``duplicate``."""
    what = F.when((F.col(reason) == "valid") & F.col(duplicate), "duplicate").otherwise(F.col(reason))
    return df.groupBy(what.alias("reason")).agg(F.count("*").alias("n"))


def statistics(df: DataFrame, label: str, text: str) -> DataFrame:
    """Rows, mean characters and mean words by label, from whole sums."""
    sums = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"), F.sum(n_words(text)).alias("words"))
    return sums.select(label, "n", F.round(F.col("chars") / F.col("n"), 4).alias("avg_chars"), F.round(F.col("words") / F.col("n"), 4).alias("avg_words"))


def bin_name(value: Column, bins: tuple) -> Column:
    """The name of the first bin whose highest value isn't passed."""
    *rows, (_, rest) = bins
    made = F.when(value <= rows[0][0], rows[0][1])
    for high, name in rows[1:]:
        made = made.when(value <= high, name)
    return made.otherwise(rest)


def histogram(df: DataFrame, value: Column, bins: tuple) -> DataFrame:
    """Rows and shares of all bins, empty ones too."""
    spark = df.sparkSession
    names = spark.range(1).select(F.explode(F.array(*(F.lit(name) for _, name in bins))).alias("bin"))
    counted = df.where(value.isNotNull()).groupBy(bin_name(value, bins).alias("bin")).agg(F.count("*").alias("c"))
    made = names.join(counted, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))
    return made.select("bin", "n", F.coalesce(share(), F.lit(0.0)).alias("pct"))


def half_open(df: DataFrame, value: Column, lows: tuple) -> DataFrame:
    """Rows and shares of the bins [low, next low), empty ones too."""
    bins = tuple((high - 1, f"{low}-{high}") for low, high in zip(lows, lows[1:], strict=False)) + ((None, f"{lows[-1]}+"),)
    return histogram(df, value, bins)


def distribution(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).select(*by, "n", share().alias("pct"))


def top(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent values; equal counts by value."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def length_percentiles(df: DataFrame, value: Column) -> DataFrame:
    """Mean, population deviation, bounds and linear percentiles of a whole number."""
    own = df.select(value.cast("long").alias("v"))
    marks = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    made = own.agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.min("v").alias("min_len"), F.max("v").alias("max_len"), F.percentile("v", marks).alias("p"))
    spread = F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n")))
    return made.select("n", "min_len", "max_len", F.round(F.col("s") / F.col("n"), 4).alias("mean_len"), F.round(spread, 4).alias("std_len"), *(F.round(F.col("p")[i], 4).alias(f"p{round(m * 100)}") for i, m in enumerate(marks)))


def quality_check(df: DataFrame, label: str, text: str) -> DataFrame:
    """For each label: rows, distinct texts, mean words and texts under ten words."""
    made = df.groupBy(label).agg(F.count("*").alias("n"), F.countDistinct(text).alias("n_distinct"), F.sum(n_words(text)).alias("w"), F.sum(F.when(n_words(text) < 10, 1).otherwise(0)).alias("n_short"))
    return made.select(label, "n", "n_distinct", F.round(F.col("w") / F.col("n"), 4).alias("avg_words"), "n_short")


def profile(df: DataFrame) -> DataFrame:
    """For each column: nulls and distinct values."""
    names = df.columns
    counted = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(f"n_{i}") for i, c in enumerate(names)), *(F.countDistinct(c).alias(f"d_{i}") for i, c in enumerate(names)))
    parts = ", ".join(f"'{c}', coalesce(n_{i}, 0), d_{i}" for i, c in enumerate(names))
    return counted.select(F.expr(f"stack({len(names)}, {parts}) as (name, n_null, n_distinct)"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Binary counts and scores, 0 where a denominator is 0; labels are 0 and 1."""
    a, p = F.col(actual), F.col(predicted)
    hit = lambda x, y: F.coalesce(F.sum(((a == x) & (p == y)).cast("long")), F.lit(0))
    made = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    safe = lambda x, y: F.when(y > 0, F.round(x / y, 6)).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return made.select("tp", "fp", "fn", "tn", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def cleaning(df: DataFrame, reason: str, key: str) -> DataFrame:
    """One row: processed, valid, removed, removal_rate (percent), duplicates, and the counts by reason.

    reason: why a row is removed, or ``valid``; of valid rows with the same key all but one are duplicates, which are
    counted beside the reasons.
    """
    by_key = df.groupBy(reason, F.when(F.col(reason) == "valid", F.col(key)).alias("_k")).agg(F.count("*").alias("n"))
    valid = F.col(reason) == "valid"
    by_reason = by_key.groupBy(reason).agg(F.sum("n").alias("n"), F.sum(F.when(valid, F.col("n") - 1).otherwise(0)).alias("again"))
    removed = F.when(F.col(reason) != "valid", F.struct(F.col(reason).alias("reason"), "n"))
    made = by_reason.agg(F.sum("n").alias("processed"), F.sum("again").alias("duplicates"), F.sum(F.when(~valid, F.col("n")).otherwise(0)).alias("rejected"), F.array_sort(F.collect_list(removed)).alias("reasons"))
    gone = F.col("rejected") + F.col("duplicates")
    return made.select(F.coalesce("processed", F.lit(0)).alias("processed"), (F.col("processed") - gone).alias("valid"), gone.alias("removed"), F.round(gone / F.nullif("processed", F.lit(0)) * 100, 2).alias("removal_rate"), "duplicates", F.map_from_entries("reasons").alias("by_reason"))


def by_split(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows of each split and label, and their percentage of the split."""
    made = df.groupBy(split, label).agg(F.count("*").alias("n"))
    return made.select(split, label, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(split)) * 100, 2).alias("pct"))


def length_profile(df: DataFrame, text: str, when: Column) -> DataFrame:
    """Mean words and texts under 20 words, by a column such as before and after."""
    made = df.select(when.alias("when"), n_words(text).alias("w")).groupBy("when").agg(F.count("*").alias("n"), F.sum("w").alias("s"), F.sum((F.col("w") < 20).cast("long")).alias("n_short"))
    return made.select("when", "n", F.round(F.col("s") / F.col("n"), 4).alias("avg_words"), "n_short")


def shown(report: DataFrame, *by: str) -> str:
    """A report, whose rows are few, as lines of text."""
    return "\n".join("  ".join(f"{k}: {v}" for k, v in row.asDict().items()) for row in report.orderBy(*by).collect())

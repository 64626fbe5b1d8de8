"""Rule-based rewriting and augmentation as columns. What is drawn by chance elsewhere is drawn by a hash of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import patterns as P
from textlake.functions.text import col, lower_first, n_words, words


def chance(key: Column | str, seed: int, *more: Column) -> Column:
    """A number from 0 to 255 by md5."""
    parts = [col(key).cast("string"), *(x.cast("string") for x in more), F.lit(str(seed))]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 2), 16, 10).cast("int")


def humanize(c: Column | str, key: Column | str, seed: int = 42) -> Column:
    """Sentences between ". ": even ones of more than five words get an opener, 77 of 256 a filler; ends with a point."""

    def one(x: Column, i: Column) -> Column:
        opened = F.when((i % 2 == 0) & (n_words(x) > 5), F.concat(F.lit(P.OPENER), lower_first(x))).otherwise(x)
        filler = F.element_at(F.array(*map(F.lit, P.FILLERS)), chance(key, seed + 1, i) % len(P.FILLERS) + 1)
        return F.when((chance(key, seed, i) < 77) & (x != ""), F.concat(filler, lower_first(opened))).otherwise(opened)

    made = F.array_join(F.transform(F.split(col(c), r"\. "), one), ". ")
    return F.when(made.endswith("."), made).otherwise(F.concat(made, F.lit(".")))


def robotize(c: Column | str, key: Column | str, seed: int = 42) -> Column:
    """Contractions written out, commas turned to points, and 26 of 256 texts opened with a summary phrase."""
    text = col(c)
    for short, long in P.CONTRACTIONS:
        text = F.replace(text, F.lit(short), F.lit(long))
    return F.when(chance(key, seed) < 26, F.concat(F.lit("In summary, "), text)).otherwise(text)


def augment(df: DataFrame, text: str, key: str, seed: int = 42) -> DataFrame:
    """``augmented``: 77 of 256 texts of five words or more are changed; half lose a tenth of their words, half have two swapped."""
    rows = df.withColumn("_w", words(text))
    n = F.size("_w")
    rows = rows.withColumn("_changed", (n >= 5) & (chance(key, seed) < 77)).withColumn("_drops", chance(key, seed + 1) < 128)
    rows = rows.withColumn("_at", chance(key, seed + 2) % F.greatest(n, F.lit(1))).withColumn("_other", chance(key, seed + 3) % F.greatest(n, F.lit(1)))
    rows = rows.withColumn("_one", F.try_element_at("_w", F.col("_at") + 1)).withColumn("_two", F.try_element_at("_w", F.col("_other") + 1))
    drop = F.when(n - F.greatest(F.lit(1), F.floor(n / 10)) >= 5, F.greatest(F.lit(1), F.floor(n / 10))).otherwise(0).cast("int")
    order = F.transform("_w", lambda w, i: F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), i.cast("string"), F.lit(str(seed)))).alias("h"), i.alias("i"), w.alias("w")))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(order), drop + 1, F.greatest(n - drop, F.lit(0))), lambda x: F.struct(x["i"], x["w"])))
    swapped = F.transform("_w", lambda w, i: F.when(i == F.col("_at"), F.col("_two")).when(i == F.col("_other"), F.col("_one")).otherwise(w))
    made = F.when(F.col("_drops"), F.array_join(F.transform(kept, lambda x: x["w"]), " ")).otherwise(F.array_join(swapped, " "))
    fresh = F.when(F.col("_changed"), made).otherwise(F.col(text))
    return rows.withColumn("augmented", fresh).drop("_w", "_changed", "_drops", "_at", "_other", "_one", "_two")


def instruction_rows(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.lit(P.INSTRUCTION).alias("instruction"), F.lit("").alias("input"), F.col(text).alias("output"))


def template_rows(df: DataFrame, text: str, order: str, n: int = 10) -> DataFrame:
    """The first n texts with an empty target, to be filled by hand; n is the feature."""
    return df.orderBy(order).limit(n).select(F.col(text).alias("original"), F.lit("").alias("humanized"))


def synthetic_pairs(df: DataFrame, text: str, key: str, seed: int = 42) -> DataFrame:
    """Paragraphs of more than ten words with their stiff counterpart."""
    parts = df.select(key, F.posexplode(F.split(text, "\n\n")).alias("part", "human_text")).where(n_words("human_text") > 10)
    return parts.select(key, "part", robotize("human_text", F.concat_ws(":", key, "part"), seed).alias("ai_text"), "human_text")

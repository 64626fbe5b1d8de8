"""A unigram or bigram language model by aggregation; perplexity by joins. Values are this engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import words


def grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each word with the one before it (empty at the start)."""
    own = words(F.lower(text))
    placed = df.select(key, F.posexplode(F.arrays_zip(F.concat(F.array(F.lit("")), own).alias("before"), F.concat(own, F.array(F.lit(None).cast("string"))).alias("word"))).alias("at", "g"))
    return placed.where("g.word is not null").select(key, "at", "g.before", "g.word")


def train(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Counts of words and of word pairs."""
    made = grams(df, key, text)
    return made.groupBy("word").agg(F.count("*").alias("n")), made.groupBy("before", "word").agg(F.count("*").alias("n"))


#: A word with more than this share of all tokens is frequent (so there are at most its inverse of these), and meets its counts in parts.
FREQUENT, SALTS = 0.001, 32


def _salted(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """Counts by word, there for each salt of a frequent word and once for the others."""
    marked = counts.join(F.broadcast(frequent), "word", "left")  # at most 1 / FREQUENT rows
    parts = F.when(F.col("frequent"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("salt", F.explode(parts)).drop("frequent")


def scored(df: DataFrame, key: str, text: str, model: tuple[DataFrame, DataFrame], bigram_weight: float = 0.0, first_tokens: int | None = None) -> DataFrame:
    """(key, at, chance, times): the words' chances, smoothed by one; with a bigram weight mixed with those after the word before.

    Without bigrams a text's equal words are one row. Frequent words meet their counts by a salt of the key, so that none is
    in one task.
    """
    unigrams, bigrams = model
    totals = unigrams.agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    frequent = unigrams.crossJoin(F.broadcast(totals)).where(F.col("n") > FREQUENT * F.col("total")).select("word", F.lit(True).alias("frequent"))  # one row
    own = grams(df, key, text)
    own = own.where(F.col("at") < first_tokens) if first_tokens is not None else own
    if not bigram_weight:
        own = own.groupBy(key, "word").agg(F.min("at").alias("at"), F.count("*").alias("times"))
    else:
        own = own.withColumn("times", F.lit(1))
    own = own.join(F.broadcast(frequent), "word", "left")  # at most 1 / FREQUENT rows
    own = own.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).otherwise(0)).drop("frequent")
    made = own.join(_salted(unigrams, frequent), ["word", "salt"], "left").crossJoin(F.broadcast(totals))  # one row
    chance = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("types") + 1)
    if bigram_weight:
        after = bigrams.groupBy("before").agg(F.sum("n").alias("n_before"))
        pairs = bigrams.withColumnRenamed("n", "n_pair").join(after, "before")
        made = made.join(_salted(pairs, frequent), ["before", "word", "salt"], "left")
        chance = bigram_weight * F.coalesce(F.col("n_pair") / F.col("n_before"), F.lit(0.0)) + (1 - bigram_weight) * chance
    return made.select(key, "at", chance.alias("chance"), "times")


def windows(df: DataFrame, key: str, text: str, model: tuple[DataFrame, DataFrame], width: int = 1024, stride: int = 512, bigram_weight: float = 0.5) -> DataFrame:
    """key, begin, end, n_tokens and nll of sliding windows: each scores the tokens that the windows before it haven't."""
    own = scored(df, key, text, model, bigram_weight)
    # The first window scores its whole width, each later one the last ``stride`` tokens of its own.
    number = F.greatest(F.ceil((F.col("at") + 1 - width) / stride), F.lit(0))
    made = own.groupBy(key, number.alias("_w")).agg(F.sum("times").alias("n_tokens"), F.sum(-F.log("chance") * F.col("times")).alias("nll"), F.max("at").alias("_last"))
    return made.select(key, (F.col("_w") * stride).alias("begin"), (F.col("_last") + 1).cast("long").alias("end"), "n_tokens", "nll")


def perplexity(df: DataFrame, key: str, text: str, model: tuple[DataFrame, DataFrame], bigram_weight: float = 0.0, first_tokens: int | None = 1024) -> DataFrame:
    """key, n_tokens and perplexity: exp of the mean negative log-likelihood over the first tokens (None: all); infinite without any."""
    rows = scored(df, key, text, model, bigram_weight, first_tokens)
    made = rows.groupBy(key).agg(F.sum("times").alias("n_tokens"), F.sum(-F.log("chance") * F.col("times")).alias("nll"))
    rows = df.select(key).distinct().join(made, key, "left")
    value = F.when(F.col("n_tokens") > 0, F.round(F.exp(F.col("nll") / F.col("n_tokens")), 2)).otherwise(float("inf"))
    return rows.select(key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), value.alias("perplexity"))

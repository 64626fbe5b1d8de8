"""Corpus BLEU by aggregation: clipped n-gram matches over n-gram counts, a brevity penalty, no smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import let, n_words, words


def grams(text: str, most: int) -> Column:
    """(n, gram) for each run of 1 to ``most`` words."""

    def of(w: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: n <= F.size(w))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(n.alias("n"), F.array_join(F.slice(w, i, n), " ").alias("gram")))))

    return let(words(text), of)


def corpus_bleu(df: DataFrame, key: str, predicted: str, reference: str, most: int = 4) -> DataFrame:
    """One row: words of predictions and references, and bleu from 0 to 100."""
    count = lambda text, name: df.select(key, F.inline(grams(text, most))).groupBy(key, "n", "gram").agg(F.count("*").alias(name))
    both = count(predicted, "p").join(count(reference, "r"), [key, "n", "gram"], "left")
    by_size = both.groupBy("n").agg(F.sum(F.least("p", F.coalesce("r", F.lit(0)))).alias("hits"), F.sum("p").alias("total"))
    sums = by_size.agg(F.count("*").alias("sizes"), F.min("hits").alias("least"), F.sum(F.log(F.col("hits") / F.col("total"))).alias("logs"))
    lengths = df.agg(F.sum(n_words(predicted)).alias("predicted_words"), F.sum(n_words(reference)).alias("reference_words"))
    p, r = F.col("predicted_words"), F.col("reference_words")
    penalty = F.when(p >= r, 0.0).otherwise(1 - r / p)
    value = F.when((F.col("sizes") == most) & (F.col("least") > 0), 100 * F.exp(F.col("logs") / most + penalty)).otherwise(0.0)
    return lengths.crossJoin(sums).select("predicted_words", "reference_words", F.round(value, 4).alias("bleu"))  # one row each

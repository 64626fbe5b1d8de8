"""Text metrics as columns: sentence statistics, burstiness, readability, the human score and its labels.

Means and variances come from whole sums (n, sum, sum of squares), so that engines agree to the last bit; rounding comes
last. Syllables are vowel groups, at least one for each word, which is this engine's own definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import patterns as P
from textlake.functions.text import at_least, at_most, below, col, collapse, count, label, n_words, sentence_lengths, words


def with_lengths(df: DataFrame, text: str = "text", unit: str = "words") -> DataFrame:
    """lengths, n_sentences, n_sum and n_squares, each computed once."""
    made = df.withColumn("lengths", sentence_lengths(F.coalesce(col(text), F.lit("")), unit))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x * x)
    return made.select("*", F.size("lengths").cast("long").alias("n_sentences"), total.alias("n_sum"), squares.alias("n_squares"))


def mean(n="n_sentences", total="n_sum") -> Column:
    return F.when(col(n) > 0, col(total) / col(n)).otherwise(0.0)


def variance(n="n_sentences", total="n_sum", squares="n_squares") -> Column:
    return F.when(col(n) > 0, (col(n) * col(squares) - col(total) * col(total)) / (col(n) * col(n))).otherwise(0.0)


def deviation() -> Column:
    return F.sqrt(variance())


def burstiness() -> Column:
    """(sd - mean) / (sd + mean); 0 for fewer than two sentences or without words."""
    total = deviation() + mean()
    return F.when((F.col("n_sentences") < 2) | (total == 0), 0.0).otherwise(F.round((deviation() - mean()) / total, 4))


def variation() -> Column:
    """Coefficient of variation, in percent."""
    return F.when((F.col("n_sentences") < 2) | (mean() == 0), 0.0).otherwise(F.round(deviation() / mean() * 100, 2))


def differences() -> Column:
    """Absolute differences of neighbouring sentence lengths."""
    n = F.greatest(F.size("lengths") - 1, F.lit(0))
    return F.zip_with(F.slice("lengths", 2, n), F.slice("lengths", 1, n), lambda a, b: F.abs(a - b))


def most_difference() -> Column:
    return F.coalesce(F.array_max(differences()), F.lit(0)).cast("double")


def mean_difference() -> Column:
    total = F.aggregate(differences(), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.col("n_sentences") < 2, 0.0).otherwise(F.round(total / (F.col("n_sentences") - 1), 2))


def burstiness_label(c: Column | str) -> Column:
    return label(col(c), P.BURSTINESS_LABELS, at_least)


def standalone_label(text: Column | str) -> Column:
    """The calculator's own label, which calls one sentence insufficient."""
    return F.when(collapse(text) == "", P.NO_TEXT).when(F.col("n_sentences") < 2, P.FEW_SENTENCES).otherwise(burstiness_label(burstiness()))


def in_bin(bounds: tuple, k: int) -> Column:
    """How many sentence lengths are in a bin."""
    low = bounds[k - 1][0] if k else 0
    high = bounds[k][0]
    return F.size(F.filter("lengths", lambda x: (x > low) & (x <= high) if high else x > low)).cast("long")


def n_syllables(c: Column | str) -> Column:
    """Vowel groups; a word without any counts as one."""
    text = F.lower(col(c))
    marked = words(F.regexp_replace(text, P.VOWELS, "#"))
    return count(text, P.VOWELS) + F.size(F.filter(marked, lambda w: ~F.contains(w, F.lit("#"))))


def reading_ease(n_sentences: Column, words: Column, syllables: Column) -> Column:
    made = 206.835 - 1.015 * (words / n_sentences) - 84.6 * (syllables / words)
    return F.when((n_sentences > 0) & (words > 0), F.round(made, 2)).otherwise(0.0)


def grade_level(n_sentences: Column, words: Column, syllables: Column) -> Column:
    made = 0.39 * (words / n_sentences) + 11.8 * (syllables / words) - 15.59
    return F.when((n_sentences > 0) & (words > 0), F.round(made, 2)).otherwise(0.0)


def ease_label(c: Column | str) -> Column:
    return label(col(c), P.EASE_LABELS, at_least)


def grade_label(c: Column | str) -> Column:
    return label(col(c), P.GRADE_LABELS, at_most)


def grammar_label(c: Column | str) -> Column:
    return F.when(col(c) == 0, P.NO_GRAMMAR_ERRORS).otherwise(label(col(c), P.GRAMMAR_LABELS, below))


def perplexity_label(c: Column | str) -> Column:
    return label(col(c), P.PERPLEXITY_LABELS, below)


def human_score(perplexity, burst, grammar_rate, cv) -> Column:
    w = P.SCORE_WEIGHTS
    parts = F.least(col(perplexity) / 5, F.lit(100.0)) * w["perplexity"] + (col(burst) + 1) * 50 * w["burstiness"]
    parts = parts + F.greatest(F.lit(0.0), 100 - col(grammar_rate) * 10) * w["grammar"] + F.least(col(cv) * 2, F.lit(100.0)) * w["cv"]
    return F.round(parts, 2)


def likely_source(c: Column | str) -> Column:
    return label(col(c), P.SOURCE_LABELS, at_least)


def confidence(c: Column | str) -> Column:
    return label(col(c), P.CONFIDENCE_LABELS, at_least)


def evaluate(df: DataFrame, text: str = "text", perplexity: str | None = None, grammar_errors: str | None = None) -> DataFrame:
    """All metrics of each text. perplexity, grammar_errors: columns that a model or checker has made; else infinite and 0.

    Empty or null text has null metrics.
    """
    rows = with_lengths(df, text)
    words, syllables = n_words(text).cast("long"), n_syllables(text).cast("long")
    rows = rows.withColumn("n_words", words).withColumn("n_syllables", syllables)
    rows = rows.withColumn("perplexity", F.col(perplexity) if perplexity else F.lit(float("inf")))
    rows = rows.withColumn("grammar_errors", F.col(grammar_errors) if grammar_errors else F.lit(0))
    rows = rows.withColumn("grammar_rate", F.when(F.col("n_words") > 0, F.round(F.col("grammar_errors") / F.col("n_words") * 100, 2)).otherwise(0.0))
    rows = rows.select(
        "*",
        reading_ease(F.col("n_sentences"), F.col("n_words"), F.col("n_syllables")).alias("reading_ease"),
        grade_level(F.col("n_sentences"), F.col("n_words"), F.col("n_syllables")).alias("grade_level"),
        F.round(mean(), 2).alias("avg_len"),
        F.round(variance(), 2).alias("var_len"),
        F.round(deviation(), 2).alias("std_len"),
        burstiness().alias("burstiness"),
        variation().alias("cv"),
        most_difference().alias("max_diff"),
        mean_difference().alias("avg_diff"),
    )
    rows = rows.withColumn("human_score", human_score("perplexity", "burstiness", "grammar_rate", "cv"))
    made = {
        "perplexity_label": perplexity_label("perplexity"),
        "ease_label": ease_label("reading_ease"),
        "grade_label": grade_label("grade_level"),
        "grammar_label": grammar_label("grammar_rate"),
        "burstiness_label": burstiness_label("burstiness"),
        "likely_source": likely_source("human_score"),
        "confidence": confidence("human_score"),
    }
    rows = rows.select("*", *(v.alias(k) for k, v in made.items()))
    found = F.coalesce(collapse(text), F.lit("")) != ""
    fresh = [c for c in rows.columns if c not in df.columns or c == "grammar_errors"]
    return rows.select(*(c for c in df.columns if c not in fresh), *(F.when(found, F.col(c)).alias(c) for c in fresh))


def log_perplexity(c: Column | str) -> Column:
    return F.log(col(c))


def complexity(df: DataFrame, text: str = "text", grammar_errors: str | None = None) -> DataFrame:
    """The stand-alone analysis: readability, grammar and sentences of each text; zeros and N/A for empty or null text."""
    kept = ("reading_ease", "grade_level", "grammar_errors", "grammar_rate", "n_sentences", "avg_len", "var_len", "std_len")
    rows = evaluate(df, text, grammar_errors=grammar_errors)
    return rows.select(*df.columns, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in kept), *(F.coalesce(c, F.lit(P.NO_TEXT)).alias(c) for c in ("ease_label", "grade_label", "grammar_label")))

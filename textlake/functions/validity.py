"""Validity rules: reason codes and filters as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.text import col, let, n_code_marks, n_letters, n_spaces, n_words, strip, words


def reason(c: Column | str, least: int = 50, most: int = 10_000, language: Column | None = None, wanted: str = "en", raw: Column | None = None) -> Column:
    """The first rule that fails, or ``valid``.

    language: a column of language codes, if that rule is wanted. raw: what the text was made of; null or empty is ``no_text``.
    """
    text = F.coalesce(col(c), F.lit(""))
    solid = lambda t: F.length(F.replace(t, F.lit(" "), F.lit("")))
    repetitive = lambda t: let(words(t), lambda w: (F.size(w) > 10) & (F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0)) < 0.3))

    def judged(t: Column) -> Column:
        made = F.when(t == "", "empty").when(F.length(t) < least, "too_short").when(F.length(t) > most, "too_long")
        made = made.when(let(solid(t), lambda n: (n > 0) & (n_letters(t) / n < 0.7)), "low_alpha_ratio")
        made = made.when(n_code_marks(t) > F.length(t) / 50, "code_like").when(repetitive(t), "repetitive")
        if language is not None:
            made = made.when(language.isNull(), "language_detection_failed").when(language != wanted, F.concat(F.lit("wrong_language_"), language))
        return made.otherwise("valid")

    made = let(text, judged)
    return made if raw is None else F.when(F.coalesce(raw, F.lit("")) == "", "no_text").otherwise(made)


def accepted(c: Column | str, least: int = 15, most: int = 10_000, unique: float = 0.25, alpha: float = 0.7, chars: int = 50, ends: bool = False) -> Column:
    """The collectors' filter: length, word bounds, distinct words, and letters or white space by all characters.

    Shares of 0 ask nothing. ends: whether the text must end in . ! or ?. What costs little is asked first.
    """

    def judged(t: Column) -> Column:
        made = F.length(t) >= max(1, chars)
        if chars > 1:
            made = made & (F.length(strip(t)) >= chars)
        if ends:
            made = made & F.right(t, F.lit(1)).isin(".", "!", "?")
        made = made & let(words(t), lambda w: F.size(w).between(least, most) & ((F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0)) >= unique) if unique else F.lit(True)))
        if alpha:
            made = made & ((n_letters(t) + n_spaces(t)) / F.nullif(F.length(t), F.lit(0)) >= alpha)
        return F.coalesce(made, F.lit(False))

    return let(F.coalesce(col(c), F.lit("")), judged)


def word_bounds(c: Column | str, least: int, most: int) -> Column:
    return n_words(c).between(least, most)


def short_text(c: Column | str, least: int = 5, most: int = 30) -> Column:
    """Texts of a few words, whatever they hold."""
    return accepted(strip(c), least, most, 0, 0, 1)


def length_stratum(c: Column | str) -> Column:
    n = n_words(c)
    return F.when(n <= 30, "short").when(n <= 100, "medium").otherwise("long")


def required(*names: str) -> Column:
    """All are there and not empty."""
    out = F.lit(True)
    for name in names:
        out = out & (F.coalesce(F.col(name).cast("string"), F.lit("")) != "")
    return out

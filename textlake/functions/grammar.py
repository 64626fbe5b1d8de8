"""A small grammar checker over words: what breaks a rule, where, and what to write instead.

It stands where a caller has no checker of their own. Offsets are word numbers, from 0; lengths are characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.text import let, words

VOWELS = ("a", "e", "i", "o", "u")
#: rule, category, message.
RULES = (
    ("REPEATED_WORD", "DUPLICATION", "The word is there twice."),
    ("ARTICLE", "GRAMMAR", "The article doesn't fit the next word's first letter."),
    ("LOWER_I", "CASING", "The pronoun is a capital letter."),
    ("LOOSE_MARK", "TYPOGRAPHY", "A mark follows its word without a space."),
)


def _broken(rule: str, word: Column, before: Column) -> Column:
    low, last = F.lower(word), F.lower(F.coalesce(before, F.lit("")))
    first = F.substring(low, 1, 1)
    return {
        "REPEATED_WORD": (low == last) & F.rlike(low, F.lit("^[a-z]+$")),
        "ARTICLE": ((last == "a") & first.isin(*VOWELS)) | ((last == "an") & F.rlike(first, F.lit("^[a-z]$")) & ~first.isin(*VOWELS)),
        "LOWER_I": word == "i",
        "LOOSE_MARK": F.rlike(word, F.lit("^[,.;:!?]")),
    }[rule]


def _suggestions(rule: str, word: Column, before: Column) -> Column:
    before = F.coalesce(before, F.lit(""))
    return {
        "REPEATED_WORD": F.array(word),
        "ARTICLE": F.array(F.concat(F.when(F.lower(before) == "a", "an ").otherwise("a "), word)),
        "LOWER_I": F.array(F.lit("I")),
        "LOOSE_MARK": F.array(F.concat(before, word)),
    }[rule]


def errors(c: Column | str, most_suggestions: int = 3) -> Column:
    """rule, category, message, context (the words around), offset, length and suggestions of each error, in order."""

    def found(own: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            before = F.try_element_at(own, F.when(i > 0, i).otherwise(F.size(own) + 1))
            context = F.array_join(F.slice(own, F.greatest(i, F.lit(1)), F.when(i > 0, 3).otherwise(2)), " ")
            made = [
                F.when(_broken(rule, word, before), F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(message).alias("message"), context.alias("context"), i.alias("offset"), F.length(word).alias("length"), F.slice(_suggestions(rule, word, before), 1, most_suggestions).alias("suggestions")))
                for rule, category, message in RULES
            ]
            return F.filter(F.array(*made), lambda x: x.isNotNull())

        return F.flatten(F.transform(own, at))

    return let(words(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))), found)


def n_errors(c: Column | str) -> Column:
    return F.size(errors(c))

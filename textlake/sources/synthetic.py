"""Synthetic rows: templates filled by hash, and variations of examples. The same seed gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import patterns as P
from textlake.functions.text import capitalize, hash_prefix, lower_each, lower_first, n_words
from textlake.functions.validity import accepted
from textlake.operators.dedup import first_wins

TOPICS = ("remote work", "public transport", "school gardens", "solar power", "city parks", "reading habits", "water use", "local news")
OPENINGS = ("In recent years, {} has become a subject of wide interest.", "{} shapes daily life in more ways than one may think.", "There are several reasons to look closely at {}.")
MIDDLES = ("Supporters of {} point to lower costs and steadier results.", "Critics hold that {} brings problems that few plans foresee.", "Evidence on {} is mixed, and much depends on local conditions.", "A balanced view of {} weighs short-term effort against long-term gain.")
ENDINGS = ("In conclusion, {} deserves careful and continued study.", "Overall, {} will remain important for years to come.")


TRANSITIONS = ("Moreover, ", "At the same time, ", "By contrast, ", "For example, ", "In practice, ")


def pick(values: tuple[str, ...], *key: Column) -> Column:
    """One of the values, by md5 of the key."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 7), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, values)), number % len(values) + 1)


def essays(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n essays: an opening, two to five paragraphs with a transition each, and an ending about a topic."""
    rows = spark.range(n).withColumn("topic", pick(TOPICS, F.col("id"), F.lit(seed)))
    count = pick(("2", "3", "4", "5"), F.col("id"), F.lit(seed + 1)).cast("int")
    paragraph = lambda i: F.concat(pick(TRANSITIONS, F.col("id"), F.lit(seed + 5), i), lower_first(pick(MIDDLES, F.col("id"), F.lit(seed + 2), i)))
    middles = F.transform(F.sequence(F.lit(1), count), paragraph)
    body = F.array_join(F.concat(F.array(pick(OPENINGS, F.col("id"), F.lit(seed + 3))), middles, F.array(pick(ENDINGS, F.col("id"), F.lit(seed + 4)))), "\n\n")
    text = F.replace(body, F.lit("{}"), F.col("topic"))
    return rows.select("id", text.alias("text"), F.lit("ai").alias("label"), F.lit("synthetic").alias("source"))


def new_essays(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Of n essays those that the collectors' filter accepts, each text once."""
    return first_wins(essays(spark, n, seed).where(accepted("text")), hash_prefix("text"), "id")


def short_sentences(spark: SparkSession, templates: tuple[str, ...], slots: dict[str, tuple[str, ...]], n: int, seed: int = 42) -> DataFrame:
    """Distinct sentences of n draws of a template and a value for each of its slots."""
    rows = spark.range(n)
    text = pick(templates, F.col("id"), F.lit(seed))
    for i, (slot, values) in enumerate(slots.items()):
        text = F.replace(text, F.lit("{" + slot + "}"), pick(values, F.col("id"), F.lit(seed + 1 + i)))
    return rows.groupBy(text.alias("text")).agg(F.min("id").alias("id")).select("id", "text")


def variants(df: DataFrame, text: str) -> DataFrame:
    """Each text and its rewrites, each once: closed by . or !, lower case, capitalized, short ones with fillers."""
    own = F.col(text)
    open_end = ~F.right(own, F.lit(1)).isin(".", "!", "?")
    made = [own, F.when(open_end, F.concat(own, F.lit("."))), F.when(open_end, F.concat(own, F.lit("!"))), lower_each(own), capitalize(own)]
    short = n_words(own) < 10
    made += [F.when(short, F.concat(F.lit(x), lower_each(own))) for x in P.FILLER_PREFIXES]
    made += [F.when(short, F.concat(own, F.lit(x))) for x in P.FILLER_SUFFIXES]
    return df.select(F.explode(F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull()))).alias("variant")).distinct()


def prompt(examples: list[str], template: str, text: str) -> Column:
    """A prompt: the examples, then the template with the text in place of {text}."""
    head = reduce(lambda a, b: f"{a}\n---\n{b}", examples) if examples else ""
    return F.concat(F.lit(head), F.lit("\n\n" if head else ""), F.replace(F.lit(template), F.lit("{text}"), F.col(text)))

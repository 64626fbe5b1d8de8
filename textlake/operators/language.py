"""A language detector by frequent words: a language's most frequent words are learned, and a text has the language whose words it holds most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions.text import words

#: Parts of a language's words whose best are found one by one.
PARTS = 64


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = 100) -> DataFrame:
    """(lang, word): the ``size`` most frequent words of each language; equal counts by word. Bounded by languages times ``size``."""
    counted = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words(F.lower(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    best = Window.partitionBy("lang", "_part").orderBy(F.desc("n"), "word")  # the best of each part of the words, then of these
    parts = counted.withColumn("_part", F.pmod(F.xxhash64("word"), F.lit(PARTS))).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= size)
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return parts.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= size).select("lang", "word")


def detect(df: DataFrame, key: str, text: str, model: DataFrame) -> DataFrame:
    """key and ``detected``: the language with most hits, the first by name of several; null where no word is known."""
    said = df.select(key, F.explode(words(F.lower(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    hits = said.join(F.broadcast(model), "word").groupBy(key, "lang").agg(F.sum("n").alias("hits"))  # languages times the model's size
    best = hits.groupBy(key).agg(F.min(F.struct((-F.col("hits")).alias("h"), "lang")).alias("best"))
    return df.select(key).distinct().join(best.select(key, F.col("best.lang").alias("detected")), key, "left")

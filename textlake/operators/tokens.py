"""Word tokens: a vocabulary by aggregation, encoding by joins, padding, truncation and length analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions.text import words

PAD, UNKNOWN, SPECIAL = 0, 1, 2


def vocabulary(df: DataFrame, text: str, size: int) -> DataFrame:
    """The most frequent words with their token_id from 2 on; equal counts by word. Its size is bounded by ``size``."""
    counted = df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), "word").limit(size)
    return best.select("word", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + SPECIAL - 1).alias("token_id"))


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, most: int = 512) -> DataFrame:
    """key, input_ids (cut at ``most``), token_length and truncated; texts without words have none. The key is unique."""
    placed = df.select(key, F.size(words(text)).alias("n"), F.posexplode_outer(F.slice(words(text), 1, most)).alias("at", "word"))
    known = placed.join(F.broadcast(vocab.select("word", "token_id")), "word", "left")  # a vocabulary's size is bounded
    token = F.struct("at", F.coalesce("token_id", F.lit(UNKNOWN)).alias("id"))
    made = known.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), token))).alias("t"))
    ids = F.transform("t", lambda x: x["id"])
    return made.select(key, ids.alias("input_ids"), F.size("t").alias("token_length"), (F.size("t") >= most).alias("truncated"))


def padded(ids: Column | str, most: int, pad: int = PAD) -> Column:
    own = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(own, F.array_repeat(F.lit(pad), F.lit(most) - F.size(own)))


def mask(ids: Column | str, most: int) -> Column:
    own = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.array_repeat(F.lit(1), F.size(own)), F.array_repeat(F.lit(0), F.lit(most) - F.size(own)))


def counters(encoded: DataFrame) -> DataFrame:
    """Texts, those without tokens, truncated ones (an exact fit counts), and lengths."""
    n = F.col("token_length")
    return encoded.agg(
        F.count("*").alias("total"),
        F.sum((n > 0).cast("long")).alias("processed"),
        F.sum((n == 0).cast("long")).alias("failed"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
        F.round(F.avg(F.when(n > 0, n)), 4).alias("avg_length"),
        F.max(F.when(n > 0, n)).alias("max_length"),
        F.min(F.when(n > 0, n)).alias("min_length"),
    )

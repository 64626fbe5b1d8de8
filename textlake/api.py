"""The engine for callers that have texts, lists or folders rather than tables. Everything runs as plans over DataFrames.

A text that is empty is refused by :func:`analyze` and :func:`compare`; the stand-alone analyzers give zeros and N/A for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from textlake.functions import cleaning, formatting, grammar, metrics, rewrite, validity
from textlake.functions import patterns as P
from textlake.functions import text as X
from textlake.operators import classifier, dedup, language_model, reports, sampling, tokens, training
from textlake.operators.compare import compare as compare_pairs
from textlake.operators.compare import difference, more_human, pair, percent_change
from textlake.sources import readers

LEAST_CHARS = 10
BAR = 20


def _texts(spark: SparkSession, *texts: str | None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def _empty(text: str | None) -> bool:
    return not text or not text.strip()


def analyze(spark: SparkSession, text: str) -> dict:
    """All metrics of a text; raises for an empty one."""
    if _empty(text):
        raise ValueError("the text is empty")
    return metrics.evaluate(_texts(spark, text)).first().asDict()


def compare(spark: SparkSession, original: str, changed: str) -> dict:
    """Metrics before and after, what got better and worse, and a summary."""
    one, two = (metrics.evaluate(_texts(spark, x)) for x in (original, changed))
    return compare_pairs(pair(one, two, "id")).first().asDict(recursive=True)


def long_enough(text: str) -> bool:
    """Whether an interactive text is worth judging."""
    return len(text.strip()) >= LEAST_CHARS


def humanize_text(spark: SparkSession, text: str, seed: int = 42) -> str:
    return _texts(spark, text).select(rewrite.humanize("text", "id", seed).alias("t")).first().t


@dataclass
class TextCleaner:
    """Cleaning and validity of single texts."""

    spark: SparkSession
    least: int = 50
    most: int = 10_000

    def clean_text(self, text: str) -> str:
        return _texts(self.spark, text).select(cleaning.clean("text").alias("t")).first().t

    def is_valid_text(self, text: str) -> tuple[bool, str]:
        reason = _texts(self.spark, text).select(validity.reason("text", self.least, self.most).alias("r")).first().r
        return reason == "valid", reason


@dataclass
class DataCleaner:
    """A folder of raw files to cleaned rows, and a report on what was removed."""

    spark: SparkSession
    remove_duplicates: bool = True

    def judged(self, folder: str, label: str) -> DataFrame:
        rows = readers.directory(self.spark, folder, label).withColumn("ord", F.monotonically_increasing_id())
        rows = rows.withColumn("text", cleaning.clean("raw")).withColumn("reason", validity.reason("text", raw=F.col("raw")))
        return rows.withColumn("original_length", F.length("raw")).withColumn("cleaned_length", F.length("text"))

    def process_directory(self, folder: str, out: str, label: str) -> DataFrame:
        """Writes the valid rows, numbered within their label, as JSON lines, and gives them."""
        rows = self.judged(folder, label).where("reason = 'valid'")
        if self.remove_duplicates:
            rows = dedup.first_wins(rows, X.hash_exact("text"), "ord")
        made = formatting.cleaned_ids(rows, "ord").select("id", "text", "label", "source", "original_length", "cleaned_length")
        readers.write_jsonl(made, out)
        return made

    def generate_report(self, folder: str, label: str) -> dict:
        rows = self.judged(folder, label).withColumn("h", X.hash_exact("text"))
        return reports.cleaning(rows, "reason", "h").first().asDict(recursive=True)


@dataclass
class DatasetFormatter:
    """Samples of both classes, balanced and in one form."""

    balance: str = "undersample"
    size: int | None = None
    seed: int = 42

    def format(self, df: DataFrame, order: str = "id") -> DataFrame:
        ways = {"undersample": sampling.undersample, "oversample": sampling.oversample, "none": lambda df, *_: df}
        rows = df.where(validity.required("text", "label"))
        rows = sampling.to_size(rows, "label", order, self.size, self.seed) if self.size else ways[self.balance](rows, "label", order, self.seed)
        return formatting.samples(rows, order)


@dataclass
class DatasetSplitter:
    """Train, validation and test parts of each label."""

    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    seed: int = 42

    def run(self, df: DataFrame, key: str = "id", label: str = "label") -> tuple[DataFrame, DataFrame]:
        """The rows with their split, and the label distribution of each split."""
        made = sampling.stratified_split(df.dropna(subset=[key, label]), label, key, self.train, self.val, self.test, self.seed)
        return made, reports.by_split(made, "split", label)


@dataclass
class DataTokenizer:
    """Word ids with padding and masks, and counters of lengths."""

    size: int = 50_000
    most: int = 512

    def process(self, df: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
        """The vocabulary, the encoded rows and their counters."""
        vocab = tokens.vocabulary(df, text, self.size)
        encoded = tokens.encode(df, key, text, vocab, self.most)
        return vocab, encoded.withColumn("attention_mask", tokens.mask("input_ids", self.most)).withColumn("padded", tokens.padded("input_ids", self.most)), tokens.counters(encoded)


def _apart(one: Row, two: Row, first: str, second: str, kept: tuple[str, ...], **differences: str) -> dict:
    made = {label: {c: row[c] for c in kept} for label, row in ((first, one), (second, two))}
    return made | {"differences": {k: abs(one[c] - two[c]) for k, c in differences.items()}}


@dataclass
class TextComplexityAnalyzer:
    """Readability, grammar and sentences of single texts."""

    spark: SparkSession
    check_grammar: bool = False

    def _rows(self, *texts: str) -> list[Row]:
        rows = _texts(self.spark, *texts)
        rows = rows.withColumn("grammar_errors", grammar.n_errors("text")) if self.check_grammar else rows
        return metrics.complexity(rows, grammar_errors="grammar_errors" if self.check_grammar else None).orderBy("id").collect()

    def analyze(self, text: str) -> dict:
        return self._rows(text)[0].asDict()

    def compare_texts(self, text1: str, text2: str, label1: str = "Text 1", label2: str = "Text 2") -> dict:
        one, two = self._rows(text1, text2)
        return _apart(one, two, label1, label2, ("reading_ease", "grade_level", "grammar_errors", "avg_len", "var_len"), flesch_ease_diff="reading_ease", grade_diff="grade_level", grammar_diff="grammar_errors")


@dataclass
class BurstinessCalculator:
    """Variation of sentence lengths of single texts."""

    spark: SparkSession

    def _rows(self, unit: str, *texts: str) -> list[Row]:
        rows = metrics.with_lengths(_texts(self.spark, *texts), unit=unit)
        several = F.col("n_sentences") >= 2
        zero = lambda c: F.when(several, c).otherwise(0.0)
        made = rows.select(
            "id", metrics.burstiness().alias("burstiness"), "n_sentences", F.round(metrics.mean(), 2).alias("avg_len"), zero(F.round(metrics.deviation(), 2)).alias("std_len"), metrics.variation().alias("cv"),
            zero(metrics.most_difference()).alias("max_diff"), metrics.mean_difference().alias("avg_diff"), "lengths", metrics.standalone_label("text").alias("interpretation"),
            *(metrics.in_bin(P.SENTENCE_BINS, k).alias(name) for k, (_, name) in enumerate(P.SENTENCE_BINS)),
        )
        return made.orderBy("id").collect()

    def analyze(self, text: str, unit: str = "words") -> dict:
        row = self._rows(unit, text)[0].asDict()
        return {k: v for k, v in row.items() if k not in {"id", *(name for _, name in P.SENTENCE_BINS)}}

    def compare_texts(self, text1: str, text2: str, label1: str = "Text 1", label2: str = "Text 2") -> dict:
        one, two = self._rows("words", text1, text2)
        made = _apart(one, two, label1, label2, ("burstiness", "cv", "std_len", "interpretation"), burstiness_diff="burstiness", cv_diff="cv")
        return made | {"more_human_like": label1 if one.burstiness > two.burstiness else label2}

    def get_sentence_length_distribution(self, text: str) -> dict:
        row = self._rows("words", text)[0]
        return {name: row[name] for _, name in P.SENTENCE_BINS}


@dataclass
class PerplexityCalculator:
    """Perplexity under a model of words and word pairs that a corpus has made."""

    spark: SparkSession
    corpus: DataFrame
    key: str = "id"
    text: str = "text"
    bigram_weight: float = 0.5
    model: tuple[DataFrame, DataFrame] = field(init=False)

    def __post_init__(self):
        self.model = tuple(x.cache() for x in language_model.train(self.corpus, self.key, self.text))

    def calculate_batch_perplexity(self, texts: list[str]) -> list[float]:
        found = {r.id: r.perplexity for r in language_model.perplexity(_texts(self.spark, *texts), "id", "text", self.model, self.bigram_weight).collect()}
        return [found[i] for i in range(len(texts))]

    def calculate_perplexity(self, text: str) -> float:
        return self.calculate_batch_perplexity([text])[0]

    def evaluate_with_stats(self, text: str) -> dict:
        value = self.calculate_perplexity(text)
        row = self.spark.range(1).select(F.lit(value).alias("perplexity")).select("perplexity", metrics.log_perplexity("perplexity").alias("log_perplexity"), metrics.perplexity_label("perplexity").alias("interpretation")).first()
        return row.asDict() | {"text_length": len(text), "n_words": len(text.split())}

    def compare_texts(self, text1: str, text2: str, label1: str = "Text 1", label2: str = "Text 2") -> dict:
        one, two = self.calculate_batch_perplexity([text1, text2])
        x, y = F.lit(one), F.lit(two)
        row = self.spark.range(1).select(difference(x, y).alias("difference"), F.abs(percent_change(x, y)).alias("percent_change"), more_human(x, y, label1, label2).alias("more_human_like")).first()
        return {label1: one, label2: two} | row.asDict()


@dataclass
class Detector:
    """Verdicts of a fitted classifier on single texts."""

    spark: SparkSession
    model: PipelineModel

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Detector:
        return cls(spark, training.load(spark, folder)[0])

    def detect_batch(self, texts: list[str]) -> list[dict]:
        made = classifier.predict(self.model, _texts(self.spark, *texts)).orderBy("id").collect()
        return [{"prediction": r.prediction, "is_ai": r.is_ai, "ai_percentage": r.ai_percentage, "human_percentage": round(r.human_probability * 100, 2), "confidence": round(r.confidence * 100, 2)} for r in made]

    def detect(self, text: str) -> dict:
        return self.detect_batch([text])[0]

    def analyze(self, text: str) -> dict:
        """The verdict, and a bar for it."""
        made = self.detect(text)
        filled = int(made["ai_percentage"] / 100 * BAR)
        return made | {"visual_bar": "█" * filled + "░" * (BAR - filled)}

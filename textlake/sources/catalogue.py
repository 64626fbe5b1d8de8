"""The catalogue of corpora: for each connector where its texts are, whose they are, its bounds, its cap and its truncation.

A connector reads a local table in place of a download. Four families share the machinery of :mod:`collect` and differ in
their filter, in what they hold to be a repeat, and in cleaning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as X
from textlake.functions.cleaning import assistant_turns
from textlake.operators.chunking import joined_rows, paragraphs, word_chunks
from textlake.sources.collect import Options, Source, collect

HUMAN, AI = "human", "ai"


@dataclass(frozen=True)
class Connector:
    """row: its number in the catalogue; shape: how its fields hold texts; n: words, rows, parts or the word bounds of a shape."""

    row: str
    source: str
    shape: str
    fields: tuple[str, ...]
    label: str = HUMAN
    least: int = 15
    most: int = 10_000
    cap: int | None = None
    pool: str = ""
    n: tuple[int, ...] = ()
    words: int | None = None
    seen: str | None = None


# What each connector reads, and its bounds.
_M = 1_000_000
_CONFIGS = ("all", "finance", "medicine", "open_qa", "wiki_csai", "reddit_eli5")
_ROLES = ("gpt", "assistant", "chatgpt")
FIRST = (
    *(Connector("1", f"hc3_{x}", "two_lists", ("human_answers", "chatgpt_answers")) for x in _CONFIGS),
    Connector("2", "gpt_wiki", "two_fields", ("wiki_intro", "generated_intro")),
    Connector("3", "ai_detection", "labelled", ("text", "label")),
    Connector("4", "wikipedia", "paragraphs", ("text",), cap=20 * _M, n=(5,)),
    *(Connector("5", "cnn_dm", "tagged", ("article", "highlights")) for _ in ("train", "validation", "test")),
    *(Connector("6", "xsum", "field", ("document",)) for _ in ("train", "validation", "test")),
    Connector("7", "openwebtext", "field", ("text",), cap=20 * _M),
    Connector("8", "c4", "field", ("text",), cap=20 * _M),
    Connector("9", "writing_prompts", "field", ("story", "text")),
    Connector("9", "eli5", "list", ("answers.text",)),
    Connector("10", "arxiv", "field", ("abstract",), cap=10 * _M, pool="arxiv"),
    Connector("10", "arxiv", "field", ("article",), cap=10 * _M, pool="arxiv", words=1500),
    Connector("10", "pubmed", "field", ("abstract",), cap=20 * _M),
    Connector("11", "yelp", "field", ("text",), cap=20 * _M // 3),
    Connector("11", "amazon", "field", ("content",), cap=20 * _M // 3),
    Connector("11", "imdb", "field", ("text",)),
    Connector("12", "bookcorpus", "joined", ("text",), cap=20 * _M, pool="books", n=(10,)),
    Connector("12", "pg19", "chunks", ("text",), cap=20 * _M, pool="books", n=(500,)),
    Connector("13", "multi_news", "field", ("document", "text"), cap=2 * _M),
    Connector("13", "gigaword", "field", ("document", "text"), cap=2 * _M),
    Connector("13", "newsroom", "field", ("text",), cap=2 * _M),
    Connector("14", "gpt2_output", "field", ("text",), AI),
    Connector("14", "hh_rlhf", "transcript", ("chosen",), AI),
    Connector("14", "sharegpt", "turns", ("conversations", *_ROLES), AI),
    Connector("15", "dolly", "field", ("response",), AI),
    Connector("15", "oasst", "role", ("role", "text"), AI),
    Connector("15", "flan", "field", ("target", "targets"), AI, cap=5 * _M),
    *(Connector("16", x, "field", ("output", "response", "text"), AI, cap=2 * _M) for x in ("alpaca", "WizardLM_evol_instruct_V2_196k", "GPTeacher-General-Instruct")),
    Connector("17", "qwedsacf/grade-style-essays", "field", ("essay", "text")),
    Connector("17", "wikitext", "joined", ("text",), n=(20,)),
    Connector("18", "squad", "field", ("context",)),
    Connector("18", "natural_questions", "field", ("document.text",), words=1000),
    Connector("20", "cc_news", "field", ("text",), cap=5 * _M),
    Connector("20", "wikihow", "field", ("text",)),
)
_TARGET = 500_000
SECOND = (
    Connector("c1", "eli5", "field", ("title",), least=8, most=1000, cap=_TARGET // 4),
    Connector("c1", "writingprompts", "field", ("story",), most=500, cap=_TARGET // 4),
    Connector("c1", "reddit", "field", ("content", "body", "selftext"), least=10, most=300, cap=_TARGET // 4),
    Connector("c2", "imdb", "field", ("text",), most=400, cap=_TARGET // 3, pool="reviews"),
    Connector("c2", "yelp", "field", ("text",), most=300, cap=2 * _TARGET // 3, pool="reviews"),
    Connector("c2", "amazon", "field", ("content",), most=300, cap=_TARGET // 3),
    Connector("c3", "cnn_dm", "field", ("article",), most=500, cap=_TARGET // 3),
    Connector("c3", "pubmed", "field", ("abstract",), most=1000, cap=_TARGET // 3),
    Connector("c3", "wikipedia", "paragraph", ("text",), most=300, cap=_TARGET // 3),
    *(Connector("c4", "hc3_chatgpt", "list", ("chatgpt_answers",), AI, most=1000) for _ in _CONFIGS),
    Connector("c4", "sharegpt", "turns", ("conversations", *_ROLES), AI, most=1000),
    Connector("c4", "gpt_wiki", "field", ("generated_intro",), AI, most=1000),
    Connector("c5", "alpaca", "field", ("output",), AI, most=1000),
    Connector("c5", "dolly", "field", ("response",), AI, most=1000),
    Connector("c5", "oasst", "role", ("role", "text"), AI, most=1000),
    Connector("c5", "wizardlm", "turns", ("conversations", "gpt"), AI, most=1000),
    Connector("c5", "flan", "field", ("target", "targets"), AI, most=1000, cap=100_000),
    *(Connector("c6", x, "labelled", ("text", "label"), most=1000, seen=HUMAN) for x in ("chatgpt-detector-roberta", "ai-text-detection-pile", "DeepfakeTextDetection")),
    *(Connector("c7", "hc3_human", "list", ("human_answers",), most=1000) for _ in _CONFIGS),
)
_ANY = 1 << 30
THIRD = (
    *(Connector("g1", "hc3", "two_lists", ("human_answers", "chatgpt_answers"), most=_ANY) for _ in _CONFIGS[:5]),
    Connector("g2", "gpt_wiki", "two_fields", ("wiki_intro", "generated_intro"), most=_ANY),
    *(Connector("g3", x, "labelled", ("text", "label"), most=_ANY) for x in ("chatgpt-detector-roberta", "DeepfakeTextDetection")),
    Connector("g4", "eli5", "field", ("title",), least=10, most=_ANY, cap=50_000),
    Connector("g4", "writingprompts", "field", ("story",), least=20, most=500, cap=30_000),
    Connector("g5", "alpaca", "field", ("output",), AI, most=_ANY),
    Connector("g5", "dolly", "field", ("response",), AI, most=_ANY),
    Connector("g5", "oasst", "role", ("role", "text"), AI, most=_ANY),
    Connector("g6", "imdb", "field", ("text",), least=20, most=300, cap=25_000),
    Connector("g6", "yelp", "field", ("text",), least=20, most=300, cap=25_000),
)
SHORT = (
    Connector("f1", "tweets", "field", ("text",), least=5, most=30),
    Connector("f2", "sms", "field", ("sms",), least=5, most=30),
    Connector("f3", "rotten_tomatoes", "field", ("text",), least=5, most=30),
    Connector("f4", "sst2", "field", ("sentence",), least=5, most=30),
    Connector("f5", "yahoo", "scanned", ("question_title",), least=5, most=30, n=(50_000,)),
    Connector("f6", "ag_news", "first_sentence", ("text",), least=5, most=30),
    Connector("f7", "synthetic", "field", ("text",), least=5, most=30),
)
SENTENCES = (
    Connector("h1", "tatoeba", "scanned", ("translation.en",), least=5, most=25, n=(100_000,)),
    Connector("h2", "simple_wiki", "sentences", ("text",), least=5, most=25, cap=50_000, n=(5, 20)),
    Connector("h3", "patterns", "field", ("text",), least=5, most=25),
)


@dataclass(frozen=True)
class Family:
    """What a family's connectors have in common; the filter's shares of distinct words and letters, its least characters."""

    connectors: tuple[Connector, ...]
    options: Options
    unique: float = 0.25
    alpha: float = 0.7
    chars: int = 50
    ends: bool = False


FAMILIES = {
    "first": Family(FIRST, Options()),
    "second": Family(SECOND, Options(most_words=None, one_set_per_label=True, hashed="normalized", clean="prefixes"), unique=0.3),
    "third": Family(THIRD, Options(most_words=None, hashed="none", clean="strip"), unique=0, alpha=0, chars=1),
    "short": Family(SHORT, Options(most_words=None, hashed="exact", clean="strip"), unique=0, alpha=0, chars=1),
    "sentences": Family(SENTENCES, Options(most_words=None, hashed="exact", clean="strip"), unique=0, alpha=0, chars=1, ends=True),
}


def texts(c: Connector) -> Column:
    """An array of (text, label, source) for each row of a connector's table."""
    one = lambda text, label=c.label, source=c.source: F.struct(text.alias("text"), F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), F.lit(source).alias("source"))
    each = lambda array, label=c.label: F.transform(F.coalesce(array, F.array().cast("array<string>")), lambda x: one(x, label))
    first = F.col(c.fields[0])
    made: dict[str, Callable[[], Column]] = {
        "field": lambda: F.array(one(X.first_truthy(*c.fields))),
        "scanned": lambda: F.array(one(first)),
        "joined": lambda: F.array(one(first)),
        "two_fields": lambda: F.array(one(first, HUMAN), one(F.col(c.fields[1]), AI)),
        "tagged": lambda: F.array(one(first), one(F.col(c.fields[1]), c.label, f"{c.source}_{c.fields[1]}")),
        "list": lambda: each(first),
        "two_lists": lambda: F.concat(each(first, HUMAN), each(F.col(c.fields[1]), AI)),
        "labelled": lambda: F.array(one(first, X.decode_label(c.fields[1]))),
        "paragraphs": lambda: each(F.slice(F.split(first, "\n\n"), 1, c.n[0])),
        "paragraph": lambda: F.array(one(F.split(first, "\n\n")[0])),
        "chunks": lambda: each(word_chunks(first, c.n[0])),
        "turns": lambda: each(F.transform(F.filter(first, lambda x: x["from"].isin(*c.fields[1:])), lambda x: x["value"])),
        "transcript": lambda: each(assistant_turns(first)),
        "role": lambda: F.when(first == "assistant", F.array(one(F.col(c.fields[1])))),
        "first_sentence": lambda: F.array(one(X.plain_sentences(first)[0])),
        "sentences": lambda: each(F.filter(F.transform(X.plain_sentences(first), lambda x: F.concat(X.strip(x), F.lit("."))), lambda x: X.n_words(x).between(*c.n))),
    }
    return made[c.shape]()


def prepared(c: Connector, table: DataFrame, order: str) -> DataFrame:
    """The connector's table: rows joined, or only the first ones, where the connector says so."""
    if c.shape == "joined":
        rows = joined_rows(table.select(order, F.coalesce(c.fields[0], F.lit("")).alias(c.fields[0])), c.fields[0], order, c.n[0], ())
        return rows.select(F.col("group_no").alias(order), F.col("text").alias(c.fields[0]))
    if c.shape == "scanned":
        return table.orderBy(order).limit(c.n[0])  # how many rows are read is the feature
    return table


def source(c: Connector, family: Family, table: Callable[[], DataFrame], order: str = "o") -> Source:
    """The connector as a source over the rows that ``table`` gives."""
    return Source(
        c.source, lambda: prepared(c, table(), order), texts(c), order, c.least, c.most, family.unique, c.cap,
        cut_first=c.row == "3", chars=family.chars, alpha=family.alpha, ends=family.ends, pool=c.pool, words=c.words, seen=c.seen, clean_first=c.row == "c6",
    )


def collect_family(name: str, table: Callable[[Connector], DataFrame], order: str = "o", capped: bool = True) -> DataFrame:
    """All rows that a family's connectors accept. table: gives a connector's rows, ``order`` its column of whole numbers.

    capped: whether the connectors' caps hold; without them all rows are taken.
    """
    family = FAMILIES[name]
    connectors = [c if capped else replace(c, cap=None) for c in family.connectors]
    return collect([source(c, family, lambda c=c: table(c), order) for c in connectors], family.options)


def top_up(humans: int, machines: int, target: int) -> int:
    """How many synthetic texts are wanted: only as many as the class ai lacks, to the other class or its target."""
    return max(0, min(humans - machines, target - machines))


__all__ = ["FAMILIES", "Connector", "Family", "collect_family", "paragraphs", "prepared", "source", "texts", "top_up"]

"""Declarative sources: where texts are in a table, their label, bounds and cap; filtered, deduplicated, truncated, labelled.

Sources are scanned in order. Within a source rows are filtered, then a text whose hash an earlier accepted row has is
dropped, then the cap holds. Only rows that were accepted count as seen, so a source's hashes are set against those of
the sources before it. Sources whose cap isn't reached by what passes their filter are chosen together by one
aggregation; each other source is a step of its own: a loop over plans, not over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as X
from textlake.functions.cleaning import clean_collected
from textlake.functions.validity import accepted
from textlake.operators.lineage import cut
from textlake.operators.ranking import positions


@dataclass(frozen=True)
class Source:
    """Where texts come from.

    name: the source's tag, where a text has none of its own. table: what gives the rows. texts: an array of (text, label)
    for each row, or of (text, label, source). order: a column of whole numbers. least, most: bounds of words; chars: of
    characters; unique, alpha: least shares; ends: whether a text must end in . ! or ?. cap: most accepted texts, shared
    by all sources of the same ``pool``. words: what texts are cut to; cut_first: whether before they are hashed. seen:
    whose texts they must not repeat, if that isn't their label's. clean_first: whether cleaning comes before the hash.
    """

    name: str
    table: Callable[[], DataFrame]
    texts: Column
    order: str
    least: int = 15
    most: int = 10_000
    unique: float = 0.25
    cap: int | None = None
    cut_first: bool = False
    chars: int = 50
    alpha: float = 0.7
    ends: bool = False
    pool: str = ""
    words: int | None = None
    seen: str | None = None
    clean_first: bool = False


@dataclass(frozen=True)
class Options:
    """hashed: what texts mustn't repeat: prefix, normalized, exact or none; clean: none, strip (first of all) or prefixes."""

    most_words: int | None = 2000
    prefix: int = 1000
    one_set_per_label: bool = False
    hashed: str = "prefix"
    clean: str = "none"


def labelled(*pairs: tuple[Column, str]) -> Column:
    """An array of (text, label) out of columns."""
    return F.array(*(F.struct(text.alias("text"), F.lit(label).alias("label")) for text, label in pairs))


def each(texts: Column, label: str) -> Column:
    """An array of (text, label) out of an array of texts."""
    return F.transform(texts, lambda x: F.struct(x.alias("text"), F.lit(label).alias("label")))


def by_label(text: Column, label: Column) -> Column:
    """One text whose label is 0 or 1."""
    return F.array(F.struct(text.alias("text"), X.decode_label(label).alias("label")))


def _hash(text: Column, options: Options) -> Column:
    made = {"prefix": lambda: X.hash_prefix(text, options.prefix), "normalized": lambda: X.hash_normalized(text), "exact": lambda: X.hash_exact(text), "none": lambda: F.lit("")}
    return made[options.hashed]()


def spread(source: Source, rank: int, options: Options) -> DataFrame:
    """All texts of a source with their place (o, i), before any filter."""
    rows = source.table().select(F.col(source.order).cast("long").alias("o"), F.posexplode(source.texts).alias("i", "_t"))
    tagged = "source" in rows.schema["_t"].dataType.names
    rows = rows.select("o", "i", F.col("_t.text").alias("text"), F.col("_t.label").alias("label"), (F.col("_t.source") if tagged else F.lit(source.name)).alias("source"))
    if options.clean == "strip":
        rows = rows.withColumn("text", X.strip("text"))
    return rows.select(F.lit(rank).alias("source_rank"), "source", "o", "i", "label", F.lit(source.words or options.most_words).cast("int").alias("words"), "text")


def candidates(source: Source, rank: int, options: Options) -> DataFrame:
    """The places of a source's texts that its filter accepts, with their hash and set, before any dedup."""
    fits = accepted("text", source.least, source.most, source.unique, source.alpha, source.chars, source.ends)
    rows = spread(source, rank, options).where(F.col("label").isNotNull() & fits)
    hashed = F.col("text")
    if source.cut_first:
        hashed = X.first_words(hashed, source.words or options.most_words)
    if source.clean_first:
        hashed = clean_collected(hashed)
    seen = F.coalesce(F.lit(source.seen), "label") if options.one_set_per_label else F.lit("")
    return rows.select("source_rank", "source", "o", "i", _hash(hashed, options).alias("hash"), "label", seen.alias("seen"))


def choose(places: DataFrame, sources: list[Source], options: Options) -> DataFrame:
    """Of the candidates' places (source_rank, o, i, hash, seen) those that are accepted."""
    key = ["hash", "seen"] if options.hashed != "none" else ["source_rank", "o", "i"]
    counts = {r.source_rank: r["count"] for r in places.groupBy("source_rank").count().collect()}  # a row a source
    pools: dict[str, int] = {}
    for rank, source in enumerate(sources):
        pools[source.pool] = pools.get(source.pool, 0) + counts.get(rank, 0)
    out: DataFrame | None = None

    def add(ranks: list[int], cap: int | None = None) -> int:
        """Accepts what these sources have that isn't seen."""
        nonlocal out
        rows = places.where(F.col("source_rank").isin(ranks))
        if options.hashed != "none":
            rows = rows.groupBy(*key).agg(F.min(F.struct("source_rank", "o", "i")).alias("at")).select(*key, "at.*")
            if out is not None:
                rows = rows.join(out.select(*key), key, "left_anti")
        if cap is not None:
            rows = positions(rows, ("o", "i")).where(F.col("position") < cap).drop("position")  # the cap is the feature
        rows = cut(rows.select("source_rank", "o", "i", *(c for c in key if c not in ("source_rank", "o", "i"))))
        out = rows if out is None else out.unionByName(rows)
        return rows.count() if cap is not None else 0

    waiting: list[int] = []
    taken: dict[str, int] = {}
    for rank, source in enumerate(sources):
        if source.cap is None or (pools[source.pool] if source.pool else counts.get(rank, 0)) <= source.cap:
            waiting.append(rank)
            continue
        if waiting:
            add(waiting)
            waiting = []
        n = add([rank], max(0, source.cap - taken.get(source.pool, 0) if source.pool else source.cap))
        taken[source.pool] = taken.get(source.pool, 0) + n
    if waiting or out is None:
        add(waiting)
    return out


def collect(sources: list[Source], options: Options = Options()) -> DataFrame:  # noqa: B008
    """text, label, label_int and source of all accepted rows, with source_rank, o and i as their order, and their hash.

    Texts are read twice, once for the places and once for the rows; only places and hashes are kept in between, and the
    filter runs once.
    """
    places = cut(reduce(DataFrame.unionByName, (candidates(s, rank, options) for rank, s in enumerate(sources))))
    kept = choose(places, sources, options).select("source_rank", "o", "i")
    kept = places.select("source_rank", "o", "i", "hash").join(kept, ["source_rank", "o", "i"], "left_semi")
    rows = reduce(DataFrame.unionByName, (spread(s, rank, options) for rank, s in enumerate(sources))).join(kept, ["source_rank", "o", "i"])
    text = F.when(F.col("words").isNull(), F.col("text")).otherwise(X.first_words("text", F.col("words")))
    if options.clean == "prefixes":
        text = clean_collected(text)
    return rows.select(text.alias("text"), "label", X.encode_label("label").alias("label_int"), "source", "source_rank", "o", "i", "hash")


def collect_each(sources: list[Source], options: Options = Options()) -> tuple[DataFrame, dict[str, str]]:  # noqa: B008
    """As :func:`collect`, but a source whose table can't be read is left out; its error is in the map."""
    able, errors = [], {}
    for source in sources:
        try:
            spread(source, 0, options).limit(1).count()
            able.append(source)
        except Exception as error:  # whatever a source does
            errors[source.name] = str(error).splitlines()[0]
    return collect(able, options), errors

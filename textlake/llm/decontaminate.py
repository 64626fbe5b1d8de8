"""Benchmark decontamination: one word-level Aho-Corasick automaton over the items' windows scans each text once.

Texts and items are lower-cased (A-Z) and cut into words of ASCII letters and digits and all other non-ASCII characters.
A window is ``width`` consecutive item words, or a whole item that has fewer, but not none. A document word is hit if it
lies inside any occurrence of a window. ``hits`` has the stretches of hit words as spans of bytes of the original text, so
that they can be cut out or shown.

The benchmark is a stated query set. Its windows are read in blocks of at most ``block_windows``, which bounds both what
is broadcast at a time and the automaton. One block (some hundred thousand windows) is scanned in one pass without a
shuffle; further blocks each scan the table again, their broadcast is given back after it, and the few documents with hits
meet in an aggregation by row.

Null text has no words, and neither has a null item; items with a null id hit words but are not named. Items that
share an id are one item; windows that several items have count for all of them. Repeated rows are scanned alike. One very
long text takes time in proportion and some fifty times its size in one worker. An empty table gives an empty result, an
empty benchmark no hits. Other columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm._common import ALNUM, LOWER, cut, in_chunks, others, raw

RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BUILT: dict = {}


def spans(text: bytes) -> list[tuple[int, int]]:
    """Where each word stands in the original text, in bytes."""
    return [x.span() for x in WORD.finditer(text.translate(LOWER))]


def windows(text: bytes, width: int) -> list[tuple[bytes, ...]]:
    words = text.translate(ALNUM).split()
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


class Automaton:
    """The windows of a block of items; words that no item has are 0."""

    def __init__(self, block: list[tuple[int | None, tuple[bytes, ...]]]):
        self.ids: dict[bytes, int] = {}
        self.items: list[set] = []
        places: dict[tuple, int] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for item, window in block:
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in window)
            if key not in places:
                places[key] = len(self.items)
                self.items.append(set())
                self.found.add_word(key, (places[key], len(key)))
            self.items[places[key]].add(item)
        if self.items:
            self.found.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans of the hits (merged, in order) and the items found."""
        spans, items = [], set()
        if self.items and words:
            get = self.ids.get
            for last, (k, n) in self.found.iter(tuple([get(w, 0) for w in words])):
                items |= self.items[k]
                begin = last + 1 - n
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, last + 1))
        return spans, items


def _automaton(shared) -> Automaton:
    """Built once in a worker process, for the block that it last used."""
    if shared.value["key"] not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.value["key"]] = Automaton(shared.value["block"])
    return _BUILT[shared.value["key"]]


def blocks(benchmark: DataFrame, width: int, block_windows: int) -> Iterator[list]:
    """(item id, window) of all items, so many at a time."""
    held: list = []
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        for window in windows((text or "").encode(), width):
            held.append((item, window))
            if len(held) >= block_windows:
                yield held
                held = []
    if held:
        yield held


def _named(items: set) -> tuple[int, str]:
    named = sorted(x for x in items if x is not None)
    return len(named), hashlib.sha256(",".join(named).encode()).hexdigest()


def hits_of(text: bytes, found: list[tuple[int, int]]) -> list[dict]:
    """Stretches of words as spans of the original's bytes."""
    if not found:
        return []
    places = spans(text)
    return [{"begin": places[x][0], "end": places[y - 1][1]} for x, y in found]


SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def _result(n_words: list, found: list[list[tuple[int, int]]], items: list[set], texts: list[bytes]) -> pa.Array:
    named = [_named(x) for x in items]
    n_hit = [sum(y - x for x, y in own) for own in found]
    columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([x for x, _ in named], pa.int64()), pa.array([x for _, x in named], pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
    return pa.StructArray.from_arrays([*columns, pa.array([hits_of(t, x) for t, x in zip(texts, found, strict=True)], pa.list_(SPAN))], list(RESULT))


STRUCT = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean,hits:array<struct<begin:long,end:long>>>"
PART = pa.struct([("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _whole(block: Broadcast | None):
    """Scans texts for the only block there is."""

    def scanned(chunk: pa.RecordBatch) -> pa.Array:
        texts, n_words, found, items = raw(chunk), [], [], []
        for one in texts:
            words = one.translate(ALNUM).split()
            hit, own = _automaton(block).scan(words) if block else ([], set())
            n_words.append(len(words))
            found.append(hit)
            items.append(own)
        return _result(n_words, found, items, texts)

    return F.arrow_udf(lambda text: in_chunks(scanned, text), STRUCT)


def _partly(block: Broadcast):
    """Scans texts for one of several blocks; null without a hit."""

    def scanned(chunk: pa.RecordBatch) -> pa.Array:
        out = []
        for one in raw(chunk):
            hit, items = _automaton(block).scan(one.translate(ALNUM).split())
            out.append({"begins": [x for x, _ in hit], "ends": [y for _, y in hit], "items": sorted(items, key=str)} if hit else None)
        return pa.array(out, PART)

    return F.arrow_udf(lambda text: in_chunks(scanned, text), "struct<begins:array<int>,ends:array<int>,items:array<string>>")


def _joined(chunk: pa.RecordBatch) -> pa.Array:
    """The blocks' hits of each text as one result."""
    texts, n_words, found, items = raw(chunk), [], [], []
    for one, own in zip(texts, chunk.column(1).to_pylist(), strict=True):
        n_words.append(len(one.translate(ALNUM).split()))
        hit: list[tuple[int, int]] = []
        for begin, end in sorted((x, y) for part in own or [] for x, y in zip(part["begins"], part["ends"], strict=True)):
            if hit and begin <= hit[-1][1]:
                hit[-1] = (hit[-1][0], max(hit[-1][1], end))
            else:
                hit.append((begin, end))
        found.append(hit)
        items.append({i for part in own or [] for i in part["items"]})
    return _result(n_words, found, items, texts)


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 200_000) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items_sha256, contaminated and hits."""
    context = docs.sparkSession.sparkContext

    def shared(block: list) -> Broadcast:
        return context.broadcast({"key": f"{id(context)}-{hashlib.sha256(repr(block).encode()).hexdigest()}", "block": block})

    keep = [F.col(f"`{c}`") for c in others(docs, RESULT)]
    more = blocks(benchmark, width, block_windows)
    first, second = next(more, None), next(more, None)
    if second is None:
        found = _whole(shared(first) if first else None)
        return docs.select(*keep, found("text").alias("_made")).select(*keep, "_made.*")

    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")
    hits = None
    for block in chain((first, second), more):
        now = shared(block)
        part = cut(texts.select("_id", "_text", _partly(now)("text").alias("_hit")).where("_hit is not null"))
        now.destroy()
        hits = part if hits is None else hits.union(part)
    hits = hits.groupBy("_id", "_text").agg(F.collect_set("_hit").alias("_hits"))  # at most one for each block
    both = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left")
    joined = F.arrow_udf(lambda text, hits: in_chunks(_joined, text, hits), STRUCT)
    return both.select(*keep, joined("text", "_hits").alias("_made")).select(*keep, "_made.*")

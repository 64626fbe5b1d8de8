"""Line dedup: owners of hash ranges keep a once-seen and a twice-seen Bloom filter; only suspects go on to be confirmed.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``least_points`` code
points that at least ``least_docs`` documents hold lose all their lines but those in the largest doc_id that holds them.

1. Each document gives a 128-bit hash for each of its distinct keys. A key that several documents of one worker's share
   hold is known to repeat: one row of it goes to its owner as such, the others need no filter and are spread evenly,
   so that a key which a third of all documents hold meets in no task.
2. The rows go by hash to owners. An owner's filters have 16 bits for each of its rows, so no filter grows with the corpus.
   (One pair of filters for all keys would have to grow with them.)
3. Only suspects shuffle again, for the exact number of documents and the largest doc_id of each 128-bit hash. Hot keys'
   documents are made distinct over all tasks before they are counted.
4. Up to ``MOST_KEYS`` repeated keys (24 bytes each) are broadcast, and no text is shuffled. If there are more, documents
   are told their lost keys by a join, salted for frequent keys, and another on doc_id.

Null or empty text is one empty line. Rows that share a doc_id are one document and lose the same keys; so are those with
a null doc_id, which is smaller than any other. One very long text needs a few times its size in one worker. An empty
table gives an empty result. Other columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm._common import LOWER, chunks, cut, in_chunks, others, raw, rows

BLANK = b" \t\n\r\x0b\x0c"
PLAIN, REPEATS, SURE = 0, 1, 2
#: Distinct keys that a worker gathers before it passes them on.
GATHERED = 200_000
PROBES = 4
#: Parts in which the documents that hold a key meet its verdict.
SALTS = 16
#: Repeated keys that are broadcast (24 MB).
MOST_KEYS = 1_000_000


def line_keys(text: bytes, least_points: int) -> list[bytes | None]:
    """The hash of each line's key; None for keys that are too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).translate(LOWER)
        long = len(key) >= least_points and (len(key) >= 4 * least_points or len(key.decode("utf-8", "replace")) >= least_points)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _gather(least_points: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32())])

    def flush(held: dict):
        keys, ids, kinds = [], [], []
        for key, own in held.items():
            keys += [key] * len(own)
            ids += own
            kinds += [PLAIN] if len(own) == 1 else [REPEATS] + [SURE] * (len(own) - 1)
        both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        for i in range(0, len(ids), 50_000):
            part = slice(i, i + 50_000)
            yield rows(schema, h1=pa.array(both[part, 0]), h2=pa.array(both[part, 1]), doc_id=ids[part], kind=kinds[part])

    def run(batches):
        held, n = defaultdict(list), 0
        for batch in chunks(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch), strict=True):
                own = {*line_keys(text, least_points)} - {None}
                n += len(own)
                for key in own:
                    held[key].append(doc)
            if n >= GATHERED:
                yield from flush(held)
                held, n = defaultdict(list), 0
        yield from flush(held)

    return run


def _places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    step = h2.view(np.uint64) | np.uint64(1)
    return np.stack([(h1.view(np.uint64) + np.uint64(j) * step) & np.uint64(size - 1) for j in range(PROBES)])


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    flat = at.ravel()
    np.bitwise_or.at(bits, flat >> np.uint64(3), np.left_shift(1, flat & np.uint64(7)).astype(np.uint8))


def _all_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _suspects(batches):
    """Of an owner's rows those whose hash is in its twice-seen filter."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not held:
        return
    table = pa.concat_tables(held)
    h1, h2, kind = (table.column(c).to_numpy() for c in ("h1", "h2", "kind"))
    size = 1 << max(6, int(16 * len(h1) - 1).bit_length())
    once, twice = np.zeros(size >> 3, np.uint8), np.zeros(size >> 3, np.uint8)
    sure = kind == SURE
    for begin in range(0, len(h1), 20_000):
        part = np.arange(begin, min(begin + 20_000, len(h1)))
        part = part[~sure[part]]
        at = _places(h1[part], h2[part], size)
        _, first, count = np.unique(h1[part], return_index=True, return_counts=True)
        again = _all_set(once, at) | (kind[part] == REPEATS)
        again[first[count > 1]] = True
        _set(twice, at[:, again])
        _set(once, at)
    keep = sure.copy()
    for begin in range(0, len(h1), 200_000):
        part = slice(begin, begin + 200_000)
        keep[part] |= _all_set(twice, _places(h1[part], h2[part], size))
    out = table.select(["h1", "h2", "doc_id"]).filter(pa.array(keep))
    yield from (rows(schema, h1=b.column(0), h2=b.column(1), doc_id=b.column(2)) for b in out.combine_chunks().to_batches(50_000))


def suspects(docs: DataFrame, least_points: int = 20) -> DataFrame:
    """(h1, h2, doc_id) of the keys that the filters hold to be repeated."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_gather(least_points), "h1 long, h2 long, doc_id long, kind int")
    dealt = seen.repartition(F.when(F.col("kind") == SURE, F.xxhash64("h1", "doc_id")).otherwise(F.col("h1")))
    return cut(dealt.mapInArrow(_suspects, "h1 long, h2 long, doc_id long"))


def repeated_keys(found: DataFrame, least_docs: int = 3) -> DataFrame:
    """(h1, h2, keep): the keys that are in so many documents, and the largest doc_id of each."""
    each = found.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
    return each.agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= least_docs).select("h1", "h2", "keep")


def lost_keys(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id and the hashes of the keys that it loses, for documents that lose any."""
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    lost = spread.join(salted, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))


def _remaining(texts: list[bytes], keys: list[list[bytes | None]], gone: list) -> pa.Array:
    """Texts without the lines whose key is gone (a set, or flags by line), and how many lines there were and went."""
    out, n_lines, n_dropped = [], [], []
    for text, own, lost in zip(texts, keys, gone, strict=True):
        lines = text.split(b"\n")
        n_lines.append(len(lines))
        if lost is not None:
            lines = [x for x, key in zip(lines, own, strict=True) if key not in lost]
        n_dropped.append(n_lines[-1] - len(lines))
        out.append(b"\n".join(lines))
    return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])


class Verdicts:
    """Repeated keys, sorted by their hash, and the documents that keep them."""

    def __init__(self, repeated: DataFrame):
        table = repeated.toArrow()  # at most MOST_KEYS rows
        h1 = table.column("h1").to_numpy()
        order = np.argsort(h1, kind="stable")
        self.h1, self.h2 = h1[order], table.column("h2").to_numpy()[order]
        self.none = table.column("keep").is_null().to_numpy()[order]
        self.keep = table.column("keep").fill_null(0).to_numpy()[order]

    def lost(self, digests: np.ndarray, docs: np.ndarray, none: np.ndarray) -> np.ndarray:
        """Which of the keys (rows of two numbers), of documents with or without an id, are lost."""
        out = np.zeros(len(digests), bool)
        if not len(self.h1):
            return out
        at = np.searchsorted(self.h1, digests[:, 0])
        left = np.arange(len(digests))
        while len(left := left[(at[left] < len(self.h1))]) and len(left := left[self.h1[at[left]] == digests[left, 0]]):
            same = self.h2[at[left]] == digests[left, 1]
            hit = left[same]
            own = np.where(none[hit] | self.none[at[hit]], none[hit] & self.none[at[hit]], docs[hit] == self.keep[at[hit]])
            out[hit] = ~own
            left = left[~same]
            at[left] += 1
        return out


def drop_repeated_lines(docs: DataFrame, least_points: int = 20, least_docs: int = 3, most_keys: int = MOST_KEYS) -> DataFrame:
    """The documents with their lost lines taken out of ``text``, and n_lines (before) and n_dropped."""
    found = suspects(docs, least_points)
    repeated = cut(repeated_keys(found, least_docs))
    schema = "struct<text:string,n_lines:long,n_dropped:long>"
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    doc_id = F.col("whole.doc_id").cast("long")
    if repeated.count() <= most_keys:
        shared = docs.sparkSession.sparkContext.broadcast(Verdicts(repeated))

        def judged(chunk: pa.RecordBatch) -> pa.Array:
            texts = raw(chunk)
            keys = [line_keys(x, least_points) for x in texts]
            sizes = [sum(k is not None for k in own) for own in keys]
            digests = np.frombuffer(b"".join(k for own in keys for k in own if k is not None), np.int64).reshape(-1, 2)
            ids = chunk.column(1)
            lost = shared.value.lost(digests, np.repeat(ids.fill_null(0).to_numpy(), sizes), np.repeat(ids.is_null().to_numpy(zero_copy_only=False), sizes))
            ends = np.cumsum(sizes)
            gone = [{digests[k].tobytes() for k in np.flatnonzero(lost[end - size : end]) + end - size} or None for size, end in zip(sizes, ends.tolist(), strict=True)]
            return _remaining(texts, keys, gone)

        made = whole.select("whole", F.arrow_udf(lambda text, ids: in_chunks(judged, text, ids), schema)("whole.text", doc_id).alias("made"))
    else:

        def told(chunk: pa.RecordBatch) -> pa.Array:
            texts = raw(chunk)
            gone = [x and {np.array([y["h1"], y["h2"]], np.int64).tobytes() for y in x} for x in chunk.column(1).to_pylist()]
            return _remaining(texts, [line_keys(x, least_points) if g else [] for x, g in zip(texts, gone, strict=True)], gone)

        lost = lost_keys(found, repeated).withColumnRenamed("doc_id", "lost_id")
        both = whole.join(lost, doc_id.eqNullSafe(F.col("lost_id")), "left")
        made = both.select("whole", F.arrow_udf(lambda text, lost: in_chunks(told, text, lost), schema)("whole.text", "lost").alias("made"))
    result = ("n_lines", "n_dropped")
    return made.select(*(F.col("made.text") if c == "text" else F.col(f"whole.`{c}`") for c in others(docs, result)), *(F.col(f"made.{c}") for c in result))

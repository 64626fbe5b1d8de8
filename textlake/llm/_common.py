"""Shared parts of the training-data operators: Arrow chunking, word hashes, lineage cuts and graph components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.operators.lineage import cut, release

#: Text handled at once by a Python worker; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def others(df: DataFrame, result: tuple[str, ...]) -> list[str]:
    """The columns that a result doesn't replace, whatever their case."""
    return [c for c in df.columns if c.lower() not in result]


#: Bits of the largest filter that is broadcast (8 MB).
MOST_BITS = 1 << 26
#: Bits of a filter's block, which one task sets and sends as one row.
BLOCK_BITS = 1 << 19


def filter_bits(n: int, most: int = MOST_BITS) -> int:
    """16 bits for each of n keys, as a power of two, but at most ``most``."""
    return 1 << min(most.bit_length() - 1, max(10, (16 * n).bit_length()))


def bit_filter(places: DataFrame, bits: int) -> np.ndarray:
    """A filter's 64-bit words, in which the bits at the given places (at) are set.

    Each block of ``BLOCK_BITS`` is set by one task, so the driver gets as many rows as there are blocks, ``bits`` / 8 bytes in all.
    """
    schema = pa.schema([("block", pa.int64()), ("set", pa.binary())])

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("at").to_numpy()
            block = at // BLOCK_BITS
            for one in np.unique(block).tolist():
                own = held.setdefault(one, np.zeros(min(bits, BLOCK_BITS), bool))
                own[at[block == one] % BLOCK_BITS] = True
        for one, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], schema=schema)

    dealt = places.select("at").repartition(F.shiftright("at", BLOCK_BITS.bit_length() - 1))
    table = np.zeros(bits >> 6, np.int64)
    size = min(bits, BLOCK_BITS) >> 6
    for row in dealt.mapInArrow(run, "block long, set binary").collect():  # at most bits / BLOCK_BITS
        table[row.block * size : (row.block + 1) * size] |= np.frombuffer(row.set, np.int64)
    return table


def in_filter(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the rows of places (rows by probes) have all their bits set."""
    return ((table[places >> 6] >> (places & 63)) & 1).astype(bool).all(axis=1)


def likely(df: DataFrame, ids: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow(run, schema) over the rows whose doc_id is among the distinct ids (doc_id), and few others.

    A Bloom filter of the ids drops the others, in the worker that runs the rest, so no text is shuffled. It has 16 bits
    for each id and ``MOST_BITS`` at most; with far more ids it drops less. Joins on doc_id that follow make it exact.
    """
    bits = filter_bits(ids.count())
    places = F.array(*(F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(bits)) for k in range(3)))
    shared = df.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.explode(places).alias("at")), bits))

    def known(batches):
        for batch in batches:
            hit = in_filter(shared.value, batch.column("_places").flatten().to_numpy().reshape(-1, 3))
            if hit.any():
                yield batch.filter(pa.array(hit))

    return df.select("doc_id", "text", places.alias("_places")).mapInArrow(lambda batches: run(known(batches)), schema)


def beside(pairs: DataFrame, key: str, other: str, table: DataFrame) -> DataFrame:
    """Pairs with the columns of the table's row whose id is ``key``, however many pairs a key has.

    Pairs are gathered for each key and hash range of ``other``, as many ranges as there are shuffle partitions, and only
    these lists meet in the join: a key with a third of all pairs is spread over all tasks, and its table row is copied
    once for each list.
    """
    ranges = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in pairs.columns if c != key]
    lists = pairs.groupBy(key, F.pmod(F.xxhash64(other), F.lit(ranges)).alias("_range")).agg(F.collect_list(F.struct(*rest)).alias("_pairs"))
    met = lists.join(table.withColumnRenamed("id", key), key)
    return met.select(key, *(c for c in table.columns if c != "id"), F.explode("_pairs").alias("_pair")).select(key, "_pair.*", *(c for c in table.columns if c != "id"))


def tidy() -> None:
    """Gives the memory of finished chunks back to the system, which the allocators would keep for a worker that now waits."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        begin, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)
        del batch, sizes
        tidy()


def in_chunks(made, *columns: pa.Array, limit: int = CHUNK_BYTES) -> pa.Array:
    """What ``made`` (a record batch of text and the other columns to an array) gives for each chunk of a column of texts, joined."""
    names = ["text", *(f"c{i}" for i in range(1, len(columns)))]
    parts = [made(x) for x in chunks([pa.RecordBatch.from_arrays(list(columns), names)], limit=limit)]
    return pa.concat_arrays(parts) if parts else made(pa.RecordBatch.from_arrays(list(columns), names))


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the given columns."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)


def lists(flat: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    """An array of lists out of their joined values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), pa.array(flat, kind))


#: ASCII upper case to lower case.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The same, and every ASCII character that isn't a letter or digit to a space.
ALNUM = bytes(x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in LOWER)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b), as (id, component): its smallest id, for each id that has a link.

    Alternating large-star and small-star steps, with minima by aggregation and joins only; no group is gathered.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        both = low = large = small = None
        release(links.sparkSession)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    held = edges.groupBy("u").agg(F.min("v").alias("component"))
    return held.select(F.col("u").alias("id"), "component").union(edges.select("v", "v").distinct())


_FACTORS = np.random.default_rng(7).integers(1, 2**64, 1024, np.uint64) | np.uint64(1)
_INSIDE = np.array([x not in b" \t\n\r\x0b\x0c" for x in range(256)])


class Words:
    """The words (cut at ASCII white space) of several texts at once, as arrays.

    data: the texts' bytes, each text followed by a line feed, after the given byte table; starts, sizes: the words'
    places there; hashes: 64-bit, the same in all processes; bounds: word numbers at which the texts begin, and their end;
    offsets: the same for bytes.
    """

    def __init__(self, texts: list[bytes], table: bytes | None = None):
        joined = b"\n".join([*texts, b""])
        self.data = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
        inside = _INSIDE[self.data]
        turn = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(turn == 1)
        self.sizes = np.flatnonzero(turn == -1) - self.starts
        self.offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)])
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.inside = inside

    @property
    def hashes(self) -> np.ndarray:
        """Made in blocks of some bytes, so that one very long text takes no more than a few times its size."""
        out = np.empty(len(self.starts), np.uint64)
        edges = np.unique(np.concatenate([np.searchsorted(self.starts, np.arange(0, len(self.data), CHUNK_BYTES)), [len(self.starts)]])).tolist()
        for i, j in zip(edges, edges[1:], strict=False):
            begin, end = self.starts[i], self.starts[j - 1] + self.sizes[j - 1]
            starts = self.starts[i:j] - begin
            place = np.arange(end - begin) - np.repeat(starts, np.diff(np.append(starts, end - begin)))
            part = (self.data[begin:end] + np.uint64(1)) * _FACTORS[place & 1023]
            if self.sizes[i:j].max() > 1024:
                part *= (2 * (place >> 10) + 1).astype(np.uint64)
            part *= self.inside[begin:end]
            out[i:j] = np.add.reduceat(part, starts)
        return mixed(out + self.sizes.astype(np.uint64))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text of a value for each byte."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

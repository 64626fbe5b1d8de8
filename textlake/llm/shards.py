"""Sharding by longest-processing-time scheduling: groups of equal texts go, by size, to the least-loaded shard on a heap.

The law is ``bytes``: shard sizes are near equal. A group whose size is above a ``fine``-th of a shard's fair share is
scheduled by itself; there are at most ``fine`` * ``n_shards`` of these, whatever the input. All other groups are first
put by hash into ``bundles`` bundles, whose sizes are aggregated, so the heap sees a bounded number of items and no
more than their sizes reaches the driver. (The plain schedule of all groups would need all sizes in one heap; a bundle is
about a 200th of a shard's share, so that the loads differ by less than that, but for groups that are larger than a share.)
Slots are numbered in ``parts`` parts of each shard, after the counts of the parts before; no shard's rows meet in one
task, as rows are spread over the parts by all their columns.

Null text has no bytes and makes one group with other null and empty texts. Repeated rows each get a slot, in any order;
rows that are equal in all columns meet in one part. Of equal sizes that with the smaller key comes first, of equal loads
the lower shard. One very long text is a group like any other. A null doc_id is kept. An empty table gives an empty
result. Other columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.llm._common import cut, others

RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
FINE, BUNDLES, PARTS = 64, 8192, 64


def schedule(sizes: list[tuple[int, tuple]], n_shards: int) -> dict[tuple, int]:
    """Item keys to shards: the largest first, each to the least-loaded shard (the lowest of several)."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def shard(docs: DataFrame, n_shards: int = 40, fine: int = FINE, bundles: int = BUNDLES, parts: int = PARTS) -> DataFrame:
    """The documents with size, text_crc32, law, shard (0 to n_shards - 1), slot (gapless in its shard) and grown_shard."""
    spark = docs.sparkSession
    text = _text()
    keep = others(docs, RESULT)
    own_names = [f"_{i}" for i in range(len(keep))]  # so that no column's name clashes with those in use here
    sized = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, own_names, strict=True)), F.struct(F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant")))).alias("mix")).alias("_own"))
    rows = sized.select("_own.*")
    groups = cut(rows.groupBy("g1", "g2").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    bound = max(1, total // (fine * n_shards))
    bundle = F.pmod(F.col("g1"), F.lit(bundles))
    large = [(x.size_, (x.g1, x.g2)) for x in groups.where(F.col("size") > bound).select("g1", "g2", F.col("size").alias("size_")).collect()]  # at most fine * n_shards rows
    small = [(x.size_, (x.k,)) for x in groups.where(F.col("size") <= bound).groupBy(bundle.alias("k")).agg(F.sum("size").alias("size_")).collect()]  # at most `bundles` rows
    placed = schedule(large + small, n_shards)
    by_group = spark.createDataFrame([(*k, s) for k, s in placed.items() if len(k) == 2], "l1 long, l2 long, large_shard int")
    by_bundle = spark.createDataFrame([(k[0], s) for k, s in placed.items() if len(k) == 1], "k long, bundle_shard int")
    own = sized.join(F.broadcast(by_group), (F.col("_own.g1") == F.col("l1")) & (F.col("_own.g2") == F.col("l2")), "left")
    own = own.join(F.broadcast(by_bundle), F.pmod(F.col("_own.g1"), F.lit(bundles)) == F.col("k"), "left")
    own = own.select(*own_names, "_own", F.coalesce("large_shard", "bundle_shard").alias("_shard"), F.pmod("_own.mix", F.lit(parts)).alias("_part"))
    held = own.groupBy("_shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select(F.col("_shard").alias("s"), F.col("_part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_own.mix", "_own.crc", "_own.g1"))
    own = own.withColumn("_number", number).join(F.broadcast(first), (F.col("_shard") == F.col("s")) & (F.col("_part") == F.col("p")))  # n_shards * parts rows
    return own.select(
        *(F.col(x).alias(c) for c, x in zip(keep, own_names, strict=True)),
        F.col("_own.size").alias("size"),
        F.col("_own.crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_first") + F.col("_number") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact Jaccard.

A document's set holds its distinct ``width``-word shingles (64-bit hashes; words are cut at ASCII white space, A-Z
lower-cased). Documents with 100 * |intersection| >= ``percent`` * |union| are linked; components are the result.

1. Documents with equal sets are one class, found by a digest; all that follows is on one representative each.
2. A sketch is the k smallest shingle hashes. Linked documents share at least ``agreed`` percent of their sketches, half by
   default: at a true similarity of 0.85, fewer than 16 of 32 has a chance of about 5e-7, at 0.8 of about 3e-5. For 0.8
   take 40 percent: fewer than 13 of 32 has a chance of about 2e-7. So a list of documents is made for each value that sketches
   share. Lists of at most ``listed`` documents give their pairs; a longer one gives pairs with one pivot only, the
   document with the most shared values.
3. Pairs whose union sketch has fewer of its values in both are dropped; the rest are verified on the full sets.
4. A document with fewer than ``agreed`` percent of its values in long lists shares a short list with each partner, so nothing is lost.
   For the others (members of groups of thousands of near copies) an exact way follows: a prefix filter on their full
   sets, the rarest shingles first, with size and position bounds. Only pairs from different components so far are made,
   and only between a list's largest component and the rest, so a group that is already connected gives none.

Links are lost only in 2, with the chance given. Documents without words have an empty set and no link; a null doc_id
has component null and is kept; rows that share a doc_id are one document. An empty table gives an empty result. Other
columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.llm._common import LOWER, Words, beside, chunks, components, cut, likely, lists, mixed, others, raw, release, rows

K, LISTED = 32, 32
#: Documents of a long list that meet its pivot, or its other documents, in one part.
PART = 512
#: A value with more than one in so many of all rows is frequent.
FREQUENT = 1000
RESULT = ("n_shingles", "component_id", "kept")


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + max(0, n)]
    return mixed(out + np.uint64(width)).view(np.int64)


def shingle_sets(width: int):
    """An iterator's documents with their sorted shingle sets."""

    def run(batches):
        for batch in chunks(batches):
            words = Words([text.translate(LOWER) for text in raw(batch)])
            hashes = words.hashes
            every = shingles(hashes, width)
            sets = []
            for begin, end in zip(words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
                few = end - begin < width
                sets.append(np.unique(shingles(hashes[begin:end], end - begin) if few and end > begin else every[begin : max(begin, end - width + 1)]))
            yield batch.column("doc_id"), sets

    return run


def _sketch(width: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for ids, sets in shingle_sets(width)(batches):
            low = [x[:k] for x in sets]
            yield rows(schema, doc_id=ids, digest=[xxhash.xxh3_128_digest(x.tobytes()) for x in sets], n=[len(x) for x in sets], sketch=lists(np.concatenate(low), [len(x) for x in low], pa.int64()))

    return run


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set 256 bits: whether it has an odd number of hashes for each value of their lowest byte.

    Sets differ in at least as many hashes as their bitmaps do in bits, whatever else they have in common.
    """
    sizes = [len(x) for x in sets]
    place = np.repeat(np.arange(len(sets)), sizes) * 256 + (np.concatenate(sets) & 255 if sets else np.empty(0, np.int64))
    odd = (np.bincount(place, minlength=256 * len(sets)) & 1).astype(np.uint8).reshape(-1, 256)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


BITS = ("b0", "b1", "b2", "b3")
FULL = "id long, shingles array<long>, b0 long, b1 long, b2 long, b3 long"


def _full(width: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64())), *((b, pa.int64()) for b in BITS)])

    def run(batches):
        for ids, sets in shingle_sets(width)(batches):
            bits = dict(zip(BITS, map(pa.array, np.ascontiguousarray(bitmaps(sets).T)), strict=True))
            yield rows(schema, id=ids, shingles=lists(np.concatenate(sets), [len(x) for x in sets], pa.int64()), **bits)

    return run


def _once(pairs: DataFrame) -> DataFrame:
    """Pairs (hot, cold) whose other direction isn't there too."""
    return pairs.withColumn("_a", F.least("hot", "cold")).withColumn("_b", F.greatest("hot", "cold")).dropDuplicates(["_a", "_b"]).drop("_a", "_b")


def _links(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (hot, cold) those that are linked, by their full sets, as (a, b). A document may be hot in very many pairs."""
    both = beside(pairs, "hot", "cold", full.select("id", F.col("shingles").alias("sa"))).join(full.select(F.col("id").alias("cold"), F.col("shingles").alias("sb")), "cold")
    both = both.select("hot", "cold", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select(F.least("hot", "cold").alias("a"), F.greatest("hot", "cold").alias("b")).distinct()


def _sized(percent: int):
    """Sets of these sizes can be linked."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _counted(held: DataFrame) -> DataFrame:
    """Rows (s, ...) with f, the number of rows that have their s. The few frequent values come by broadcast, so none is in one task."""
    often = cut(held.groupBy("s").agg(F.count("*").alias("f")))
    total = often.agg(F.sum("f")).first()[0] or 0
    frequent = often.where(F.col("f") * FREQUENT > total)  # fewer than FREQUENT rows
    marked = held.join(F.broadcast(frequent), "s", "left")
    rare = marked.where("f is null").drop("f").join(often.where(F.col("f") * FREQUENT <= total), "s")
    return marked.where("f is not null").unionByName(rare)


def _rest(hot: DataFrame, full: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs of the documents ``hot`` (id) in different components that a prefix filter on full sets can't exclude.

    A long list's documents meet in a grid of parts, so that no task has all of them, and only pairs go on whose sizes,
    places and bitmaps let them be linked.
    """
    sets = full.join(hot, "id", "left_semi").dropDuplicates(["id"])
    held = cut(sets.select("id", F.size("shingles").alias("n"), *BITS, F.explode("shingles").alias("s")))
    order = Window.partitionBy("id").orderBy("f", "s")
    placed = _counted(held).withColumn("at", F.row_number().over(order))
    prefix = placed.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1) & (F.col("f") > 1))
    prefix = cut(prefix.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")))
    parts = F.ceil(F.col("f") / PART)  # a list's documents by parts
    most = prefix.groupBy("s", "f", "component").agg(F.count("*").alias("m")).groupBy("s", "f").agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("all"))
    most = most.where("all > most.m").select("s", F.col("most.component").alias("largest"), F.ceil((F.col("all") - F.col("most.m")) / PART).alias("few_parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    release(hot.sparkSession)
    several = prefix.withColumn("part", F.pmod(F.xxhash64("id"), parts)).join(most, ["s", "part"])
    side = lambda df, x: [F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"p{x}"), F.col("component").alias(f"c{x}"), *(F.col(b).alias(f"{b}{x}") for b in BITS)]
    few = several.where("component <> largest").select("s", F.pmod(F.xxhash64(F.lit(1), "id"), "few_parts").alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *side(several, "a"))
    others = several.select("s", F.explode(F.sequence(F.lit(0), F.col("few_parts") - 1)).alias("i"), "part", *side(several, "b"))
    least = F.ceil((F.col("na") + F.col("nb")) * percent / (100.0 + percent) - 1e-9)
    apart = sum((F.bit_count(F.col(f"{b}a").bitwiseXOR(F.col(f"{b}b"))) for b in BITS), F.lit(0))
    can = (F.col("ca") != F.col("cb")) & _sized(percent) & (1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least) & (apart <= F.col("na") + F.col("nb") - 2 * least)
    made = few.join(others, ["s", "i", "part"]).where(can)
    return _once(made.select(F.col("b").alias("hot"), F.col("a").alias("cold")))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, k: int = K, listed: int = LISTED, agreed: int = 50) -> DataFrame:
    """The documents with n_shingles, component_id (smallest doc_id reachable by links) and kept (doc_id = component_id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(texts.mapInArrow(_sketch(width, k), "doc_id long, digest binary, n long, sketch array<long>"))
    classes = signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    own = cut(signed.join(classes.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "sketch").dropDuplicates(["id", "sketch"]))

    release(docs.sparkSession)
    held = own.select("id", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    often = held.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    shared = cut(held.join(often, "v"))
    short, long = shared.where(F.col("f") <= listed), shared.where(F.col("f") > listed)
    one = short.select("v", F.col("id").alias("hot"), F.col("n").alias("na"))
    two = short.select("v", F.col("id").alias("cold"), F.col("n").alias("nb"))
    pairs = one.join(two, (one.v == two.v) & (F.col("hot") < F.col("cold")) & _sized(percent)).select("hot", "cold").distinct()
    score = shared.groupBy("id").agg(F.sum("f").alias("score"), F.first("size").alias("size"), F.sum(F.when(F.col("f") > listed, 1).otherwise(0)).alias("long"))
    score = score.withColumn("share", F.col("score") / F.col("size"))
    pivots = long.join(score.select("id", "share"), "id").groupBy("v").agg(F.max(F.struct("share", F.xxhash64("v", "id").alias("mix"), "id", "n")).alias("p"), F.first("f").alias("f"))
    pivots = pivots.select("v", F.col("p.id").alias("hot"), F.col("p.n").alias("np"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("f") / PART) - 1)).alias("part"))
    spread = long.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("f") / PART)))
    starred = spread.join(pivots, ["v", "part"]).where("id <> hot")
    starred = starred.select("hot", F.col("id").alias("cold"), F.col("n").alias("na"), F.col("np").alias("nb")).where(_sized(percent)).select("hot", "cold").distinct()

    sketches = own.select("id", "sketch")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    near = 100 * F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) >= agreed * F.size("u")
    # A pivot is hot in very many pairs; cold documents are in a few for each value of their sketch.
    pairs = beside(_once(pairs.union(starred)), "hot", "cold", sketches.withColumnRenamed("sketch", "sa"))
    pairs = pairs.join(sketches.select(F.col("id").alias("cold"), F.col("sketch").alias("sb")), "cold")
    pairs = cut(pairs.withColumn("u", union).where(near).select("hot", "cold").distinct())

    release(docs.sparkSession)
    dense = cut(score.where(100 * F.col("long") >= agreed * F.col("size")).select("id"))
    ids = pairs.select(F.col("hot").alias("doc_id")).union(pairs.select("cold")).union(dense).distinct()
    full = cut(likely(texts, cut(ids), _full(width), FULL).distinct())
    release(docs.sparkSession)
    links = cut(_links(pairs, full, percent))
    joined = components(links)
    if not dense.isEmpty():
        more = _links(_rest(dense, full, joined, percent), full, percent)
        joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    release(docs.sparkSession)
    of_class = classes.join(joined, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    found = signed.where("doc_id is not null").select("doc_id", "digest", "n").distinct().join(of_class, "digest", "left")
    found = found.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "doc_id")).alias("component_id"))
    result = found.select(F.col("doc_id").alias("_id"), "n_shingles", "component_id")
    keep = [F.col(f"`{c}`") for c in others(docs, RESULT)]
    both = docs.select(*keep).join(result, F.col("doc_id").cast("long") == F.col("_id"), "left")
    return both.select(*keep, F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

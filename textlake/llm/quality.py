"""Quality rules: robust multivariate outliers by minimum covariance determinant, for each language and source.

Base rules come first: too few words, or too many words in repeated windows. Of the documents that pass them, a vector of
statistics is taken: symbols, words without letters, repeated words, words equal to the one before (for each word), repeated
lines (for each line), capital letters (for each letter) and the logarithm of the mean word length. Each is a ratio with a
pseudo-count, which keeps short texts near the usual value.

For each group, a language and a source, the estimate is that of the ``SHARE`` of its rows whose covariance has the least
determinant. Three starts (medians with median deviations, the spatial signs' covariance, the correlation of squashed
scores) are each improved by concentration steps over all rows until their determinant settles: the moments of the
rows that are nearest by Mahalanobis distance, as aggregates. The start with the least determinant is taken. The same is
done for each language and for all rows, and an estimate is drawn to the next wider one by n / (n + ``PRIOR``), that of all
rows to a wide prior, so that a group's size changes its estimate without a step. A document is rejected if its squared
distance exceeds ``cutoff``. ``FLOORS`` is the least spread of each statistic: deviations below it say nothing (most
statistics are 0 in clean text).

No group is gathered: workers add up sums and histograms, and the aggregation's keys are single numbers of these, so that
a group with a third of all rows is spread. Up to ``MOST_GROUPS`` groups are estimated at once, their few numbers on the
driver and broadcast; more groups are done in blocks of that many, and meet their rows in a salted join.

Null text has no words. Null languages and sources are values of their own. Repeated rows count as often as they occur;
ties in distance are all taken. One very long text needs a few times its size. An empty table gives an empty result.
Other columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.llm._common import Words, chunks, cut, in_chunks, lists, mixed, others, raw, rows
from textlake.operators.lineage import shared_folder

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_letters", "n_capitals", "n_bare_words", "n_echoes")
RESULT = (*COUNTS, "base_failed", "kept", "distance")
#: Least standard deviations of the statistics, in the order of :func:`statistics`.
FLOORS = (0.05, 0.03, 0.05, 0.1, 0.03, 0.05, 0.03)
P = len(FLOORS)
#: Squared distance beyond which a document is an outlier: the chi-squared distribution with seven degrees of freedom leaves about 1e-11.
CUTOFF = 66.0
SHARE, STEPS, SALTS = 0.75, 12, 16
#: Rows of the next wider estimate that stand beside a group's own, and groups that are estimated at once.
PRIOR, MOST_GROUPS = 200, 4096
STARTS, BINS = 3, 1 << 14
#: Makes the covariance of the nearest 75 % of normal rows in seven dimensions that of all.
CONSISTENCY = 1.325

_SYMBOL = np.array([x in b"#*$%&|<>" for x in range(256)])
_CAPITAL = np.array([65 <= x <= 90 for x in range(256)])
_LETTER = np.array([65 <= x <= 90 or 97 <= x <= 122 or x >= 0xC3 for x in range(256)])
_POINT = np.array([x & 0xC0 != 0x80 for x in range(256)])


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, width: int = 8) -> np.ndarray:
    """For each text the number of words in windows of ``width`` words that the text holds twice or more."""
    n = len(hashes) - width + 1
    marks = np.zeros(len(hashes) + 1, np.int64)
    if n > 0:
        windows = np.zeros(n, np.uint64)
        for j in range(width):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        text = np.searchsorted(bounds, np.arange(n), side="right") - 1
        whole = np.flatnonzero(np.arange(n) + width <= bounds[text + 1])
        windows = mixed(windows[whole] + mixed(text[whole].astype(np.uint64)))
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = whole[order[np.append(same, False) | np.insert(same, 0, False)]] if len(order) else whole
        np.add.at(marks, twice, 1)
        np.add.at(marks, twice + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def count(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All counts of each text."""
    words = Words(texts)
    hashes = words.hashes
    echoes = np.concatenate([[0], np.cumsum(np.append(False, hashes[1:] == hashes[:-1])[: len(hashes)])])
    begun = np.minimum(words.bounds[:-1] + 1, words.bounds[1:])  # a text's first word echoes nothing
    letter = _LETTER[words.data]
    bare = ~np.logical_or.reduceat(letter, words.starts) if len(words.starts) else np.empty(0, bool)
    bare = np.concatenate([[0], np.cumsum(bare)])
    lines = [[x for x in text.split(b"\n") if x.strip()] for text in texts]
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": words.per_text(_POINT[words.data] & words.inside),
        "n_symbols": words.per_text(_SYMBOL[words.data]),
        "n_dup_lines": np.array([len(x) - len({*x}) for x in lines], np.int64),
        "n_repeat_words": repeated_words(hashes, words.bounds),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_letters": words.per_text(letter),
        "n_capitals": words.per_text(_CAPITAL[words.data]),
        "n_bare_words": bare[words.bounds[1:]] - bare[words.bounds[:-1]],
        "n_echoes": echoes[words.bounds[1:]] - echoes[begun],
    }


STRUCT = "struct<" + ",".join(f"{c}:long" for c in (*COUNTS, *MORE)) + ">"


def _counts(text: pa.Array) -> pa.Array:
    schema = pa.schema([(c, pa.int64()) for c in (*COUNTS, *MORE)])
    return in_chunks(lambda x: rows(schema, **{k: pa.array(v, pa.int64()) for k, v in count(raw(x)).items()}).to_struct_array(), text)


def counts(text: str) -> Column:
    """All counts of each text of a column, as a struct."""
    return F.arrow_udf(_counts, STRUCT)(text)


def base_failed(c):
    """Of counts as columns or as arrays."""
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def statistics(c, log=F.log) -> list:
    """The vector out of counts as columns, or as arrays."""
    words = c["n_words"] + 20
    return [
        c["n_symbols"] / words,
        c["n_bare_words"] / words,
        c["n_repeat_words"] / words,
        c["n_dup_lines"] / (c["n_lines"] + 5),
        c["n_capitals"] / (c["n_letters"] + 100),
        log((c["word_chars"] + 600) / (c["n_words"] + 100)),
        c["n_echoes"] / words,
    ]


#: A squared distance as a bin, and a statistic as a bin of a 32nd of its floor.
def _distance_bin(d: np.ndarray) -> np.ndarray:
    return np.clip(64 * np.log2(1 + d), 0, BINS - 1).astype(np.int64)


def _value_bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * 32 / np.array(FLOORS)), 0, BINS - 1).astype(np.int64)


def key(lang: Column, source: Column | None = None) -> Column:
    """A group's name; without a source that of a whole language."""
    return F.concat(lang, F.lit("\x00"), source) if source is not None else lang


ALL = "\x00"
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MOMENTS = 1 + P + len(_PAIRS)


def moments(group: np.ndarray, x: np.ndarray, n_groups: int) -> np.ndarray:
    """For each group the number of rows, the sums and the products' sums."""
    columns = [np.ones(len(x)), *x.T, *(x[:, i] * x[:, j] for i, j in _PAIRS)]
    return np.stack([np.bincount(group, c, n_groups) for c in columns], axis=1)


def shapes(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances out of moments (the last axis); zeros without rows."""
    n = np.maximum(sums[..., :1], 1)
    mean = sums[..., 1 : P + 1] / n
    second = np.empty((*sums.shape[:-1], P, P))
    for k, (i, j) in enumerate(_PAIRS):
        second[..., i, j] = second[..., j, i] = sums[..., P + 1 + k] / n[..., 0]
    return mean, second - mean[..., :, None] * mean[..., None, :]


def distances(x: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Squared, of each row from its own centre."""
    d = x - centre
    return np.einsum("ni,nij,nj->n", d, inverse, d)


def _swept(vectors: DataFrame, names: Broadcast, made: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Sums (k, value) of what ``made`` (group numbers, vectors) gives for all rows: an array that is flattened to places k, or the places to count.

    A row counts in its own group, in its language's and in that of all rows, as far as these are among the names.
    """
    schema = pa.schema([("k", pa.int64()), ("value", pa.float64())])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        at, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return [(at, np.bincount(back, np.concatenate([x for _, x in parts]), len(at)))]

    def run(batches):
        held, n = [(np.empty(0, np.int64), np.empty(0))], 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, P)
            groups = []
            for level in ("own", "lang"):
                code = batch.column(level).dictionary_encode()
                groups.append(np.array([names.value.get(v, -1) for v in code.dictionary.to_pylist()], np.int64)[code.indices.to_numpy()])
            groups.append(np.full(len(x), names.value.get(ALL, -1)))
            for group in groups:
                if len(known := np.flatnonzero(group >= 0)):
                    part = made(group[known], x[known]).ravel()
                    at = part if part.dtype == np.int64 else np.flatnonzero(part)
                    held.append((at, np.ones(len(at)) if part.dtype == np.int64 else part[at]))
                    n += len(at)
            if n > 1_000_000:
                held, n = merged(held), 0
        (at, value), *_ = merged(held)
        for begin in range(0, len(at), 50_000):
            yield rows(schema, k=pa.array(at[begin : begin + 50_000]), value=pa.array(value[begin : begin + 50_000]))

    return vectors.mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value"))


def _array(sums: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums as an array on the driver; its size is bounded by the groups of a block."""
    out = np.zeros(int(np.prod(shape)))
    found = sums.toPandas()
    out[found["k"].to_numpy(int)] = found["value"].to_numpy(float)
    return out.reshape(shape)


def _quantile(counts: DataFrame, share: float, shape: tuple[int, ...]) -> np.ndarray:
    """The first bin of each histogram (k: histogram and bin) up to which ``share`` of its rows lie."""
    own = counts.select(F.floor(F.col("k") / BINS).alias("h"), (F.col("k") % BINS).alias("bin"), "value")
    before = Window.partitionBy("h").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = own.select("h", "bin", F.sum("value").over(before).alias("s"), F.sum("value").over(Window.partitionBy("h")).alias("t"))  # at most BINS rows
    return _array(reached.where(F.col("s") >= share * F.col("t") - 1e-6).groupBy(F.col("h").alias("k")).agg(F.min("bin").cast("double").alias("value")), shape).astype(np.int64)


def _places(group: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Each column's bin as its place in the groups' histograms."""
    return (group[:, None] * bins.shape[1] + np.arange(bins.shape[1])) * BINS + bins


class Estimate:
    """The least determinants' centres and covariances of some groups, with their numbers of rows."""

    def __init__(self, vectors: DataFrame, names: list[str], share: float = SHARE, steps: int = STEPS):
        context = vectors.sparkSession.sparkContext
        number = context.broadcast({name: i for i, name in enumerate(names)})
        n = len(names)
        floors = np.array(FLOORS)

        def sweep(made) -> DataFrame:
            return _swept(vectors, number, made)

        middle = _quantile(sweep(lambda g, x: _places(g, _value_bin(x))), 0.5, (n, P)) * floors / 32
        away = _quantile(sweep(lambda g, x: _places(g, _value_bin(np.abs(x - middle[g])))), 0.5, (n, P)) * floors / 32
        scale = np.maximum(1.4826 * away, floors)

        def begun(g: np.ndarray, x: np.ndarray) -> np.ndarray:
            z = (x - middle[g]) / scale[g]
            signs = z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
            return np.stack([moments(g, signs, n), moments(g, np.tanh(z), n)], axis=1)

        sums = _array(sweep(begun), (n, 2, MOMENTS))
        self.rows = sums[:, 0, 0]
        spread = np.stack([np.broadcast_to(np.eye(P), (n, P, P)), P * shapes(sums)[1][:, 0], shapes(sums)[1][:, 1]], axis=1) + 0.05 * np.eye(P)
        outer = scale[:, None, :, None] * scale[:, None, None, :]
        centre, spread = np.repeat(middle[:, None], STARTS, axis=1), spread * outer
        settled = np.full((n, STARTS), np.inf)
        for _ in range(steps):
            inverse = np.linalg.inv(spread)

            def measured(g: np.ndarray, x: np.ndarray, centre=centre, inverse=inverse) -> np.ndarray:
                return np.stack([_distance_bin(distances(x, centre[g, s], inverse[g, s])) for s in range(STARTS)], axis=1)

            radius = _quantile(sweep(lambda g, x, of=measured: _places(g, of(g, x))), share, (n, STARTS))

            def nearest(g: np.ndarray, x: np.ndarray, of=measured, radius=radius) -> np.ndarray:
                near = of(g, x) <= radius[g]
                return np.stack([moments(g[near[:, s]], x[near[:, s]], n) for s in range(STARTS)], axis=1)

            centre, own = shapes(_array(sweep(nearest), (n, STARTS, MOMENTS)))
            spread = CONSISTENCY * own + np.diag(np.square(floors))
            value = np.linalg.slogdet(spread)[1]
            still = np.abs(value - settled) <= 1e-3
            settled = value
            if still.all():
                break
        best = settled.argmin(axis=1)
        self.centre, self.spread, self.determinant = centre[np.arange(n), best], spread[np.arange(n), best], settled
        number.unpersist()


def blocks(found: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The names of all rows, of the languages and of the groups, each with that of the next wider estimate, so many at a time."""
    langs = found.select("lang").distinct().orderBy("lang")
    held = [(ALL, "")]
    for rows_in in (((r.lang, ALL) for r in langs.toLocalIterator()), ((r.own, r.lang) for r in found.toLocalIterator())):
        for one in rows_in:
            held.append(one)
            if len(held) >= MOST_GROUPS:
                yield held
                held = []
    if held:
        yield held


def estimates(vectors: DataFrame, found: DataFrame):
    """Blocks of groups' names with their centres and inverse covariances; vectors: (own, lang, x); found: the groups (own, lang), in order.

    The driver holds the languages' estimates and one block.
    """
    wider = {"": (np.zeros(P), np.diag(np.square(3 * np.array(FLOORS))))}
    for part in blocks(found):
        one = Estimate(vectors, [name for name, _ in part])
        names, centres, spreads = [], [], []
        for (name, wide), n, centre, spread in zip(part, one.rows, one.centre, one.spread, strict=True):
            w = n / (n + PRIOR)
            base = wider[wide]
            drawn = (w * centre + (1 - w) * (base[0] if wide else centre), w * spread + (1 - w) * base[1])
            if "\x00" in name and name != ALL:
                names.append(name)
                centres.append(drawn[0])
                spreads.append(drawn[1])
            else:  # a language's, or that of all rows
                wider[name] = drawn
        if names:
            yield names, np.stack(centres), np.linalg.inv(np.stack(spreads))


def _measured_by_join(rows_in: DataFrame, table: DataFrame) -> DataFrame:
    """Distances of rows (own, x) from their groups' centres, which are there for each salt."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"own": "_own", "salt": "_salt"})
    both = rows_in.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, (F.col("own") == F.col("_own")) & (F.col("salt") == F.col("_salt")), "left")
    d = [F.col("x")[i] - F.col("centre")[i] for i in range(P)]
    value = sum((d[i] * d[j] * F.col("inverse")[P * i + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))
    return both.withColumn("distance", value).drop("_own", "_salt", "salt", "centre", "inverse")


def _vectors(batches):
    """The vectors (own, lang, x) of texts that pass the base rules."""
    schema = pa.schema([("own", pa.string()), ("lang", pa.string()), ("x", pa.list_(pa.float64()))])
    for chunk in chunks(batches):
        made = count(raw(chunk))
        passed = np.flatnonzero(~base_failed(made))
        x = np.stack(statistics(made, np.log), axis=1)[passed]
        yield rows(schema, own=chunk.column("own").take(pa.array(passed)), lang=chunk.column("lang").take(pa.array(passed)), x=lists(x.ravel(), [P] * len(passed), pa.float64()))


def _apart(known: dict, own: pa.Array, x: np.ndarray) -> pa.Array:
    """Squared distances of vectors from their groups' centres; null for groups without an estimate."""
    code = own.dictionary_encode()
    found = [known.get(v) for v in code.dictionary.to_pylist()]
    at = code.indices.to_numpy()
    there = np.array([v is not None for v in found], bool)[at]
    out = np.full(len(at), np.nan)
    if there.any():
        centre, inverse = (np.stack([np.zeros((P,) * (k + 1)) if v is None else v[k] for v in found]) for k in (0, 1))
        out[there] = distances(x[there], centre[at[there]], inverse[at[there]])
    return pa.array(out, mask=~there)


def _judged(known: dict, chunk: pa.RecordBatch) -> pa.Array:
    """All counts of a chunk's texts and their distances."""
    made = count(raw(chunk))
    x = np.stack(statistics(made, np.log), axis=1) if chunk.num_rows else np.empty((0, P))
    columns = [pa.array(made[c], pa.int64()) for c in (*COUNTS, *MORE)]
    return pa.StructArray.from_arrays([*columns, _apart(known, chunk.column(1), x)], [*COUNTS, *MORE, "distance"])


def judge(docs: DataFrame, cutoff: float = CUTOFF, counted: str | None = None) -> DataFrame:
    """The documents with their counts, base_failed, kept and distance (null where the base rules failed in all rows of a group).

    counted: a column that has the texts' :func:`counts` already. Without it the texts are counted twice, once for the
    estimates and once for the verdict, rather than carried through a shuffle.
    """
    spark = docs.sparkSession
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x01"))
    levels = [key(named("lang"), named("source")).alias("own"), key(named("lang")).alias("lang")]
    if counted:
        passed = docs.select(*levels, F.col(counted).alias("c")).where(~base_failed(F.col("c")))
        vectors = cut(passed.select("own", "lang", F.array(*statistics(F.col("c"))).alias("x")))
    else:
        vectors = cut(docs.select(*levels, "text").mapInArrow(_vectors, "own string, lang string, x array<double>"))
    vectors = vectors.coalesce(max(1, min(vectors.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)))
    found = cut(vectors.select("own", "lang").distinct().orderBy("own"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), levels[0])
    n_groups = found.count()
    if n_groups <= MOST_GROUPS:
        known = {}
        for own, centre, inverse in estimates(vectors, found) if n_groups else ():
            known |= {name: (c, i) for name, c, i in zip(own, centre, inverse, strict=True)}
        shared = spark.sparkContext.broadcast(known)
        if counted:
            x = F.array(*statistics(F.col(f"whole.`{counted}`")))
            both = whole.select("whole", F.col(f"whole.`{counted}`").alias("c"), F.arrow_udf(lambda own, x: _apart(shared.value, own, x.flatten().to_numpy().reshape(-1, P)), "double")("own", x).alias("distance"))
        else:  # texts are counted and judged at once, so that a task needs one worker
            both = whole.select("whole", F.arrow_udf(lambda text, own: in_chunks(lambda chunk: _judged(shared.value, chunk), text, own), f"{STRUCT[:-1]},distance:double>")("whole.text", "own").alias("c"))
            both = both.select("whole", "c", "c.distance")
    else:
        folder = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
        for own, centre, inverse in estimates(vectors, found):
            part = spark.createDataFrame([(a, b.tolist(), c.ravel().tolist()) for a, b, c in zip(own, centre, inverse, strict=True)], "own string, centre array<double>, inverse array<double>")
            part.write.mode("append").parquet(folder)
        both = whole.withColumn("c", F.col(f"whole.`{counted}`") if counted else counts("whole.text"))
        both = _measured_by_join(both.withColumn("x", F.array(*statistics(F.col("c")))), spark.read.parquet(folder))
    keep = [F.col(f"whole.`{c}`") for c in others(docs, RESULT)]
    failed = base_failed(F.col("c"))
    return both.select(*keep, *(F.col(f"c.{c}").alias(c) for c in COUNTS), failed.alias("base_failed"), (~failed & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")

"""Line dedup, near-dedup, passages, sharding: against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from textlake.llm import lines, near, passages, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_lines(plain, plain_docs):
    keys = lambda t: [low(x.strip(" \t\n\r\x0b\x0c")) for x in (t or "").split("\n")]
    held = defaultdict(set)
    for i, t in plain:
        for k in keys(t):
            if len(k) >= 20:
                held[k].add(i)
    want = {}
    for i, t in plain:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t), strict=True) if len(held[k]) < 3 or i == max(held[k])]
        n = len((t or "").split("\n"))
        want[i] = (n, n - len(kept), "\n".join(kept))
    for most in (lines.MOST_KEYS, 0):  # with the keys broadcast, and joined
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.drop_repeated_lines(plain_docs, most_keys=most).collect()}
        assert got == want
    assert sum(x[1] for x in want.values()) > 6


def test_lines_with_odd_rows(docs, empty):
    made = lines.drop_repeated_lines(docs)
    assert made.count() == docs.count() and {"kept", "a.b", "Shard", "k"} <= set(made.columns)
    assert lines.drop_repeated_lines(empty).count() == 0


def test_rows_with_one_id_are_one_document(spark):
    line = "this is a line of more than twenty points"
    rows = [(1, line), (1, line), (1, f"{line}\nx"), (2, line), (None, line), (None, line)]
    for most in (lines.MOST_KEYS, 0):
        made = lines.drop_repeated_lines(spark.createDataFrame(rows[:4], "doc_id long, text string").repartition(2), most_keys=most).collect()
        assert sum(r.n_dropped for r in made) == 0
        made = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), most_keys=most).collect()
        assert {(r.doc_id, r.n_dropped) for r in made} == {(1, 1), (2, 0), (None, 1)}


def test_filters_lose_no_repeat():
    """An owner's rows: each hash that is there twice is a suspect, whatever batches it is in."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(1)
    h = draw.integers(-(2**62), 2**62, 30_000)
    h[20_000:25_000] = h[:5000]
    kind = np.zeros(len(h), np.int32)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 7000]) for x in (h, h ^ 5, np.arange(len(h)), kind)], ["h1", "h2", "doc_id", "kind"]) for i in range(0, len(h), 7000)]
    found = pa.Table.from_batches(lines._suspects(iter(batches))).column("doc_id").to_pylist()
    assert {*range(5000), *range(20_000, 25_000)} <= {*found} and len(found) < 10_500


def shingle_set(text):
    words = WORD.findall(low(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def union_find(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def expected_components(items):
    sets = {i: shingle_set(t) for i, t in items}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, union_find(links, ids)


def check_near(spark, items, **options):
    sets, top = expected_components(items)
    df = spark.createDataFrame(items, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df, **options).collect()}
    assert got == {i: (len(sets[i]), top[i], top[i] == i) for i in sets}
    return top


def test_near(spark, plain):
    check_near(spark, plain)


@pytest.mark.parametrize("listed", [2, 32])
def test_near_copies_in_one_large_group(spark, listed):
    """Lists longer than ``listed`` take the exact way for the rest; chains and rings of edits lose no link."""
    import random

    draw = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    items = []
    for i in range(60):
        words = list(base)
        for place in draw.sample(range(120), draw.choice([0, 1, 1, 2, 3, 4])):
            words[place] = draw.choice(["u", "v", f"n{i}"])
        items.append((i * 7 % 61, " ".join(words)))
    chain = [f"c{i}" for i in range(130)]
    items += [(100 + k, " ".join(chain[2 * k : 2 * k + 100])) for k in range(12)]
    top = check_near(spark, items, listed=listed)
    assert len({top[i] for i, _ in items if i >= 100}) == 1 and 1 < len({*top.values()}) < 60


def test_near_with_odd_rows(docs, empty):
    made = near.near_duplicates(docs).collect()
    assert len(made) == docs.count()
    assert all(r.component_id is None and r.kept for r in made if r.doc_id is None)
    assert near.near_duplicates(empty).count() == 0


def test_passages(plain, plain_docs):
    found = passages.repeated_passages(plain_docs).collect()
    words = {i: WORD.findall(low(t)) for i, t in plain}
    by_window = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            by_window[tuple(w[k : k + 50])].add(i)
    pairs = {(min(x), i) for x in by_window.values() if len(x) > 1 for i in x}
    ids = {i for p in pairs for i in p}
    linked = union_find([(r.doc_id, r.other_doc_id) for r in found], list(words))
    assert ids and all(linked[a] == linked[b] for a, b in pairs)
    for r in found:
        one, two = (shingle_set(" ".join(x)) for x in (words[r.doc_id][r.start_word : r.end_word], words[r.other_doc_id][r.other_start_word : r.other_end_word]))
        assert r.end_word - r.start_word >= 50 and abs(len(one & two) / len(one | two) - r.similarity) < 1e-9 and r.similarity >= 0.8
    assert {r.doc_id for r in found} | {r.other_doc_id for r in found} <= ids | {2}


def test_stretches_of_many_places():
    """A passage that one document holds once and the other often: every match under enough hash functions is kept."""
    import numpy as np

    n = 1500
    matches = np.array([(kind, kind, 60, 100 * k + kind, 100 * k + 60) for kind in range(4) for k in range(n)])
    for turned in (matches, matches[:, [0, 3, 4, 1, 2]]):
        found = passages.stretches(np.zeros(len(turned), int), turned, 46)[1]
        places = found[:, 2:] if turned is matches else found[:, :2]
        assert {x // 100 for x in places[:, 0].tolist()} == set(range(n))
    alone = np.array([(0, 0, 60, 100 * k, 100 * k + 60) for k in range(n)])
    assert len(passages.stretches(np.zeros(n, int), alone, 46)[0]) == 0


@pytest.mark.parametrize("seed", range(6))
def test_agreed_matches_by_brute_force(seed):
    """Thousands of random matches in several groups: the sweep keeps those that brute force keeps."""
    import numpy as np

    draw = np.random.default_rng(seed)
    n, most = 3000, 20
    group, kind = np.sort(draw.integers(0, 4, n)), draw.integers(0, 4, n)
    a0, b0 = draw.integers(0, [400, 1200, 2500][seed % 3], (2, n))
    a1, b1 = a0 + draw.integers(most - 1, 60, n), b0 + draw.integers(most - 1, 200, n)
    order = np.lexsort((a0, group))
    group, kind, a0, a1, b0, b1 = (x[order] for x in (group, kind, a0, a1, b0, b1))
    wide = lambda x0, x1: np.minimum(x1[:, None], x1) - np.maximum(x0[:, None], x0) + 1 >= most
    both = wide(a0, a1) & wide(b0, b1) & (group[:, None] == group)
    for enough in (2, 3):
        want = sum((both & (kind == k)).any(axis=1).astype(int) for k in range(4)) >= enough
        assert (passages.agreed(group, kind, a0, a1, b0, b1, most, enough) == want).all()
    assert want.any()


def test_stretches_within_equal_ones():
    """Matches within an equal stretch change nothing; an equal stretch needs no other hash function."""
    import numpy as np

    equal = np.array([(passages.EXACT, k, k + 45, k + 7, k + 52) for k in range(30)])
    more = np.array([(kind, 3, 60, 9, 70) for kind in range(4)])
    for rows in (equal, np.concatenate([more, equal])):
        group, found = passages.stretches(np.zeros(len(rows), int), rows, 46)
        assert group.tolist() == [0] and found.tolist() == [[0, 74, 7, 81]]


def test_near_passages_are_found(spark):
    """Passages of 200 words with some words changed, so that no 50 are equal: nine of ten pairs are found where 0.8 or more of the shingles are."""
    import random

    draw = random.Random(3)
    words = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    items, alike = [], {}
    for k in range(0, 400, 2):
        passage = words(200)
        edited = list(passage)
        for place in range(24 + draw.randrange(4), 200, 48):
            edited[place] = f"new{k}x{place}"
        one, two = ({tuple(x[i : i + 5]) for i in range(196)} for x in (passage, edited))
        alike[k] = len(one & two) / len(one | two)
        for i, own in ((k, passage), (k + 1, edited)):
            items.append((i, " ".join(words(draw.randrange(60)) + own + words(draw.randrange(60)))))
    assert min(alike.values()) >= 0.8
    found = passages.repeated_passages(spark.createDataFrame(items, "doc_id long, text string").repartition(4)).collect()
    pairs = {(min(r.doc_id, r.other_doc_id), max(r.doc_id, r.other_doc_id)) for r in found}
    assert pairs <= {(k, k + 1) for k in alike} and len(pairs) >= 0.9 * len(alike)


def test_near_passages_between_decoys(spark):
    """Near passages are found though the documents first and before in each list have the shingles, but not the passage."""
    import random

    draw = random.Random(5)
    words = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    items, pairs = [], set()
    for k in range(0, 400, 8):
        passage = words(200)
        edited = list(passage)
        for place in range(24, 200, 48):
            edited[place] = f"new{k}x{place}"
        for i in range(k, k + 8):
            pieces = [x for begin in range(i % 4, 200, 20) for x in passage[begin : begin + 20] + words(20)]
            items.append((i, " ".join({k + 3: passage, k + 6: edited}.get(i, pieces))))
        pairs.add((k + 6, k + 3))
    found = passages.repeated_passages(spark.createDataFrame(items, "doc_id long, text string").coalesce(1)).collect()
    assert len(pairs & {(r.doc_id, r.other_doc_id) for r in found}) >= 0.95 * len(pairs)


def test_classes_of_a_key_meet():
    """All rows of a key that are of different documents and classes meet, once each; compound windows as by brute force."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(2)
    key, node, doc = draw.integers(0, 5, 300), draw.integers(0, 4, 300), draw.integers(0, 40, 300)
    batch = pa.table({"key": key, "node": node, "a": doc, "a_span": np.arange(300)}).to_batches()
    got = [tuple(sorted(x)) for b in passages._met(batch) for x in zip(b["a_span"].to_pylist(), b["b_span"].to_pylist(), strict=True)]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if key[i] == key[j] and node[i] != node[j] and doc[i] != doc[j]}
    assert set(got) == want and len(got) == len(want)
    bounds = np.array([0, 120, 300])
    for hashes in (draw.integers(1, 2**63, (2, 300), np.uint64), draw.integers(1, 9, (2, 300)).astype(np.uint64)):
        one, two = (passages.compact_windows(h, bounds, 10) for h in hashes)
        own = [list(zip(*x, strict=True)) for x in (one, two)]
        want = {(i, j) for i, (a, b, c) in enumerate(own[0]) for j, (x, y, z) in enumerate(own[1]) if max(a, x) <= min(b, y) and max(b, y) <= min(c, z) and min(c, z) - max(a, x) >= 9}
        made = list(zip(*(x.tolist() for x in passages.compounds(one, two, 10)), strict=True))
        assert set(made) == want and len(made) == len(want)


def test_rounds_leave_no_shuffle_files(spark):
    """Components of a long chain: the shuffle files of finished rounds are gone when it ends."""
    import gc
    import time

    from textlake.llm._common import components

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        every = disk.getAllFiles()
        names = [every.apply(i).getName() for i in range(every.size())]
        return {x.split("_")[1] for x in names if x.startswith("shuffle_")}

    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)
    before = held()
    made = components(chain)
    time.sleep(2)
    assert len(held() - before) <= 12
    assert made.count() == 301


def test_pairs_beside_a_hub(spark):
    """However many pairs a key has, each meets its row once."""
    from textlake.llm._common import beside

    pairs = spark.createDataFrame([(0, i, i * 2) for i in range(500)] + [(i, i + 1, 5) for i in range(1, 40)], "a long, b long, x long")
    table = spark.createDataFrame([(i, [i, i]) for i in range(30)], "id long, held array<long>")
    made = beside(pairs, "a", "b", table)
    got = sorted((r.a, r.b, r.x, tuple(r.held)) for r in made.collect())
    assert got == sorted((a, b, x, (a, a)) for a, b, x in [(0, i, i * 2) for i in range(500)] + [(i, i + 1, 5) for i in range(1, 30)])


def test_compact_windows():
    """Each window's centre is its minimum, and each long subsequence lies in just one window with its minimum as centre."""
    import numpy as np

    bounds = np.array([0, 60, 65, 65, 110])
    for seed in range(20):
        h = np.random.default_rng(seed).integers(1, 2**63, 110, np.uint64)
        spans = list(zip(*passages.compact_windows(h, bounds, 8), strict=True))
        for first, last in ((0, 60), (65, 110)):
            for begin in range(first, last):
                for end in range(begin + 7, last):
                    assert sum(x <= begin <= c <= end <= y and h[c] == h[begin : end + 1].min() for x, c, y in spans) == 1
        assert all(first <= x and y < last for x, c, y in spans for first, last in zip(bounds, bounds[1:], strict=False) if first <= c < last)


def test_dense():
    import numpy as np

    hit = np.array([1] * 10 + [0] * 30 + [1] * 20 + [0] + [1] * 20 + [0] * 5, bool)
    assert passages.dense(hit, 15) == [(40, 81)] and passages.dense(hit, 15, 1.0) == [(40, 60), (61, 81)]
    assert passages.dense(np.ones(50, bool), 50) == [(0, 50)] and passages.dense(np.zeros(50, bool), 5) == []


def test_passages_with_odd_rows(docs, empty):
    assert passages.repeated_passages(docs).count() > 0
    assert passages.repeated_passages(empty).count() == 0


def frequent_line(n_words, own, n_pairs=40, n_docs=400):
    """Pairs that share a frequent line with own words behind it, among documents that hold the line only."""
    import random

    draw = random.Random(n_words)
    words = lambda n: " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))
    line, items, pairs = words(n_words), [], []
    items = [(i, f"{words(40)} {line} {words(40)}") for i in range(n_docs)]
    for k in range(n_pairs):
        tail = words(own)
        pairs.append((n_docs + 2 * k, n_docs + 2 * k + 1))
        items += [(i, f"{words(40)} {line} {tail} {words(40)}") for i in pairs[-1]]
    items += [(n_docs + 2 * n_pairs + k, f"{line} " * 5) for k in range(2)]
    return items, pairs


@pytest.mark.parametrize("n_words, own", [(30, 20), (40, 12)])
@pytest.mark.parametrize("parts", [1, 8])
def test_passages_with_a_frequent_line(spark, n_words, own, parts):
    items, pairs = frequent_line(n_words, own)
    found = passages.repeated_passages(spark.createDataFrame(items, "doc_id long, text string").repartition(parts)).collect()
    linked = union_find([(r.doc_id, r.other_doc_id) for r in found if r.similarity == 1.0], [i for i, _ in items])
    assert sum(linked[a] == linked[b] for a, b in pairs) == len(pairs)


@pytest.mark.parametrize("repeats", [0, 1])
def test_passages_at_several_places(spark, repeats):
    """Each place of a passage has a row, whatever chunks the documents are in."""
    import random

    draw = random.Random(8)
    words = lambda n: " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))
    passage = words(60)
    often = " ".join(f"{words(740)} {passage}" for _ in range(5))
    once = f"{words(70)} {passage} {words(70)}"
    items = [(i, often if i == repeats else once) for i in range(2)]
    for parts in ([items], [items[:1], items[1:]]):
        df = spark.createDataFrame(spark.sparkContext.parallelize([x for p in parts for x in p], len(parts)), "doc_id long, text string")
        found = passages.repeated_passages(df).collect()
        places = {(r.start_word, r.end_word) if r.doc_id == repeats else (r.other_start_word, r.other_end_word) for r in found}
        assert {(800 * k + 740, 800 * k + 800) for k in range(5)} <= places


def test_shards(docs, empty):
    made = shards.shard(docs, n_shards=5).collect()
    assert len(made) == docs.count()
    by_text, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in made:
        text = (r.text or "").encode()
        assert r["size"] == len(text) + 16 and r.text_crc32 == zlib.crc32(text) and r.law == "bytes" and r.grown_shard is None
        by_text[text].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(x) == 1 for x in by_text.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shards.shard(empty).count() == 0


def plain_lpt(sizes, n_shards):
    """The schedule by definition: each group to the shard with the least load."""
    load = [0] * n_shards
    for size in sorted(sizes, reverse=True):
        load[load.index(min(load))] += size
    return load


@pytest.mark.parametrize("seed", range(3))
def test_loads_are_as_even_as_the_plain_schedule(spark, seed):
    """Groups of very uneven sizes, some of many copies: loads are within a 50th of a share of those of plain scheduling."""
    import random

    draw = random.Random(seed)
    items = []
    for k in range(3000):
        text = f"t{k} " + "x" * int(draw.paretovariate(0.9) * 20 % 20_000)
        items += [text] * (draw.choice([1, 1, 1, 2, 5, 40]) if k % 50 else 300)
    df = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string").repartition(4)
    made = shards.shard(df, n_shards=8).collect()
    load, groups = [0] * 8, defaultdict(int)
    for r in made:
        load[r.shard] += r["size"]
        groups[r.text] += r["size"]
    want = plain_lpt(groups.values(), 8)
    share = sum(load) / 8
    assert max(load) - max(want) <= share / 50 and min(want) - min(load) <= share / 50
    assert max(load) <= 4 / 3 * max(share, max(groups.values())) + share / 50


def test_schedule_by_brute_force():
    import random

    draw = random.Random(3)
    for _ in range(50):
        sizes = [(draw.randint(1, 40), (i,)) for i in range(draw.randint(1, 60))]
        n = draw.randint(1, 7)
        placed = shards.schedule(sizes, n)
        load = [0] * n
        for size, key in sizes:
            load[placed[key]] += size
        assert sorted(load) == sorted(plain_lpt([s for s, _ in sizes], n))


def test_digest_of_kept_lines():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_words_in_a_row_are_one_window():
    """A word that is repeated in a row has a window for each key, not for each place; places far apart keep theirs."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    every = SimpleNamespace(value=np.full(1 << 10, -1, np.int64))
    apart = " ".join(f"v{i}" for i in range(300))
    line = " ".join(f"l{i}" for i in range(50))
    texts = [" ".join(["thor"] * 400 + ["handti"] * 400), f"{line} {apart} {line}"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": texts})
    made = [x for b in passages._gather(50, 5, every)([batch]) for x in b.to_pylist() if x["b"] is None]
    runs = [x["key"] for x in made if x["a"] == 1]
    assert runs and len(runs) == len(set(runs)) and len(runs) < 100
    keys = [x["key"] for x in made if x["a"] == 2]
    assert len(keys) > len(set(keys))


def test_copies_pair_with_the_first(spark):
    """Copies in any chunk have one row each, with the smallest id; a document of two rows keeps what its other row has."""
    import random

    draw = random.Random(4)
    words = lambda n: " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))
    text, other = words(80), words(70)
    items = [(i, text if i % 2 else text.upper().replace(" ", "\n")) for i in range(60)]
    found = passages.repeated_passages(spark.createDataFrame(items, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in found) == [(i, 0, 80, 0, 0, 80, 1.0) for i in range(1, 60)]
    items = [(0, text), (1, text), (7, text), (7, other), (9, other), (10, words(49)), (11, None), (None, text)]
    found = passages.repeated_passages(spark.createDataFrame(items, "doc_id long, text string").repartition(4)).collect()
    assert {(1, 0), (9, 7)} <= {(r.doc_id, r.other_doc_id) for r in found} and {7} & {r.doc_id for r in found}


def test_pairs_that_cannot_be_dense_are_not_verified():
    """The test of all pairs at once lets through whatever has a passage."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(9)
    one, two = [], []
    for k in range(300):
        a = draw.integers(-(2**31), 2**31, draw.integers(0, 120)).astype(np.int32)
        b = a.copy()
        b[draw.random(len(b)) < k / 600] = 5
        one.append(a)
        two.append(np.concatenate([draw.integers(-(2**31), 2**31, draw.integers(0, 50)).astype(np.int32), b]))
    a, b = (pa.array([x.tolist() for x in z], pa.list_(pa.int32())) for z in (one, two))
    able = passages._alike(a, b, 46)
    want = [passages.verify(x, y, 46) for x, y in zip(one, two, strict=True)]
    assert all(able[k] for k, x in enumerate(want) if x) and 0 < able.sum() < 300
    assert [[tuple(y.values()) for y in x] for x in passages._verified(a, b).to_pylist()] == want


def test_copies_without_a_broadcast(spark, monkeypatch):
    """Where copies are too many to broadcast their ids, a join drops them, with the same result."""
    monkeypatch.setattr(passages, "MOST_IDS", 0)
    text = " ".join(f"w{i}" for i in range(80))
    items = [(i, text) for i in range(8)] + [(8, " ".join(f"w{i}" for i in range(20, 75)))]
    found = passages.repeated_passages(spark.createDataFrame(items, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in found) == [(i, 0, 80, 0, 0, 80, 1.0) for i in range(1, 8)] + [(8, 0, 55, 0, 20, 75, 1.0)]

"""Dedup, sampling, chunks, comparison, sources, sinks, streaming: properties and plain Python."""

import json
import textwrap
import zipfile

import pytest
from pyspark.sql import functions as F

from textlake import api
from textlake.functions import rewrite
from textlake.functions import text as X
from textlake.operators import chunking, classifier, compare, dedup, language_model, reports, sampling, tokens
from textlake.sources import collect, readers, synthetic
from textlake.streaming import ingest


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, "human" if i % 3 else "ai", f"text {i % 40} of many words here") for i in range(100)], "id long, label string, text string").cache()


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_first_wins(rows):
    kept = dedup.first_wins(rows, X.hash_exact("text"), "id")
    assert ids(kept) == list(range(40)) and ids(dedup.first_wins(kept, X.hash_exact("text"), "id")) == list(range(40))
    by_label = dedup.first_wins(rows, X.hash_exact("text"), "id", ("label",))
    assert len(ids(by_label)) == rows.select("text", "label").distinct().count()


def test_overlap_leaves_both_sides(rows):
    kept = dedup.without_overlap(rows, "label")
    assert dedup.overlap(kept.where("label = 'human'"), kept.where("label = 'ai'")).count() == 0
    assert dedup.new_only(rows.where("id < 50"), rows.where("id < 10")).count() == 30


def test_resume_and_interleave(rows):
    done = rows.where("id < 10").select(X.hash_exact("text").alias("key"))
    assert ids(dedup.resume(rows, done, X.hash_exact("text"), "id")) == list(range(10, 40))
    places = sorted((r.position, r.label) for r in dedup.interleave(rows, "label", "human", "id").collect())
    assert [x for _, x in places[:6]] == ["human", "ai"] * 3


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 100])
def test_splits(rows, n):
    part = rows.where(F.col("id") < n)
    for made in (sampling.stratified_split(part, "label", "id"), sampling.plain_split(part, "id")):
        got = made.collect()
        assert sorted(r.id for r in got) == list(range(n)) and {r.split for r in got} <= {"train", "val", "test"}
    if n == 100:
        counts = {(r.label, r.split): r["count"] for r in sampling.stratified_split(part, "label", "id").groupBy("label", "split").count().collect()}
        assert counts["ai", "test"] == 4 and counts["human", "test"] == 7 and counts["ai", "train"] + counts["ai", "val"] == 30


def test_ratios_must_sum_to_one(rows):
    with pytest.raises(ValueError):
        sampling.plain_split(rows, "id", 0.8, 0.1, 0.2)


def test_balance(rows):
    size = lambda df: {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    assert size(sampling.undersample(rows, "label", "id")) == {"ai": 34, "human": 34}
    assert size(sampling.oversample(rows, "label", "id")) == {"ai": 66, "human": 66}
    assert size(sampling.to_size(rows, "label", "id", 50)) == {"ai": 50, "human": 50}
    assert size(sampling.balanced(rows, "label", "id", 20)) == {"ai": 20, "human": 20}
    assert ids(sampling.undersample(rows, "label", "id", 1)) != ids(sampling.undersample(rows, "label", "id", 2))
    ranks = [r["rank"] for r in sampling.ranked(rows, "id", 1, ("label",)).where("label = 'ai'").collect()]
    assert sorted(ranks) == list(range(1, 35))


def test_chunks(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 149, 150, 151, 300)] + ["a-b " * 90 + "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = df.orderBy("id").select(chunking.word_chunks("text", 150).alias("c"), chunking.wrapped("text").alias("l")).collect()
    for text, r in zip(texts, got, strict=True):
        assert " ".join(r.c).split() == text.split() and all(len(x.split()) == 150 for x in r.c[:-1])
        assert r.l == textwrap.wrap(text, 200)
    windows = df.where("id = 5").select(chunking.token_windows(X.n_words("text"), 128, 64).alias("w")).first().w
    assert sum(w.fresh for w in windows) == 300 and windows[0].begin == 0 and windows[-1].end == 300


def test_joined_rows(rows):
    made = chunking.joined_rows(rows, "text", "id", 10, ("label",)).collect()
    assert len(made) == 3 + 6 and all(r.n_rows == 10 for r in made)


def pair_of(spark, before, after):
    fields = "id long, perplexity double, burstiness double, reading_ease double, grammar_errors int, cv double, human_score double, likely_source string"
    one, two = (spark.createDataFrame([x], fields) for x in (before, after))
    return compare.compare(compare.pair(one, two, "id")).first()


def test_compare(spark):
    r = pair_of(spark, (1, 10.0, -0.5, 50.0, 4, 0.0, 40.0, "AI-generated"), (1, 20.0, -0.25, 40.0, 2, 5.0, 45.0, "Mixed/Unclear"))
    assert r.improvements == {"perplexity": 100.0, "burstiness": 50.0, "grammar_errors": 50.0, "human_score": 12.5} and r.degradations == {"reading_ease": 20.0}
    assert r.success is False and r.overall_improvement == 5.0 and "limited impact" in r.summary and "Classification changed: AI-generated → Mixed/Unclear" in r.summary
    assert "Main improvements: perplexity (+100.0%), burstiness (+50.0%), grammar_errors (+50.0%)" in r.summary
    r = pair_of(spark, (1, float("inf"), 0.0, 1.0, 0, 1.0, 40.0, "x"), (1, float("inf"), 1.0, 1.0, 3, 1.0, 45.01, "x"))
    assert r.improvements == {"human_score": pytest.approx(12.53, abs=0.01)} and r.degradations == {} and r.success is True


def test_a_small_loss_has_no_negative_zero(spark):
    """as the SQL, which rounds before it prints."""
    r = pair_of(spark, (1, 1.0, 0.0, 1.0, 0, 1.0, 40.02, "x"), (1, 1.0, 0.0, 1.0, 0, 1.0, 40.0, "x"))
    assert "Overall change: 0.0 points." in r.summary and "human_score (-0.1%)" in r.summary
    r = pair_of(spark, (1, 1.0, 0.0, 1.0, 0, 1.0, 40.05, "x"), (1, 1.0, 0.0, 1.0, 0, 1.0, 40.0, "x"))
    assert "Overall change: -0.0 points." not in r.summary


def test_confusion_without_rows(spark):
    r = reports.confusion(spark.createDataFrame([], "a int, p int"), "a", "p").first()
    assert (r.tp, r.accuracy, r.f1) == (0, 0.0, 0.0)


def test_histogram_has_all_bins(spark):
    df = spark.createDataFrame([(100,), (101,), (5001,)], "v int")
    made = {r.bin: r.n for r in reports.histogram(df, F.col("v"), ((100, "a"), (500, "b"), (1000, "c"), (None, "d"))).collect()}
    assert made == {"a": 1, "b": 1, "c": 0, "d": 1}
    assert {r.bin: r.n for r in reports.half_open(df, F.col("v"), (0, 100, 101)).collect()} == {"0-100": 0, "100-101": 1, "101+": 2}


def test_rewrites(spark):
    df = spark.createDataFrame([(i, "I can't, won't. This one has more words than five. It's short") for i in range(40)], "id long, text string")
    robots = [r[0] for r in df.select(rewrite.robotize("text", "id")).collect()]
    assert {x.removeprefix("In summary, ") for x in robots} == {"I cannot. will not. This one has more words than five. It's short"}
    made = [r[0] for r in df.select(rewrite.humanize("text", "id")).collect()]
    assert all(x.endswith(".") for x in made) and len(set(made)) > 1 and made == [r[0] for r in df.select(rewrite.humanize("text", "id")).collect()]
    changed = rewrite.augment(df, "text", "id").collect()
    assert any(r.augmented != r.text for r in changed) and all(len(r.augmented.split()) >= 5 for r in changed)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "b a a c"), (2, ""), (3, "a z")], "id long, text string")
    vocab = tokens.vocabulary(df, "text", 2)
    assert [(r.word, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("a", 2), ("b", 3)]
    made = {r.id: r for r in tokens.encode(df, "id", "text", vocab, 3).collect()}
    assert made[1].input_ids == [3, 2, 2] and made[1].truncated and made[2].input_ids == [] and made[3].input_ids == [2, 1]
    padded = spark.createDataFrame([([3, 2],)], "t array<int>").select(tokens.padded("t", 4).alias("p"), tokens.mask("t", 4).alias("m")).first()
    assert padded.p == [3, 2, 0, 0] and padded.m == [1, 1, 0, 0]


def test_language_model(spark):
    import math

    df = spark.createDataFrame([(1, "a a b"), (2, "")], "id long, text string")
    made = {r.id: r.perplexity for r in language_model.perplexity(df, "id", "text", language_model.train(df, "id", "text")).collect()}
    assert made[2] == float("inf") and made[1] == round(math.exp(-(2 * math.log(3 / 6) + math.log(2 / 6)) / 3), 2)


def test_classifier(spark):
    rows = [(i, "good fine nice words" if i % 2 else "bad poor sad words", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label double")
    made = classifier.predict(classifier.fit(df, features=256), df).collect()
    assert all(r.is_ai == (r.label == 1) and 0.5 <= r.confidence <= 1 for r in made)


def test_collect_filters_then_dedups_then_caps(spark):
    good = lambda i: " ".join(f"w{i}x{k}words" for k in range(20)).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(0, "short"), (1, good(1)), (2, good(1)), (3, good(2)), (4, good(3))]
    df = spark.createDataFrame(rows, "o long, t string")
    one = collect.Source("one", lambda: df, collect.labelled((F.col("t"), "human")), "o", cap=2)
    two = collect.Source("two", lambda: df, collect.labelled((F.col("t"), "ai")), "o")
    got = sorted((r.source, r.text == good(3)) for r in collect.collect([one, two]).collect())
    assert got == [("one", False), ("one", False), ("two", True)]


def test_synthetic(spark):
    made = synthetic.essays(spark, 30).collect()
    assert made == synthetic.essays(spark, 30).collect() and all("{}" not in r.text and 3 < len(r.text.split("\n\n")) < 8 for r in made)
    few = synthetic.short_sentences(spark, ("A {x} is {y}.",), {"x": ("cat", "dog"), "y": ("big", "old")}, 100).collect()
    assert {r.text for r in few} == {"A cat is big.", "A cat is old.", "A dog is big.", "A dog is old."}


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "one"}, {"content": "two"}]))
    (tmp_path / "b.jsonl").write_text('{"body": "three"}\nnot json\n{"text": "", "content": "x"}\n')
    (tmp_path / "c.txt").write_text("four\n\n  five \n\n\n")
    (tmp_path / "d.csv").write_text('text,n\n"six, ""quoted""",1\n')
    got = [(r.raw, r.source) for r in readers.directory(spark, str(tmp_path), "human").orderBy("kind", "raw").collect()]
    assert got == [("one", "a"), ("two", "a"), ("", "b"), ("three", "b"), ("five", "c"), ("four", "c"), ('six, "quoted"', "d")]
    assert readers.jsonl(spark, str(tmp_path / "b.jsonl"), strict=True).where(f"{readers.CORRUPT} is not null").select("text", readers.CORRUPT).collect()[0][1] == "not json"


def test_docx(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as file:
        file.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    assert [(r.paragraph, r.text) for r in readers.docx(spark, str(tmp_path)).orderBy("paragraph").collect()] == [(0, "Hello there"), (1, "")]


def test_chunk_files_and_labels(spark, rows, tmp_path):
    readers.write_chunks(rows, f"{tmp_path}/c", 10)
    back = spark.read.parquet(f"{tmp_path}/c")
    assert ids(back) == list(range(100)) and len(list((tmp_path / "c" / "label=ai").glob("*.parquet"))) >= 4
    rows.where("label = 'ai'").select("text").write.parquet(f"{tmp_path}/p/ai_part")
    rows.where("label = 'human'").select("text").write.parquet(f"{tmp_path}/p/human_part")
    counts = {r.label: r["count"] for r in readers.labelled_parquet(spark, f"{tmp_path}/p").groupBy("label").count().collect()}
    assert counts == {0: 66, 1: 34}
    readers.write_json_array(rows.limit(3), f"{tmp_path}/x.json")
    assert len(json.loads((tmp_path / "x.json").read_text())) == 3


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    text = lambda i: " ".join(f"word{chr(97 + i)}{chr(97 + k)}" for k in range(20))
    frame = lambda *n: spark.createDataFrame([(text(i),) for i in n], "text string")

    def run():
        stream = ingest.accepted_once(ingest.read(spark, f"{tmp_path}/in", "text string"))
        ingest.to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        return sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect())

    frame(1, 2, 2).write.parquet(f"{tmp_path}/in")
    assert run() == [text(1), text(2)]
    frame(2, 3).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [text(1), text(2), text(3)]


def test_facade(spark):
    made = api.analyze(spark, "One two three. Four five.")
    assert made["n_sentences"] == 2 and made["likely_source"]
    with pytest.raises(ValueError):
        api.analyze(spark, "  ")
    assert api.compare(spark, "One two. Three four.", "One. Two three four five six seven eight.")["summary"]
    assert api.long_enough("0123456789") and not api.long_enough(" short ")

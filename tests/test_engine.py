"""The facade, collection with caps and failing sources, streams, training, grammar, ranks."""

import json

import pytest
from pyspark.sql import functions as F

from textlake import api
from textlake.functions import grammar
from textlake.operators import language, language_model, ranking, training
from textlake.operators.lineage import shared_folder
from textlake.plans import corpora
from textlake.sources import catalogue, collect, readers
from textlake.streaming import ingest

WORDS = "the quick brown fox jumps over one lazy dog while seven old owls watch it from their dark and quiet trees"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"text {i % 40} {WORDS} number {i % 40}", "human" if i % 3 else "ai") for i in range(100)], "o long, text string, label string").cache()


def test_positions_are_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, "a" if i % 4 else "b") for i in range(101)], "k int, g string").repartition(5)
    got = sorted((r.k, r.position) for r in ranking.positions(df, ("k",)).collect())
    assert got == [(i, i) for i in range(101)]
    for group in ("a", "b"):
        own = sorted((r.k, r.position) for r in ranking.positions(df, ("k",), ("g",)).collect() if r.g == group)
        assert [p for _, p in own] == list(range(len(own)))


@pytest.mark.parametrize("cap", [None, 5, 1000])
def test_caps_and_order_of_sources(rows, cap):
    """As a loop over rows would: filter, then dedup against accepted rows, then the cap."""
    sources = [collect.Source("first", lambda: rows.where("o < 60"), collect.labelled((F.col("text"), "human")), "o", cap=cap), collect.Source("second", lambda: rows, collect.labelled((F.col("text"), "ai")), "o")]
    seen, want = set(), []
    for source, ids, most in (("first", range(60), cap), ("second", range(100), None)):
        n = 0
        for i in ids:
            if (most is None or n < most) and i % 40 not in seen:
                seen.add(i % 40)
                want.append((source, i))
                n += 1
    got = sorted((r.source, r.o) for r in collect.collect(sources).collect())
    assert got == sorted(want)


def test_pools_share_a_cap(rows):
    sources = [collect.Source(x, lambda: rows.withColumn("text", F.concat(F.lit(x), "text")), collect.labelled((F.col("text"), "human")), "o", cap=50, pool="p") for x in ("a", "b")]
    got = [r.source for r in collect.collect(sources).collect()]
    assert len(got) == 50


def test_a_failing_source_leaves_the_others(spark, rows):
    sources = [collect.Source("gone", lambda: spark.read.parquet("/nowhere"), collect.labelled((F.col("text"), "human")), "o"), collect.Source("here", lambda: rows, collect.labelled((F.col("text"), "human")), "o")]
    made, errors = collect.collect_each(sources)
    assert list(errors) == ["gone"] and {r.source for r in made.collect()} == {"here"}


def test_catalogue_is_whole():
    every = [c for f in catalogue.FAMILIES.values() for c in f.connectors]
    assert {c.row for c in every} >= {*map(str, [*range(1, 19), 20])} | {f"c{i}" for i in range(1, 8)} | {f"g{i}" for i in range(1, 7)} | {f"f{i}" for i in range(1, 8)} | {"h1", "h2", "h3"}
    assert catalogue.top_up(100, 40, 70) == 30 and catalogue.top_up(100, 40, 500) == 60 and catalogue.top_up(10, 40, 70) == 0


@pytest.mark.parametrize(("family", "source"), [("sentences", "simple_wiki"), ("third", "eli5")])
def test_families_without_caps(spark, monkeypatch, family, source):
    """the queries take all rows, as their SQL does; the catalogue's caps hold elsewhere."""
    from dataclasses import replace

    own = catalogue.FAMILIES[family]
    monkeypatch.setitem(catalogue.FAMILIES, family, replace(own, connectors=tuple(replace(c, cap=2) if c.cap else c for c in own.connectors if c.source == source)))
    said = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten number{i}. ") for i in range(5)], "o long, text string")
    rows = said.withColumn("title", F.col("text"))
    assert catalogue.collect_family(family, lambda c: rows).count() == 2
    assert catalogue.collect_family(family, lambda c: rows, capped=False).count() == 5
    seen = []
    monkeypatch.setattr(corpora, "collect_family", lambda name, table, capped=True: seen.append(capped) or catalogue.collect_family(name, lambda c: rows, capped=capped))
    assert [r.n for r in corpora.collected(spark, "", family).collect()] == [5] and seen == [False]


def test_streams(spark, tmp_path):
    spark.range(500).withColumn("text", F.concat(F.lit("t"), "id")).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: ingest.read(spark, f"{tmp_path}/in", "id long, text string")
    done = ingest.each_alone({"good": lambda: ingest.flush(read(), f"{tmp_path}/out", f"{tmp_path}/ck", 100), "bad": lambda: ingest.flush(ingest.read(spark, f"{tmp_path}/none", "id long"), f"{tmp_path}/o2", f"{tmp_path}/c2")})
    assert done["good"] is None and done["bad"]
    counts = [r["count"] for r in spark.read.schema("id long, text string").parquet(f"{tmp_path}/out").groupBy(F.input_file_name()).count().collect()]
    assert sum(counts) == 500 and max(counts) <= 100


def test_polled_generator(spark, tmp_path):
    calls = ingest.polled(spark, lambda n: F.when(n % 3 != 0, F.concat(F.lit("answer "), n)), 7)
    run = calls.writeStream.format("memory").queryName("answers").trigger(processingTime="1 second").start()
    for _ in range(60):
        run.processAllAvailable() if False else run.awaitTermination(1)
        if spark.table("answers").count() >= 8:
            break
    run.stop()
    ids = sorted(r.id for r in spark.table("answers").collect())
    assert ids and all(i % 3 for i in ids) and len(ids) == len(set(ids))


def test_training_saved_found_and_loaded(spark, tmp_path):
    good, bad = "clear useful words about gardens and trees", "win casino bonus click cheap pills now"
    df = spark.createDataFrame([(i, f"{bad if i % 2 else good} {i % 7}", float(i % 2), "val" if i % 5 == 0 else "train") for i in range(100)], "id int, text string, label double, split string")
    model, history = training.train(df, iterations=(1, 3, 5, 7, 9), patience=2, features=1 << 8)
    assert 2 <= len(history) <= 5 and max(h["f1"] for h in history) > 0.9
    with pytest.raises(FileNotFoundError):
        training.find(spark, str(tmp_path))
    for place in ("final_model", "best_model"):
        training.save(model, f"{tmp_path}/{place}", spark, {"place": place})
    assert training.find(spark, str(tmp_path)).endswith("best_model")
    assert training.load(spark, str(tmp_path))[1] == {"place": "best_model"}
    detector = api.Detector.from_folder(spark, str(tmp_path))
    assert [x["is_ai"] for x in detector.detect_batch([bad, good])] == [True, False] and len(detector.analyze(bad)["visual_bar"]) == 20
    assert training.clear(spark, f"{tmp_path}/final_model") and not training.clear(spark, f"{tmp_path}/final_model")


def test_grammar(spark):
    made = spark.createDataFrame([("I saw the the cat and a owl , an tree i like",), ("",), (None,)], "text string").select(grammar.errors("text").alias("e")).collect()
    assert [(x.rule, x.offset, x.suggestions[0]) for x in made[0].e] == [("REPEATED_WORD", 3, "the"), ("ARTICLE", 7, "an owl"), ("LOOSE_MARK", 8, "owl,"), ("ARTICLE", 10, "a tree"), ("LOWER_I", 11, "I")]
    assert made[0].e[0].context == "the the cat" and made[1].e == [] and made[2].e == []


def test_language_detector(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the end", "en"), (4, "xyz", None), (5, None, "fr")], "id int, text string, lang string")
    found = {r.id: r.detected for r in language.detect(df, "id", "text", language.learn(df)).collect()}
    assert found == {1: "en", 2: "fr", 3: "en", 4: None, 5: None}


def test_windows_score_each_token_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b"), (3, "")], "id int, text string")
    model = language_model.train(df, "id", "text")
    made = sorted((r.id, r.begin, r.end, r.n_tokens) for r in language_model.windows(df, "id", "text", model, 4, 3).collect())
    assert made == [(1, 0, 4, 4), (1, 3, 7, 3), (1, 6, 10, 3), (1, 9, 11, 1), (2, 0, 2, 2)]
    total = {r.id: r.s for r in language_model.windows(df, "id", "text", model, 4, 3).groupBy("id").agg(F.sum("nll").alias("s")).collect()}
    whole = {r.id: r.s for r in language_model.windows(df, "id", "text", model, 100, 50).groupBy("id").agg(F.sum("nll").alias("s")).collect()}
    assert all(abs(total[i] - whole[i]) < 1e-9 for i in whole)


def test_facade(spark, tmp_path):
    text = f"{WORDS}. {WORDS.capitalize()}, he said. Short one."
    assert api.TextCleaner(spark).clean_text("<p>a  b</p>") == "a b" and api.TextCleaner(spark).is_valid_text("x") == (False, "too_short")
    readers.write_text(spark, f"{tmp_path}/in/a.jsonl", "\n".join(json.dumps({"text": x}) for x in (text, text, "short", "")))
    cleaner = api.DataCleaner(spark)
    assert [r.id for r in cleaner.process_directory(f"{tmp_path}/in", f"{tmp_path}/out", "human").collect()] == ["human_00000000"]
    report = cleaner.generate_report(f"{tmp_path}/in", "human")
    assert report["processed"] == 4 and report["duplicates"] == 1 and report["by_reason"] == {"too_short": 1, "no_text": 1} and report["removal_rate"] == 75.0
    df = spark.createDataFrame([(i, f"{text} {i}", "ai" if i % 4 == 0 else "human") for i in range(40)], "id int, text string, label string")
    assert api.DatasetFormatter().format(df).groupBy("label").count().select("count").distinct().collect()[0][0] == 10
    assert api.DatasetSplitter().run(df)[1].count() == 6
    vocab, encoded, counters = api.DataTokenizer(most=8).process(df)
    assert counters.first().truncated == 40 and len(encoded.first().padded) == 8 and vocab.count() > 20
    assert api.TextComplexityAnalyzer(spark, True).analyze("  ")["ease_label"] == "N/A"
    assert api.TextComplexityAnalyzer(spark).compare_texts(text, "One.")["differences"]["grade_diff"] > 0
    burst = api.BurstinessCalculator(spark)
    assert burst.analyze("One two.")["interpretation"].startswith("Insufficient") and burst.analyze("")["interpretation"] == "N/A"
    assert sum(burst.get_sentence_length_distribution(text).values()) == 3 and burst.compare_texts(text, "One. Two.", "x", "y")["more_human_like"] == "x"
    ppl = api.PerplexityCalculator(spark, df)
    assert ppl.calculate_perplexity("") == float("inf") and ppl.evaluate_with_stats(text)["perplexity"] > 1
    assert ppl.compare_texts(text, "zzz qqq")["more_human_like"] == "Text 2"
    assert api.humanize_text(spark, "One two.").endswith(".")


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_readers_on_odd_files(spark, tmp_path):
    assert readers.jsonl_or_none(spark, f"{tmp_path}/none").count() == 0 and readers.pairs_json(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        readers.human_only(spark.createDataFrame([("ai",)], "label string"))
    readers.write_text(spark, f"{tmp_path}/b.txt", "one\n \ntwo\n\nthree \n\n\n\n")
    assert [r.text for r in readers.text_blocks(spark, f"{tmp_path}/b.txt").collect()] == ["one\n \ntwo", "three"]
    spark.createDataFrame([("t" * 30,)], "text string").write.parquet(f"{tmp_path}/train/books.parquet")
    spark.createDataFrame([("t" * 30,)], "text string").coalesce(1).write.parquet(f"{tmp_path}/train/x")
    assert readers.labelled_parquet(spark, f"{tmp_path}/train").count() == 0
    assert readers.disk_usage(spark, str(tmp_path)) > 100

"""Queries over the standard tables, one for each operator, and their SQL.

Texts are returned as md5, so that results stay small. Documents are of class human or ai by the parity of their doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.functions import cleaning, metrics, rewrite, validity
from textlake.functions import patterns as P
from textlake.functions import text as X
from textlake.operators import bleu, chunking, classifier, compare, dedup, language_model, reports, sampling, tokens
from textlake.plans import sql as S
from textlake.plans.registry import CLASSED, TEXT, TURNS, classed, docs, query, scratch, spread, table, text, turns
from textlake.sources import collect, synthetic
from textlake.streaming import ingest


# Cleaning and validity


@query(
    f"""WITH {S.clean_ctes("documents", "doc_id", "text")}, r AS (SELECT doc_id, {S.reason("t")} AS reason, md5(t) AS h FROM cleaned),
    d AS (SELECT *, row_number() OVER (PARTITION BY reason = 'valid', h ORDER BY doc_id) AS k FROM r)
    SELECT CASE WHEN reason = 'valid' AND k > 1 THEN 'duplicate' ELSE reason END AS reason, count(*) AS n FROM d GROUP BY 1"""
)
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned and judged: how many are valid, repeat a valid one, or fail a rule."""
    rows = docs(spark, sf_dir).select(cleaning.clean("text").alias("t")).select(validity.reason("t").alias("reason"), X.hash_exact("t").alias("h"))
    made = reports.cleaning(rows, "reason", "h")
    counts = F.map_concat("by_reason", F.create_map(F.lit("valid"), F.col("valid"), F.lit("duplicate"), F.col("duplicates")))
    return made.select(F.explode(counts).alias("reason", "n")).where("n > 0")


@query(f"SELECT doc_id, {S.reason('t')} AS reason FROM (SELECT doc_id, {TEXT} AS t FROM documents)")
def valid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", validity.reason("text").alias("reason"))


@query(f"SELECT doc_id, CASE WHEN reason = 'valid' AND lang <> 'en' THEN 'wrong_language_' || lang ELSE reason END AS reason FROM (SELECT doc_id, lang, {S.reason('t')} AS reason FROM (SELECT doc_id, lang, {TEXT} AS t FROM documents))")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validity rules with the language rule last; the table's own language stands for a detector."""
    return docs(spark, sf_dir).select("doc_id", validity.reason("text", language=F.col("lang")).alias("reason"))


@query(
    f"""SELECT source, n, correct, CASE WHEN correct / n < 0.7 THEN 'low' WHEN correct / n < 0.85 THEN 'moderate' ELSE 'good' END AS band
    FROM (SELECT source, count(*) AS n, count(*) FILTER ((quality = 1) = ({S.reason("t")} = 'valid')) AS correct FROM (SELECT source, quality, {TEXT} AS t FROM documents JOIN labels USING (doc_id)) GROUP BY source)"""
)
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each category, here the source, how many of the labelled rows are judged right, and the band of that share."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    right = (F.col("quality") == 1) == (validity.reason("text") == "valid")
    made = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("correct"))
    return made.select("source", "n", "correct", classifier.band(F.col("correct") / F.col("n")).alias("band"))


@query(f"SELECT source, {S.reason('t')} AS reason, count(*) AS n FROM (SELECT source, {TEXT} AS t FROM documents) GROUP BY ALL")
def reason_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source", validity.reason("text").alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {TEXT} AS t FROM documents) WHERE {S.accepted('t')}")
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(validity.accepted("text")).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {TEXT} AS t FROM documents) WHERE {S.accepted('t', 15, 1000, 0.3)}")
def filter_text_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(validity.accepted("text", 15, 1000, 0.3)).select("doc_id")


@query(f"SELECT doc_id, CAST(length({TEXT}) AS BIGINT) AS chars, CAST({S.n_words(TEXT)} AS BIGINT) AS words, CAST(len(list_distinct({S.words(TEXT)})) AS BIGINT) AS uniques, CAST({S.count(TEXT, P.LETTER)} AS BIGINT) AS letters, CAST({S.count(TEXT, '[{};[]')} AS BIGINT) AS code_marks FROM documents")
def doc_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text()
    made = {"chars": F.length(t), "words": X.n_words(t), "uniques": F.size(F.array_distinct(X.words(t))), "letters": X.n_letters(t), "code_marks": X.n_code_marks(t)}
    return docs(spark, sf_dir).select("doc_id", *(v.cast("long").alias(k) for k, v in made.items()))


def _step(name: str, step: Callable[[Column], Column], source: str = "documents", key: str = "doc_id", column: str = "text"):
    """A query function for one cleaning step: each text's hash and length after it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = spread(table(spark, sf_dir, source)).select(key, step(F.coalesce(column, F.lit(""))).alias("t"))
        return made.select(key, F.md5("t").alias("h"), F.length("t").cast("long").alias("n"))

    run.__name__ = name
    return run


def _changed(name: str, step: Callable[[Column], Column], sql_step: Callable[[str], str] | None, source: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    """The same, with the SQL of a step that is an expression there."""
    query(f"SELECT {key}, md5(t) AS h, CAST(length(t) AS BIGINT) AS n FROM (SELECT {key}, {sql_step(f"coalesce({column}, '')")} AS t FROM {source})" if sql_step else None)(_step(name, step, source, key, column))


_changed("url_email_removal", cleaning.remove_urls, S.urls)
_changed("special_chars", cleaning.remove_special, S.special)
_changed("encoding_normalize", cleaning.normalize, S.normalize)
_changed("compose", lambda c: cleaning.compose(c, decode=False), lambda x: f"nfc_normalize({x})")
_changed("noise_removal", lambda c: cleaning.remove_noise(c, repeats=False), S.noise)
_changed("whitespace_normalize", cleaning.normalize_whitespace, S.whitespace)
_changed("whitespace_collapse", X.collapse, S.collapse)
_changed("clean_collected", cleaning.clean_collected, lambda x: f"trim({S.sub(S.collapse(x), '^(?:' + '|'.join(P.ASSISTANT_PREFIXES) + ')')})")
_changed("truncate_100_words", lambda c: X.first_words(c, 100), lambda x: f"CASE WHEN {S.n_words(x)} > 100 THEN array_to_string(({S.words(x)})[1:100], ' ') ELSE {x} END")
query(f"WITH {S.repeats_ctes('(SELECT doc_id, ' + TEXT + ' AS text FROM documents)', 'doc_id', 'text', 'made')} SELECT doc_id, md5(t) AS h, CAST(length(t) AS BIGINT) AS n FROM made")(_step("repeat_collapse", cleaning.collapse_repeats))
query(f"WITH {S.clean_ctes('documents', 'doc_id', 'text')} SELECT doc_id, md5(t) AS h, CAST(length(t) AS BIGINT) AS n FROM cleaned")(_step("clean_text", cleaning.clean))
_changed("html_text_native", cleaning.html_native, S.html, "pages", "page_id", "html")
_changed("html_text_arrow", cleaning.html_arrow, S.html, "pages", "page_id", "html")


@query(f"SELECT doc_id, part, md5(p) AS h FROM (SELECT doc_id, unnest(range(len(l))) AS part, unnest(l) AS p FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS l FROM documents)) WHERE upper(p) SIMILAR TO '.*({'|'.join(P.BOOK_NOISE)}).*' OR (upper(p) = p AND lower(p) <> p AND length(p) < 60) OR length(p) < 50")
def book_noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(text(), "\n")).alias("part", "p"))
    return lines.where(cleaning.book_noise("p")).select("doc_id", F.col("part").cast("long").alias("part"), F.md5("p").alias("h"))


@query(f"SELECT doc_id, part, md5(t) AS h FROM (SELECT doc_id, part, {S.sub('t', P.DOCX_SYMBOL)} AS t FROM (SELECT doc_id, part, {S.collapse(S.without('p', P.EMOJI))} AS t FROM (SELECT doc_id, unnest(range(len(l))) AS part, unnest(l) AS p FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS l FROM documents))) WHERE length(t) >= 30)")
def docx_paragraph_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(text(), "\n")).alias("part", "p"))
    made = lines.select("doc_id", F.col("part").cast("long").alias("part"), cleaning.clean_docx("p").alias("t")).where("t is not null")
    return made.select("doc_id", "part", F.md5("t").alias("h"))


@query(f"SELECT doc_id, sentence_no FROM (SELECT doc_id, unnest(range(len(s))) AS sentence_no, unnest(s) AS t FROM (SELECT doc_id, {S.sentences(TEXT)} AS s FROM documents)) WHERE right(t, 1) IN ('.', '!', '?') AND {S.n_words('t')} BETWEEN 5 AND 25")
def complete_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_sentences(docs(spark, sf_dir).select("doc_id", text().alias("text")), "text")
    return rows.where(cleaning.complete_sentence("sentence")).select("doc_id", F.col("sentence_no").cast("long").alias("sentence_no"))


@query(f"SELECT doc_id, CASE WHEN w <= 30 THEN 'short' WHEN w <= 100 THEN 'medium' ELSE 'long' END AS stratum FROM (SELECT doc_id, {S.n_words(TEXT)} AS w FROM documents)")
def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", validity.length_stratum(text()).alias("stratum"))


@query("SELECT doc_id, md5(text) AS exact, substr(md5(substr(text, 1, 1000)), 1, 16) AS prefix, md5(substr(" + S.collapse("lower(text)") + ", 1, 500)) AS normalized FROM documents")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.hash_exact("text").alias("exact"), X.hash_prefix("text").alias("prefix"), X.hash_normalized("text").alias("normalized"))


# Dedup and sets


def _first(name: str, key: Callable[[str], Column], sql_key: str, by: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dedup.first_wins(classed(spark, sf_dir).select("doc_id", "text", "label"), key("text"), "doc_id", (by,) if by else ()).select("doc_id")

    run.__name__ = name
    query(f"SELECT min(doc_id) AS doc_id FROM {CLASSED} GROUP BY {sql_key}{', ' + by if by else ''}")(run)


_first("exact_dedup_md5", X.hash_exact, "md5(text)")
_first("prefix_dedup_1000", X.hash_prefix, "substr(md5(substr(text, 1, 1000)), 1, 16)")
_first("normalized_dedup_500", X.hash_normalized, f"md5(substr({S.collapse('lower(text)')}, 1, 500))", "label")


@query("SELECT md5(text) AS key, count(*) AS copies, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(docs(spark, sf_dir), X.hash_exact("text"), "doc_id")


@query(f"SELECT md5(text) AS h FROM (SELECT text FROM {CLASSED} WHERE label = 'human' INTERSECT SELECT text FROM {CLASSED} WHERE label = 'ai')")
def class_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classed(spark, sf_dir)
    return dedup.overlap(rows.where("label = 'human'"), rows.where("label = 'ai'")).select(F.md5("text").alias("h"))


@query(f"SELECT doc_id, label FROM {CLASSED} WHERE text IN (SELECT text FROM {CLASSED} GROUP BY text HAVING count(DISTINCT label) = 1)")
def remove_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.without_overlap(classed(spark, sf_dir).select("doc_id", "label", "text"), "label").select("doc_id", "label")


@query(f"SELECT md5(text) AS h FROM (SELECT text FROM {CLASSED} WHERE label = 'human' EXCEPT SELECT text FROM {CLASSED} WHERE label = 'ai')")
def new_not_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classed(spark, sf_dir)
    return dedup.new_only(rows.where("label = 'human'"), rows.where("label = 'ai'")).select(F.md5("text").alias("h"))


@query(f"SELECT doc_id FROM (SELECT min(doc_id) AS doc_id, md5(text) AS h FROM {CLASSED} GROUP BY text) WHERE h NOT IN (SELECT md5(text) FROM {CLASSED} WHERE doc_id < 300)")
def resumed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows whose hash an earlier run, here that over the documents before 300, hasn't accepted."""
    rows = docs(spark, sf_dir).select("doc_id", "text")
    done = rows.where("doc_id < 300").select(X.hash_exact("text").alias("key")).distinct()
    return dedup.resume(rows, done, X.hash_exact("text"), "doc_id").select("doc_id")


@query("SELECT priority, count(*) AS n FROM (SELECT 0 AS priority FROM documents WHERE lang <> 'en' UNION ALL SELECT 1 FROM documents WHERE lang = 'en') GROUP BY 1")
def union_with_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    return dedup.by_priority(rows.where("lang <> 'en'"), rows.where("lang = 'en'")).groupBy("priority").agg(F.count("*").alias("n"))


@query("SELECT copy, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS s FROM pages, (SELECT unnest(range(1, 101)) AS copy) GROUP BY 1")
def replicate_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.replicate(table(spark, sf_dir, "pages").select("page_id"), 100).groupBy(F.col("copy").cast("long").alias("copy")).agg(F.count("*").alias("n"), F.sum("page_id").alias("s"))


@query("SELECT page_id, label, md5(text) AS h FROM (SELECT page_id, 'human' AS label, url AS text FROM pages UNION ALL SELECT page_id, 'ai', html FROM pages)")
def unpivot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unpivot(table(spark, sf_dir, "pages"), "page_id", url="human", html="ai").select("page_id", "label", F.md5("text").alias("h"))


@query(f"SELECT doc_id, 2 * (row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1) + CASE WHEN label = 'human' THEN 0 ELSE 1 END AS position FROM {CLASSED}")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.interleave(classed(spark, sf_dir).select("doc_id", "label"), "label", "human", "doc_id").select("doc_id", F.col("position").cast("long").alias("position"))


@query(
    f"""SELECT DISTINCT doc_id, item_id FROM documents d, benchmark b
    WHERE {S.n_words("b.text")} >= 6 AND contains(d.text, b.text)"""
)
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark text of six words or more: joined on the hash of four inner words, then checked."""
    items = table(spark, sf_dir, "benchmark").where(X.n_words("text") >= 6).select("item_id", F.col("text").alias("item"))
    items = items.withColumn("a", F.xxhash64(F.array_join(F.slice(X.words("item"), 2, 4), " ")))
    own = docs(spark, sf_dir).select("doc_id", "text")
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(4)), " ")))
    spots = own.select("doc_id", F.explode(F.array_distinct(X.let(X.words("text"), hashes))).alias("a"))
    found = spots.join(items.select("item_id", "a"), "a").select("doc_id", "item_id").distinct()
    checked = found.join(items, "item_id").join(own, "doc_id").where(F.contains("text", "item"))
    return checked.select("doc_id", "item_id").distinct()


# Reports


@query(f"SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM {TURNS} GROUP BY label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(turns(spark, sf_dir), "label")


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM documents GROUP BY source")
def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(docs(spark, sf_dir), "source")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(docs(spark, sf_dir), "source", 5)


def _histogram_sql(value: str, table_: tuple, source: str) -> str:
    names = ", ".join(f"({S.q(name)})" for _, name in table_)
    return f"""WITH b(bin) AS (VALUES {names}), c AS (SELECT {S.bins(value, table_)} AS bin, count(*) AS n FROM {source} GROUP BY 1), m AS (SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin))
    SELECT bin, n, round(n / sum(n) OVER () * 100, 2) AS pct FROM m"""


@query(_histogram_sql("length(text)", P.LENGTH_BINS, "documents"))
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(docs(spark, sf_dir), F.length("text"), P.LENGTH_BINS)


_TOKEN_BINS = tuple((high - 1, f"{low}-{high}") for low, high in zip(P.TOKEN_BINS, P.TOKEN_BINS[1:], strict=False)) + ((None, f"{P.TOKEN_BINS[-1]}+"),)


@query(_histogram_sql(S.n_words(TEXT), _TOKEN_BINS, "documents"))
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.half_open(docs(spark, sf_dir), X.n_words(text()), P.TOKEN_BINS)


@query(
    f"""WITH x AS (SELECT CAST({S.n_words(TEXT)} AS BIGINT) AS v FROM documents)
    SELECT count(*) AS n, min(v) AS min_len, max(v) AS max_len, round(sum(v) / count(*), 4) AS mean_len, round(sqrt((count(*) * sum(v * v) - sum(v) * sum(v)) / (count(*) * count(*))), 4) AS std_len,
    {", ".join(f"round(quantile_cont(v, {m}), 4) AS p{round(m * 100)}" for m in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))} FROM x"""
)
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_percentiles(docs(spark, sf_dir), X.n_words(text()))


@query(f"SELECT label, count(*) AS n, round(sum(length(text)) / count(*), 4) AS avg_chars, round(sum({S.n_words('text')}) / count(*), 4) AS avg_words FROM {CLASSED} GROUP BY label")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.statistics(classed(spark, sf_dir), "label", "text")


@query(f"SELECT label, count(*) AS n, count(DISTINCT text) AS n_distinct, round(sum({S.n_words('text')}) / count(*), 4) AS avg_words, count(*) FILTER ({S.n_words('text')} < 10) AS n_short FROM {TURNS} GROUP BY label")
def quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_check(turns(spark, sf_dir), "label", "text")


@query("SELECT 'lang' AS name, count(*) - count(lang) AS n_null, count(DISTINCT lang) AS n_distinct FROM documents UNION ALL SELECT 'source', count(*) - count(source), count(DISTINCT source) FROM documents")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.profile(docs(spark, sf_dir).select("lang", "source"))


@query(
    f"""WITH p AS (SELECT quality AS a, CASE WHEN {S.reason("t")} = 'valid' THEN 1 ELSE 0 END AS p FROM (SELECT quality, {TEXT} AS t FROM documents JOIN labels USING (doc_id))),
    c AS (SELECT count(*) FILTER (a = 1 AND p = 1) AS tp, count(*) FILTER (a = 0 AND p = 1) AS fp, count(*) FILTER (a = 1 AND p = 0) AS fn, count(*) FILTER (a = 0 AND p = 0) AS tn FROM p)
    SELECT *, CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) ELSE 0.0 END AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1 FROM c"""
)
def quality_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("quality", (validity.reason("text") == "valid").cast("int").alias("p"))
    return reports.confusion(rows, "quality", "p")


@query("""SELECT '{"source":"' || source || '","n":' || count(*) || '}' AS json FROM documents GROUP BY source""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.as_json(docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")))


# Sentence metrics


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_lengths(docs(spark, sf_dir).select("doc_id", "text"))


@query(f"SELECT doc_id, n FROM ({S.LENGTHS})")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("doc_id", F.col("n_sentences").alias("n"))


@query(f"SELECT doc_id, n, {S.rounded(S.MEAN, 2)} AS avg_len, {S.rounded(S.VARIANCE, 2)} AS var_len, {S.rounded(S.DEVIATION, 2)} AS std_len, CAST(coalesce(list_min(lengths), 0) AS BIGINT) AS min_len, CAST(coalesce(list_max(lengths), 0) AS BIGINT) AS max_len FROM ({S.LENGTHS})")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics
    return measured(spark, sf_dir).select("doc_id", F.col("n_sentences").alias("n"), F.round(m.mean(), 2).alias("avg_len"), F.round(m.variance(), 2).alias("var_len"), F.round(m.deviation(), 2).alias("std_len"), F.coalesce(F.array_min("lengths"), F.lit(0)).alias("min_len"), F.coalesce(F.array_max("lengths"), F.lit(0)).alias("max_len"))


@query(
    "SELECT doc_id, "
    + ", ".join(f"CAST(len(list_filter(lengths, lambda x: x > {P.SENTENCE_BINS[k - 1][0] if k else 0}{f' AND x <= {high}' if high else ''})) AS BIGINT) AS b{k}" for k, (high, _) in enumerate(P.SENTENCE_BINS))
    + f" FROM ({S.LENGTHS})"
)
def sentence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("doc_id", *(metrics.in_bin(P.SENTENCE_BINS, k).alias(f"b{k}") for k in range(len(P.SENTENCE_BINS))))


@query(f"SELECT doc_id, {S.BURSTINESS} AS burstiness, {S.CV} AS cv FROM ({S.LENGTHS})")
def burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("doc_id", metrics.burstiness().alias("burstiness"), metrics.variation().alias("cv"))


@query(f"SELECT doc_id, CAST(coalesce(list_max({S.DIFFS}), 0) AS DOUBLE) AS max_diff, CASE WHEN n < 2 THEN 0.0 ELSE {S.rounded(f'list_sum({S.DIFFS}) / (n - 1)', 2)} END AS avg_diff FROM ({S.LENGTHS})")
def consecutive_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("doc_id", metrics.most_difference().alias("max_diff"), metrics.mean_difference().alias("avg_diff"))


@query(f"SELECT doc_id, {S.label('b', P.BURSTINESS_LABELS, '>=')} AS label, CASE WHEN e THEN '{P.NO_TEXT}' WHEN n < 2 THEN '{P.FEW_SENTENCES}' ELSE {S.label('b', P.BURSTINESS_LABELS, '>=')} END AS standalone FROM (SELECT l.doc_id, n, {S.BURSTINESS} AS b, {S.collapse(TEXT)} = '' AS e FROM ({S.LENGTHS}) l JOIN documents USING (doc_id))")
def burstiness_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("doc_id", metrics.burstiness_label(metrics.burstiness()).alias("label"), metrics.standalone_label(text()).alias("standalone"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text, their perplexity standing in as a column: 60 and as much as the doc_id mod 200."""
    rows = docs(spark, sf_dir).select("doc_id", "text", (F.col("doc_id") % 200 + 60).cast("double").alias("lm"))
    return metrics.evaluate(rows, perplexity="lm").where(X.collapse(text()) != "")


_EVALUATED = f"SELECT doc_id, {S.EASE} AS ease, {S.GRADE} AS grade, {S.BURSTINESS} AS b, {S.CV} AS cv, CAST(doc_id % 200 + 60 AS DOUBLE) AS ppl FROM (SELECT r.* FROM ({S.READING}) r JOIN documents d USING (doc_id) WHERE {S.collapse('d.text')} <> '')"
_PARTS = ("least(ppl / 5, 100.0) * CAST(0.35 AS DOUBLE)", "(b + 1) * 50 * CAST(0.35 AS DOUBLE)", "greatest(0.0, 100 - CAST(0 AS DOUBLE) * 10) * CAST(0.15 AS DOUBLE)", "least(cv * 2, 100.0) * CAST(0.15 AS DOUBLE)")
_SCORE = S.rounded(" + ".join(_PARTS), 2)


@query(f"SELECT doc_id, ease, grade FROM ({_EVALUATED})")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("doc_id", F.col("reading_ease").alias("ease"), F.col("grade_level").alias("grade"))


@query(f"SELECT doc_id, {S.label('ease', P.EASE_LABELS, '>=')} AS ease_label, {S.label('grade', P.GRADE_LABELS, '<=')} AS grade_label, {S.label('ppl', P.PERPLEXITY_LABELS, '<')} AS perplexity_label, '{P.NO_GRAMMAR_ERRORS}' AS grammar_label FROM ({_EVALUATED})")
def metric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("doc_id", "ease_label", "grade_label", "perplexity_label", "grammar_label")


@query(f"SELECT doc_id, {_SCORE} AS human_score FROM ({_EVALUATED})")
def human_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("doc_id", "human_score")


@query(f"SELECT source, confidence, count(*) AS n FROM (SELECT {S.label('h', P.SOURCE_LABELS, '>=')} AS source, {S.label('h', P.CONFIDENCE_LABELS, '>=')} AS confidence FROM (SELECT {_SCORE} AS h FROM ({_EVALUATED}))) GROUP BY ALL")
def source_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).groupBy(F.col("likely_source").alias("source"), "confidence").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, i AS place, x AS length, {S.rounded(S.MEAN, 2)} AS mean_len, x > ({S.MEAN}) AS above FROM (SELECT *, unnest(lengths) AS x, unnest(range(len(lengths))) AS i FROM ({S.LENGTHS}))")
def sentence_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chart of sentence lengths shows: each length, the mean, and which are above it."""
    rows = measured(spark, sf_dir).select("doc_id", metrics.mean().alias("m"), F.posexplode("lengths").alias("place", "length"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), F.col("length").cast("long").alias("length"), F.round("m", 2).alias("mean_len"), (F.col("length") > F.col("m")).alias("above"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the assistant turns right after them, as before and after."""
    rows = turns(spark, sf_dir).withColumn("pair", F.col("id") - F.when(F.col("label") == "ai", 1).otherwise(0))
    rows = metrics.evaluate(rows.withColumn("lm", F.length("text").cast("double")), perplexity="lm").where(X.collapse(text()) != "")
    kept = ["pair", *(name for name, _ in compare.METRICS), "likely_source"]
    return compare.compare(compare.pair(rows.where("label = 'human'").select(kept), rows.where("label = 'ai'").select(kept), "pair"))


_TURN_LENGTHS = S.LENGTHS.replace("doc_id", "id").replace("FROM documents", f"FROM {TURNS} t0")
_TURN_SCORES = f"""SELECT id, label, ppl, b, cv, {S.EASE} AS ease, {_SCORE} AS h FROM (SELECT l.id, label, n, {S.n_words("text")} AS w, {S.syllables("text")} AS y, CAST(length(text) AS DOUBLE) AS ppl, {S.BURSTINESS} AS b, {S.CV} AS cv FROM ({_TURN_LENGTHS}) l JOIN {TURNS} t USING (id) WHERE {S.collapse("text")} <> '')"""


@query(
    f"""WITH s AS ({_TURN_SCORES}), p AS (SELECT a.id AS pair, a.h AS h0, z.h AS h1 FROM s a JOIN s z ON z.id = a.id + 1 AND a.label = 'human' AND z.label = 'ai')
    SELECT pair, {S.rounded("h1 - h0", 2)} AS overall_improvement, h1 - h0 > 5 AS success FROM p"""
)
def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("pair", "overall_improvement", "success")


_PAIRS = f"(SELECT a.id AS pair, a.text AS before, z.text AS after FROM {TURNS} a JOIN {TURNS} z ON z.id = a.id + 1 AND a.label = 'human' AND z.label = 'ai')"


def paired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the assistant turns right after them."""
    rows = turns(spark, sf_dir)
    before = rows.where("label = 'human'").select(F.col("id").alias("pair"), F.col("text").alias("before"))
    after = rows.where("label = 'ai'").select((F.col("id") - 1).alias("pair"), F.col("text").alias("after"))
    return before.join(after, "pair")


def _gram_sql(column: str, name: str) -> str:
    return f"SELECT pair, n, array_to_string(w[i : i + n - 1], ' ') AS gram, count(*) AS {name} FROM (SELECT pair, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM (SELECT pair, {S.words(column)} AS w FROM {_PAIRS}), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n) GROUP BY ALL"


@query(
    f"""WITH p AS ({_gram_sql("after", "p")}), r AS ({_gram_sql("before", "r")}), s AS (SELECT n, sum(least(p, coalesce(r, 0))) AS hits, sum(p) AS total FROM p LEFT JOIN r USING (pair, n, gram) GROUP BY n),
    t AS (SELECT count(*) AS sizes, min(hits) AS least, sum(CASE WHEN hits > 0 THEN ln(hits / total) END) AS logs FROM s), l AS (SELECT CAST(sum({S.n_words("after")}) AS BIGINT) AS predicted_words, CAST(sum({S.n_words("before")}) AS BIGINT) AS reference_words FROM {_PAIRS})
    SELECT predicted_words, reference_words, CASE WHEN sizes = 4 AND least > 0 THEN round(100 * exp(logs / 4 + CASE WHEN predicted_words >= reference_words THEN 0.0 ELSE 1 - reference_words / predicted_words END), 4) ELSE 0.0 END AS bleu FROM l, t"""
)
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bleu.corpus_bleu(paired_turns(spark, sf_dir), "pair", "after", "before")


@query(
    f"""SELECT pair, {S.rounded("abs(x - y)", 4)} AS difference, CASE WHEN x > y THEN 'before' ELSE 'after' END AS more_human, CASE WHEN x <> 0 THEN {S.rounded("(y - x) / abs(x) * 100", 2)} ELSE 0.0 END AS pct
    FROM (SELECT pair, CAST({S.n_words("before")} AS DOUBLE) AS x, CAST({S.n_words("after")} AS DOUBLE) AS y FROM {_PAIRS})"""
)
def pairwise_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two texts by one number, here their word counts."""
    rows = paired_turns(spark, sf_dir).select("pair", X.n_words("before").cast("double").alias("x"), X.n_words("after").cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.select("pair", compare.difference(x, y).alias("difference"), compare.more_human(x, y, "before", "after").alias("more_human"), compare.percent_change(x, y).alias("pct"))


# Sampling and splits

_RANKED = f"SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {S.rank_hash('id', 42)}, id) AS r, count(*) OVER (PARTITION BY label) AS t FROM {TURNS}"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", "label")


@query(f"SELECT id, label FROM ({_RANKED}) WHERE r <= (SELECT min(t) FROM ({_RANKED}))")
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample(keyed(spark, sf_dir), "label", "id")


@query(f"SELECT id, label, unnest(range(0, 1 + CAST(floor(((SELECT max(t) FROM ({_RANKED})) - r) / t) AS BIGINT))) AS copy FROM ({_RANKED})")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.oversample(keyed(spark, sf_dir), "label", "id").withColumn("copy", F.col("copy").cast("long"))


@query(f"SELECT id, label, unnest(range(0, 1 + CAST(greatest(floor((300 - r) / t), 0) AS BIGINT))) AS copy FROM ({_RANKED}) WHERE r <= 300")
def custom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.to_size(keyed(spark, sf_dir), "label", "id", 300).withColumn("copy", F.col("copy").cast("long"))


@query(f"SELECT id, label FROM ({_RANKED}) WHERE r <= least(100, (SELECT min(t) FROM ({_RANKED})))")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced(keyed(spark, sf_dir), "label", "id", 100)


@query(f"SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM {TURNS}) WHERE r <= 50")
def head_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_balanced(keyed(spark, sf_dir), "label", "id", 50)


def _split_sql(test: float, val: float) -> str:
    return f"SELECT id, label, CASE WHEN r <= e THEN 'test' WHEN r <= e + ceil(round((t - e) * CAST({val} AS DOUBLE), 9)) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, ceil(round(t * CAST({test} AS DOUBLE), 9)) AS e FROM ({_RANKED}))"


@query(_split_sql(0.1, 0.1 / 0.9))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(keyed(spark, sf_dir), "label", "id")


@query(_split_sql(0.075, 0.075 / 0.925))
def stratified_split_85(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(keyed(spark, sf_dir), "label", "id", 0.85, 0.075, 0.075)


@query(f"SELECT id, CASE WHEN r <= floor(round(t * 0.8, 9)) THEN 'train' WHEN r <= floor(round(t * 0.8, 9)) + floor(round(t * 0.1, 9)) THEN 'val' ELSE 'test' END AS split FROM (SELECT id, row_number() OVER (ORDER BY {S.rank_hash('id', 42)}, id) AS r, count(*) OVER () AS t FROM {TURNS})")
def plain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.plain_split(keyed(spark, sf_dir), "id").select("id", "split")


@query(
    f"""WITH s AS (SELECT id, CASE WHEN w <= 30 THEN 'short' WHEN w <= 100 THEN 'medium' ELSE 'long' END AS stratum FROM (SELECT id, {S.n_words("text")} AS w FROM {TURNS}))
    SELECT id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {S.rank_hash("id", 42)}, id) AS r, count(*) OVER (PARTITION BY stratum) AS t FROM s) WHERE stratum <> 'short' OR r <= floor(t / 3)"""
)
def length_remix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.remix(turns(spark, sf_dir).select("id", "text"), validity.length_stratum("text"), "id").select("id", "stratum")


# Chunks


@query(
    f"""WITH w AS (SELECT doc_id, {S.words(TEXT)} AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(w) / 150) AS BIGINT))) AS chunk_no, w FROM w)
    SELECT doc_id, chunk_no, md5(t) AS h FROM (SELECT doc_id, chunk_no, array_to_string(w[chunk_no * 150 + 1 : chunk_no * 150 + 150], ' ') AS t FROM c) WHERE length(t) >= 50"""
)
def word_chunks_150(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_chunks(docs(spark, sf_dir).select("doc_id", "text"), "text", 150, 50)
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("h"))


@query()
def textwrap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.wrapped("text")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.md5("line").alias("h"))


@query("SELECT lang, g AS group_no, count(*) AS n_rows, md5(string_agg(text, ' ' ORDER BY doc_id)) AS h FROM (SELECT lang, doc_id, text, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 10 AS g FROM documents) GROUP BY 1, 2 HAVING count(*) = 10")
def row_concat_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.joined_rows(docs(spark, sf_dir).select("lang", "doc_id", "text"), "text", "doc_id", 10, ("lang",)).select("lang", F.col("group_no").cast("long").alias("group_no"), "n_rows", F.md5("text").alias("h"))


@query(f"SELECT doc_id, sentence_no, md5(t) AS h FROM (SELECT doc_id, unnest(range(len(s))) AS sentence_no, unnest(s) AS t FROM (SELECT doc_id, {S.sentences(TEXT)} AS s FROM documents))")
def explode_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_sentences(docs(spark, sf_dir).select("doc_id", text().alias("text")), "text")
    return rows.select("doc_id", F.col("sentence_no").cast("long").alias("sentence_no"), F.md5("sentence").alias("h"))


@query(rf"SELECT doc_id, unnest(list_transform(list_filter(list_transform(string_split({TEXT}, chr(10) || chr(10))[1:5], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: md5(x))) AS h FROM documents")
def first_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.explode(F.transform(chunking.paragraphs(text(), 5), F.md5)).alias("h"))


@query(f"SELECT doc_id, b AS begin, least(b + 256, n) AS end, least(b + 256, n) - CASE WHEN b = 0 THEN 0 ELSE least(b + 128, n) END AS fresh FROM (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 128)) AS b FROM (SELECT doc_id, CAST({S.n_words(TEXT)} AS BIGINT) AS n FROM documents)) WHERE least(b + 256, n) - CASE WHEN b = 0 THEN 0 ELSE least(b + 128, n) END > 0")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.inline(chunking.token_windows(X.n_words(text()).cast("long"), 256, 128)))


@query("SELECT conv_id, n, md5(t) AS h FROM (SELECT conv_id, count(*) AS n, string_agg(CASE role WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'System: ' END || text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def flat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("conv_id", "n", F.md5("t").alias("h"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat text for each conversation, whose turns are few."""
    rows = table(spark, sf_dir, "conversations")
    said = F.concat(F.when(F.col("role") == "user", "Human: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("System: "), "text")
    made = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("a"))
    return made.select("conv_id", "n", F.array_join(F.transform("a", lambda x: x["s"]), " ").alias("t"))


@query(
    """WITH t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'System: ' END || text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
    SELECT conv_id, unnest(list_transform(string_split(t, 'Assistant:')[2:], lambda x: md5(trim(string_split(x, 'Human:')[1])))) AS h FROM t"""
)
def transcript_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("conv_id", F.explode(F.transform(cleaning.assistant_turns("t"), F.md5)).alias("h"))


# Rewriting and synthetic rows


@query(f"SELECT '{P.INSTRUCTION}' AS instruction, '' AS input, md5(text) AS output FROM documents")
def instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.instruction_rows(docs(spark, sf_dir).select(F.md5("text").alias("text")), "text")


def _robot_sql(x: str, key: str) -> str:
    made = x
    for short, long in P.CONTRACTIONS:
        made = f"replace({made}, {S.q(short)}, {S.q(long)})"
    return f"CASE WHEN {S.chance(42, key)} < 26 THEN 'In summary, ' || {made} ELSE {made} END"


@query(f"SELECT doc_id, md5({_robot_sql('text', 'doc_id')}) AS h FROM documents")
def robotize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(rewrite.robotize("text", "doc_id")).alias("h"))


_OPENED = f"CASE WHEN (i - 1) % 2 = 0 AND {S.n_words('x')} > 5 THEN '{P.OPENER}' || {S.lower_first('x')} ELSE x END"


@query(
    f"""WITH s AS (SELECT doc_id, string_split(text, '. ') AS l FROM documents), x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM s),
    o AS (SELECT doc_id, i, x, {_OPENED} AS o FROM x),
    f AS (SELECT doc_id, i, CASE WHEN {S.chance(42, "doc_id", "i - 1")} < 77 AND x <> '' THEN ([{", ".join(map(S.q, P.FILLERS))}])[{S.chance(43, "doc_id", "i - 1")} % {len(P.FILLERS)} + 1] || {S.lower_first("o")} ELSE o END AS y FROM o),
    j AS (SELECT doc_id, string_agg(y, '. ' ORDER BY i) AS t FROM f GROUP BY doc_id)
    SELECT doc_id, md5(CASE WHEN right(t, 1) = '.' THEN t ELSE t || '.' END) AS h FROM j"""
)
def rule_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(rewrite.humanize("text", "doc_id")).alias("h"))


@query(f"SELECT doc_id, part, md5({_robot_sql('p', 'k')}) AS ai, md5(p) AS human FROM (SELECT doc_id, part, p, doc_id || ':' || part AS k FROM (SELECT doc_id, unnest(range(len(l))) AS part, unnest(l) AS p FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents)) WHERE {S.n_words('p')} > 10)")
def synthetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rewrite.synthetic_pairs(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
    return made.select("doc_id", F.col("part").cast("long").alias("part"), F.md5("ai_text").alias("ai"), F.md5("human_text").alias("human"))


_VARIANTS = f"""SELECT DISTINCT unnest(list_filter([t, CASE WHEN o THEN t || '.' END, CASE WHEN o THEN t || '!' END, lower(t), upper(substr(t, 1, 1)) || lower(substr(t, 2)),
    {", ".join(f"CASE WHEN w < 10 THEN {S.q(x)} || lower(t) END" for x in P.FILLER_PREFIXES)}, {", ".join(f"CASE WHEN w < 10 THEN t || {S.q(x)} END" for x in P.FILLER_SUFFIXES)}], lambda x: x IS NOT NULL)) AS v
    FROM (SELECT t, right(t, 1) NOT IN ('.', '!', '?') AS o, {S.n_words("t")} AS w FROM (SELECT unnest({S.sentences(TEXT)}) AS t FROM documents) WHERE {S.n_words("t")} <= 12)"""


@query(f"SELECT md5(v) AS h FROM ({_VARIANTS})")
def sentence_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_sentences(docs(spark, sf_dir).select(text().alias("text")), "text").where(X.n_words("sentence") <= 12)
    return synthetic.variants(rows, "sentence").select(F.md5("variant").alias("h"))


@query("SELECT doc_id, md5('A: one' || chr(10) || '---' || chr(10) || 'B: two' || chr(10) || chr(10) || 'Rewrite: ' || text) AS h FROM documents")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(synthetic.prompt(["A: one", "B: two"], "Rewrite: {text}", "text")).alias("h"))


# Collection


def sources(spark: SparkSession, sf_dir: str) -> list[collect.Source]:
    """Documents as human texts, capped, then user and assistant turns by role."""
    rows = lambda: docs(spark, sf_dir)
    said = lambda: turns(spark, sf_dir)
    return [
        collect.Source("documents_en", lambda: rows().where("lang = 'en'"), collect.labelled((F.col("text"), "human")), "doc_id", cap=300),
        collect.Source("documents", rows, collect.labelled((F.col("text"), "human")), "doc_id", most=1000, unique=0.3),
        collect.Source("turns", said, F.array(F.struct("text", "label")), "id", least=5),
    ]


@query(
    f"""WITH a AS (SELECT doc_id AS o, text, substr(md5(substr(text, 1, 1000)), 1, 16) AS h FROM documents WHERE lang = 'en' AND {S.accepted(TEXT)}),
    a1 AS (SELECT h, min(o) AS o FROM a GROUP BY h ORDER BY min(o) LIMIT 300),
    b1 AS (SELECT substr(md5(substr(text, 1, 1000)), 1, 16) AS h, min(doc_id) AS o FROM documents WHERE {S.accepted(TEXT, 15, 1000, 0.3)} GROUP BY 1),
    b2 AS (SELECT * FROM b1 WHERE h NOT IN (SELECT h FROM a1)),
    c1 AS (SELECT substr(md5(substr(text, 1, 1000)), 1, 16) AS h, min(id) AS o FROM {TURNS} WHERE {S.accepted(TEXT, 5)} GROUP BY 1),
    c2 AS (SELECT * FROM c1 WHERE h NOT IN (SELECT h FROM a1) AND h NOT IN (SELECT h FROM b2))
    SELECT 'documents_en' AS source, h AS hash FROM a1 UNION ALL SELECT 'documents', h FROM b2 UNION ALL SELECT 'turns', h FROM c2"""
)
def collect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, dedup across sources, cap: the cap is the feature."""
    return collect.collect(sources(spark, sf_dir)).select("source", "hash")


# Tokens, models


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", F.lower("text").alias("text"))


_VOCAB = f"SELECT word, n, 1 + row_number() OVER (ORDER BY n DESC, word) AS token_id FROM (SELECT word, count(*) AS n FROM (SELECT unnest({S.words('lower(text)')}) AS word FROM {TURNS}) GROUP BY word ORDER BY n DESC, word LIMIT 2000)"


@query(f"SELECT word, n, token_id FROM ({_VOCAB})")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(worded(spark, sf_dir), "text", 2000).select("word", "n", F.col("token_id").cast("long").alias("token_id"))


@query(
    f"""WITH t AS (SELECT id, ({S.words("lower(text)")})[1:64] AS w FROM {TURNS}), p AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t), v AS ({_VOCAB}),
    e AS (SELECT id, string_agg(CAST(coalesce(token_id, 1) AS VARCHAR), ',' ORDER BY i) AS ids, count(*) AS n FROM p LEFT JOIN v USING (word) GROUP BY id)
    SELECT t.id, coalesce(ids, '') AS ids, coalesce(n, 0) AS token_length, coalesce(n, 0) >= 64 AS truncated FROM t LEFT JOIN e USING (id)"""
)
def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worded(spark, sf_dir)
    made = tokens.encode(rows, "id", "text", tokens.vocabulary(rows, "text", 2000), 64)
    return made.select("id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids"), F.col("token_length").cast("long").alias("token_length"), "truncated")


@query(
    f"""WITH n AS (SELECT least({S.n_words("lower(text)")}, 64) AS n FROM {TURNS})
    SELECT count(*) AS total, count(*) FILTER (n > 0) AS processed, count(*) FILTER (n = 0) AS failed, count(*) FILTER (n >= 64) AS truncated, round(avg(n) FILTER (n > 0), 4) AS avg_length, CAST(max(n) FILTER (n > 0) AS BIGINT) AS max_length, CAST(min(n) FILTER (n > 0) AS BIGINT) AS min_length FROM n"""
)
def token_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worded(spark, sf_dir)
    made = tokens.counters(tokens.encode(rows, "id", "text", tokens.vocabulary(rows, "text", 2000), 64))
    return made.select(*(F.col(c).cast("long").alias(c) if c != "avg_length" else F.col(c) for c in made.columns))


@query(
    f"""WITH g AS (SELECT id, unnest({S.words("lower(text)")}) AS word FROM {TURNS}), u AS (SELECT word, count(*) AS n FROM g GROUP BY word), t AS (SELECT sum(n) AS total, count(*) AS types FROM u)
    SELECT id, count(*) AS n_tokens, round(exp(sum(-ln((n + 1) / (total + types + 1))) / count(*)), 2) AS perplexity FROM g JOIN u USING (word), t GROUP BY id"""
)
def unigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("id", "text")
    made = language_model.perplexity(rows, "id", "text", language_model.train(rows, "id", "text"), first_tokens=None)
    return made.where("n_tokens > 0")


@query()
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents split, a quality classifier fitted on the train part, judged on the rest."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    rows = sampling.stratified_split(rows, "label", "doc_id")
    made = classifier.predict(classifier.fit(rows.where("split = 'train'"), features=1 << 12), rows.where("split <> 'train'"))
    return reports.confusion(made.withColumn("p", F.col("is_ai").cast("int")), "label", "p")


@query("SELECT id, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 9) AS loss FROM (SELECT id, CASE WHEN label = 'ai' THEN 0.95 ELSE 0.05 END AS y, (id % 97 + 1) / 99 AS p FROM " + TURNS + ")")
def smoothed_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir)
    return rows.select("id", F.round(classifier.smoothed_loss(X.encode_label("label"), (F.col("id") % 97 + 1) / 99), 9).alias("loss"))


@query("SELECT doc_id, share, c, round(c / t * 100, 2) AS pct FROM (SELECT doc_id, source AS share, count(*) OVER (PARTITION BY source) AS c, count(*) OVER () AS t FROM documents)")
def source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's source and the source's share, by two aggregations and a join rather than a window over all rows."""
    rows = docs(spark, sf_dir).select("doc_id", "source")
    counts = rows.groupBy("source").agg(F.count("*").alias("c")).withColumn("t", F.sum("c").over(Window.partitionBy()))
    return rows.join(counts, "source").select("doc_id", F.col("source").alias("share"), "c", F.round(F.col("c") / F.col("t") * 100, 2).alias("pct"))


# Streaming


@query(f"SELECT DISTINCT substr(md5(substr(text, 1, 1000)), 1, 16) AS hash FROM documents WHERE {S.accepted(TEXT)}")
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file stream, filtered and deduplicated with state, written exactly once, read again."""
    schema = docs(spark, sf_dir).schema
    folder = scratch(spark)
    stream = ingest.accepted_once(ingest.read(spark, f"{sf_dir}/documents.parque[t]", schema))
    ingest.to_parquet(stream.select("hash"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("hash string").parquet(f"{folder}/out")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the corpus: tumbling windows over the event table, as a batch of the streaming definition."""
    return ingest.counts_by(table(spark, sf_dir, "events"), "event_type", "ts", "1 hour", "1 hour")

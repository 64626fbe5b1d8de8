"""Queries over samples, ids, reports by split, filters, grammar, scored windows, rewrites and training figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import cleaning, formatting, grammar, metrics, rewrite, validity
from textlake.functions import patterns as P
from textlake.functions import text as X
from textlake.operators import chunking, classifier, dedup, language, language_model, reports, sampling, tokens, training
from textlake.operators.ranking import positions
from textlake.plans import sql as S
from textlake.plans.queries import _EVALUATED, _PAIRS, _TURN_SCORES, _VOCAB, _split_sql, compared, evaluated, keyed, paired_turns, worded
from textlake.plans.registry import CLASSED, TEXT, TURNS, classed, docs, query, table, text, turns
from textlake.sources import synthetic

# Samples and ids


@query(
    f"""SELECT coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'd' || doc_id END, printf('sample_%08d', r)) AS id, label, source, CAST(length(text) AS BIGINT) AS length, CAST({S.n_words("text")} AS BIGINT) AS word_count, n_chars AS original_length
    FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM {CLASSED})"""
)
def format_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the samples' form; every third has no id and gets one of its place."""
    rows = classed(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("d"), "doc_id")).alias("id"), "text", "label", "source", F.col("n_chars").alias("original_length"))
    made = formatting.samples(rows, "doc_id")
    return made.select("id", "label", "source", F.col("length").cast("long").alias("length"), F.col("word_count").cast("long").alias("word_count"), "metadata.original_length")


@query(f"SELECT doc_id, printf('%s_%08d', label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1) AS id FROM (SELECT doc_id, label, {S.reason('t')} AS reason FROM (SELECT doc_id, label, {TEXT} AS t FROM {CLASSED})) WHERE reason = 'valid'")
def cleaned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows, numbered within their class."""
    rows = classed(spark, sf_dir).where(validity.reason("text") == "valid").select("doc_id", "label")
    return formatting.cleaned_ids(rows, "doc_id").select("doc_id", "id")


@query(f"SELECT id, label FROM (SELECT id, label, row_number() OVER (ORDER BY {S.rank_hash('id', 42)}, id) AS r FROM {TURNS}) WHERE r <= 20")
def drawn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows to look at; the number is the feature."""
    return sampling.drawn(keyed(spark, sf_dir), "id", 20)


@query("SELECT doc_id AS original, '' AS humanized FROM documents ORDER BY doc_id LIMIT 10")
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten texts with an empty target, to be filled by hand."""
    return rewrite.template_rows(docs(spark, sf_dir).select("doc_id"), "doc_id", "doc_id", 10)


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM documents")
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order, each with its place."""
    return positions(docs(spark, sf_dir).select("doc_id", "n_chars"), ("n_chars", "doc_id")).select("doc_id", F.col("position").cast("long").alias("place"))


# Filters


@query(f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR text IS NULL OR text = '' THEN 'no_text' ELSE {S.reason('t')} END AS reason FROM (SELECT doc_id, text, {TEXT} AS t FROM documents)")
def no_text_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons, where a row whose raw text is missing (here every seventh) says so."""
    raw = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    return docs(spark, sf_dir).select("doc_id", validity.reason("text", raw=raw).alias("reason"))


@query(f"SELECT id FROM {TURNS} WHERE {S.n_words(TEXT)} BETWEEN 20 AND 300")
def word_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where(validity.word_bounds(text(), 20, 300)).select("id")


@query(f"SELECT md5(t) AS h FROM (SELECT DISTINCT {S.strip('s')} AS t FROM (SELECT unnest({S.sentences(TEXT)}) AS s FROM documents)) WHERE {S.n_words('t')} BETWEEN 5 AND 30")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences of five to thirty words."""
    rows = chunking.explode_sentences(docs(spark, sf_dir).select(text().alias("text")), "text").select(X.strip("sentence").alias("t"))
    return rows.where(validity.short_text("t")).distinct().select(F.md5("t").alias("h"))


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang, source FROM documents) WHERE lang IS NOT NULL AND source IS NOT NULL")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without null in the wanted columns; here every fifth has one."""
    rows = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), "source")
    return rows.dropna(subset=["lang", "source"]).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text, lang FROM documents) WHERE text <> '' AND lang <> ''")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"), "lang")
    return rows.where(validity.required("text", "lang")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 20 AND 10000")
def char_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.length("text").between(20, 10_000)).select("doc_id")


_TOP = f"""(SELECT lang, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM (SELECT lang, unnest({S.words("lower(text)")}) AS word FROM documents WHERE lang IS NOT NULL) GROUP BY lang, word) WHERE r <= 100)"""
_DETECTED = f"""SELECT d.doc_id, h.lang AS detected FROM documents d LEFT JOIN (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, lang) AS k
    FROM (SELECT doc_id, unnest({S.words("lower(text)")}) AS word FROM documents) JOIN {_TOP} USING (word) GROUP BY doc_id, lang) WHERE k = 1) h USING (doc_id)"""


@query(_DETECTED)
def language_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language whose frequent words a document holds most."""
    rows = docs(spark, sf_dir).select("doc_id", "text", "lang")
    return language.detect(rows, "doc_id", "text", language.learn(rows))


@query(f"SELECT doc_id, CASE WHEN r <> 'valid' THEN r WHEN detected IS NULL THEN 'language_detection_failed' WHEN detected <> 'en' THEN 'wrong_language_' || detected ELSE r END AS reason FROM (SELECT doc_id, {S.reason('t')} AS r FROM (SELECT doc_id, {TEXT} AS t FROM documents)) JOIN ({_DETECTED}) USING (doc_id)")
def language_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validity rules with the detector's language last."""
    rows = docs(spark, sf_dir).select("doc_id", "text", "lang")
    found = language.detect(rows, "doc_id", "text", language.learn(rows))
    return rows.join(found, "doc_id").select("doc_id", validity.reason("text", language=F.col("detected")).alias("reason"))


# Reports


@query(
    f"""WITH {S.clean_ctes("documents", "doc_id", "text")}, r AS (SELECT doc_id, {S.reason("t")} AS reason, md5(t) AS h FROM cleaned),
    d AS (SELECT *, row_number() OVER (PARTITION BY reason = 'valid', h ORDER BY doc_id) AS k FROM r)
    SELECT count(*) AS processed, count(*) FILTER (reason = 'valid' AND k = 1) AS valid, count(*) FILTER (reason <> 'valid' OR k > 1) AS removed, round(count(*) FILTER (reason <> 'valid' OR k > 1) / count(*) * 100, 2) AS removal_rate,
    count(*) FILTER (reason = 'valid' AND k > 1) AS duplicates, count(*) FILTER (reason = 'too_short') AS too_short, count(*) FILTER (reason = 'too_long') AS too_long, count(*) FILTER (reason = 'low_alpha_ratio') AS low_alpha_ratio FROM d"""
)
def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning steps and rules over all documents: what was processed, is valid, was removed and why."""
    rows = docs(spark, sf_dir).select(cleaning.clean("text").alias("t")).select(validity.reason("t").alias("reason"), X.hash_exact("t").alias("h"))
    made = reports.cleaning(rows, "reason", "h")
    of = lambda x: F.coalesce(F.try_element_at("by_reason", F.lit(x)), F.lit(0)).alias(x)
    return made.select("processed", "valid", "removed", "removal_rate", "duplicates", of("too_short"), of("too_long"), of("low_alpha_ratio"))


@query(f"SELECT split, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split) * 100, 2) AS pct FROM ({_split_sql(0.1, 0.1 / 0.9)}) GROUP BY split, label")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_split(sampling.stratified_split(keyed(spark, sf_dir), "label", "id"), "split", "label")


@query(f"SELECT label, source, count(*) AS n FROM {CLASSED} GROUP BY ROLLUP (label, source)")
def class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by class, by class and source, and in all."""
    return classed(spark, sf_dir).rollup("label", "source").agg(F.count("*").alias("n"))


_STRATA = f"(SELECT id, text, CASE WHEN w <= 30 THEN 'short' WHEN w <= 100 THEN 'medium' ELSE 'long' END AS stratum, w FROM (SELECT id, text, {S.n_words('text')} AS w FROM {TURNS}))"


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {S.rank_hash("id", 42)}, id) AS r, count(*) OVER (PARTITION BY stratum) AS t FROM {_STRATA}), b AS (SELECT 'before' AS "when", w FROM s UNION ALL SELECT 'after', w FROM s WHERE stratum <> 'short' OR r <= floor(t / 3))
    SELECT "when", count(*) AS n, round(sum(w) / count(*), 4) AS avg_words, count(*) FILTER (w < 20) AS n_short FROM b GROUP BY 1"""
)
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts before short texts are thinned out, and after."""
    rows = turns(spark, sf_dir).select("id", "text")
    after = sampling.remix(rows, validity.length_stratum("text"), "id").select("id", "text")
    both = rows.withColumn("w", F.lit("before")).unionByName(after.withColumn("w", F.lit("after")))
    return reports.length_profile(both, "text", F.col("w"))


@query(f"SELECT source, repeat('█', CAST(floor(c / t * 20) AS INTEGER)) AS bar, printf('%.1f%%', round(c / t * 100, 1)) AS share FROM (SELECT source, count(*) AS c, sum(count(*)) OVER () AS t FROM documents GROUP BY source)")
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with a bar and a percentage."""
    rows = reports.distribution(docs(spark, sf_dir), "source").withColumn("t", F.expr("sum(n) over ()"))
    share = F.col("n") / F.col("t")
    return rows.select("source", formatting.bar(share, 20).alias("bar"), formatting.percent(share, 1).alias("share"))


# Grammar, perplexity, comparison

_GRAMMAR = f"""(SELECT doc_id, i - 1 AS "offset", x AS word, lower(x) AS l, coalesce(lower(b), '') AS p, coalesce(b, '') AS b FROM (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {S.words(TEXT)} AS w FROM documents))))"""
_BROKEN = f"""SELECT doc_id, 'REPEATED_WORD' AS rule, "offset", word AS suggestion FROM {_GRAMMAR} WHERE l = p AND regexp_matches(l, '^[a-z]+$')
    UNION ALL SELECT doc_id, 'ARTICLE', "offset", CASE WHEN p = 'a' THEN 'an ' ELSE 'a ' END || word FROM {_GRAMMAR} WHERE (p = 'a' AND substr(l, 1, 1) IN ('a', 'e', 'i', 'o', 'u')) OR (p = 'an' AND regexp_matches(substr(l, 1, 1), '^[a-z]$') AND substr(l, 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u'))
    UNION ALL SELECT doc_id, 'LOWER_I', "offset", 'I' FROM {_GRAMMAR} WHERE word = 'i'
    UNION ALL SELECT doc_id, 'LOOSE_MARK', "offset", b || word FROM {_GRAMMAR} WHERE regexp_matches(word, '^[,.;:!?]')"""


@query(_BROKEN)
def grammar_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error of the built-in grammar rules with its place and what to write instead."""
    rows = docs(spark, sf_dir).select("doc_id", F.explode(grammar.errors("text")).alias("e"))
    return rows.select("doc_id", "e.rule", F.col("e.offset").cast("long").alias("offset"), F.col("e.suggestions")[0].alias("suggestion"))


@query(f"SELECT doc_id, n, {S.label('rate', P.GRAMMAR_LABELS, '<').replace('CASE', f'CASE WHEN rate = 0 THEN {S.q(P.NO_GRAMMAR_ERRORS)}', 1)} AS label, rate FROM (SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN w > 0 THEN {S.rounded('coalesce(n, 0) / w * 100', 2)} ELSE 0.0 END AS rate FROM (SELECT doc_id, {S.n_words(TEXT)} AS w FROM documents) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_BROKEN}) GROUP BY doc_id) USING (doc_id))")
def grammar_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors for each hundred words, and their label."""
    rows = docs(spark, sf_dir).select("doc_id", "text", grammar.n_errors("text").alias("g"))
    made = rows.select("doc_id", F.col("g").cast("long").alias("n"), X.n_words(text()).alias("w"))
    made = made.withColumn("rate", F.when(F.col("w") > 0, F.round(F.col("n") / F.col("w") * 100, 2)).otherwise(0.0))
    return made.select("doc_id", "n", metrics.grammar_label("rate").alias("label"), "rate")


@query(
    f"""SELECT doc_id, CASE WHEN e THEN 0.0 ELSE {S.EASE} END AS reading_ease, CASE WHEN e THEN 0.0 ELSE CAST(n AS DOUBLE) END AS n_sentences, CASE WHEN e THEN '{P.NO_TEXT}' ELSE {S.label(f"({S.EASE})", P.EASE_LABELS, ">=")} END AS ease_label
    FROM (SELECT r.*, {S.collapse("d.t")} = '' AS e FROM ({S.READING.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text FROM documents)").replace("JOIN documents", "JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text FROM documents) d0")}) r JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE coalesce(text, '') END AS t FROM documents) d USING (doc_id))"""
)
def complexity_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-alone analysis, with zeros for empty texts, here every ninth."""
    rows = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text")).alias("text"))
    return metrics.complexity(rows).select("doc_id", "reading_ease", "n_sentences", "ease_label")


_GRAMS = f"""(SELECT id, i - 1 AS place, w[i] AS word, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS before FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, {S.words("lower(text)")} AS w FROM {TURNS})))"""
_CHANCES = f"""WITH g AS (SELECT * FROM {_GRAMS}), u AS (SELECT word, count(*) AS n FROM g GROUP BY word), t AS (SELECT sum(n) AS total, count(*) AS types FROM u), b AS (SELECT before, word, count(*) AS k FROM g GROUP BY before, word), f AS (SELECT before, sum(k) AS m FROM b GROUP BY before),
    c AS (SELECT id, place, CAST(0.5 AS DOUBLE) * k / m + CAST(0.5 AS DOUBLE) * ((n + 1) / (total + types + 1)) AS chance FROM g JOIN u USING (word) JOIN b USING (before, word) JOIN f USING (before), t)"""


@query(f"{_CHANCES} SELECT id, count(*) AS n_tokens, round(exp(sum(-ln(chance)) / count(*)), 2) AS perplexity FROM c GROUP BY id")
def bigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("id", "text")
    return language_model.perplexity(rows, "id", "text", language_model.train(rows, "id", "text"), bigram_weight=0.5).where("n_tokens > 0")


@query(f'{_CHANCES} SELECT id, w * 32 AS "begin", max(place) + 1 AS "end", count(*) AS n_tokens, round(sum(-ln(chance)), 4) AS nll FROM (SELECT *, CAST(greatest(ceil((place + 1 - 64) / 32), 0) AS BIGINT) AS w FROM c) GROUP BY id, w')
def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 tokens, 32 apart, each with the likelihood of its new tokens."""
    rows = turns(spark, sf_dir).select("id", "text")
    made = language_model.windows(rows, "id", "text", language_model.train(rows, "id", "text"), 64, 32)
    return made.select("id", "begin", "end", F.col("n_tokens").cast("long").alias("n_tokens"), F.round("nll", 4).alias("nll"))


@query(f"SELECT doc_id, round(ln(ppl), 6) AS log_perplexity FROM ({_EVALUATED})")
def log_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("doc_id", F.round(metrics.log_perplexity("perplexity"), 6).alias("log_perplexity"))


_MOVES = " UNION ALL ".join(
    f"SELECT pair, {i} AS i, '{name}' AS name, {before} AS o, {after} AS z, {higher} AS higher FROM p"
    for i, (name, higher, before, after) in enumerate((("perplexity", True, "p0", "p1"), ("burstiness", True, "b0", "b1"), ("reading_ease", True, "e0", "e1"), ("cv", True, "c0", "c1"), ("human_score", True, "h0", "h1")))
)
_MOVED = f"""WITH s AS ({_TURN_SCORES}), p AS (SELECT a.id AS pair, a.h AS h0, z.h AS h1, a.ppl AS p0, z.ppl AS p1, a.b AS b0, z.b AS b1, a.ease AS e0, z.ease AS e1, a.cv AS c0, z.cv AS c1 FROM s a JOIN s z ON z.id = a.id + 1 AND a.label = 'human' AND z.label = 'ai'),
    m AS ({_MOVES}), k AS (SELECT pair, i, name, {S.rounded("abs((z - o) / abs(o) * 100)", 2)} AS pct, (z > o) = higher AS better FROM m WHERE o <> 0 AND z <> o)"""


@query(f"{_MOVED} SELECT pair, name, better, pct FROM k")
def compare_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What got better and what worse between two texts, in percent."""
    rows = compared(spark, sf_dir)
    side = lambda c, better: rows.select("pair", F.explode(c).alias("name", "pct"), F.lit(better).alias("better"))
    return side("improvements", True).unionByName(side("degradations", False)).select("pair", "name", "better", "pct")


def _listed_sql(better: str, sign: str) -> str:
    shown = f"printf('%.1f', {S.rounded('pct', 1)})"
    return f"(SELECT pair, string_agg(name || ' ({sign}' || {shown} || '%)', ', ' ORDER BY pct DESC, i) AS l FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY pct DESC, i) AS r FROM k WHERE {better}) WHERE r <= 3 GROUP BY pair)"


@query(
    f"""{_MOVED} SELECT pair, concat_ws(' ', CASE WHEN h1 - h0 > 5 THEN '✅ Humanization successful! Overall human score improved by ' || printf('%.1f', {S.rounded("h1 - h0", 1)}) || ' points.' ELSE '⚠️ Humanization had limited impact. Overall change: ' || printf('%.1f', {S.rounded("h1 - h0", 1)}) || ' points.' END,
    'Main improvements: ' || u.l, 'Areas of concern: ' || w.l, CASE WHEN {S.label("h0", P.SOURCE_LABELS, ">=")} <> {S.label("h1", P.SOURCE_LABELS, ">=")} THEN 'Classification changed: ' || {S.label("h0", P.SOURCE_LABELS, ">=")} || ' → ' || {S.label("h1", P.SOURCE_LABELS, ">=")} END) AS summary
    FROM p LEFT JOIN {_listed_sql("better", "+")} u USING (pair) LEFT JOIN {_listed_sql("NOT better", "-")} w USING (pair)"""
)
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison in words."""
    return compared(spark, sf_dir).select("pair", "summary")


@query(f"SELECT round(avg({S.GRADE}), 4) AS mean_grade, count(*) AS n FROM (SELECT l.*, {S.n_words('text')} AS w, {S.syllables('text')} AS y FROM ({S.LENGTHS.replace('doc_id', 'pair').replace('FROM documents', f'FROM (SELECT pair, after AS text FROM {_PAIRS}) p0')}) l JOIN (SELECT pair, after AS text FROM {_PAIRS}) USING (pair))")
def prediction_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean grade level of the changed texts, which stands beside their BLEU."""
    rows = metrics.evaluate(paired_turns(spark, sf_dir).select("pair", F.col("after").alias("text")))
    return rows.agg(F.round(F.avg(F.coalesce("grade_level", F.lit(0.0))), 4).alias("mean_grade"), F.count("*").alias("n"))


# Rewriting, synthetic rows, tokens, training

_CHANCE = lambda seed: S.chance(seed, "doc_id")
_AUGMENTED = f"""WITH w AS (SELECT doc_id, text, {S.words("text")} AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w),
    d AS (SELECT *, n >= 5 AND {_CHANCE(42)} < 77 AS changed, {_CHANCE(43)} < 128 AS drops, {_CHANCE(44)} % greatest(n, 1) AS a, {_CHANCE(45)} % greatest(n, 1) AS b, CASE WHEN n - greatest(1, n // 10) >= 5 THEN greatest(1, n // 10) ELSE 0 END AS k FROM n),
    m AS (SELECT doc_id, text, changed, CASE WHEN drops THEN array_to_string(list_transform(list_sort(list_transform(list_sort(list_transform(range(n), lambda i: struct_pack(h := md5(concat_ws('|', doc_id, i, '42')), i := i, w := w[i + 1])))[k + 1 :], lambda x: struct_pack(i := x.i, w := x.w))), lambda x: x.w), ' ')
    ELSE array_to_string(list_transform(range(n), lambda i: CASE WHEN i = a THEN w[b + 1] WHEN i = b THEN w[a + 1] ELSE w[i + 1] END), ' ') END AS t FROM d)
    SELECT doc_id, md5(CASE WHEN changed THEN t ELSE text END) AS h FROM m"""


@query(_AUGMENTED)
def augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.augment(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("augmented").alias("h"))


@query(f"SELECT k AS id, CASE WHEN r <= floor(round(t * 0.9, 9)) THEN 'train' ELSE 'test' END AS split FROM (SELECT k, row_number() OVER (ORDER BY {S.rank_hash('k', 42)}, k) AS r, count(*) OVER () AS t FROM (SELECT doc_id || ':' || part AS k FROM (SELECT doc_id, unnest(range(len(l))) AS part, unnest(l) AS p FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents)) WHERE {S.n_words('p')} > 10))")
def synthetic_pairs_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic pairs, nine of ten to learn from."""
    made = rewrite.synthetic_pairs(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id").select(F.concat_ws(":", "doc_id", "part").alias("id"))
    return sampling.plain_split(made, "id", 0.9, 0.0, 0.1).select("id", "split")


def _pick_sql(values: tuple[str, ...], *key: str) -> str:
    joined = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"([{', '.join(map(S.q, values))}])[CAST('0x' || substr(md5({joined}), 1, 7) AS INTEGER) % {len(values)} + 1]"


@query(
    f"""WITH r AS (SELECT unnest(range((SELECT count(*) FROM documents))) AS id), t AS (SELECT id, {_pick_sql(synthetic.TOPICS, "id", "42")} AS topic, CAST({_pick_sql(("2", "3", "4", "5"), "id", "43")} AS INTEGER) AS n FROM r),
    b AS (SELECT id, replace(array_to_string(list_concat([{_pick_sql(synthetic.OPENINGS, "id", "45")}], list_transform(range(1, n + 1), lambda i: {_pick_sql(synthetic.TRANSITIONS, "id", "47", "i")} || lower(substr({_pick_sql(synthetic.MIDDLES, "id", "44", "i")}, 1, 1)) || substr({_pick_sql(synthetic.MIDDLES, "id", "44", "i")}, 2)), [{_pick_sql(synthetic.ENDINGS, "id", "46")}]), chr(10) || chr(10)), '{{}}', topic) AS t FROM t)
    SELECT min(id) AS id, md5(any_value(t)) AS h FROM (SELECT id, t FROM b WHERE {S.accepted("t")}) GROUP BY substr(md5(substr(t, 1, 1000)), 1, 16)"""
)
def synthetic_essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic essays as there are documents; what the filter accepts, each text once."""
    return synthetic.new_essays(spark, docs(spark, sf_dir).count()).select("id", F.md5("text").alias("h"))


_TEMPLATES = ("I {verb} the {thing} today.", "The {thing} was {quality}, so I {verb} it.")
_SLOTS = {"verb": ("like", "miss", "found"), "thing": ("bus", "coffee", "new song"), "quality": ("great", "late", "fine")}
_FILLED = _pick_sql(_TEMPLATES, "id", "42")
for _i, (_slot, _values) in enumerate(_SLOTS.items()):
    _FILLED = f"replace({_FILLED}, '{{{_slot}}}', {_pick_sql(_values, 'id', str(43 + _i))})"


@query(f"SELECT min(id) AS id, t AS text FROM (SELECT id, {_FILLED} AS t FROM (SELECT unnest(range(500)) AS id)) GROUP BY t")
def short_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences of 500 draws of a template and words."""
    return synthetic.short_sentences(spark, _TEMPLATES, _SLOTS, 500)


@query(
    f"""WITH t AS (SELECT id, ({S.words("lower(text)")})[1:512] AS w FROM {TURNS}), p AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t), v AS ({_VOCAB}),
    e AS (SELECT id, list(coalesce(token_id, 1) ORDER BY i) AS ids FROM p LEFT JOIN v USING (word) GROUP BY id)
    SELECT id, md5(array_to_string(list_concat(l, list_transform(range(512 - len(l)), lambda x: 0)), ',')) AS input_ids, len(l) AS attended FROM (SELECT t.id, coalesce(ids, []) AS l FROM t LEFT JOIN e USING (id))"""
)
def padded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids padded to 512, and how many of them are attended."""
    rows = worded(spark, sf_dir)
    made = tokens.encode(rows, "id", "text", tokens.vocabulary(rows, "text", 2000))
    ids = F.array_join(tokens.padded("input_ids", 512).cast("array<string>"), ",")
    attended = F.aggregate(tokens.mask("input_ids", 512), F.lit(0), lambda a, x: a + x).cast("long")
    return made.select("id", F.md5(ids).alias("input_ids"), attended.alias("attended"))


@query(
    f"""WITH s AS ({_split_sql(0.1, 0.1 / 0.9)}), n AS (SELECT split, least({S.n_words("lower(text)")}, 512) AS n FROM {TURNS} JOIN s USING (id))
    SELECT split, count(*) AS total, count(*) FILTER (n > 0) AS processed, count(*) FILTER (n >= 512) AS truncated, CAST(max(n) AS BIGINT) AS max_length FROM n GROUP BY split"""
)
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splits encoded with the vocabulary of all, and a report on each."""
    rows = worded(spark, sf_dir)
    split = sampling.stratified_split(keyed(spark, sf_dir), "label", "id").select("id", "split")
    made = tokens.encode(rows, "id", "text", tokens.vocabulary(rows, "text", 2000)).join(split, "id")
    n = F.col("token_length")
    return made.groupBy("split").agg(F.count("*").alias("total"), F.sum((n > 0).cast("long")).alias("processed"), F.sum((n >= 512).cast("long")).alias("truncated"), F.max(n).cast("long").alias("max_length"))


@query("SELECT epoch, count(*) AS n, round(avg(loss), 6) AS mean_loss FROM (SELECT id % 5 AS epoch, -(y * ln(p) + (1 - y) * ln(1 - p)) AS loss FROM (SELECT id, CASE WHEN label = 'ai' THEN 0.95 ELSE 0.05 END AS y, (id % 97 + 1) / 99 AS p FROM " + TURNS + ")) GROUP BY epoch")
def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a smoothed loss by epoch, here the id's remainder."""
    rows = keyed(spark, sf_dir).select((F.col("id") % 5).alias("epoch"), classifier.smoothed_loss(X.encode_label("label"), (F.col("id") % 97 + 1) / 99).alias("loss"))
    return training.mean_loss(rows, "epoch", "loss")


@query(
    """WITH h AS (SELECT conv_id AS epoch, count(*) AS f1 FROM conversations GROUP BY conv_id), b AS (SELECT *, max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM h),
    i AS (SELECT epoch, f1, o IS NULL OR f1 > o AS improved, max(f1) OVER (ORDER BY epoch) AS best FROM b), s AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) >= 3 AS late FROM i)
    SELECT epoch, f1, improved, best, coalesce(bool_or(late) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM s"""
)
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training's history, here conversations by their number of turns: the best so far, and where patience ends it."""
    history = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("epoch")).agg(F.count("*").alias("f1"))
    return training.early_end(history, "epoch", "f1", 3).select("epoch", "f1", "improved", "best", "stopped")


@query("SELECT n_name AS module, CAST((n_nationkey + 1) * 64 * 128 * 3 AS BIGINT) AS frozen, CAST(((n_nationkey + 1) * 64 + 128) * 8 * 3 AS BIGINT) AS trainable FROM nation")
def adapter_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of low-rank adapters, for modules that the nations stand for."""
    layers = table(spark, sf_dir, "nation").select(F.col("n_name").alias("module"), ((F.col("n_nationkey") + 1) * 64).alias("d_in"), F.lit(128).alias("d_out"), F.lit(3).alias("n"))
    return training.adapters(layers, 8, 16).select("module", "frozen", "trainable")


@query(
    f"""WITH w AS (SELECT doc_id, {S.words(TEXT)} AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(w) / 500) AS BIGINT))) AS chunk_no, w FROM w), t AS (SELECT doc_id, chunk_no, array_to_string(w[chunk_no * 500 + 1 : chunk_no * 500 + 500], ' ') AS t FROM c)
    SELECT md5(t) AS h FROM (SELECT t FROM t WHERE {S.accepted("t")} QUALIFY row_number() OVER (PARTITION BY substr(md5(substr(t, 1, 1000)), 1, 16) ORDER BY doc_id, chunk_no) = 1)"""
)
def word_chunks_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 500 words that the collectors' filter accepts, each prefix once."""
    rows = chunking.explode_chunks(docs(spark, sf_dir).select("doc_id", "text"), "text", 500).where(validity.accepted("chunk"))
    rows = rows.withColumn("o", F.struct("doc_id", "chunk_no"))
    return dedup.first_wins(rows, X.hash_prefix("chunk"), "o").select(F.md5("chunk").alias("h"))

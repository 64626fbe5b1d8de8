"""Queries over readers and sinks: tables are written in a format into the shared folder and read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.functions import formatting
from textlake.operators import reports, tokens
from textlake.plans import sql as S
from textlake.plans.queries import _EVALUATED, _SCORE, _VOCAB, evaluated, worded
from textlake.plans.registry import CLASSED, TURNS, classed, docs, query, scratch, table, turns
from textlake.sources import readers
from textlake.streaming import ingest

_ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
_BLOCKS = r"list_filter(list_transform(string_split({}, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query("SELECT item_id, md5(text) AS h FROM benchmark")
def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pretty JSON array, written and read."""
    path = f"{scratch(spark)}/items.json"
    readers.write_json_array(table(spark, sf_dir, "benchmark").select("item_id", "text"), path)
    return readers.json_file(spark, path, _ITEM).select("item_id", F.md5("text").alias("h"))


def _broken(spark: SparkSession, sf_dir: str) -> str:
    """JSON lines of the documents, of which every tenth is cut off, and every eleventh followed by an empty line."""
    rows = docs(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text", "source")).alias("j"))
    line = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit('{"id": '), F.substring(F.md5("j"), 1, 5))).otherwise(F.col("j"))
    path = f"{scratch(spark)}/lines"
    rows.select(F.when(F.col("doc_id") % 11 == 0, F.concat(line, F.lit("\n"))).otherwise(line).alias("value")).write.text(path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0")
def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which some are broken: these are dropped."""
    return readers.jsonl(spark, _broken(spark, sf_dir)).where("id is not null").select("id", "source", F.md5("text").alias("h"))


@query("SELECT count(*) AS lines, count(*) FILTER (doc_id % 10 = 0) AS broken FROM documents")
def jsonl_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.broken_lines(spark, _broken(spark, sf_dir)).agg(F.sum("lines").alias("lines"), F.sum("broken").alias("broken"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS h FROM documents")
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written by the sink and read with broken ones kept, of which there are none."""
    path = f"{scratch(spark)}/lines"
    readers.write_jsonl(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"), path)
    rows = readers.jsonl(spark, path, strict=True)
    return rows.where(F.col(readers.CORRUPT).isNull()).select("id", F.md5("text").alias("h"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CAST(n_chars AS VARCHAR) AS n_chars, md5(coalesce(text, '')) AS h FROM documents")
def csv_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns as csv with a header, texts with line ends and quotes and all; read again, every column is a string."""
    path = f"{scratch(spark)}/csv"
    readers.write_csv(docs(spark, sf_dir), path, ("doc_id", "source", "n_chars", "text"))
    return readers.csv_file(spark, path).select("doc_id", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("h"))


@query(f"SELECT md5(t) AS h FROM (SELECT unnest({_BLOCKS.format('text')}) AS t FROM benchmark)")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text files, whose blocks are parted by empty lines."""
    path = f"{scratch(spark)}/txt"
    table(spark, sf_dir, "benchmark").repartition(4).select(F.concat("text", F.lit("\n")).alias("value")).write.text(path)
    return readers.text_blocks(spark, path).select(F.md5("text").alias("h"))


@query(
    f"""WITH b AS (SELECT item_id, text FROM benchmark)
    SELECT 'ai' AS label, 'one' AS source, 0 AS kind, md5(text) AS h FROM b UNION ALL SELECT 'ai', 'lines', 1, md5(text) FROM b UNION ALL SELECT 'ai', 'more.lines', 1, md5(text) FROM b
    UNION ALL SELECT 'ai', 'blocks', 2, md5(t) FROM (SELECT unnest({_BLOCKS.format('text')}) AS t FROM b) UNION ALL SELECT 'ai', 'table', 3, md5(text) FROM b"""
)
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with files of all four kinds, each of which holds the items."""
    folder = scratch(spark)
    items = [r.text for r in table(spark, sf_dir, "benchmark").select("text").collect()]  # a stated query set
    lines = "\n".join(json.dumps({"text": x}) for x in items)
    contents = {
        "one.json": json.dumps([{"content": x} for x in items]),
        "lines.jsonl": lines,
        "more.lines.jsonl": lines + "\n{broken\n",
        "blocks.txt": "\n\n".join(items),
        "table.csv": "body,n\n" + "\n".join('"' + x.replace('"', '""') + '",1' for x in items),
        "other.md": "not read",
    }
    for name, content in contents.items():
        readers.write_text(spark, f"{folder}/{name}", content)
    return readers.directory(spark, folder, "ai").where("raw is not null").select("label", "source", "kind", F.md5("raw").alias("h"))


@query(
    f"""SELECT label || '_chunk_' || printf('%08d', r // 150) || '.parquet' AS file, r % 150 AS "row", doc_id
    FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS r FROM {CLASSED}) WHERE label = 'human'"""
)
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered files of 150 rows for each class; those of one class read by their prefix, in order."""
    folder = scratch(spark)
    readers.write_numbered(classed(spark, sf_dir).select("doc_id", "label", "text"), folder, "doc_id", 150)
    return readers.parquet_by_prefix(spark, folder, "human_").select("file", F.col("row").cast("long").alias("row"), "doc_id")


@query("SELECT r // 300 AS file_no, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) GROUP BY 1")
def exact_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of just 300 rows."""
    path = f"{scratch(spark)}/chunks"
    readers.rechunk(docs(spark, sf_dir).select("doc_id", "text"), path, "doc_id", 300)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.first("file_no").cast("long").alias("file_no"), F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return files.drop("f")


@query("SELECT label, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS s FROM (SELECT doc_id, doc_id % 2 AS label, length(text) AS c FROM documents WHERE doc_id % 5 <> 4) WHERE c >= 20 GROUP BY label")
def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files whose label is a name, a number or in the file's name; those without any, and short texts, are left out."""
    folder = scratch(spark)
    rows = classed(spark, sf_dir).select("doc_id", "text", "label")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    bare = rows.where("doc_id % 5 in (2, 3)")
    kinds = {
        "named": rows.where("doc_id % 5 = 0").select("text", "doc_id", "label"),
        "counted": rows.where("doc_id % 5 = 1").select("text", "doc_id", (F.col("label") == "ai").cast("int").alias("label_int")),
        "human_texts": bare.where("label = 'human'").select("text", "doc_id"),
        "some_ai": bare.where("label = 'ai'").select("text", "doc_id"),
        "train": rows.where("doc_id % 5 = 4").select("text", "doc_id"),
    }
    for name, part in kinds.items():
        part.coalesce(1).write.parquet(f"{folder}/_{name}")
        system.rename(system.globStatus(path(f"{folder}/_{name}/*.parquet"))[0].getPath(), path(f"{folder}/{name}.parquet"))
        system.delete(path(f"{folder}/_{name}"), True)
    found = None
    for name in kinds:  # each file has columns of its own
        part = readers.labelled_parquet(spark, f"{folder}/{name}.parquet", also=("doc_id",))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("label").agg(F.count("*").alias("n"), F.sum("doc_id").alias("s"))


@query(f"SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) AS k, count(*) OVER (PARTITION BY label) AS t FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM {TURNS}) WHERE r <= 120) QUALIFY k <= min(t) OVER ()")
def cached_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes kept as a table, loaded cut to 120 each and balanced."""
    folder = scratch(spark)
    readers.write_cache(turns(spark, sf_dir).select("id", "label", "text"), folder)
    return readers.read_cache(spark, folder, "id", 120).select("id", "label")


@query(f"SELECT label, count(*) AS n FROM {TURNS} GROUP BY label")
def cache_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that the cache's manifest states."""
    folder = scratch(spark)
    readers.write_cache(turns(spark, sf_dir).select("id", "label"), folder)
    counts = json.loads(readers.read_text(spark, f"{folder}/cache_info.json"))["counts"]
    return spark.createDataFrame(sorted(counts.items()), "label string, n long")


@query(f"SELECT a.id AS pair, md5(a.text) AS human, md5(z.text) AS ai FROM {TURNS} a JOIN {TURNS} z ON z.id = a.id + 1 AND a.label = 'human' AND z.label = 'ai'")
def pairs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts as JSON lines, and what is read of a file that isn't there: nothing."""
    rows = turns(spark, sf_dir)
    before, after = rows.where("label = 'human'").select(F.col("id").alias("pair"), F.col("text").alias("human_text")), rows.where("label = 'ai'").select((F.col("id") - 1).alias("pair"), F.col("text").alias("ai_text"))
    path = f"{scratch(spark)}/pairs.jsonl"
    readers.write_jsonl(before.join(after, "pair").select("pair", "ai_text", "human_text"), path)
    known = readers.pairs_json(spark, path).distinct().union(readers.pairs_json(spark, f"{path}.none"))
    both = before.join(after, "pair").join(known, ["ai_text", "human_text"])
    return both.select("pair", F.md5("human_text").alias("human"), F.md5("ai_text").alias("ai"))


@query(f"SELECT id FROM {TURNS} WHERE label = 'human'")
def human_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.human_only(turns(spark, sf_dir)).select("id")


@query(f"SELECT word, token_id FROM ({_VOCAB})")
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary as one JSON object, read again."""
    path = f"{scratch(spark)}/vocabulary.json"
    readers.write_vocabulary(tokens.vocabulary(worded(spark, sf_dir), "text", 2000), path)
    return spark.createDataFrame(list(json.loads(readers.read_text(spark, path)).items()), "word string, token_id long")


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM documents GROUP BY source")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as one JSON document, read again."""
    path = f"{scratch(spark)}/report.json"
    readers.write_report(reports.distribution(docs(spark, sf_dir), "source"), path)
    return readers.json_file(spark, path, T.StructType.fromDDL("source string, n long, pct double"))


@query(f"SELECT doc_id, ease AS reading_ease, b AS burstiness, cv, {_SCORE} AS human_score FROM ({_EVALUATED})")
def evaluation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations as JSON rows, parsed again."""
    kept = ("doc_id", "reading_ease", "burstiness", "cv", "human_score")
    made = evaluated(spark, sf_dir).select(F.to_json(F.struct(*kept)).alias("j"))
    return made.select(formatting.from_json("j", "doc_id long, reading_ease double, burstiness double, cv double, human_score double").alias("p")).select("p.*")


@query(
    f"""WITH t AS (SELECT id, ({S.words("lower(text)")})[1:512] AS w FROM {TURNS}), p AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t), v AS ({_VOCAB})
    SELECT id, md5(string_agg(CAST(coalesce(token_id, 1) AS VARCHAR), ',' ORDER BY i)) AS h, count(*) AS token_length FROM p LEFT JOIN v USING (word) GROUP BY id"""
)
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows as parquet arrays, read again."""
    path = f"{scratch(spark)}/tokens"
    rows = worded(spark, sf_dir)
    readers.write_tokens(tokens.encode(rows, "id", "text", tokens.vocabulary(rows, "text", 2000)), path)
    made = spark.read.parquet(path).where("token_length > 0")
    return made.select("id", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("h"), F.col("token_length").cast("long").alias("token_length"))


@query("SELECT doc_id, md5(text) AS h FROM documents")
def stream_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, written in files of at most 200 rows; a second run adds nothing."""
    folder = scratch(spark)
    for _ in range(2):
        rows = ingest.read(spark, f"{sf_dir}/documents.parque[t]", docs(spark, sf_dir).schema)
        ingest.flush(rows.select("doc_id", "text"), f"{folder}/out", f"{folder}/checkpoint", 200).awaitTermination()
    out = spark.read.schema("doc_id long, text string").parquet(f"{folder}/out")
    return out.select("doc_id", F.md5("text").alias("h"))

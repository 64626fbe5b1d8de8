"""File readers with declared schemas, and sinks. Broken lines are dropped and can be counted; they aren't fatal."""

from __future__ import annotations

import io
import json
import zipfile
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.functions.text import encode_label, first_present, strip
from textlake.operators.ranking import positions
from textlake.operators.sampling import head_balanced, undersample

SAMPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "content", "body", "label", "source", "timestamp")])
CORRUPT = "_corrupt_record"


def json_file(spark: SparkSession, path: str | list[str], schema: T.StructType = SAMPLE) -> DataFrame:
    """A list gives a row for each element, an object one row."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder by name, or the one file; none if there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in system.listStatus(at) if x.isFile()) if system.exists(at) else []


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = SAMPLE, strict: bool = False) -> DataFrame:
    """Lines that don't parse are dropped, or with ``strict`` kept with their text in ``_corrupt_record``; :func:`broken_lines` counts them."""
    if not strict:
        return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)
    return spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).json(path)


def jsonl_or_none(spark: SparkSession, path: str, schema: T.StructType = SAMPLE) -> DataFrame:
    """As :func:`jsonl`; a file that isn't there has no rows."""
    return jsonl(spark, path, schema) if files(spark, path) else spark.createDataFrame([], schema)


def broken_lines(spark: SparkSession, path: str | list[str], schema: T.StructType = SAMPLE) -> DataFrame:
    """file, lines, broken: how many lines of each file hold something, and how many of these don't parse."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select("file", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("p"))
    broken = F.col("p").isNull() | F.col(f"p.{CORRUPT}").isNotNull()
    return parsed.groupBy("file").agg(F.count("*").alias("lines"), F.sum(broken.cast("long")).alias("broken"))


def text_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parts between two line ends, stripped, without empty ones; and the file's name."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n\n")).alias("part", "text"))
    return parts.select("file", "part", strip("text").alias("text")).where("text <> ''")


def parquet_by_prefix(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """The parquet files of a folder whose names begin with ``prefix``, and their order: file (by name) and row."""
    rows = spark.read.option("pathGlobFilter", f"{prefix}*.parquet").parquet(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def csv_file(spark: SparkSession, path: str) -> DataFrame:
    """With a header; all columns are strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def samples(df: DataFrame, *more: str) -> DataFrame:
    """``raw``: the first of text, content and body that is there; label and source if they are. more: a column to keep as ``_from``."""
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return df.select(first_present(*(have(c) for c in ("text", "content", "body"))).alias("raw"), have("label").alias("label"), have("source").alias("source"), *(F.col(c).alias("_from") for c in more))


def _stem(file_name: Column) -> Column:
    """A file's name without folders and suffix."""
    return F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")


def directory(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """All json, jsonl, txt and csv files of a folder; source is the file's name without suffix.

    The kinds are in this order (kind), and within them the files by name. Files of a kind are read at once, but csv files,
    whose headers may differ.
    """
    names = files(spark, folder)
    of = lambda suffix: [x for x in names if x.endswith(f".{suffix}")]
    file = F.col("_metadata.file_name")
    parts = []
    for rank, (suffix, read) in enumerate((("json", json_file), ("jsonl", jsonl))):
        if of(suffix):
            rows = read(spark, of(suffix)).withColumn("_file", file)
            parts.append((rank, samples(rows, "_file")))
    if of("txt"):
        parts.append((2, samples(text_blocks(spark, of("txt")), "file")))
    parts += [(3, samples(csv_file(spark, x).withColumn("_file", file), "_file")) for x in of("csv")]
    if not parts:
        return spark.createDataFrame([], "raw string, label string, source string, kind int")
    made = [rows.select("raw", F.lit(label).alias("label"), _stem(F.col("_from")).alias("source"), F.lit(rank).alias("kind")) for rank, rows in parts]
    return reduce(DataFrame.unionByName, made)


def label_of(df: DataFrame, file_name: Column) -> Column:
    """0 or 1 from ``label``, else ``label_int``, else the words of the file's name; null if none tells."""
    parts = []
    if "label" in df.columns:
        named = F.lower(F.col("label").cast("string"))
        parts.append(F.when(named.isin("human", "ai"), encode_label(named)))
    if "label_int" in df.columns:
        parts.append(F.when(F.col("label_int").isin(0, 1), F.col("label_int").cast("int")))
    named = F.split(F.lower(_stem(file_name)), "[^a-z]+")
    parts.append(F.when(F.array_contains(named, "human"), 0).when(F.array_contains(named, "ai"), 1))
    return F.coalesce(*parts)


def labelled_parquet(spark: SparkSession, path: str, least_chars: int = 20, most_chars: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(text, label) and the columns ``also`` of rows whose label is known and whose length fits; unreadable files are skipped."""
    rows = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
    made = rows.select("text", label_of(rows, F.col("_metadata.file_path")).alias("label"), *also)
    fits = F.length("text") >= least_chars if most_chars is None else F.length("text").between(least_chars, most_chars)
    return made.where(fits & F.col("label").isNotNull())


def paragraphs_of_docx(content: bytes) -> list[str]:
    """The paragraphs' texts of a document; none if it can't be read."""
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as file:
            root = ElementTree.fromstring(file.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    return ["".join(t.text or "" for t in p.iter(f"{name}t")) for p in root.iter(f"{name}p")]


def docx(spark: SparkSession, path: str) -> DataFrame:
    """file, paragraph number and text of all .docx files of a folder."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                own = paragraphs_of_docx(content)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.string())], ["file", "paragraph", "text"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return found.select("path", "content").mapInArrow(run, "file string, paragraph long, text string")


def write_chunks(df: DataFrame, path: str, rows_per_file: int = 100_000, by: str | None = "label") -> None:
    """Snappy parquet files of at most so many rows, in a folder for each label."""
    writer = df.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One pretty array, row by row through the driver; for small results."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(b"["))
    for i, row in enumerate(df.toLocalIterator()):
        out.write(bytearray((("," if i else "") + "\n  " + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str)).encode()))
    out.write(bytearray(b"\n]\n"))
    out.close()


def pairs_json(spark: SparkSession, path: str) -> DataFrame:
    """(ai_text, human_text) of a JSON list or of JSON lines; a file that isn't there has no rows."""
    schema = T.StructType([T.StructField("ai_text", T.StringType()), T.StructField("human_text", T.StringType())])
    if not files(spark, path):
        return spark.createDataFrame([], schema)
    return jsonl(spark, path, schema) if path.endswith(".jsonl") else json_file(spark, path, schema)


def human_only(df: DataFrame) -> DataFrame:
    """The rows of class human; raises if there are none."""
    rows = df.where("label = 'human'")
    if rows.isEmpty():
        raise ValueError("there are no rows of class human")
    return rows


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file on whatever file system the path is of."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_report(report: DataFrame, path: str) -> None:
    """A report, whose rows are few, as one JSON document."""
    write_text(report.sparkSession, path, json.dumps([json.loads(x) for x in report.toJSON().collect()], ensure_ascii=False, indent=2))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """word to token_id as one JSON object, by token_id; a vocabulary's size is bounded."""
    rows = vocab.select("word", "token_id").orderBy("token_id").toLocalIterator()
    write_text(vocab.sparkSession, path, json.dumps({r.word: r.token_id for r in rows}, ensure_ascii=False, indent=0))


def write_cache(df: DataFrame, folder: str, label: str = "label") -> None:
    """The classes as a table, and beside it a manifest with their counts and the time."""
    df.write.mode("overwrite").partitionBy(label).parquet(f"{folder}/texts")
    counts = {str(r[0]): r[1] for r in df.groupBy(label).count().collect()}
    now = df.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    write_text(df.sparkSession, f"{folder}/cache_info.json", json.dumps({"counts": counts, "created": now}))


def read_cache(spark: SparkSession, folder: str, key: str, most: int | None = None, label: str = "label", seed: int = 42) -> DataFrame:
    """The cached classes, cut to ``most`` rows of each and to as many as the smallest has; in order of the key, then drawn by hash."""
    rows = spark.read.parquet(f"{folder}/texts")
    if most is not None:
        rows = head_balanced(rows, label, key, most)
    return undersample(rows, label, key, seed)


def write_tokens(encoded: DataFrame, folder: str) -> None:
    """Token rows as parquet, whose columns are arrays."""
    encoded.write.mode("overwrite").parquet(folder)


def rechunk(df: DataFrame, path: str, order: str, rows_per_file: int) -> None:
    """Files of just so many rows in order, the last with the rest: a folder file_no=... of one file each."""
    rows = positions(df, (order,)).withColumn("file_no", F.floor(F.col("position") / rows_per_file)).drop("position")
    rows.repartition("file_no").sortWithinPartitions("file_no", order).write.mode("overwrite").partitionBy("file_no").parquet(path)


def write_numbered(df: DataFrame, folder: str, order: str, rows_per_file: int = 100_000, label: str = "label") -> None:
    """Snappy files <label>_chunk_<number> in one folder, each of just so many rows of its label in order, the last of the rest."""
    spark = df.sparkSession
    rows = positions(df, (order,), (label,)).withColumn("_no", F.floor(F.col("position") / rows_per_file)).drop("position")
    parted = rows.withColumn("_label", F.col(label)).repartition("_label", "_no").sortWithinPartitions("_label", "_no", order)
    parted.write.mode("overwrite").option("compression", "snappy").partitionBy("_label", "_no").parquet(f"{folder}/_parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for one in system.globStatus(path(f"{folder}/_parts/_label=*/_no=*/*.parquet")):  # as many as there are files
        name, number = (x.split("=", 1)[1] for x in one.getPath().toString().split("/")[-3:-1])
        system.rename(one.getPath(), path(f"{folder}/{name}_chunk_{int(number):08d}.parquet"))
    system.delete(path(f"{folder}/_parts"), True)


def disk_usage(spark: SparkSession, path: str) -> int:
    """Bytes of all that lies in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def preview(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def merge(spark: SparkSession, path: str, out: str, rows_per_file: int = 1_000_000) -> None:
    """A folder of chunks as larger files."""
    write_chunks(spark.read.parquet(path), out, rows_per_file, by=None)

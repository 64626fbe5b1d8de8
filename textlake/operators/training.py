"""Training a classifier with a validation part and an early end; saving, finding and loading it; adapters' sizes."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textlake.operators import classifier, reports
from textlake.operators.lineage import remove
from textlake.sources.readers import files, read_text, write_text

#: Where a folder's model is looked for, the first that is there.
PLACES = ("best_model", "final_model", "")


def early_end(history: DataFrame, epoch: str, metric: str, patience: int) -> DataFrame:
    """The history with best (so far), improved and stopped: whether ``patience`` epochs since the best have passed before. An epoch is a row."""
    until = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    rows = history.withColumn("improved", F.coalesce(F.col(metric) > F.max(metric).over(before), F.lit(True)))
    rows = rows.withColumn("best", F.max(metric).over(until))
    rows = rows.withColumn("_late", (F.col(epoch) - F.max(F.when(F.col("improved"), F.col(epoch))).over(until) >= patience).cast("int"))
    return rows.withColumn("stopped", F.coalesce(F.max("_late").over(before) == 1, F.lit(False))).drop("_late")


def mean_loss(df: DataFrame, epoch: str, loss: str) -> DataFrame:
    return df.groupBy(epoch).agg(F.count("*").alias("n"), F.round(F.avg(loss), 6).alias("mean_loss"))


def f1(df: DataFrame, label: str) -> float:
    return reports.confusion(df.withColumn("p", F.col("is_ai").cast("int")), label, "p").first()["f1"]


def train(df: DataFrame, split: str = "split", text: str = "text", label: str = "label", iterations: tuple[int, ...] = (5, 10, 20, 40), patience: int = 2, features: int = 1 << 14) -> tuple[PipelineModel, list[dict]]:
    """The model with the best F1 on the rows of split ``val``, and the history; ends after ``patience`` tries without a better one."""
    learned, judged = df.where(F.col(split) == "train").cache(), df.where(F.col(split) == "val").cache()
    best, history, since = None, [], 0
    for n in iterations:
        made = classifier.pipeline(text, label, features)
        made.getStages()[-1].setMaxIter(n)
        model = made.fit(learned.where(F.col(text).isNotNull() & F.col(label).isNotNull()))
        value = f1(classifier.predict(model, judged), label)
        history.append({"iterations": n, "f1": value})
        if best is None or value > best[0]:
            best, since = (value, model), 0
        else:
            since += 1
            if since >= patience:
                break
    learned.unpersist()
    judged.unpersist()
    return best[1], history


def save(model: PipelineModel, folder: str, spark: SparkSession, metadata: dict) -> None:
    """The model, its metadata as JSON and a short card."""
    model.write().overwrite().save(f"{folder}/model")
    write_text(spark, f"{folder}/metadata.json", json.dumps(metadata, indent=2))
    write_text(spark, f"{folder}/README.md", "# Model\n\n" + "\n".join(f"- {k}: {v}" for k, v in metadata.items()) + "\n")


def find(spark: SparkSession, folder: str) -> str:
    """Where the folder's model is: the best, else the final one, else the folder itself."""
    for place in PLACES:
        at = f"{folder}/{place}".rstrip("/")
        if files(spark, f"{at}/metadata.json"):
            return at
    raise FileNotFoundError(f"no model in {folder}")


def load(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    at = find(spark, folder)
    return PipelineModel.load(f"{at}/model"), json.loads(read_text(spark, f"{at}/metadata.json"))


def clear(spark: SparkSession, folder: str) -> bool:
    """Removes a folder of intermediate files; never called by itself."""
    return remove(spark, folder)


def adapters(layers: DataFrame, rank: int, alpha: int) -> DataFrame:
    """Low-rank adapters' parameters by module: layers has module, d_in, d_out and n (how many of these there are)."""
    own = (F.col("d_in") + F.col("d_out")) * rank * F.col("n")
    return layers.select("module", (F.col("d_in") * F.col("d_out") * F.col("n")).cast("long").alias("frozen"), own.cast("long").alias("trainable"), F.round(own / (F.col("d_in") * F.col("d_out") * F.col("n")) * 100, 4).alias("pct"), F.lit(alpha / rank).alias("scale"))

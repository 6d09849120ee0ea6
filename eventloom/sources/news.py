"""News articles: the windows of a collection run, landed files, and where a broken-off run goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(spark: SparkSession, start: str, end: str, days: int = 2, batch: int = 10) -> DataFrame:
    """(last, first, n, batch): windows of `days` days from the end backwards, numbered, in batches; the last batch may be smaller."""
    if days < 2:
        raise ValueError("a window has two days at least")
    ends = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")), F.lit(days))).alias("back"))
    last = F.date_sub(F.lit(end).cast("date"), F.col("back"))
    n = F.floor(F.col("back") / days)
    return ends.select(last.cast("string").alias("last"), F.date_sub(last, days - 1).cast("string").alias("first"), n.alias("n"), F.floor(n / batch).alias("batch"))


def landed(spark: SparkSession, folder: str, form: str = "parquet") -> DataFrame:
    """All files below a folder, with `path` and the `theme` that the file's name begins with."""
    rows = spark.read.option("recursiveFileLookup", "true").option("multiLine", "true").format(form).load(folder)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("theme", F.regexp_extract("path", r"([^/_.]+)[^/]*$", 1))


def per_file_counts(news: DataFrame) -> DataFrame:
    """(path, n), and one row with a null path for all."""
    return news.rollup("path").agg(F.count(F.lit(1)).alias("n"))


def remaining(news: DataFrame, last_title: str | None, order: str = "ord") -> DataFrame:
    """The rows after the first one of the last processed title; all of them if there is none."""
    if last_title is None:
        return news
    at = news.where(F.col("title") == last_title).agg(F.min(order).alias("_at"))
    return news.crossJoin(F.broadcast(at)).where(F.col("_at").isNull() | (F.col(order) > F.col("_at"))).drop("_at")  # one row


def answer_rows(log: DataFrame) -> DataFrame:
    """A log of parallel arrays (outputs, labels, context_walks) as one row per answer, with its position."""
    zipped = log.select(*[c for c in log.columns if c not in ("outputs", "labels", "context_walks")], F.posexplode(F.arrays_zip("outputs", "labels", "context_walks")).alias("pos", "a"))
    return zipped.select(*[c for c in zipped.columns if c != "a"], "a.outputs.*", F.col("a.labels").alias("label"), F.col("a.context_walks").alias("context_walk"))


def trainer_losses(state: DataFrame, batch: int) -> DataFrame:
    """A trainer's state file (log_history) as (step, examples, loss, eval_loss), rows without either left out."""
    log = state.select(F.explode("log_history").alias("h"))
    return log.select("h.step", (F.col("h.step") * batch).alias("examples"), "h.loss", "h.eval_loss").where("loss is not null or eval_loss is not null")

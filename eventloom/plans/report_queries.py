"""Registered queries of audits, summaries and log merges, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators import metrics, sampling, walks
from eventloom.plans.queries import _LABELLED, _TEST, _split_parts, _walk_sql, query
from eventloom.plans.text_queries import _LOSS
from eventloom.plans.views import edges_sql, ev_nodes, news_edges
from eventloom.runtime import table
from eventloom.sources.news import remaining

_PPL = f"{_LOSS}, p AS (SELECT example, round(exp(sum(CASE WHEN mask THEN loss ELSE 0 END) / nullif(sum(CASE WHEN mask THEN 1 ELSE 0 END), 0)), 6) AS perplexity FROM l GROUP BY example)"


def _perplexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("example"), (F.col("l_discount").cast("double") * 10).alias("loss"), (F.col("l_returnflag") != "N").alias("mask"))
    return metrics.perplexity(rows, "example").withColumn("perplexity", F.round("perplexity", 6))


@query(f"WITH {_PPL} SELECT CASE WHEN perplexity < 80 THEN 'positive' ELSE 'negative' END AS pred, example % 2 = 0 AS label, count(*) AS n FROM p WHERE perplexity IS NOT NULL GROUP BY ALL")
def perplexity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _perplexities(spark, sf_dir).where("perplexity is not null")
    return p.groupBy(F.when(F.col("perplexity") < 80, "positive").otherwise("negative").alias("pred"), (F.col("example") % 2 == 0).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PPL}, low AS (SELECT * FROM p WHERE perplexity IS NOT NULL ORDER BY perplexity, example LIMIT 100) SELECT example % 2 = 0 AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM low), 6) AS share FROM low GROUP BY 1")
def lowest_perplexity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = _perplexities(spark, sf_dir).where("perplexity is not null").orderBy("perplexity", "example").limit(100)
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())  # over two rows
    return low.groupBy((F.col("example") % 2 == 0).alias("label")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / total).alias("share"))


@query(f"WITH {edges_sql()}{_walk_sql('1.0', 2026, 3)}, n AS (SELECT len(walk) AS n FROM w3) SELECT min(n) AS min, round(quantile_cont(n, 0.25), 6) AS q25, round(median(n), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q75, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max, round(avg(n), 6) AS mean, round(avg(CASE WHEN n > 2 THEN 1.0 ELSE 0 END), 6) AS above_2 FROM n")
def walk_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = walks.random_walks(ev_nodes(spark, sf_dir), news_edges(spark, sf_dir), 2, 4).select(F.size("walk").cast("long").alias("n"))
    q = F.percentile("n", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
    one = n.agg(F.min("n").alias("min"), q.alias("q"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.avg((F.col("n") > 2).cast("double")).alias("above_2"))
    return one.select("min", *[F.col("q")[k].alias(c) for k, c in enumerate(("q25", "median", "q75", "p95"))], "max", "mean", "above_2")


@query(f"WITH {edges_sql()}{_TEST}{_LABELLED} SELECT label_description, count(*) AS n, count(*) FILTER (label <> EXISTS (SELECT 1 FROM edges e WHERE e.u = labelled.u AND e.v = labelled.v)) AS wrong FROM labelled GROUP BY label_description")
def edge_label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = news_edges(spark, sf_dir)
    split = sampling.labelled_split(ev_nodes(spark, sf_dir), edges, 0.1, 0.5)
    there = split.join(edges.select("u", "v", F.lit(True).alias("there")), ["u", "v"], "left")
    return there.groupBy("label_description").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.coalesce("there", F.lit(False))).alias("wrong"))


@query(f"WITH {edges_sql()}{_TEST} SELECT (SELECT count(*) FROM ev_nodes) AS nodes, (SELECT count(*) FROM tested) AS test, (SELECT count(*) FROM (SELECT seq_id FROM tested INTERSECT SELECT u FROM edges)) AS with_way_out")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, test = _split_parts(spark, sf_dir)
    both = test.intersect(edges.select(F.col("u").alias("seq_id")))
    count = lambda f, name: f.agg(F.count(F.lit(1)).alias(name))
    return count(nodes, "nodes").crossJoin(count(test, "test")).crossJoin(count(both, "with_way_out"))  # single rows


@query("WITH last AS (SELECT min(d.doc_id) AS done FROM documents d JOIN documents l ON l.doc_id = 150 AND d.text = l.text) SELECT doc_id AS ord FROM documents, last WHERE done IS NULL OR doc_id > done")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after the text that row 150 holds, whole texts being the titles; all rows, if there is no such row."""
    news = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("title"))
    last = news.where("ord = 150").first()
    return remaining(news, None if last is None else last["title"]).select("ord")


@query("SELECT user_id, arg_max(props, event_id) FILTER (event_type = 'click') AS click, arg_max(props, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max_by("props", "event_id"))
    return e.select("user_id", "click", "view")


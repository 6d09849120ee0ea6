"""Registered queries of model comparisons, training samples and audits, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.rand import race_sql, u01_sql
from eventloom.functions.text import json_object
from eventloom.operators import closures, graph, parsing, prepare, sampling
from eventloom.plans.queries import _PATHS, _TEST, _split_parts, query
from eventloom.plans.views import LP_SQL, edges_sql, ev_nodes, lp_rows, news_edges
from eventloom.runtime import table

_ACCURACY = f"WITH {LP_SQL}, acc AS (SELECT model, theme, ctx, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM lp WHERE success AND label IS NOT NULL GROUP BY model, theme, ctx)"


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, theme, ctx, accuracy) of valid answers."""
    return lp_rows(spark, sf_dir).where("success and label is not null").groupBy("model", "theme", "ctx").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


@query(f"{_ACCURACY} SELECT ctx, model, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std FROM acc GROUP BY ctx, model")
def metrics_by_context_and_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(spark, sf_dir).groupBy("ctx", "model").agg(F.avg("accuracy").alias("mean"), F.stddev("accuracy").alias("std"))


@query(f"{_ACCURACY} SELECT round(avg(a.accuracy - b.accuracy), 6) AS mean, round(median(a.accuracy - b.accuracy), 6) AS median FROM acc a JOIN acc b USING (model, theme) WHERE a.ctx = 0 AND b.ctx = 4")
def context_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What separates the smallest from the largest context, over all models and themes."""
    rows = _accuracy(spark, sf_dir)
    a, b = (rows.where(F.col("ctx") == c).select("model", "theme", F.col("accuracy").alias(x)) for c, x in ((0, "a"), (4, "b")))
    gain = F.col("a") - F.col("b")
    return a.join(b, ["model", "theme"]).agg(F.avg(gain).alias("mean"), F.median(gain).alias("median"))


@query(f"WITH {LP_SQL} SELECT model, sum(CASE WHEN success THEN 0 ELSE 1 END)::BIGINT AS invalid, round(avg(CASE WHEN success THEN 0.0 ELSE 1.0 END), 6) AS invalid_rate, round(sum(CASE WHEN pred THEN 1 ELSE 0 END) / count(*), 6) AS true_rate, count(DISTINCT theme) AS themes FROM lp GROUP BY model")
def invalid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid answers, their share, the share of true ones among all, and how many themes each model answered."""
    bad = F.when(F.col("success"), 0).otherwise(1)
    return lp_rows(spark, sf_dir).groupBy("model").agg(F.sum(bad).alias("invalid"), F.avg(bad.cast("double")).alias("invalid_rate"), (F.count(F.when(F.col("pred"), 1)) / F.count(F.lit(1))).alias("true_rate"), F.countDistinct("theme").alias("themes"))


_TYPES = ("click", "view", "purchase", "refund", "unheard_of")


@query(f"SELECT o.place, o.event_type, n.n FROM (VALUES {', '.join(f'({k}, {t!r})' for k, t in enumerate(_TYPES))}) o(place, event_type) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) n USING (event_type)")
def counts_in_given_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts put into an order from outside; what does not occur has a null."""
    order = spark.createDataFrame(list(enumerate(_TYPES)), "place int, event_type string")
    return order.join(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type", "left").select("place", "event_type", "n")


_THEMES = ("de", "en", "es", "fr")


@query(f"{_ACCURACY} SELECT model, {', '.join(f'round(avg(accuracy) FILTER (theme = {t!r}), 6) AS {t}' for t in _THEMES)} FROM acc GROUP BY model")
def metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per model, a column per theme; the themes are given, so that no pass looks for them."""
    return _accuracy(spark, sf_dir).groupBy("model").pivot("theme", list(_THEMES)).agg(F.avg("accuracy")).select("model", *_THEMES)


@query("""WITH s AS (SELECT batch, CAST(ceil((SELECT count(*) FROM documents) / batch) AS BIGINT) AS steps FROM (VALUES (16), (64), (512)) b(batch)),
    e AS (SELECT *, CAST(ceil(steps / 4) AS BIGINT) AS eval_steps, CAST(ceil(steps * 0.03) AS BIGINT) AS warmup FROM s)
    SELECT batch, steps, eval_steps, warmup, (SELECT count(*) FROM range(1, steps + 1) r(i) WHERE i % eval_steps = 0) AS evaluations FROM e""")
def step_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an epoch by batch size, a quarter of them between evaluations, 3 % to warm up, and how many steps evaluate."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    plan = spark.createDataFrame([(16,), (64,), (512,)], "batch int").crossJoin(n)  # three rows and one
    plan = plan.withColumn("steps", F.ceil(F.col("n") / F.col("batch"))).withColumn("eval_steps", F.ceil(F.col("steps") / 4)).withColumn("warmup", F.ceil(F.col("steps") * F.lit(0.03)))
    return plan.select("batch", "steps", "eval_steps", "warmup", F.floor(F.col("steps") / F.col("eval_steps")).alias("evaluations"))


@query(f"WITH {edges_sql()}{_TEST}, gone AS (SELECT DISTINCT v FROM true_edges) SELECT count(*) AS edges, sum(CASE WHEN u IN (SELECT v FROM gone) THEN 1 ELSE 0 END)::BIGINT AS invalid FROM true_edges")
def invalid_test_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test edges, and those whose source is not in the training graph."""
    nodes, edges, test = _split_parts(spark, sf_dir)
    true = sampling.true_edges(edges, test, 0.5, 2026)
    left, _ = graph.train_graph(nodes, edges, true)
    marked = true.join(left.select(F.col("seq_id").alias("u"), F.lit(0).alias("bad")), "u", "left")
    return marked.agg(F.count(F.lit(1)).alias("edges"), F.sum(F.coalesce("bad", F.lit(1))).alias("invalid"))


@query(f"WITH {edges_sql()} SELECT u, v, round(weight, 6) AS weight FROM edges JOIN ev_nodes n ON n.seq_id = v ORDER BY n.t DESC, u, v LIMIT 10")
def latest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest_edges(ev_nodes(spark, sf_dir), news_edges(spark, sf_dir), 10).select("u", "v", "weight")


_DRAWN = f"""drawn AS (SELECT id, CAST(floor({u01_sql(21, "id", "'u'")} * n) AS BIGINT) AS u, CAST(floor({u01_sql(21, "id", "'v'")} * n) AS BIGINT) AS v FROM range(2000) r(id), (SELECT count(*) AS n FROM ev_nodes))"""


@query(f"""WITH {edges_sql()}, {_DRAWN} (SELECT u, v, true AS label FROM edges ORDER BY {u01_sql(21, "'train'", "u", "v")}, u, v LIMIT 60) UNION ALL
    (SELECT u, v, false FROM (SELECT u, v, min(id) AS id FROM drawn WHERE u <> v GROUP BY u, v) d WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.u = d.u AND e.v = d.v) OR (e.u = d.v AND e.v = d.u)) ORDER BY id LIMIT 60)""")
def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.labelled_training(ev_nodes(spark, sf_dir), news_edges(spark, sf_dir), 60, 21)


_BUCKETS = {"hard": (0.0, 0.5), "medium": (0.5, 0.6), "easy": (0.6, 2.0)}


@query(f"WITH {edges_sql()} " + " UNION ALL ".join(f"(SELECT u, v, {name!r} AS bucket FROM edges WHERE weight >= {low} AND weight < {high} ORDER BY {race_sql(u01_sql(31, 'u', 'v'), 'weight')}, u, v LIMIT 20)" for name, (low, high) in _BUCKETS.items()))
def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bucket_samples(news_edges(spark, sf_dir), _BUCKETS, 20, 31).select("u", "v", "bucket")


@query(f"WITH {edges_sql()}, p AS (SELECT count(*) AS m FROM (SELECT DISTINCT least(u, v), greatest(u, v) FROM edges)) SELECT round(2.0 * m / (n * (n - 1)), 6) AS density FROM p, (SELECT count(*) AS n FROM ev_nodes)")
def undirected_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected_density(ev_nodes(spark, sf_dir), news_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {edges_sql()}{_PATHS}, ego AS (SELECT source, node FROM paths WHERE dist <= 1) SELECT a.source, count(*) AS edges FROM ego a JOIN edges e ON e.u = a.node JOIN ego b ON b.source = a.source AND b.node = e.v GROUP BY a.source")
def ego_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graphs that are induced by each node and its direct successors."""
    return closures.ego_edge_counts(news_edges(spark, sf_dir))


@query("""WITH d AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE 'soon' END AS text, date_trunc('second', ts) AS s FROM events)
    SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '2000-01-01 00:00:00' ELSE strftime(s, '%Y-%m-%d %H:%M:%S') END AS published FROM d""")
def published_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as feeds write them, as ISO 8601, and none."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = F.when(k == 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", F.date_format(prepare.published_at("text", F.lit("2000-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS what, event_id % 4 <> 0 AS valid FROM events""")
def parse_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated events in their JSON form, in code fences; those that lack a key are not valid."""
    full = ("what", "where", "when", "who", "how", "why", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("what"), F.lit("here").alias("where"), F.col("ts").cast("string").alias("when"), F.col("user_id").cast("string").alias("who"), F.lit("quote \" and\nline").alias("how"), F.lit(None).cast("string").alias("why"), F.col("event_id").cast("string").alias("event_id"))
    written = F.when(F.col("id") % 4 == 0, json_object(full[1:], 2)).otherwise(json_object(full, 2))
    fields = rows.select(F.col("id").alias("event_id"), parsing.json_event(F.concat(F.lit("```json\n"), written, F.lit("\n```"))).alias("f"))
    found = fields.select("event_id", parsing.standard_event(F.col("f")).alias("e"))
    return found.select("event_id", F.col("e.what").alias("what"), F.col("e").isNotNull().alias("valid"))

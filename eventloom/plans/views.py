"""Event nodes, edges and answer rows as views over the driver's tables, and the same as SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.plans.event_graph import NEWS, graph_edges
from eventloom.runtime import cut, table

WEEK = replace(NEWS, when_range=(0.0, 7.0))


def ev_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per embedding, with the event at the same relative place of the events table."""
    events, vectors = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    step = events.count() // max(1, vectors.count())
    # Places are multiples of the step: no other event can meet a vector, so none is sent to the join.
    events = events.where(F.col("event_id") % step == 0 if step else F.col("event_id") == 0)
    e = vectors.select(F.col("vec_id").alias("seq_id"), F.col("embedding").cast("array<double>").alias("what_vec"), (F.col("vec_id") * step).alias("event_id"))
    v = events.select("event_id", F.col("ts").cast("timestamp").alias("when"), F.col("event_type").alias("how"), F.col("user_id").alias("who"), F.col("props").alias("why"), (F.col("user_id") * 37 % 181 - 90).cast("double").alias("lat"), (F.col("user_id") * 73 % 361 - 180).cast("double").alias("lon"))
    return e.join(v, "event_id").drop("event_id")


def news_edges(spark: SparkSession, sf_dir: str, config=NEWS, columns: tuple[str, ...] = ()) -> DataFrame:
    """The edges, stored; columns: only these."""
    edges = graph_edges(ev_nodes(spark, sf_dir), config)
    return cut(edges.select(*columns) if columns else edges)


def lp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link-prediction answers: labelled documents with a made-up prediction."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(
        "doc_id", (F.col("quality") == 1).alias("label"), (F.col("n_chars") % 3 != 0).alias("pred"), (F.col("doc_id") % 11 != 0).alias("success"),
        F.col("source").alias("model"), F.col("lang").alias("theme"), (F.col("doc_id") % 5).alias("ctx"),
    )


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals; sums are not added up in the same order everywhere."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


NODES_SQL = """ev_nodes AS MATERIALIZED (
  SELECT e.vec_id AS seq_id, CAST(e.embedding AS DOUBLE[]) AS what_vec, v.ts AS t, v.event_type AS how, v.user_id AS who, v.props AS why,
         CAST(((v.user_id * 37) % 181) - 90 AS DOUBLE) AS lat, CAST(((v.user_id * 73) % 361) - 180 AS DOUBLE) AS lon
  FROM embeddings e JOIN events v ON v.event_id = e.vec_id * ((SELECT count(*) FROM events) // (SELECT count(*) FROM embeddings)))"""

PAIRS_SQL = (
    NODES_SQL
    + """,
pairs AS MATERIALIZED (
  SELECT CASE WHEN a.t < b.t THEN a.seq_id ELSE b.seq_id END AS u, CASE WHEN a.t < b.t THEN b.seq_id ELSE a.seq_id END AS v,
         list_inner_product(a.what_vec, b.what_vec) AS what_sim,
         CAST(trunc(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))) AS BIGINT) AS km,
         CAST(abs(date_diff('day', CAST(a.t AS DATE), CAST(b.t AS DATE))) AS BIGINT) AS days
  FROM ev_nodes a JOIN ev_nodes b ON a.seq_id < b.seq_id)"""
)


def edges_sql(days: int = 31) -> str:
    """`edges`: similarity edges of the shipped setting with another time window."""
    return (
        PAIRS_SQL
        + f""",
live AS (SELECT u, v, what_sim AS weight, what_sim, 1 / (1 + km) AS where_sim, 1 / (1 + days) AS when_sim FROM pairs
         WHERE what_sim BETWEEN 0.1 AND 1.0 AND km BETWEEN 0 AND 10000 AND days BETWEEN 0 AND {days} AND what_sim > 0),
mid AS (SELECT u, median(weight) AS m FROM live GROUP BY u),
thr AS (SELECT l.u, any_value(m) + 3.0 * median(abs(weight - m)) / 0.6745 AS threshold FROM live l JOIN mid USING (u) GROUP BY l.u),
edges AS MATERIALIZED (SELECT l.u, l.v, weight, what_sim, where_sim, when_sim, 'similarity' AS edge_type FROM live l JOIN thr USING (u) WHERE weight >= threshold
          QUALIFY row_number() OVER (PARTITION BY l.u ORDER BY weight DESC, l.v DESC) <= 100)"""
    )


COMPONENTS_SQL = """,
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT seq_id AS node, seq_id AS r FROM ev_nodes UNION SELECT reach.node, b.v FROM reach JOIN both_ways b ON b.u = reach.r),
member AS MATERIALIZED (SELECT node AS seq_id, min(r) AS component FROM reach GROUP BY node)"""

LP_SQL = """lp AS (SELECT d.doc_id, quality = 1 AS label, n_chars % 3 <> 0 AS pred, d.doc_id % 11 <> 0 AS success, source AS model, lang AS theme, d.doc_id % 5 AS ctx
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

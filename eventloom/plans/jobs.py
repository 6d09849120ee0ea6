"""Whole jobs: articles to graph, graph to split, split to predictions, seeds to generated events. A theme is a column, so all themes run in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.text import event_time
from eventloom.operators import metrics, parsing, prepare, sampling, walks
from eventloom.operators.graph import train_graph
from eventloom.plans.datasets import ASK, ASK_WITH_CONTEXT, event_texts, filled, walk_texts, with_ends
from eventloom.plans.event_graph import GraphConfig, build_graph
from eventloom.plans.models import ModelClient, complete

EXTRACT = "Read this news article and name its keywords, what happened, who, where, why and how, as one JSON object.\nTitle: {title}\nDescription: {description}\nLink: {url}\nPublished: {date}"
CONTINUE = "Events so far:\n{c}\nWrite the next event in the same form."


def load_config(text: str) -> dict[str, Any]:
    """A nested YAML text as a dict."""
    import yaml

    return yaml.safe_load(text)


def graph_config(values: dict[str, Any]) -> GraphConfig:
    """GraphConfig from a dict; unknown keys raise, ranges may be lists."""
    known = {f.name for f in fields(GraphConfig)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return GraphConfig(**{k: tuple(v) if k.endswith("_range") else v for k, v in values.items()})


def extract_events(news: DataFrame, factory: Callable[[], ModelClient]) -> DataFrame:
    """Articles (ord, title, description, url, published) as events: duplicates of a title go, the rest are asked about, failures are left out."""
    first = prepare.keep_first(news, "title", "ord").withColumn("date", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss"))
    text = filled(EXTRACT, **{k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("title", "description", "url", "date")})
    answered = complete(first.withColumn("prompt", text), factory)
    found = answered.withColumn("e", parsing.extraction("answer", F.col("published"))).where("e.success")
    return found.select("ord", "title", "description", *[F.col(f"e.{k}").alias(k) for k in ("keywords", "what", "who", "why", "how", "where", "when")])


def build_from_news(news: DataFrame, factory: Callable[[], ModelClient], embed: Callable[[DataFrame], DataFrame], config: GraphConfig) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the event graph of articles; embed adds what_vec to nodes."""
    nodes = embed(prepare.prepare_nodes(extract_events(news, factory)))
    return nodes, build_graph(nodes, config)


def evaluation_split(nodes: DataFrame, edges: DataFrame, **settings: Any) -> DataFrame:
    return sampling.labelled_split(nodes, edges, **settings)


def predict_links(nodes: DataFrame, edges: DataFrame, test: DataFrame, factory: Callable[[], ModelClient], walk_length: int = 4, seed: int = 2026, with_context: bool = True) -> DataFrame:
    """(u, v, label, label_description, success, link, explanation): a model asked about each test edge, with a walk into the past of u over the graph without the test's targets."""
    nodes_left, edges_left = train_graph(nodes, edges, test.where("label"))
    texts = event_texts(nodes)
    rows = with_ends(test, texts)
    values = {"a": F.col("a"), "b": F.col("b")}
    if with_context:
        past = walks.random_walks(nodes_left.select("seq_id"), edges_left, 1, walk_length, "none", seed, inverted=True)
        past = past.withColumn("walk", walks.context_of("walk", True)).where(F.size("walk") > 0)
        past = walk_texts(past, texts, "json").select(F.col("anchor").alias("u"), F.col("text").alias("context"))
        rows = rows.join(past, "u", "left")
        values["c"] = F.coalesce("context", F.lit("[]"))
    asked = rows.select("u", "v", "label", "label_description", filled(ASK_WITH_CONTEXT if with_context else ASK, **values).alias("prompt"))
    answered = complete(asked, factory).withColumn("r", parsing.link_answer(F.coalesce("answer", F.lit(""))))
    return answered.select("u", "v", "label", "label_description", "r.success", "r.link", "r.explanation")


def link_report(predictions: DataFrame) -> DataFrame:
    """Reports over all valid answers and by label description, from one pass over grouping sets (null: all)."""
    rows = predictions.where("success").select("label_description", "label", F.col("link").alias("pred"))
    return metrics.report(rows, ["label_description"], sets=[["label_description"], []])


def generate_events(nodes: DataFrame, edges: DataFrame, factory: Callable[[], ModelClient], recent: int = 100, walks_per_node: int = 1, length: int = 5, seed: int = 2026) -> DataFrame:
    """(anchor, walk_no, generated): the first valid event that a model writes after a walk that ends in one of the latest nodes; null if it wrote none."""
    seeds = nodes.orderBy(F.desc("when"), "seq_id").limit(recent)
    found = walks.random_walks(seeds, edges, walks_per_node, length, "none", seed, inverted=True)
    asked = walk_texts(found, event_texts(nodes)).withColumn("prompt", filled(CONTINUE, c=F.col("text")))
    first = F.get(parsing.tagged_events(F.coalesce("answer", F.lit(""))), 0)
    return complete(asked, factory).select("anchor", "walk_no", parsing.standard_event(first).alias("generated"))


def as_text_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with their six fields as strings and the time as the texts carry it, beside the timestamp."""
    return nodes.select("seq_id", "event_id", *[F.col(k).cast("string").alias(k) for k in ("what", "who", "where", "why", "how")], event_time("when").alias("when"))


def run_themes(spark: SparkSession, rows: DataFrame, themes: list[str], job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A job that must not mix themes, for each named theme, as one result with a theme column."""
    out = None
    for theme in themes:
        one = job(rows.where(F.col("theme") == theme)).withColumn("theme", F.lit(theme))
        out = one if out is None else out.unionByName(one)
    return out

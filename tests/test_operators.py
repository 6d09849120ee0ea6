"""Operators on hand-made fixtures: corner cases of each, properties of graphs, walks and splits, jobs with a stub model, sources, sinks and streams."""

from __future__ import annotations

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import similarity, text
from eventloom.functions.rand import u01
from eventloom.operators import graph, metrics, parsing, prepare, sampling, walks
from eventloom.operators.components import components
from eventloom.operators.pairs import event_pairs
from eventloom.operators.removable import removable_edges
from eventloom.operators.thresholds import thresholds
from eventloom.plans import datasets, jobs
from eventloom.plans.event_graph import GraphConfig, bridge_edges, build_graph, similarity_edges, weighed_pairs
from eventloom.plans.models import StubClient, complete, last_tokens
from eventloom.sources import news, sinks
from eventloom.streaming import news as streams

DAY = datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(k, [math.cos(k * 0.7), math.sin(k * 0.7), (k % 3) / 2], DAY + timedelta(hours=9 * (k // 2)), float(k % 5), float(k % 7), f"e{k}", f"what {k}", "who", "here", "why", "how") for k in range(24)]
    return spark.createDataFrame(rows, "seq_id long, what_vec array<double>, when timestamp, lat double, lon double, event_id string, what string, who string, where string, why string, how string")


@pytest.fixture(scope="module")
def edges(nodes):
    return build_graph(nodes, GraphConfig("what", "percentile", 60.0, when_range=(0.0, 3.0), max_neighbors=3)).cache()


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_kilometres_and_days(spark):
    frame = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0719, DAY + timedelta(hours=23), DAY + timedelta(hours=25))], "a double, b double, c double, d double, s timestamp, t timestamp")
    r = frame.select(similarity.haversine_km("a", "b", "c", "d").alias("km"), similarity.calendar_days("s", "t").alias("days"), similarity.whole_days("s", "t").alias("whole")).first()
    assert (r.km, r.days, r.whole) == (7, 1, 0)


def test_conversions_do_not_clip(spark):
    r = one(spark, a=similarity.CONVERSIONS["linear"](F.lit(30.0), max_distance=10), b=similarity.CONVERSIONS["exponential"](F.lit(2.0), alpha=4), c=similarity.CONVERSIONS["inverse"](F.lit(3.0)))
    assert (r.a, round(r.b, 9), r.c) == (-2.0, round(math.exp(-0.5), 9), 0.25)


def test_pairs_of_equal_times_go_to_the_smaller_number(nodes):
    found = {(r.u, r.v) for r in event_pairs(nodes).collect()}
    assert len(found) == 24 * 23 // 2 and (1, 0) in found and (0, 1) not in found and (0, 2) in found


def test_time_window_loses_no_pair(nodes):
    near = {(r.u, r.v) for r in event_pairs(nodes).where("days <= 2").collect()}
    assert {(r.u, r.v) for r in event_pairs(nodes, 2).collect()} == near


def test_single_value_is_its_own_threshold(spark):
    one_each = spark.createDataFrame([(1, 0.25)], "u long, weight double")
    assert [thresholds(one_each, m).first().threshold for m in ("mad", "iqr", "zscore", "percentile")] == [0.25] * 4
    with pytest.raises(ValueError):
        thresholds(one_each, "median")


@pytest.mark.parametrize("setting", [{"similarity": "max"}, {"filter_type": "top"}, {"where_conversion": "log"}])
def test_bad_settings_raise(setting):
    with pytest.raises(ValueError):
        GraphConfig(**setting)
    with pytest.raises(ValueError):
        jobs.graph_config({"colour": 1})


def test_graph_is_connected_and_points_forward(nodes, edges):
    when = {r.seq_id: r.when for r in nodes.collect()}
    rows = edges.collect()
    alike = [r for r in rows if r.edge_type == "similarity"]
    assert all(when[r.u] <= when[r.v] for r in alike) and max(sum(x.u == r.u for x in alike) for r in alike) <= 3
    assert components(nodes, edges).select("component").distinct().count() == 1
    parts = components(nodes, edges.where("edge_type = 'similarity'")).select("component").distinct().count()
    assert len(rows) - len(alike) == parts - 1


def test_bridges_between_sizes_5_3_3_1(spark, nodes):
    few = nodes.where("seq_id < 12")
    chains = [(a, a + 1) for a in (0, 1, 2, 3)] + [(5, 6), (6, 7), (8, 9), (9, 10)]
    e = spark.createDataFrame([(u, v, 0.5, 0.5, 0.5, 0.5, "similarity") for u, v in chains], "u long, v long, weight double, what_sim double, where_sim double, when_sim double, edge_type string")
    got = bridge_edges(few, e, GraphConfig("what")).collect()
    assert len(got) == 3
    group = lambda k: 0 if k < 5 else 1 if k < 8 else 2 if k < 11 else 3
    assert sorted(group(r.v) for r in got) == [1, 2, 3] and all(group(r.u) < group(r.v) for r in got)


def test_ties_at_the_neighbour_limit(spark):
    pairs = spark.createDataFrame([(0, v, 0.5, 0.5, 0.5, 1.0, 1.0) for v in (1, 2, 3, 4)], "u long, v long, weight_all double, weight double, what_sim double, where_sim double, when_sim double")
    kept = similarity_edges(pairs, GraphConfig("what", "mad", 3.0, max_neighbors=2)).collect()
    assert {r.v for r in kept} == {3, 4}


def test_first_of_equal_and_bad_dates(spark):
    rows = [(0, "a", "x", "soon", "{}"), (1, "a", "x, Two Words", "2026-03-01", "{}"), (2, "b", "K, Two Words", "2026-03-02T10:00:00", '{"country": "Japan", "lat": 36, "long": 138}'), (3, "c", "z", None, "{}")]
    got = prepare.prepare_nodes(spark.createDataFrame(rows, "ord long, what string, keywords string, when string, where string")).collect()
    assert [(r.seq_id, r.what, r.event_id, r.where, r.lat) for r in got] == [(0, "b", "0_k_two_words_2026-03-02", "Japan", 36.0)]
    assert spark.createDataFrame([("x",), ("2026-01-02",)], "d string").select(prepare.published_at("d", F.lit("2020-01-01").cast("timestamp")).alias("t")).orderBy("t").first().t.year == 2020


@pytest.mark.parametrize(
    ("answer", "wanted"),
    [('{"link": "true"}', (False, False)), ("{}", (True, False)), ("[]", (False, False)), ('```json\n{"link": true}\n```', (True, True)), ("", (False, False)), ('{"link": null}', (False, False)), ('{"link": true, "explanation": 1}', (False, False))],
)
def test_link_answers(spark, answer, wanted):
    r = one(spark, a=parsing.link_answer(F.lit(answer))).a
    assert (r.success, r.link) == wanted


def test_tagged_events(spark):
    block = "<event>\nWhat: a: b\nno colon\nWhat: last\nID: 3\n</event>"
    r = one(spark, e=parsing.tagged_events(F.lit(block + "<event></event>")), none=parsing.tagged_events(F.lit("x")))
    assert r.e == [{"no colon": "", "what": "last", "event_id": "3"}, {}] and r.none == []
    full = F.create_map(*[x for k in text.GENERATED for x in (F.lit(k), F.lit(None).cast("string"))])
    r = one(spark, ok=parsing.is_event(full), event=parsing.standard_event(full), missing=parsing.missing_keys(F.create_map(F.lit("what"), F.lit("x"))))
    assert r.ok and r.event is not None and len(r.missing) == 6


def test_json_is_as_python_writes_it(spark):
    frame = spark.createDataFrame([('q"\\\n\t', None)], "what string, where string")
    r = frame.select(text.json_object(("what", "where")).alias("flat"), text.json_object(("what", "where"), 2).alias("deep")).first()
    value = {"what": 'q"\\\n\t', "where": None}
    assert (r.flat, r.deep) == (json.dumps(value), json.dumps(value, indent=2))


def test_small_parsers(spark):
    r = one(spark, b=parsing.repaired(F.lit('{"link": true')), c=text.cleaned_answer(F.lit(" ---json x ``` ")))
    assert (r.b, r.c) == ('{"link": true}', "x")
    frame = spark.createDataFrame([("It is TRUE, not false", "a model\nb model\nc", "gemma_it_4b")], "t string, m string, n string")
    r = frame.select(parsing.naive_label("t").alias("t"), parsing.after_last("m", "model\n").alias("m"), text.prettified("n").alias("n")).first()
    assert (r.t, r.m, r.n) == (True, "c", "Gemma It 4B")


def test_walks_follow_edges(nodes, edges):
    ways = {(r.u, r.v) for r in edges.collect()}
    for bias in walks.BIASES:
        for r in walks.random_walks(nodes, edges, 2, 5, bias).collect():
            assert r.walk[0] == r.anchor and len(r.walk) <= 5 and all(p in ways for p in zip(r.walk, r.walk[1:]))
    back = walks.random_walks(nodes, edges, 1, 4, inverted=True).collect()
    assert all(r.walk[-1] == r.anchor and all(p in ways for p in zip(r.walk, r.walk[1:])) for r in back)
    again = walks.random_walks(nodes.repartition(7), edges.repartition(5), 2, 5, "degree").collect()
    assert sorted(map(str, again)) == sorted(map(str, walks.random_walks(nodes, edges, 2, 5, "degree").collect()))
    with pytest.raises(ValueError):
        walks.random_walks(nodes, edges, 1, 2, "uniform")


def test_prefix_cuts(spark):
    r = one(spark, a=walks.prefix_length(F.lit(2), F.lit(0.9)), b=walks.prefix_length(F.lit(5), F.lit(0.99)), c=walks.weighted_prefix_length(F.lit(5), F.lit(0.0), 2.0), d=walks.weighted_prefix_length(F.lit(5), F.lit(0.999), 2.0))
    assert (r.a, r.b, r.c, r.d) == (1, 4, 1, 4)


def test_split_keeps_train_and_test_apart(nodes, edges):
    split = sampling.labelled_split(nodes, edges, 0.3, 1.0).collect()
    ways = {(r.u, r.v) for r in edges.collect()}
    assert all(((r.u, r.v) in ways) == r.label for r in split) and len({(r.u, r.v) for r in split}) == len(split)
    assert sum(r.label for r in split) * 2 == len(split)
    kept, left = graph.train_graph(nodes, edges, edges.sparkSession.createDataFrame([r for r in split if r.label]))
    gone = {r.v for r in split if r.label}
    assert not gone & {r.seq_id for r in kept.collect()} and not any(r.u in gone or r.v in gone for r in left.collect())
    with pytest.raises(ValueError):
        sampling.quota(10, 1.5)


def test_paths_and_measures(spark):
    n = spark.range(4).withColumnRenamed("id", "seq_id")
    e = spark.createDataFrame([(0, 1, 1.0, "similarity"), (1, 2, 1.0, "similarity"), (0, 2, 1.0, "component_bridge")], "u long, v long, weight double, edge_type string")
    assert {(r.source, r.node): r.dist for r in graph.shortest_paths(n, e).collect()} == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (0, 1): 1, (1, 2): 1, (0, 2): 1}
    s = graph.summary(n, e).first()
    assert (s.num_edges, round(s.bridge_share, 6), s.density, s.max_degree) == (3, 0.333333, 0.25, 2)
    assert {r.node: r.clustering for r in graph.clustering(n, e).collect()} == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.0}
    assert {(r.u, r.v) for r in removable_edges(n, e, 5).collect()} == {(0, 1)} or removable_edges(n, e, 5).count() == 1
    assert graph.ego(n, e, 1).where("source = 0").count() == 3
    with pytest.raises(ValueError):
        graph.top_edges(e, 1, "colour")


def test_report_counts_classes_of_either_side(spark):
    rows = spark.createDataFrame([("a", True, True), ("a", True, False)], "g string, label boolean, pred boolean")
    r = metrics.report(rows, ["g"]).first()
    assert (r.accuracy, r.macro_recall, r.macro_precision, r.support) == (0.5, 0.25, 0.5, 2)
    groups = spark.createDataFrame([("a",), ("none",)], "g string")
    dummy = metrics.with_dummies(groups, metrics.report(rows, ["g"]), ["g"]).where("g = 'none'").first()
    assert (dummy.accuracy, dummy.macro_f1, dummy.support) == (0.0, 0.0, 2)
    assert [r.rejected for r in metrics.holm(spark.createDataFrame([(0.001,), (0.03,), (0.04,)], "p double"), "p").orderBy("p").collect()] == [True, False, False]


def test_model_jobs(nodes, edges):
    class Flaky(StubClient):
        def complete(self, prompts):
            raise ConnectionError

    asked = nodes.select(F.col("what").alias("prompt"))
    assert complete(asked, StubClient).where("answer is not null").count() == 24
    assert complete(asked, Flaky, tries=2, wait=0.0).where("answer is null").count() == 24
    texts = jobs.as_text_nodes(nodes)
    split = sampling.labelled_split(nodes, edges, 0.3, 1.0)
    found = jobs.predict_links(texts, edges, split, StubClient)
    assert found.count() == split.count() and found.where("not success").count() == 0
    assert jobs.link_report(found).where("label_description is null").first().support == split.count()
    written = jobs.generate_events(nodes, edges, lambda: StubClient("generate"), recent=3)
    assert written.where("generated is not null").count() == 3
    sft = datasets.sft_pairs(split, texts).first()
    assert sft.text.endswith('"explanation": "placeholder"}') and sft.label in (0, 1)


def test_articles_to_graph(spark):
    rows = [(k, f"title {k % 9}", "text", "url", DAY + timedelta(days=k)) for k in range(12)]
    articles = spark.createDataFrame(rows, "ord long, title string, description string, url string, published timestamp")
    embed = lambda n: n.withColumn("what_vec", F.array(u01(1, "what"), u01(2, "what")))
    found, e = jobs.build_from_news(articles, lambda: StubClient("extract"), embed, GraphConfig("what"))
    assert found.count() == 9 and {r.where for r in found.collect()} == {"Brazil"} and components(found, e).select("component").distinct().count() == 1


def test_token_cut(spark):
    frame = spark.createDataFrame([([1, 2, 3, 4],), ([1],)], "t array<int>")
    assert [r.t for r in frame.select(last_tokens("t", 5, 2).alias("t")).collect()] == [[2, 3, 4], [1]]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 0.8125), (1, "b", None), (2, "a", 2.0)], "ord long, title string, x double")
    rows.write.parquet(str(tmp_path / "in/sport_2026"))
    assert {r.theme for r in news.landed(spark, str(tmp_path / "in")).select("theme").collect()} != {""}
    assert news.per_file_counts(news.landed(spark, str(tmp_path / "in"))).where("path is null").first().n == 3
    assert [r.ord for r in news.remaining(rows, "b").collect()] == [2] and news.remaining(rows, "zz").count() == 3 and news.remaining(rows, None).count() == 3
    made = []
    for _ in range(2):
        sinks.load_or_make(spark, str(tmp_path / "out"), lambda: made.append(1) or rows)
    assert made == [1]
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(r.x or "" for r in spark.read.option("header", "true").option("sep", ";").csv(str(tmp_path / "csv")).collect()) == ["", "0,812", "2,000"]
    sinks.write_json(rows, str(tmp_path / "json"))
    sinks.write_json(rows.limit(0), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    log = spark.createDataFrame([([(True, False)], [True], [["a"]])], "outputs array<struct<success: boolean, link: boolean>>, labels array<boolean>, context_walks array<array<string>>")
    r = news.answer_rows(log).first()
    assert (r.pos, r.success, r.link, r.label, r.context_walk) == (0, True, False, True, ["a"])
    with pytest.raises(ValueError):
        news.windows(spark, "2026-01-01", "2026-02-01", 1)


def test_streams(spark, tmp_path):
    rows = [(f"t{k % 3}", "q", DAY + timedelta(days=k)) for k in range(6)]
    spark.createDataFrame(rows, "title string, query string, published timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.first_of_title(streams.read_landed(spark, str(tmp_path / "in"), "title string, query string, published timestamp"))
    streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    counts = streams.daily_counts(streams.read_landed(spark, str(tmp_path / "in"), "title string, query string, published timestamp"))
    streams.append_to(counts, str(tmp_path / "days"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "days")).where("n <> 1").count() == 0

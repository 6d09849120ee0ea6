"""The mix does not depend on the order of its rows."""

from __future__ import annotations

from eventloom.llm.mixing import mix_sources, mixed_documents
from eventloom.llm.skew import number_within
from tests.conftest import DATA


def test_unique_ids_mix_alike_in_any_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    found = []
    for name, order, parts in (("up", "doc_id", 1), ("down", "text", 3)):
        docs.repartition(parts).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        assert rows.count() == rows.select("doc_id").distinct().count()
        found.append((sorted(mix_sources(rows).collect()), sorted((r.doc_id, r.text or "") for r in mixed_documents(rows).collect())))
    assert found[0] == found[1]


def test_null_and_repeated_ids_mix_alike_in_any_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    odd = docs.where("doc_id < 3").selectExpr("if(doc_id = 0, null, 7L) as doc_id", "text", "lang", "source", "n_chars")
    same = docs.where("doc_id = 5")
    docs = docs.union(odd).union(same).union(same).union(same.selectExpr("doc_id", "text || ' more'", "lang", "source", "n_chars"))
    found = []
    for name, order, parts in (("up", "n_chars", 1), ("down", "text", 3), ("id", "doc_id", 2)):
        docs.repartition(parts).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        key = lambda r: tuple((x is not None, x) for x in r)
        found.append((sorted(map(tuple, mix_sources(rows).collect()), key=key), sorted(map(tuple, mixed_documents(rows).collect()), key=key)))
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]) == docs.count()


def test_numbers_within_groups(spark):
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, null, id % 2) as key", "id % 5 div 4 as mark", "id as place").repartition(7)
    got = number_within(rows, ["key", "mark"], ["place"]).collect()
    assert len(got) == 2000
    groups = {}
    for r in sorted(got, key=lambda r: r.place):
        assert r.number == groups.get((r.key, r.mark), 0)
        groups[(r.key, r.mark)] = r.number + 1

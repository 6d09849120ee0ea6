"""The pipeline's stages, one after the other, against brute force."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from eventloom.llm import queries as llm_queries
from tests.conftest import DATA
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_text_operators import brute_simhash, brute_windows, classes

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "source_mix", "bpe_encode_decode"]
    clean = stages["quality_classifier"](spark, docs, SF)
    assert clean.columns == columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    bad = [d for d, r in labels.items() if r.quality == 0 or r.toxic == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)

    single = stages["simhash_near_dedup"](spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(rows[k][0] for k in brute_kept(rows))

    rest = stages["substring_dedup"](spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    wanted = {d: [w for w, g in zip(*found, strict=True) if not g] for d, found in zip(ids, brute_windows([texts[d] for d in ids], 20), strict=True)}
    assert rest.columns == columns
    assert {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rest.collect()} == wanted

    mixed = stages["source_mix"](spark, docs, SF)
    assert mixed.columns == columns and all(texts[r.doc_id] == r.text or r.text.split() == texts[r.doc_id].split()[: len(r.text.split())] for r in mixed.collect())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages["bpe_encode_decode"](spark, docs, SF).collect():
        found = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()


def test_run_and_empty_table(spark, tmp_path, monkeypatch):
    out = corpus_pipeline.run(spark, SF, str(tmp_path / "run"))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert [p.name for p in (tmp_path / "run").iterdir()] == ["3_source_mix"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, None) for name, _ in corpus_pipeline.STAGES[:4]] + corpus_pipeline.STAGES[4:])
    assert sorted(corpus_pipeline.run(spark, SF, str(tmp_path / "run")).collect()) == sorted(out.collect())  # nothing is done twice
    monkeypatch.undo()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark, tmp_path):
    words = " ".join(f"w{k}" for k in range(60))
    names = ["size", "SIZE_", "taken", "place", "turn", "words", "row_number", "repeated_spans", "keep", "tail", "n_words", "n_removed", "fp", "rid", "source_", "spans", "key"]
    rows = [(1, words, None, 3), (1, words, "a", 3), (None, words + " more", "a", None), (None, None, None, None), (4, "", "b", 0), (5, " \n", "b", 0), (6, "one two", "b", 7), (7, "x " * 30_000, "b", 60_000)]
    spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)).coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns, name
        for r in found.collect():
            assert [r[n] for n in names] == list(range(len(names))), name
    assert dict(corpus_pipeline.STAGES)["bpe_encode_decode"](spark, docs, SF).count() == len(rows)


def test_registered_queries_with_sql(spark):
    """Operators 4, 10, 11 and 13 as registered, against their SQL."""
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in llm_queries.oracle_sql().items():
        frame = llm_queries.queries()[name](spark, SF)
        theirs = con.sql(sql)
        at = [theirs.columns.index(c) for c in frame.columns]
        assert sorted(map(tuple, frame.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr), name


def test_registered_queries_without_sql(spark):
    """Columns and rows of each, over its whole table."""
    docs, vectors = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "embeddings"))
    wanted = {
        "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op2_bpe_encode_decode": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op3_byte_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op6_ordinal_quality": ["doc_id", "expected_grade", "tail", "keep"],
        "op7_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op8_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
        "op9_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
        "op12_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal", "score"],
    }
    for name, columns in wanted.items():
        frame = llm_queries.queries()[name](spark, SF)
        assert frame.columns == columns and frame.count() == docs.count(), name
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: brute_simhash(t) for d, t in texts.items()}
    root = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in llm_queries.op9_simhash_near_dedup(spark, SF).collect()} == {d: (f"{prints[d]:016x}", root[d]) for d in texts}
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    found = {}
    for r in llm_queries.op5_learned_partitions(spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, mine in found.items():
        best = sorted((-float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), k) for k, v in x.items() if k != q)[:5]
        hits += len(mine & {k for _, k in best})
    assert set(found) == {k for k in x if k % 50 == 0} and hits >= 0.9 * 5 * len(found)

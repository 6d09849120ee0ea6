"""The text operators against brute force, and their corner cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import bpe, licenses, mixing, sharding, simhash, skew, substring_dedup, token_counts

WORD = r"[^\x20\x09-\x0D]+"
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PASSAGE = " ".join(f"w{k}" for k in range(60))
TEXTS = [
    None, "", "   \n\t ", "one", "All Rights reserved. CC BY 4.0, cc by, General Public License", "a " * 3000, PASSAGE, "x " + PASSAGE + " y", PASSAGE, "<|endoftext|> it's ▁ 漢字 \U0001f642  two  spaces\n\n",
    "same text here again", "same text here again", "The quick brown fox jumps over the lazy dog near the river bank today", "the quick brown fox jumps over the lazy dog near the river bank today", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "café " * 50,
    "-" * 700 + "b" * 700, "ÉCOLE naïve " * 12, "z " * 25 + PASSAGE[:200],
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, tail string, fp string, id long, rid long, size string, place string, block string, row_number long, repeated_spans string, spans string, `_place` int, `_SIZE` int, `_taken` int, `_words` int, `_pass` int, src int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", ["b", "a", None][k % 3], len(t or ""), "clash", "clash", "clash", 7, 7, "clash", "clash", "clash", 7, "clash", "clash", 7, 7, 7, 7, 7, 7) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r[0]: r for r in frame.collect()}


def test_token_counts(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(token_counts.count_tokens(docs, PIECES, limit=1000))
    for k, text in enumerate(TEXTS):
        n = len(library.encode(text or ""))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 1000)
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_whole_tokens_are_single_tokens():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    whole = token_counts.whole_tokens(PIECES)
    words = [w for w in sorted(whole) if w.startswith("▁") and len(w) > 1 and "▁" not in w[1:]]
    assert len(words) > 1000 and all(len(x) == 1 for x in library.encode([w[1:] for w in words]))


def test_bpe_round_trip(docs, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    got = by_id(bpe.encode_and_decode(docs, BYTE_BPE))
    ids = by_id(bpe.encode(docs, BYTE_BPE))
    back = by_id(bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE))
    for k, text in enumerate(TEXTS):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(wanted, skip_special_tokens=False)
        assert ids[k].ids == wanted and back[k].text == decoded
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(wanted), hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.encode_and_decode(empty, BYTE_BPE).count() == 0
    broken = docs.sparkSession.createDataFrame([(1, [6312, 245])], "doc_id long, ids array<int>")
    assert bpe.decode(broken, BYTE_BPE).first().text == library.decode([6312, 245], skip_special_tokens=False)


def test_shards(spark, docs, empty):
    rows = sharding.assign_shards(docs, 4, rows_per_part=3).collect()
    assert len(rows) == len(TEXTS)
    total, at, slots = sum(r["size"] for r in rows), 0, defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        text = (TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None)
        assert r.shard == (2 * at + r["size"]) * 4 // (2 * total)
        at += r["size"]
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(empty, 4).count() == 0
    twins = spark.createDataFrame([(1, "a")] * 40 + [(None, None)] * 3, "doc_id long, text string")
    found = sharding.assign_shards(twins, 3, rows_per_part=5).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("s"), F.max("slot").alias("m")).collect()
    assert sum(r.n for r in found) == 43 and all(r.n == r.s == r.m + 1 for r in found)
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, 0)


def test_written_shards(docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(TEXTS) and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1, 2}


def brute_windows(texts, k):
    """texts in the order of their ids -> (words, removed flags) each."""
    seen, out = set(), []
    for text in texts:
        words = re.findall(WORD, text or "")
        gone = [False] * len(words)
        for p in range(len(words) - k + 1):
            window = tuple(words[p : p + k])
            if window in seen:
                gone[p : p + k] = [True] * k
            seen.add(window)
        out.append((words, gone))
    return out


@pytest.mark.parametrize("k", [20, 5, 2])
def test_substring_dedup(docs, empty, k):
    got = by_id(substring_dedup.dedup_substrings(docs, k).select("doc_id", "text", "n_words", "n_removed", "kept_sha256", "lang"))
    for d, (words, gone) in enumerate(brute_windows(TEXTS, k)):
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()), d
        assert re.findall(WORD, got[d].text or "") == kept
        if not any(gone):
            assert got[d].text == TEXTS[d]
    assert substring_dedup.dedup_substrings(empty, k).count() == 0


def twisted(n):
    """The Thue-Morse word and its complement: polynomial hashes modulo 2 ** 64 cannot tell them apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_substring_dedup_tells_twisted_words_apart(spark, n):
    before, (one, two) = " ".join(f"w{k}" for k in range(19)), twisted(n)
    rows = spark.createDataFrame([(1, f"{before} {one}"), (2, f"{before} {two}"), (3, f"x {before} {one} y")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(rows, 20).collect()} == {1: 0, 2: 0, 3: 20}


def test_agreeing_runs():
    assert substring_dedup.agreeing(b"a b c", b"a b c", 2) == [(0, 3)]
    assert substring_dedup.agreeing(b"a b x c d e x f", b"a b y c d e z f", 2) == [(0, 2), (3, 6)]
    assert substring_dedup.agreeing(b"a b", b"c d", 1) == []


def long_texts():
    """Texts over several chunks, one above a chunk, with passages that they share."""
    rng = random.Random(4)
    words = [f"v{k}" for k in range(4000)] + ["\u00e9t\u00e9", "x" * 300]
    shared = [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(12)]
    texts = []
    for k in range(30):
        parts = [" ".join(rng.choices(words, k=rng.randint(100, 6000))) if rng.random() < 0.7 else rng.choice(shared) for _ in range(14)]
        texts.append("  ".join(parts))
    texts.append(" ".join([*rng.choices(words, k=450_000), shared[0], "CC BY", shared[1]]))
    texts.append(None)
    assert max(len(t or "") for t in texts) > 1 << 21 and sum(len(t or "") for t in texts) > 1 << 22
    return texts


def test_long_texts_of_several_chunks(spark):
    texts = long_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = by_id(substring_dedup.dedup_substrings(docs, 20).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    for d, (words, gone) in enumerate(brute_windows(texts, 20)):
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()), d
    prints = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs).collect()}
    assert prints == {k: brute_simhash(t) for k, t in enumerate(texts)}
    base = by_id(licenses.scan_licenses(docs))
    assert base[30].n_base == 1 and base[30].base_labels == "cc-by" and sum(r.n_base for r in base.values()) == 1
    library, pieces = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids, counts = by_id(bpe.encode_and_decode(docs, BYTE_BPE)), by_id(token_counts.count_tokens(docs, PIECES))
    for k in (0, 30, 31):
        wanted = library.encode(texts[k] or "", add_special_tokens=False).ids
        assert ids[k].ids_sha256 == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
        assert counts[k].n_tokens == len(pieces.encode(texts[k] or ""))


def test_substring_dedup_of_repeated_rows(spark):
    rows = spark.createDataFrame([(5, PASSAGE), (5, PASSAGE), (None, PASSAGE), (7, "q " + PASSAGE)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.dedup_substrings(rows, 20).collect())
    assert got == [(-1, 0), (5, 60), (5, 60), (7, 60)]


def test_license_scan(docs, empty):
    got = by_id(licenses.scan_licenses(docs))
    phrases = {t.phrase: t.label for t in licenses.TEMPLATES if t.base}
    for k, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), first, last, ",".join(sorted({label for _, label in places})))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[14].labels == "mit" and 0.05 < got[14].score < 0.3
    assert licenses.license_places(docs).where("label = 'cc-by'").count() == 2
    assert licenses.scan_licenses(empty).count() == 0


def test_license_labels_and_scores_against_every_alignment(spark):
    """Each template at each place of each text, its words weighed by how few documents hold them."""
    rng = random.Random(2)
    whole = [licenses.license_words(t.text) for t in licenses.TEMPLATES]
    known = sorted({w for words in whole for w in words})
    texts = []
    for words in whole:
        bent = [rng.choice(known) if rng.random() < 0.05 else w for w in words]
        a = rng.randrange(len(words))
        texts += [" ".join(words), " ".join(["x", *bent, "Y", *words[a:], *rng.choices(known, k=30)]), " ".join(words[a:] + ["9"] + words[: a + 3])]
    texts += [" ".join(rng.choices(known, k=300)) for _ in range(10)] + [None, "", "cc by cc by cc-by-sa general public license version 3 cc0 1.0"]
    rows = [licenses.license_words(t or "") for t in texts]
    frequency = {w: sum(w in r for r in map(set, rows)) for w in known}
    idf = {w: math.log((len(rows) + 1) / (frequency[w] + 1)) + 1e-3 for w in known}
    got = by_id(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    for k, words in enumerate(rows):
        labels, score = set(), 0.0
        for t, run in zip(licenses.TEMPLATES, whole, strict=True):
            phrase = t.phrase.split()
            at = next(i for i in range(len(run)) if run[i : i + len(phrase)] == phrase)
            for i in range(len(words)):
                if words[i : i + len(phrase)] == phrase:
                    labels.add(t.label)
                    stands = sum(idf[w] for j, w in enumerate(run) if 0 <= i - at + j < len(words) and words[i - at + j] == w)
                    score = max(score, stands / sum(idf[w] for w in run))
        assert got[k].labels == ",".join(sorted(labels)) and abs(got[k].score - score) < 1e-9, (k, got[k], labels, score)
    assert sum(r.score > 0.99 for r in got.values()) >= len(licenses.TEMPLATES)


def test_mixing(spark, docs, empty):
    got = by_id(mixing.mix_sources(docs))
    size = {k: len(re.findall(WORD, t or "")) for k, t in enumerate(TEXTS)}
    taken, target = defaultdict(int), {}
    for k, r in got.items():
        assert r["size"] == size[k] and 0 <= r.taken <= 3 * size[k]
        source = ["b", "a", None][k % 3]
        taken[source] += r.taken
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert got == by_id(mixing.mix_sources(docs))
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(re.findall(WORD, r.text))
    assert dict(words) == {k: r.taken for k, r in got.items() if r.taken}
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.taken) for r in mixing.mix_sources(blank).collect()] == [(0, 0), (0, 0)]


def targets(sizes, weights, most=3.0):
    """Words per source by the definition: share by weight, fill those above their limit, share the rest again."""
    found, free, left = [0.0] * len(sizes), {k for k, n in enumerate(sizes) if n > 0}, float(sum(sizes))
    while free:
        share = left / math.fsum(weights[k] for k in free)
        full = {k for k in free if weights[k] * share > most * sizes[k]}
        for k in full or free:
            found[k] = most * sizes[k] if full else weights[k] * share
        left -= sum(found[k] for k in full)
        free = free - full if full else set()
    return found


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10], [0, 5], [5], [3, 200, 1, 40, 7000, 2, 2, 9, 10**9]])
def test_mixing_targets(spark, sizes):
    docs = spark.createDataFrame([(n, f"s{k:03}") for k, n in enumerate(sizes)], "size long, source string")
    plan = mixing.plan_sources(docs).orderBy("src").collect()
    wanted = targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sizes))])
    assert [p.source for p in plan] == [f"s{k:03}" for k in range(len(sizes))]
    assert all(abs(p.target - w) <= 1e-9 * max(1, w) for p, w in zip(plan, wanted, strict=True))


def check_schedule(plan, slots):
    """Each source's slots take its words to the word, each pass in order; every long stretch of the schedule is near the weights."""
    rows = {p.src: p for p in plan}
    for src, p in rows.items():
        own = sorted((s for s in slots if s.src == src), key=lambda s: s["rank"])
        assert [s["rank"] for s in own] == list(range(p.slots)) and sum(s.words for s in own) == p.words and all(s.words > 0 for s in own)


def test_schedule_spreads_sources(spark):
    docs = spark.createDataFrame([(k, "w " * 4096, "abc"[k % 3]) for k in range(60)], "doc_id long, text string, source string")
    plan = mixing.plan_sources(docs.select(mixing.word_count("text").alias("size"), "source"))
    slots = mixing.schedule(plan).orderBy("slot").collect()
    plan = plan.collect()
    check_schedule(plan, slots)
    half = [s for s in slots if s.slot < max(t.slot for t in slots) / 2]
    for p in plan:
        share = sum(s.words for s in half if s.src == p["src"]) / sum(s.words for s in half)
        assert abs(share - p["words"] / sum(q["words"] for q in plan)) < 0.06


@pytest.mark.parametrize("few", [20_000, 10])
def test_many_small_sources_beside_a_large_one(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    monkeypatch.setattr(mixing, "PART_SOURCES", 50)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    rows = [(k, "w " * (1 + k % 7), f"host{k % 300}" if k % 3 else None) for k in range(1200)] + [(5000 + k, "v " * 500, "host1") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.plan_sources(docs.select(mixing.word_count("text").alias("size"), "source"))
    slots = mixing.schedule(plan).collect()
    check_schedule(plan.collect(), slots)
    assert len(slots) < 3 * sum(p.slots for p in plan.collect())
    size, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r[0]: r[2] for r in rows}
    for r in mixing.mix_sources(docs).collect():
        assert r.taken <= 3 * r["size"]
        size[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    names = sorted((s for s in size if s is not None), key=str.encode) + [None]
    wanted = targets([size[s] for s in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))])
    assert all(abs(target[s] - w) < 1e-6 * max(1, w) and abs(taken[s] - w) <= 1 for s, w in zip(names, wanted, strict=True))


def test_salted_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 10)
    big = spark.createDataFrame([(1 if k < 300 else k % 9, k) for k in range(400)] + [(None, 1000), (77, 1001)], "key long, at long")
    sizes = big.groupBy("key").agg(F.count("*").alias("rows")).where("key <> 77").withColumn("v", F.col("key") * 2)
    for how in ("inner", "left", "left_semi"):
        plain = sorted(map(tuple, big.join(sizes.drop("rows"), "key", how).collect()), key=str)
        assert sorted(map(tuple, skew.join_salted(big, sizes, "key", "rows", "at", how).collect()), key=str) == plain
    assert skew.fresh(["Place", "place_", "x"], "place") == "place__"


def brute_simhash(text, width=4):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    shingles = [b" ".join(words[p : p + width]) for p in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    """The smallest key that each key reaches."""
    root = {k: k for k in values}
    while True:
        new = {k: min(root[j] for j in values if linked(values[k], values[j])) for k in values}
        if new == root:
            return root
        root = new


def test_simhash(docs, empty):
    got = by_id(simhash.simhash_groups(docs))
    prints = {k: brute_simhash(t) for k, t in enumerate(TEXTS)}
    assert {k: r.fp % 2**64 for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("block", [8, 16384])
def test_gray_index_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(3):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    values = sorted(values)
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    up = {v: v for v in values}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in simhash.near_links(frame).collect():
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() <= 4
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert {v: top(v) for v in values} == classes({v: v for v in values}, lambda a, b: (a ^ b).bit_count() <= 4)


def test_null_ids_and_repeats(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "other words stand in this one")], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.component_id) for r in simhash.simhash_groups(rows).collect()) == [(-1, 3), (3, 3), (3, 3), (9, 9)]
    for frame in (token_counts.count_tokens(rows, PIECES), bpe.encode_and_decode(rows, BYTE_BPE), licenses.scan_licenses(rows), mixing.mix_sources(rows.withColumn("source", F.lit("s")))):
        assert frame.count() == 4

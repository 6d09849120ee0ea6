"""The registered query of each training-data operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .ann import nearest
from .collocations import collocations
from .conversation_trie import numbered_turns, prefix_trie, rebuilt_turns
from .embedding_dedup import near_vectors
from .licenses import scan_licenses
from .mixing import mix_sources
from .quality import fit_quality, grade_documents, grades_of
from .runtime import table
from .secret_scan import scan_secrets
from .sharding import assign_shards
from .simhash import simhash_groups
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens

def tokenizer_file(name: str) -> str:
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 24)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, grades_of(table(spark, sf_dir, "labels")))
    return grade_documents(docs, model).drop("text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", hexed, "component_id")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_turns(numbered_turns(table(spark, sf_dir, "conversations"))))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_bpe_encode_decode, op3_byte_shards, op4_substring_dedup, op5_learned_partitions, op6_ordinal_quality, op7_license_scan,
        op8_source_mix, op9_simhash_near_dedup, op10_embedding_near_dedup, op11_conversation_trie, op12_secret_scan, op13_collocations,
    )
    return {f.__name__: f for f in found}


#: Words are re-joined windows of 20; a window is removed where the same words start earlier.
_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w)),
again AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS p FROM again),
tok AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS text FROM tok t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


#: All pairs of directions, and everything that links reach.
_OP10 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS r FROM embeddings UNION SELECT reach.node, l.b FROM reach JOIN links l ON l.a = reach.r),
root AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, root.component_id, e.vec_id = root.component_id AS kept
FROM embeddings e JOIN root ON root.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


#: CRC32 bit by bit; every prefix of every rebuilt conversation, by its digests; a node's subtree is all nodes whose sequence begins with its own.
_OP11 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda r, x: list_reduce(list_prepend(xor(r, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS half, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos < c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (SELECT conv_id, length(text) AS chars, list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY half, pos) AS seq FROM r),
m AS MATERIALIZED (SELECT conv_id, array_to_string(seq, '') AS seq, len(seq) AS d, chars FROM s UNION ALL SELECT conv_id, '', 0, 0 FROM c),
tops AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
node AS MATERIALIZED (SELECT m.seq, m.d, min(m.conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(m.chars) AS own, sha256(coalesce(string_agg(CASE WHEN tops.d = m.d THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id), '')) AS ends FROM m JOIN tops ON tops.conv_id = m.conv_id GROUP BY m.seq, m.d),
kids AS (SELECT substr(seq, 1, CAST(64 * (d - 1) AS BIGINT)) AS seq, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.k, 0) AS k FROM node LEFT JOIN kids ON kids.seq = node.seq),
above AS (SELECT substr(seq, 1, CAST(64 * a AS BIGINT)) AS seq, own, k FROM (SELECT seq, own, k, unnest(range(0, d + 1)) AS a FROM full_)),
sums AS (SELECT seq, sum(own) AS saved, count(*) FILTER (k = 0) AS leaves FROM above GROUP BY seq)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, CAST(f.k AS BIGINT) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN sums s ON s.seq = f.seq LEFT JOIN node p ON f.d > 0 AND p.seq = substr(f.seq, 1, CAST(64 * (f.d - 1) AS BIGINT))
"""


#: Every phrase is counted, sums in 128 bits; a phrase goes if one of the longer ones around it has 80 per cent of its count.
_OP13 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM cand),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f::HUGEINT) AS BIGINT) AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k)),
around AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.most IS NULL OR 100::HUGEINT * o.most < 80::HUGEINT * b.a)
SELECT k.lang, CAST(row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n.n, score
FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """Token libraries, trained models, XXH64 and CRC32 are beyond SQL, and a search that may miss is held against brute force; their tests do that."""
    return {"op4_substring_dedup": _OP4, "op10_embedding_near_dedup": _OP10, "op11_conversation_trie": _OP11, "op13_collocations": _OP13}

"""A training-corpus pipeline over `documents`: each stage calls one operator of the llm package on all that the stage before it kept.

Quality classifier, near-dedup by SimHash (and by MinHash where that sees no link), substring dedup, mixing sources to target weights, BPE encoding and decoding.
Every stage but the last returns the columns of documents; each stage's docstring states what null, empty and repeated rows become.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe
from eventloom.llm.jaccard import one_near_copy
from eventloom.llm.mixing import mixed_documents
from eventloom.llm.quality import fit_quality, grade_documents, grades_of
from eventloom.llm.runtime import exists, remove, shared_dir, table
from eventloom.llm.skew import fresh
from eventloom.llm.substring_dedup import dedup_substrings


# In every stage texts count whole, whatever their length, other columns stay, whatever their names, and an empty table gives no rows.


def _aside(docs: DataFrame, added: set[str]) -> tuple[DataFrame, list]:
    """docs with columns that an operator's added ones would replace under other names, and the columns that give docs's own back."""
    taken, back = [*docs.columns, *added], []
    for c in docs.columns:
        name = c
        if c.lower() in added:
            name = fresh(taken, c)
            taken.append(name)
        back.append((c, name))
    return docs.select(*(F.col(c).alias(name) for c, name in back)), [F.col(name).alias(c) for c, name in back]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are more likely junk or toxic than clean. The model is fitted on the labelled ones among `docs`; without any, all stay.

    A null or empty text has no features: the model's thresholds alone decide, for all such texts alike. Repeated rows share a fate, null ids too are judged by their text.
    """
    model = fit_quality(docs, grades_of(table(spark, sf_dir, "labels")))
    rows, back = _aside(docs, {"expected_grade", "tail", "keep"})
    return grade_documents(rows, model).where("keep").select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (a five-word Jaccard similarity of 0.8 or more, by chains) stays, the first by (doc_id, place in the table); rows without an id come last.

    SimHash proposes pairs through operator 9's index, MinHash those that differ in more bits; both are verified on the whole sets of shingles. Texts without words (null, empty, blank) are one group, of which one row stays; a text with fewer than five words is near only to the same words.
    """
    return one_near_copy(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that a window of 20 words covers which also starts earlier; n_chars follows the text. All documents stay, with an empty text if nothing is left; a null text stays null."""
    rows, back = _aside(docs, {"n_words", "n_removed", "kept_sha256"})
    kept = dedup_substrings(rows)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*back)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, a document once for each pass that takes it, cut where a pass ends within it; those without words (null, empty, blank) are never taken, a null source is a source."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row that the mix took, repeats and null ids included; a null text counts as empty: no tokens."""
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_copies), ("substring_dedup", repeated_passages), ("source_mix", source_mix), ("bpe_encode_decode", tokens)]

#: A trained model, 64-bit string hashes and a byte-pair encoder are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again, and go once the next stage's are written.

    A run that broke off goes on from its last finished stage if it is given the same folder again.
    """
    folder = folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    places = [f"{folder}/{k}_{name}" for k, (name, _) in enumerate(STAGES)]
    finished = [k for k in range(len(STAGES) - 1) if exists(spark, f"{places[k]}/_SUCCESS")]
    done = finished[-1] + 1 if finished else 0
    docs = spark.read.parquet(places[done - 1]) if done else table(spark, sf_dir, "documents")
    for k, (_, stage) in list(enumerate(STAGES))[done:]:
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(places[k])
            docs = spark.read.parquet(places[k])
            if k:
                remove(spark, places[k - 1])
    return docs

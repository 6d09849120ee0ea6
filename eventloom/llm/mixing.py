"""A training mix in target proportions: a low-discrepancy schedule of sources, filled with equal blocks of shuffled documents.

Slot n of the schedule goes to the source whose stretch of the cumulative weights holds the n-th point of the golden-ratio sequence, so every stretch
of the schedule, not only all of it, is close to the weights. A source's documents are shuffled and laid end to end, and that stream of words is cut
into equal blocks; the source's r-th slot takes its r-th block, starting over at the end of the stream, until its target is met to the word.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut
from .skew import fresh, join_salted, number_within

WEIGHTS, MOST_REPEATS = (1.0, 2.0, 3.0), 3.0
#: Words in a block; documents in a bucket of the shuffled order; slots in a chunk of the schedule; sources that are ranked in one task.
BLOCK_WORDS, BUCKET_DOCS, CHUNK_SLOTS, PART_SOURCES = 4096, 4096, 1 << 16, 100_000
#: Sources up to which their plan is broadcast; beyond, joins shuffle.
FEW_SOURCES = 20_000
GOLDEN = 0.6180339887498949


def _prefix(key: str, step: str, value: str) -> F.Column:
    """The sum of value over the earlier steps of a key."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _ordered(rows: DataFrame, order: list[str], total: int) -> DataFrame:
    """rows dealt into range partitions (`part`) of about PART_SOURCES rows, and stored."""
    return cut(rows.repartitionByRange(max(1, -(-total // PART_SOURCES)), *order).withColumn("part", F.spark_partition_id()))


def _running(dealt: DataFrame, order: list[str], value: F.Column, name: str) -> DataFrame:
    """dealt with the sum of value over all rows before each: per partition, upon the totals of the partitions before (one row each)."""
    dealt = dealt.withColumn(name, value)
    totals = dealt.groupBy("part").agg(F.sum(name).alias("sum"))
    before = totals.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(before, "part").withColumn(name, F.col("before") + F.sum(name).over(inside) - F.col(name)).drop("before")


def water_level(sources: DataFrame, most: float = MOST_REPEATS) -> float:
    """The words per unit of weight that the sources (n, weight) get which are not full: all words are shared by weight, none gets above `most` times its own, the excess is shared again.

    Each round passes four numbers to the driver; a round fills at least one more source, and usually all that are left to fill.
    """
    level, full = -1.0, -1
    while True:
        over = (F.col("n") > 0) & (F.col("weight") * level > most * F.col("n"))
        got = sources.agg(F.sum("n"), F.sum(F.when(over, most * F.col("n"))), F.sum(F.when(~over & (F.col("n") > 0), F.col("weight"))), F.count(F.when(over, 1))).first()
        if got[3] == full or not got[2]:
            return level if got[2] else math.inf
        full, level = got[3], (got[0] - (got[1] or 0.0)) / got[2]


def plan_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, source_col: str = "source") -> DataFrame:
    """(source, src, rows, source_size, target, words, blocks, slots, low, high) per source, by code point and null last; low to high is its stretch of the cumulative weights.

    docs has a column `size`. words: the target, rounded; blocks: of the source's stream; slots: how many blocks its words take.
    """
    sources = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).withColumn("last", F.col("source").isNull()))
    order = ["last", "source"]
    dealt = _ordered(sources, order, sources.count())
    ranked = _running(dealt, order, F.lit(1).cast("long"), "src").withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    ranked = cut(ranked)
    level = water_level(ranked, most)
    target = F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.col("weight") * F.lit(level), most * F.col("n")))
    ranked = ranked.withColumn("target", target.cast("double")).withColumn("words", F.least(F.round("target"), F.floor(most * F.col("n"))).cast("long"))
    ranked = _running(ranked, order, F.col("target"), "low")
    whole = ranked.agg(F.sum("target")).first()[0] or 1.0
    blocks = F.ceil(F.col("n") / BLOCK_WORDS)
    passes = F.when(F.col("n") > 0, F.floor(F.col("words") / F.col("n"))).otherwise(0)
    slots = passes * blocks + F.ceil((F.col("words") - passes * F.col("n")) / BLOCK_WORDS)
    return cut(ranked.select("source", "src", "rows", F.col("n").alias("source_size"), "target", "words", blocks.alias("blocks"), slots.cast("long").alias("slots"), (F.col("low") / whole).alias("low"), ((F.col("low") + F.col("target")) / whole).alias("high")))


def schedule(plan: DataFrame) -> DataFrame:
    """(slot double, src, rank long, epoch long, block long, words long): which block of which source each slot takes.

    There are as many points of the golden-ratio sequence as slots are wanted in all; a point's source is the one whose stretch holds it. A source's
    points past its target take nothing and are left out; where it gets a few too few, or its stretch is shorter than a point's share, its last
    slots lie at points of a golden-ratio sequence of its own. rank counts a source's slots in the order of the schedule; per-chunk counts are
    summed first, so no source is ranked in one task. A source's last slot takes the words that are still missing.
    """
    wanted = plan.where("words > 0")
    n, sources = wanted.agg(F.sum("slots"), F.count(F.lit(1))).first()
    n = int(n or 0)
    about = ["src", "low", "high", "words", "source_size", "blocks", "slots"]
    large = wanted.where((F.col("high") - F.col("low")) * n >= 1).select(*about)
    # A stretch meets the buckets that it overlaps: together no more than the sources and the buckets.
    buckets = 4 * max(1, sources)
    stretches = large.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") * buckets), F.least(F.floor(F.col("high") * buckets), F.lit(buckets - 1).cast("long")))))
    turn = F.col("id") * F.lit(GOLDEN)
    points = plan.sparkSession.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK_SLOTS).alias("chunk"), (turn - F.floor(turn)).alias("u")).withColumn("bucket", F.floor(F.col("u") * buckets))
    points = cut(points.join(F.broadcast(stretches) if sources <= FEW_SOURCES else stretches, "bucket").where("low <= u and u < high").select("slot", "chunk", *about))
    counts = cut(points.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n")))
    before = counts.select("src", "chunk", _prefix("src", "chunk", "n").alias("before"))
    ranked = points.join(before, ["src", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1)
    ranked = ranked.where(F.col("rank") < F.col("slots")).select(F.col("slot").cast("double").alias("slot"), "rank", *about)
    short = wanted.select(*about).join(counts.groupBy("src").agg(F.sum("n").alias("had")), "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    own = short.withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)))
    turn = F.col("low") + (F.col("rank") + 1) * F.lit(GOLDEN)
    ranked = ranked.unionByName(own.select((n * (turn - F.floor(turn))).alias("slot"), "rank", *about))
    ranked = ranked.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    begin = F.col("epoch") * F.col("source_size") + F.col("block") * BLOCK_WORDS
    whole = F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("source_size") - F.col("block") * BLOCK_WORDS)
    return ranked.select("slot", "src", "rank", "epoch", "block", F.least(whole, F.col("words") - begin).alias("words"))


def blocks_of(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """docs (key, place long, size, source) with src, source_size, target and `begin`, where each document's words begin in its source's shuffled stream.

    docs also has `mark`, a hash of what else a row holds, and `number`, its number among equal rows of (key, mark). The order is that of a seeded hash of
    (key, mark, number), so it is the same however the rows come, but for equal rows, which may swap. Buckets of that order are summed first, so a source of any size is laid out by many tasks.
    """
    rows = docs.count()
    buckets = max(1, rows // BUCKET_DOCS)
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("named")  # a null source is a source too
    sources = plan.select(named, "src", "source_size", "target", "rows")
    slim = docs.select("key", "mark", "number", "place", "size", named)
    mixed = slim.join(F.broadcast(sources.drop("rows")), "named") if sources.count() <= FEW_SOURCES else join_salted(slim, sources, "named", "rows", "place")
    mixed = mixed.drop("named").withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "mark", "number"), 1)).withColumn("bucket", F.floor(F.col("draw") / F.lit(2.0**63) * buckets))
    sums = mixed.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("src", "bucket", _prefix("src", "bucket", "n").alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("draw", "key", "mark", "number").rowsBetween(Window.unboundedPreceding, 0)
    return mixed.join(sums, ["src", "bucket"]).withColumn("begin", F.col("before") + F.sum("size").over(inside) - F.col("size")).drop("before", "draw", "bucket")


def word_count(text: str) -> F.Column:
    """Runs of non-space characters: each begins at the text's start or after white space."""
    spaced = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("long")


def _mix(slim: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """slim (key, place long, size, source, mark, tell: a hash of all its columns), stored -> place, key, size, source_size, target, taken."""
    plan = plan_sources(slim, weights, most)
    laid = cut(blocks_of(number_within(slim, ["key", "mark"], ["tell", "place"]), plan, seed))
    taken = schedule(plan).groupBy("src", "block").agg(F.collect_list("words").alias("takes"))
    pieces = laid.where("size > 0").select("place", "src", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK_WORDS), F.floor((F.col("begin") + F.col("size") - 1) / BLOCK_WORDS))).alias("block"))
    low = F.greatest(F.col("begin") - F.col("block") * BLOCK_WORDS, F.lit(0))
    high = F.least(F.col("begin") + F.col("size") - F.col("block") * BLOCK_WORDS, F.lit(BLOCK_WORDS))
    of_piece = F.aggregate("takes", F.lit(0).cast("long"), lambda s, w: s + F.greatest(F.lit(0), F.least(F.col("high"), w) - F.col("low")))
    pieces = pieces.withColumn("low", low).withColumn("high", high).join(taken, ["src", "block"]).select("place", of_piece.alias("words"))
    sums = pieces.groupBy("place").agg(F.sum("words").alias("taken"))
    return laid.join(sums, "place", "left").select("key", "place", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target (its source's), taken (words the mix takes, repeats counted).

    Sources in the order of code points, null last as a source of its own, weigh `weights`, repeating. A source's taken words are its target, rounded; no document
    is taken more than `most` times over. Documents without words (null, empty, blank) have size 0 and are never taken; long texts count whole. Repeated rows
    are documents of their own; a null id is an id like others. Other columns are not read, whatever their names. An empty table gives no rows.
    Equal rows and seed give equal results in whatever order the rows come, null and repeated ids included.
    """
    slim = cut(docs.select(F.col(id_col).alias("key"), F.monotonically_increasing_id().alias("place"), word_count(text_col).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col, source_col).alias("mark"), F.lit(0).cast("long").alias("tell")))
    return _mix(slim, weights, most, seed).drop("place").withColumnRenamed("key", id_col)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each document once for every whole pass, and once more cut to its first words where the last pass ends within it.

    Columns are those of docs, whatever their names; one named n_chars follows the text. Documents that the mix does not take (those without words,
    null, empty or blank, among them) are left out; an empty table gives no rows. The rows are numbered once and stored; the shuffle draws on their
    columns and on a number among equal rows, so the mix is the same in whatever order docs come, null and repeated ids included.
    """
    place, size, taken, turn, words = (fresh(docs.columns, c) for c in ("place", "size", "taken", "turn", "words"))
    rows = cut(docs.withColumn(place, F.monotonically_increasing_id()))
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind] or [F.lit(0)]  # what hashes cannot read tells no rows apart
    slim = cut(rows.select(F.col(id_col).alias("key"), F.col(place).alias("place"), word_count(text_col).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col, source_col).alias("mark"), F.xxhash64(*hashed).alias("tell")))
    mix = _mix(slim, weights, most, seed).where("taken > 0").select(F.col("place").alias(place), F.col("size").alias(size), F.col("taken").alias(taken))
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(taken) / F.col(size)) - 1)
    rows = rows.join(mix, place).withColumn(turn, F.explode(passes)).withColumn(words, F.least(F.col(size), F.col(taken) - F.col(turn) * F.col(size)))
    short = F.array_join(F.slice(F.filter(F.split(F.translate(F.col(text_col), "\t\n\x0b\x0c\r", "     "), " ", -1), lambda w: w != ""), F.lit(1), F.col(words).cast("int")), " ")
    text = F.when(F.col(words) < F.col(size), short).otherwise(F.col(text_col))
    rows = rows.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)

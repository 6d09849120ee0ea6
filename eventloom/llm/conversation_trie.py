"""The trie of conversations' common prefixes, from a Cartesian tree over their sorted order.

Conversations are sorted by their turns' digests; the lengths of neighbours' common prefixes (LCP) are one array. Its nearest smaller values to both sides,
found block by block and across blocks by the minima of blocks, give each LCP's interval, a node that branches or ends; equal LCPs of one interval
are one node. Depths between a node and its parent are nodes with the same members and are added last. What a node holds is an aggregate over its
interval: differences of prefix sums, a minimum over blocks. No conversation, no class of equal ones and no node's members meet in one task: turns are
numbered by range partitions, conversations compared BLOCK turns at once and then by doubling, members' lists hashed as streams of short pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut
from .skew import join_salted

#: Turns that are compared at once, and sequences in a block of the LCP array; blocks at most, whose minima are broadcast (16 bytes each).
BLOCK, LEAST_BLOCK, MOST_BLOCKS = 64, 512, 1 << 16
#: Members of a class that are one piece of its list.
PIECE = 256


def _part(k: str) -> Column:
    """The partition in which monotonically_increasing_id() gave k."""
    return F.shiftright(k, 33)


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, id, chars, end): a conversation's turns from 0 by (turn, null first, digest), the digest of role and text, code points, and those up to the turn's end.

    Range partitions number their own rows; a conversation that goes on in the next partition adds what it had before, one row a partition at most.
    """
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 32))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("id"), F.char_length(said).cast("long").alias("chars"), F.monotonically_increasing_id().alias("place"))
    dealt = cut(rows.orderBy("conv_id", "turn", "id", "place").withColumn("k", F.monotonically_increasing_id()).select("conv_id", "id", "chars", "k", _part("k").alias("part")))
    pieces = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("sum"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    late = pieces.select("conv_id", "part", F.sum("n").over(before).alias("n0"), F.sum("sum").over(before).alias("sum0")).where("n0 is not null")
    here = Window.partitionBy("conv_id", "part").orderBy("k")
    local = dealt.select("conv_id", "part", "id", "chars", (F.row_number().over(here) - 1).cast("long").alias("at"), F.sum("chars").over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("to"))
    zero = F.lit(0).cast("long")
    return local.join(F.broadcast(late), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("n0", zero)).alias("pos"), "id", "chars", (F.col("to") + F.coalesce("sum0", zero)).alias("end"))


def rebuilt_turns(turns: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """Turns of rebuilt conversations, and (conv_id, null pos) for those without any: the first h turns of conversation c - c % family, then c's own from its h-th on, h = crc32(c) % heads."""
    turns = cut(turns)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<pos:bigint,id:binary,chars:bigint,end:bigint>>")
    row = F.struct("pos", "id", "chars", "end")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < heads - 1, row))).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads).cast("long"))
    convs = own.select("conv_id", "n", "head", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("head").alias("theirs")), "base", "left")
    convs = convs.withColumn("taken", F.slice(F.coalesce("theirs", none), F.lit(1), F.col("h").cast("int")))
    last = lambda a, k: F.when(k > 0, F.coalesce(F.try_element_at(a, k.cast("int"))["end"], zero)).otherwise(zero)
    nb = F.size("taken").cast("long")
    convs = cut(convs.select("conv_id", "n", "h", "taken", (nb - F.col("h")).alias("shift"), (last(F.col("taken"), nb) - last(F.col("head"), F.col("h"))).alias("gain")))
    mine = join_salted(turns, convs.select("conv_id", "n", "h", "shift", "gain"), "conv_id", "n", "pos").where("pos >= h")
    mine = mine.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "id", "chars", (F.col("end") + F.col("gain")).alias("end"))
    first = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.pos", "t.id", "t.chars", "t.end")
    empty = convs.where((F.size("taken") == 0) & (F.col("n") <= F.col("h"))).select("conv_id", F.lit(None).cast("long"), F.lit(None).cast("binary"), zero, zero)
    return mine.union(first).union(empty)


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    """The different rows, and r, a number in their order: range partitions keep it."""
    return cut(rows.select(*by).distinct().orderBy(*by).withColumn("r", F.monotonically_increasing_id()))


def _sorted(blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(items by level, ranks of the last): items (conv_id, b, r) of level j number stretches of 2 ** j blocks in their order; the last one has whole conversations."""
    ranks = _ranked(blocks, "ids")
    levels = [cut(blocks.join(ranks, "ids").select("conv_id", "b", "r"))]
    while (levels[-1].agg(F.max("b")).first()[0] or 0) > 0:
        half = F.pmod("b", F.lit(2)) == 0
        pairs = cut(levels[-1].groupBy("conv_id", F.floor(F.col("b") / 2).alias("b")).agg(F.max(F.when(half, F.col("r"))).alias("x"), F.coalesce(F.max(F.when(~half, F.col("r"))), F.lit(-1).cast("long")).alias("y")))
        ranks = _ranked(pairs, "x", "y")
        levels.append(cut(pairs.join(ranks, ["x", "y"]).select("conv_id", "b", "r")))
    return levels, ranks


def _common(a: str, b: str) -> Column:
    """How many first entries two arrays share."""
    return F.expr(f"coalesce(nullif(array_position(zip_with(slice({a}, 1, least(size({a}), size({b}))), slice({b}, 1, least(size({a}), size({b}))), (x, y) -> x = y), false), 0) - 1, least(size({a}), size({b})))").cast("long")


def _with_lcp(seqs: DataFrame, blocks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """seqs + l: how many turns a sequence shares with the one before it (-1 for the first)."""
    ids = blocks.where("b = 0").select(F.col("conv_id").alias("conv"), "ids")
    first = cut(seqs.join(ids, "conv").select("idx", "conv", "ids"))
    pairs = first.join(first.select((F.col("idx") + 1).alias("idx"), F.col("conv").alias("prev"), F.col("ids").alias("those")), "idx").select("idx", "conv", "prev", _common("ids", "those").alias("l"))
    if len(levels) > 1:
        pairs = cut(pairs)
        deep = pairs.where(F.col("l") == BLOCK).select("idx", "conv", "prev", F.lit(0).cast("long").alias("q"))
        for j in range(len(levels) - 2, -1, -1):  # the longest equal stretch from q on, halving
            item = levels[j].select("conv_id", "b", "r")
            at = deep.withColumn("b", F.floor(F.col("q") / 2**j))
            for who in ("conv", "prev"):
                at = at.join(item.select(F.col("conv_id").alias(who), "b", F.col("r").alias(f"r_{who}")), [who, "b"], "left")
            deep = cut(at.select("idx", "conv", "prev", F.when(F.col("r_conv") == F.col("r_prev"), F.col("q") + 2**j).otherwise(F.col("q")).alias("q")))
        for who in ("conv", "prev"):
            deep = deep.join(blocks.select(F.col("conv_id").alias(who), F.col("b").alias("q"), F.col("ids").alias(f"ids_{who}")), [who, "q"], "left")
        nothing = F.array().cast("array<binary>")
        deep = deep.select("idx", F.coalesce("ids_conv", nothing).alias("x"), F.coalesce("ids_prev", nothing).alias("y"), "q").select("idx", (F.col("q") * BLOCK + _common("x", "y")).alias("more"))
        pairs = pairs.join(deep, "idx", "left").withColumn("l", F.coalesce("more", "l"))
    return seqs.join(pairs.select("idx", "l"), "idx", "left").withColumn("l", F.coalesce("l", F.lit(-1).cast("long")))


def smaller_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the nearest smaller one before and after it; -1 and len(values) where there is none."""
    before, after, stack = [-1] * len(values), [len(values)] * len(values), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][1] > v:
            after[stack.pop()[0]] = i
        # Equal values stay until a smaller one comes; their own nearest smaller one is that of the first of them.
        before[i] = before[stack[-1][0]] if stack and stack[-1][1] == v else stack[-1][0] if stack else -1
        stack.append((i, v))
    return np.array(before, dtype=np.int64), np.array(after, dtype=np.int64)


class Minima:
    """Minima of stretches of an array, from those of stretches of 2 ** k entries."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]) if len(last) > step else last[:0])

    def least(self, low: np.ndarray, high: np.ndarray, none: int) -> np.ndarray:
        """Of entries low to high - 1; `none` for empty stretches."""
        size, out = high - low, np.full(len(low), none, dtype=np.int64)
        k = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        for j in np.unique(k[size > 0]):
            at = np.flatnonzero((k == j) & (size > 0))
            out[at] = np.minimum(self.levels[j][low[at]], self.levels[j][high[at] - (1 << j)])
        return out

    def next_below(self, at: int, value: int) -> int:
        """The first place after `at` that holds less than value, or -1."""
        p, n = at + 1, len(self.levels[0])
        for j in range(len(self.levels) - 1, -1, -1):
            while p + (1 << j) <= n and p < n and self.levels[j][p] >= value:
                p += 1 << j
        return p if p < n else -1


_NONE = np.iinfo(np.int64).max
_LOCAL = "idx long, l long, len long, conv long, r long, w long, blk long, ps long, ns long, nl long, cw long, cf long, tail long, head long, mi long, ml long"


def _in_block(rows: pa.Table) -> pa.Table:
    """What a block of the array tells alone: nearest smaller places, null where they lie outside; sums before each entry; minima to its end, before an entry, and of intervals inside."""
    rows = rows.sort_by("idx")
    idx, l, nxt, length, conv, w = (rows[c].combine_chunks().fill_null(_NONE if c == "conv" else 0).to_numpy() for c in ("idx", "l", "nxt", "len", "conv", "w"))
    n, first = len(idx), int(idx[0])
    before, after = smaller_values(l)
    leaf = (nxt < length).astype(np.int64)
    nl = np.where(leaf == 1, np.arange(n) + 1, np.append(after[1:], n + 1))  # a sequence's own node ends before the next smaller value than its length
    known = np.where(leaf == 1, True, np.append(after[1:] < n, False))
    minima = Minima(conv)
    inner = (before >= 0) & (after < n)
    mine = known & (nl < n)
    mi = minima.least(np.where(inner, before, 0), np.where(inner, after, 0), _NONE)
    ml = minima.least(np.where(mine, np.arange(n), 0), np.where(mine, nl, 0), _NONE)
    out = rows.select(["idx", "l", "len", "conv", "r", "w", "blk"])
    for name, values, ok in (
        ("ps", before + first, before >= 0), ("ns", after + first, after < n), ("nl", nl + first, known), ("cw", np.cumsum(w) - w, None), ("cf", np.cumsum(leaf) - leaf, None),
        ("tail", np.minimum.accumulate(conv[::-1])[::-1], None), ("head", np.append(_NONE, np.minimum.accumulate(conv)[:-1]), None), ("mi", mi, inner), ("ml", ml, mine),
    ):
        out = out.append_column(name, pa.array(values, pa.int64(), mask=None if ok is None else ~ok))
    return out


def _answers(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """For each question (after, v) the first (after) or last place of a block that holds less than v."""
    if not asked.num_rows:
        return pa.table({"target": pa.array([], pa.int64()), "after": pa.array([], pa.bool_()), "v": pa.array([], pa.int64()), "found": pa.array([], pa.int64())})
    rows = rows.sort_by("idx")
    l, idx = rows["l"].to_numpy(), rows["idx"].to_numpy()
    v, after = asked["v"].to_numpy(), asked["after"].to_numpy()
    ahead, back = np.minimum.accumulate(l), np.minimum.accumulate(l[::-1])
    first, last = np.searchsorted(-ahead, -v, side="right"), len(l) - 1 - np.searchsorted(-back, -v, side="right")
    return asked.select(["target", "after", "v"]).append_column("found", pa.array(idx[np.where(after, first, last)], pa.int64()))


def _intervals(array: DataFrame, blocks: int) -> tuple[DataFrame, object]:
    """array with each entry's nearest smaller places and local sums (_LOCAL), none open but at the array's ends; and the blocks' minima as a broadcast."""
    spark = array.sparkSession
    local = cut(array.groupBy("blk").applyInArrow(_in_block, _LOCAL))
    rows = local.groupBy("blk").agg(F.min("l").alias("l"), F.min("conv").alias("conv")).orderBy("blk").toPandas()  # MOST_BLOCKS + 1 rows at most
    sent = spark.sparkContext.broadcast((rows["l"].to_numpy(np.int64), rows["conv"].fillna(_NONE).to_numpy(np.int64)))

    @F.pandas_udf("long")
    def block_below(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        least = sent.value[0]
        ahead, back, n = Minima(least), Minima(least[::-1]), len(least)
        for blk, v, after in parts:
            found = [ahead.next_below(b, x) if a else back.next_below(n - 1 - b, x) for b, x, a in zip(blk, v, after, strict=True)]
            yield pd.Series([f if a or f < 0 else n - 1 - f for f, a in zip(found, after, strict=True)], dtype="int64")

    open_ = lambda col, v, after: local.where(F.col(col).isNull()).select("blk", F.col(v).alias("v"), F.lit(after).alias("after"))
    asked = open_("ps", "l", False).union(open_("ns", "l", True)).union(open_("nl", "len", True)).distinct()
    aimed = cut(asked.withColumn("target", block_below("blk", "v", "after")).where("target >= 0"))
    found = array.withColumnRenamed("blk", "target").groupBy("target").cogroup(aimed.select("target", "after", "v").distinct().groupBy("target")).applyInArrow(_answers, "target long, after boolean, v long, found long")
    far = cut(aimed.join(found, ["target", "after", "v"]).select("blk", "v", "after", "found"))
    for col, v, after in (("ps", "l", False), ("ns", "l", True), ("nl", "len", True)):
        one = far.where(F.col("after") == after).select("blk", F.col("v").alias(v), F.col("found").alias("far"))
        some = local.where(F.col(col).isNull()).join(one, ["blk", v], "left").select("idx", "far")
        local = local.join(some, "idx", "left").withColumn(col, F.coalesce(col, "far")).drop("far")
    return local, sent


def _class_digests(members: DataFrame) -> DataFrame:
    """(r, sha): SHA-256 of each class's ids, ascending and comma-joined; members: r, conv_id. A digest is made in one go by definition, of pieces that stream through."""
    dealt = cut(members.orderBy("r", "conv_id").withColumn("k", F.monotonically_increasing_id()).select("r", "conv_id", "k", _part("k").alias("part")))
    piece = F.floor((F.row_number().over(Window.partitionBy("r", "part").orderBy("k")) - 1) / PIECE)
    pieces = dealt.withColumn("piece", piece).groupBy("r", "part", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("said"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for r, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = r, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(said.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], names=["r", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["r", "sha"])

    return pieces.repartition("r").sortWithinPartitions("r", "part", "piece").select("r", "said").mapInArrow(digest, "r long, sha string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each different sequence of a conversation's first `depth` turns.

    turns: conv_id, pos from 0, id (its turn's digest), chars, end (chars up to its end); a null pos stands for a conversation without turns. conv_id is the
    smallest member's; the root has depth 0 and no parent; n_leaves and saved_tokens sum up the subtree, top included: childless nodes, and (n_convs - 1) times
    the last turn's chars; ends_sha256 is of the members that end here, ids ascending and comma-joined. No conversations, no rows.
    """
    zero = F.lit(0).cast("long")
    b = F.coalesce(F.floor(F.col("pos") / BLOCK), zero).alias("b")
    blocks = turns.groupBy("conv_id", b).agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "end", "chars")))).alias("t"))
    blocks = cut(blocks.select("conv_id", "b", F.col("t.id").alias("ids"), F.col("t.end").alias("ends"), F.expr("get(t, 0).end - get(t, 0).chars").alias("before")))
    levels, ranks = _sorted(blocks)
    seqs = levels[-1].groupBy("r").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("w"))
    offsets = ranks.groupBy(_part("r").alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # a row a partition
    seqs = seqs.withColumn("part", _part("r")).join(F.broadcast(offsets), "part").select("r", "conv", "w", (F.col("first") + F.col("r").bitwiseAND((1 << 33) - 1)).alias("idx"))
    last = blocks.groupBy("conv_id").agg(F.max(F.col("b") * BLOCK + F.size("ids")).alias("len"))
    seqs = cut(seqs.join(last.select(F.col("conv_id").alias("conv"), "len"), "conv"))
    m = seqs.count()
    if not m:
        return turns.sparkSession.createDataFrame([], _TRIE)
    size = max(LEAST_BLOCK, -(-m // MOST_BLOCKS))
    array = cut(_with_lcp(seqs, blocks, levels))
    ending = turns.sparkSession.range(1).select(F.lit(m).cast("long").alias("idx"), F.lit(None).cast("long").alias("conv"), F.lit(None).cast("long").alias("r"), zero.alias("w"), zero.alias("len"), F.lit(-1).cast("long").alias("l"))
    array = array.select("idx", "conv", "r", "w", "len", "l").union(ending)
    array = array.join(array.select((F.col("idx") - 1).alias("idx"), F.col("l").alias("nxt")), "idx", "left").withColumn("blk", F.floor(F.col("idx") / size))
    local, sent = _intervals(cut(array), size)
    sums = local.groupBy("blk").agg(F.sum("w").alias("w"), F.sum(F.when((F.col("nl") == F.col("idx") + 1) & F.col("conv").isNotNull(), 1).otherwise(0)).alias("f"))
    running = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # MOST_BLOCKS + 1 rows at most
    sums = sums.select("blk", F.coalesce(F.sum("w").over(running), zero).alias("w0"), F.coalesce(F.sum("f").over(running), zero).alias("f0"))
    at = cut(local.join(F.broadcast(sums), "blk").select("idx", "l", "len", "conv", "r", "w", "ps", "ns", "nl", "tail", "head", "mi", "ml", (F.col("cw") + F.col("w0")).alias("ww"), (F.col("cf") + F.col("f0")).alias("ff")))

    # Edges end in a node that branches or ends (left, v); l is -1 only at the array's ends.
    inner = at.where("l >= 0").groupBy(F.col("ps").alias("left"), F.col("l").alias("v")).agg(F.first("ns").alias("right"), F.min("mi").alias("m"))
    tips = at.where("conv is not null").select(F.col("idx").alias("left"), F.col("len").alias("v"), F.col("nl").alias("right"), F.col("ml").alias("m"))
    here = at.select(F.col("idx").alias("left"), F.col("l").alias("l0"), "len", "ps", "conv", "r", "w", "tail", F.col("ww").alias("w0"), F.col("ff").alias("f0"))
    there = at.select(F.col("idx").alias("right"), F.col("l").alias("l1"), "head", F.col("ww").alias("w1"), F.col("ff").alias("f1"))

    @F.pandas_udf("long")
    def between(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        least = Minima(sent.value[1])
        for low, high in parts:
            yield pd.Series(least.least(low.to_numpy() // size + 1, high.to_numpy() // size, _NONE))

    edges = inner.join(here, "left").where("v <> len").unionByName(tips.join(here, "left")).join(there, "right")
    own = F.least("tail", "head", between("left", "right"))
    up = F.greatest("l0", "l1")
    edges = cut(edges.select("left", "right", "v", up.alias("u"), F.coalesce("m", own).alias("m"), "conv", "r", "w", (F.col("v") == F.col("len")).alias("ends"), (F.col("w1") - F.col("w0")).alias("n"), (F.col("f1") - F.col("f0")).alias("leaves"), F.when(F.col("l1") > F.col("l0"), F.col("left")).otherwise(F.col("ps")).alias("up_left")))

    saved = _saved(edges, blocks, size)
    kids = edges.where("u >= 0").groupBy(F.col("up_left").alias("left"), F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("kids"))
    tops = edges.select(F.col("left").alias("up_left"), F.col("v").alias("u"), F.col("m").alias("up_m"))
    many = edges.where("ends and w > 1").select("r")
    members = levels[-1].join(many, "r", "left_semi").select("r", "conv_id")
    edges = edges.withColumn("r", F.when(F.col("ends"), F.col("r")).otherwise(-1 - F.col("left")))  # no class, and no key that many rows share
    whole = edges.join(kids, ["left", "v"], "left").join(tops, ["up_left", "u"], "left").join(_class_digests(members), "r", "left")
    whole = whole.join(saved, ["left", "v"], "left")
    ends = F.when(~F.col("ends"), F.sha2(F.lit(""), 256)).when(F.col("w") > 1, F.col("sha")).otherwise(F.sha2(F.col("conv").cast("string"), 256))
    whole = cut(whole.select("m", "u", "v", "up_m", "n", F.coalesce("kids", zero).alias("kids"), "leaves", ends.alias("sha"), "conv", F.coalesce("below", zero).alias("below"), F.coalesce("to", zero).alias("to")))
    return _expanded(whole, blocks)


_TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _saved(edges: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(left, v, to, below) of edges with several members: chars up to the edge's end, and what the nodes under its end save."""
    zero = F.lit(0).cast("long")
    many = edges.where("n > 1").select("left", "right", "v", "n", "conv", F.greatest("u", zero).alias("u"))
    asked = many.select("left", "v", "conv", F.explode(F.array("u", "v")).alias("p"), "u").where("p > 0")
    ends = asked.withColumn("b", F.floor((F.col("p") - 1) / BLOCK)).join(blocks.select(F.col("conv_id").alias("conv"), "b", "ends"), ["conv", "b"])
    ends = ends.withColumn("end", F.expr(f"get(ends, cast(p - 1 - b * {BLOCK} as int))")).groupBy("left", "v").agg(F.max(F.when(F.col("p") == F.col("v"), F.col("end"))).alias("to"), F.max(F.when(F.col("p") == F.col("u"), F.col("end"))).alias("frm"))
    gained = many.join(ends, ["left", "v"], "left").withColumn("to", F.coalesce("to", zero))
    gained = cut(gained.withColumn("own", (F.col("n") - 1) * (F.col("to") - F.when(F.col("u") == F.col("v"), F.col("to")).otherwise(F.coalesce("frm", zero)))))
    totals = cut(gained.groupBy("left").agg(F.sum("own").alias("t")).withColumn("blk", F.floor(F.col("left") / size)))
    # Sums before any place: places that end an edge are asked for within their block, whose own totals stand before or at them.
    asked = gained.select("right").distinct().select(F.col("right").alias("at"), F.lit(None).cast("long").alias("t"))
    marks = totals.select(F.col("left").alias("at"), "t").union(asked).withColumn("blk", F.floor(F.col("at") / size))
    inside = Window.partitionBy("blk").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("local", F.coalesce(F.sum("t").over(inside), zero))
    filled = marks.select("blk").distinct().join(totals.groupBy("blk").agg(F.sum("t").alias("s")), "blk", "left")
    running = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # MOST_BLOCKS + 1 rows at most
    filled = filled.select("blk", F.coalesce(F.sum("s").over(running), zero).alias("t0"))
    sums = cut(marks.join(F.broadcast(filled), "blk").groupBy("at").agg(F.max(F.col("local") + F.col("t0")).alias("sum")))
    deeper = Window.partitionBy("left").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    out = gained.withColumn("same", F.coalesce(F.sum("own").over(deeper), zero)).join(totals.select("left", "t"), "left")
    out = out.join(sums.select(F.col("at").alias("left"), F.col("sum").alias("s0")), "left").join(sums.select(F.col("at").alias("right"), F.col("sum").alias("s1")), "right")
    return out.select("left", "v", "to", (F.col("s1") - F.col("s0") - F.col("t") + F.col("same")).alias("below"))


def _expanded(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each depth of an edge: those before its end have one child and no ends."""
    b = F.explode(F.sequence(F.floor(F.greatest(F.col("u"), F.lit(0)) / BLOCK), F.floor(F.greatest(F.col("v") - 1, F.lit(0)) / BLOCK)))
    wide = edges.withColumn("b", b)  # depth d > 0 has its turn in block (d - 1) / BLOCK
    low = F.when((F.col("b") == 0) & (F.col("u") < 0), F.lit(0).cast("long")).otherwise(F.greatest(F.col("u") + 1, F.col("b") * BLOCK + 1))
    depths = F.when(low <= F.least("v", F.col("b") * BLOCK + BLOCK), F.sequence(low, F.least("v", F.col("b") * BLOCK + BLOCK)))
    alone = wide.where("n = 1").withColumn("depth", F.explode(depths)).withColumn("saved", F.lit(0).cast("long"))
    # Chars of the turns from this depth to the edge's end, for each member but one, and what is saved under the end.
    shared = wide.where("n > 1").join(blocks.select(F.col("conv_id").alias("conv"), "b", "ends", "before"), ["conv", "b"]).withColumn("depth", F.explode(depths))
    start = F.expr(f"CASE WHEN depth <= 1 THEN 0L WHEN depth - 1 = b * {BLOCK} THEN before ELSE get(ends, cast(depth - 2 - b * {BLOCK} as int)) END")
    shared = shared.withColumn("saved", F.col("below") + (F.col("n") - 1) * (F.col("to") - start))
    columns = ["m", "u", "v", "up_m", "n", "kids", "leaves", "sha", "depth", "saved"]
    rows = alone.select(*columns).union(shared.select(*columns))
    top, end = F.col("depth") == F.col("u") + 1, F.col("depth") == F.col("v")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(top, F.col("up_m")).otherwise(F.col("m"))
    return rows.select(F.col("m").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(end, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(end, F.col("sha")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"))

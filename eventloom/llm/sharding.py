"""Contiguous shards of near-equal bytes, from prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

#: Bytes that a row takes in a shard besides its text.
ROW_BYTES = 8


def _running(col: str, before: bool) -> F.Column:
    return F.coalesce(F.sum(col).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1 if before else 0)), F.lit(0))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 100_000) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null: shards are not keyed).

    Rows are put in the order of (id, crc32, size, place in the table), nulls first, by range partitions of about rows_per_part rows; only ids
    and sizes move, not texts. Each partition's total is one row, whose running sum over all partitions is its byte offset; running sums within
    the partitions do the rest. Shard s holds the rows whose middle byte lies in the s-th of `shards` equal stretches, so no shard's size is off the
    target by more than one row at each end, and shards are contiguous. slot counts a shard's rows from 0 without gaps. Size is the text's UTF-8
    bytes plus ROW_BYTES; a null text has none and the crc32 of the empty one. Repeated ids and rows each get their own slot; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("place"))
    parts = max(1, -(-docs.count() // rows_per_part), docs.sparkSession.sparkContext.defaultParallelism)
    order = ["id", "crc", "size", "place"]
    dealt = cut(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select("part", _running("bytes", True).alias("byte0"), _running("rows", True).alias("row0"), F.sum("bytes").over(Window.partitionBy()).alias("whole"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = dealt.join(offsets, "part").withColumn("end", F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("row", F.col("row0") + F.row_number().over(inside) - 1)
    shard = F.expr(f"cast((2 * end - size) * {int(shards)} div (2 * whole) as int)").alias("shard")
    placed = cut(placed.select("id", "size", "crc", "row", shard))
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("row0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet folders shard=0, shard=1, ...; rows of a repeated id go to the first of its shards."""
    home = assign_shards(docs, shards, id_col, text_col).groupBy(id_col).agg(F.min("shard").alias("shard"))
    on = docs[id_col].eqNullSafe(home[id_col])
    docs.join(home, on).drop(home[id_col]).repartitionByRange(shards, "shard", id_col).write.partitionBy("shard").parquet(path)

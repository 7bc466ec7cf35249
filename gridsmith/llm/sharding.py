"""Contiguous shards of equal bytes by global prefix sums.

Rows are put in the order of their keys by range partitioning (narrow columns
only: texts are never moved).  Each partition's byte and row totals are summed,
the totals' running sums give every partition its offset, and a running sum inside
the partition gives every row its place among all bytes.  A row goes to the shard
in whose equal share of the bytes its middle byte lies, so shards are contiguous
in key order and each differs from an equal share by less than the rows at its ends.

Null texts have no bytes and count 1. Null keys come first. Rows with equal keys
are ordered by checksum, size and then by their place in the input, which also
splits a key that holds most rows over several partitions; equal rows are
interchangeable. Fewer rows than shards leave some shards empty; an empty table
gives no rows. Columns other than key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm.common import materialize, partitions


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    return _placed(docs, F.monotonically_increasing_id(), shards, id_col, text_col).drop("_at")


def _placed(docs: DataFrame, at: Column, shards: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), at.alias("_at"))
    order = ["doc_id", "text_crc32", "size", "_at"]
    spark = docs.sparkSession
    dealt = materialize(rows.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "shard-rows")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))  # one row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("b").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.join(F.broadcast(offsets), "_part")  # as many rows as shuffle partitions
        .select(*order, "n0", "all_bytes", (F.col("b0") + F.sum("size").over(upto)).alias("end"), F.row_number().over(inside).alias("k"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "_at",
            F.least(F.lit(shards - 1), F.expr(f"cast((cast(2 * end - size as decimal(38,0)) * {shards}) div (2 * all_bytes) as int)")).alias("shard"),
            (F.col("n0") + F.col("k") - 1).alias("at"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "_at", "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of every row, each shard in a folder _shard=N of its own. Null and
    repeated ids are kept: rows are numbered in a table, and joined by number."""
    numbered = materialize(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered-rows")
    where = _placed(numbered, F.col("_number"), shards, id_col, text_col).select(F.col("_at").alias("_number"), F.col("shard").alias("_shard"))
    numbered.join(where, "_number").drop("_number").write.partitionBy("_shard").parquet(path)

"""Contiguous shards of near equal size, by global prefix sums of row sizes.

Rows are put in order over partitions of a range exchange; each partition's total, summed over
those before it, tells how many bytes and rows stand before any row of it, and equal cuts of the
whole then give each row its shard.  DataFrame functions only: no row is seen by Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import stored

#: Bytes that a row counts besides its text.
OVERHEAD = 16
#: Rows that a partition of the order holds, about.
ROWS = 100_000


def in_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", carry: list[str] = ()) -> DataFrame:
    """key, size, text_crc32, shard, slot of each row of docs; columns to carry come in one struct, `carried`.

    Rows stand in the order of key (nulls last), size, checksum.  Of T bytes in all, shard s
    takes the rows whose middle lies from s T / shards up to (s + 1) T / shards; so a shard's
    bytes differ from T / shards by less than the largest row, equal texts need not meet, and a
    row of more than two targets leaves shards without rows.  slot counts a shard's rows from 0.

    size is the text's UTF-8 bytes (none if null) plus OVERHEAD.  Equal rows are dealt one by
    one, so a key that a third of all rows share is cut like any others.  An empty table gives
    no rows; a text of any length is one row.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    plain = docs.select(F.col(key).alias("key"), *carried, (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body).alias("crc"))
    # written once, so that every later step sees the same number beside a row
    rows = stored(plain.withColumn("tie", F.monotonically_increasing_id()), "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    order = [F.col("key").asc_nulls_last(), F.col("size"), F.col("crc"), F.col("tie")]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))
    sorted_ = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ordered")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sorted_.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    totals = totals.select("part", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b"), F.coalesce(F.sum("r").over(ahead), F.lit(0)).alias("r"))
    mine = Window.partitionBy("part").orderBy(*order)
    before = F.col("b") + F.coalesce(F.sum("size").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sorted_.join(totals, "part").withColumns({"at": F.col("r") + F.row_number().over(mine) - 1, "before": before})
    # twice the bytes up to the row's middle, so that all stays in whole numbers
    shard = F.expr(f"cast(2 * before + size as decimal(20, 0)) * {shards} div cast({2 * total} as decimal(20, 0))").cast("int")
    placed = stored(placed.select("key", *(["carried"] if carry else []), "size", "crc", shard.alias("shard"), "at"), "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("at").alias("first")))  # as many rows as shards
    return placed.join(first, "shard").select(F.col("key").alias(key), *(["carried"] if carry else []), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, key: str = "doc_id", text: str = "text") -> None:
    """Writes docs, with their columns and slot, in folders shard=0, 1, ...; a shard's files hold ranges of its slots in order.

    A shard is several files where it is large, so no task writes a whole one.  A column of docs
    named shard or slot keeps its values under that name with an underscore behind it.
    """
    held = in_shards(docs, shards, key, text, docs.columns)
    names = [F.col(f"carried.`{c}`").alias(c + "_" if c.lower() in ("shard", "slot") else c) for c in docs.columns]
    out = held.select(*names, "slot", "shard")
    size = held.agg(F.count("*")).first()[0]
    parts = max(shards, -(-size // ROWS))
    out.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)

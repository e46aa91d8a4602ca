"""The engine's tables seen in the driver's: memories, turns, edges and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import exprs as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores if its files give fewer partitions: texts cost far more to read than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def memories(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """One memory a document: layer, status and strengths follow from its id, feedback from labels.

    whole: statements are whole texts; else their first 160 characters, which fit a token budget.
    """
    docs, labels = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    m = docs.join(labels.select("doc_id", F.col("quality").alias("positive"), F.col("toxic").alias("negative")), "doc_id", "left")
    layer = F.when(i % 20 == 0, "mental_model").when(i % 20 <= 3, "observation").when(i % 20 <= 18, "raw").otherwise("experience")
    strength = 0.1 + (i * 37 % 90) / F.lit(100.0)
    status = F.when(i % 17 == 0, "locked").when(i % 11 == 0, "candidate").otherwise(X.status_of(strength))
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (i * 7919 % 2592000) * 1000000)
    return m.select(
        i.alias("id"),
        layer.alias("layer"),
        (F.col("text") if whole else F.substring("text", 1, 160)).alias("statement"),
        "text",
        F.when(F.col("source").isin("src0", "src1"), "global").otherwise(F.concat(F.lit("project:"), "source")).alias("scope"),
        F.col("lang").alias("domain"),
        F.array("source", "lang").alias("tags"),
        at.alias("learned_at"),
        F.timestamp_micros(F.unix_micros(at) + (i % 5 - 1) * 3600000000).alias("valid_from"),
        F.when(i % 3 != 0, F.timestamp_micros(F.unix_micros(at) + (i % 9) * 86400000000)).alias("last_seen"),
        F.when(i % 8 != 0, F.timestamp_micros(F.unix_micros(at) + (i % 31) * 79200000000)).alias("last_accessed"),
        strength.alias("strength"),
        (0.2 + (i * 53 % 80) / F.lit(100.0)).alias("storage"),
        (i % 23).alias("frequency"),
        (i % 13).alias("turns"),
        (1 + i % 10).alias("weight"),
        (1 + i * 3 % 10).alias("confidence"),
        F.when(i % 3 == 0, "do").when(i % 3 == 1, "dont").alias("polarity"),
        (i % 4 == 0).alias("consolidated"),
        status.alias("status"),
        F.when(i % 2 == 0, "new").otherwise("stable").alias("trend"),
        F.coalesce("positive", F.lit(0)).alias("positive"),
        F.coalesce("negative", F.lit(0)).alias("negative"),
        (i % 7).alias("adopted"),
        (1 + i % 6).alias("proof"),
        (i % 4).alias("evidence"),
        (i % 5).alias("sources"),
    )


def entity_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, entity): orders as memories, parts as entities."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type, weight): each document leads back to one at half its id and on to a near one, by kind of its id."""
    i = F.col("doc_id")
    n = table(spark, sf_dir, "documents").select("doc_id")
    kind = F.when(i % 3 == 0, "semantic").when(i % 3 == 1, "causal").otherwise("co_accessed")
    first = n.select(i.alias("src"), F.floor(i / 2).alias("dst"), kind.alias("type"), (0.5 + (i % 5) / F.lit(10.0)).alias("weight"))
    second = n.select(i.alias("src"), (i + 1 + i * 13 % 17).alias("dst"), F.lit("temporal").alias("type"), (0.4 + (i % 6) / F.lit(10.0)).alias("weight"))
    return first.union(second).where("src <> dst")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, source_id): of every third experience, the two observations of its twenty ids."""
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id")).where("memory_id % 20 = 19 and floor(memory_id / 20) % 3 = 0")
    return e.select("memory_id", F.explode(F.array(F.col("memory_id") - 18, F.col("memory_id") - 17)).alias("source_id"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode a turn: every fourth a checkpoint, every third with next steps."""
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (F.col("conv_id") % 500 * 3600 + F.col("turn") * 60) * 1000000)
    mark = F.col("turn") % 4 == 0
    steps = F.when(F.col("turn") % 3 == 0, F.array(F.lit("one"), F.lit("two"), F.lit("three"), F.lit("four"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", at.alias("ts"), F.col("turn").alias("ord"), F.when(mark, "checkpoint").otherwise("turn").alias("kind"), F.when(mark, F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("label"), F.substring("text", 1, 80).alias("summary"), steps.alias("next_steps"))

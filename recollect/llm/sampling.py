"""Bounded, hash-ordered training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1 << 40


def bounded_sample(rows: DataFrame, stratum: str, key: str, most: int) -> DataFrame:
    """At most `most` rows of each stratum, those of the smallest hash of `key`; one row a key.

    Copies share a key, so a group of copies counts once.  A hash threshold set from an
    approximate distinct count leaves about twice `most` rows a stratum before any are ranked.
    """
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(SCALE))
    hashed = rows.where(F.col(stratum).isNotNull() & F.col(key).isNotNull()).withColumn("_h", h)
    sizes = hashed.groupBy(stratum).agg(F.approx_count_distinct("_h").alias("n")).collect()
    if not sizes:
        return rows.limit(0)
    limit = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(int(min(1.0, 2 * most / max(1, r[1])) * SCALE)))])
    near = hashed.where(F.col("_h") < limit[F.col(stratum)]).dropDuplicates([stratum, "_h"])
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_h"))
    return near.withColumn("_r", rank).where(F.col("_r") <= most).drop("_h", "_r")

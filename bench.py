"""Times the headline queries: one JSON line.  BENCH_SF_DIR: tables; BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import shutil
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")

QUERIES = (
    "tokenize_counts", "content_hash", "document_frequency", "bm25_topk", "bm25_batch", "substring_rank", "semantic_topk", "semantic_pairs", "temporal_search", "temporal_bfs",
    "graph_expansion", "temporal_edges", "rrf_fuse", "rerank_dims", "token_budget_trim", "recall_full", "decay_strength", "batch_decay", "dedup_actions", "learn_candidates", "feedback_fold",
    "consolidate_merge", "experience_synth", "store_stats", "review_scores", "three_way_merge", "chunk_layout", "adjacent_pairs",
)


def main() -> None:
    from pyspark.sql import DataFrame, SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    from recollect.operators import retrieval as R
    from recollect.plans import views as V
    from recollect.plans.queries import QUERIES as all_queries

    def timed(make) -> float:
        took = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return round(min(took), 3)

    seconds = {name: timed(lambda f=all_queries[name]: f(spark, sf_dir)) for name in QUERIES if name in all_queries}
    # a store as the engine keeps it: tables and an index of the texts, which recalls then read
    import tempfile

    home = tempfile.mkdtemp(prefix="bench-")

    def build() -> DataFrame:
        parts = {"memories": V.memories(spark, sf_dir, whole=False), "bridge": V.entity_bridge(spark, sf_dir), "edges": V.edges(spark, sf_dir)}
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{home}/{name}")
        for name in ("index", "trigrams"):
            shutil.rmtree(f"{home}/{name}", ignore_errors=True)
        held = spark.read.parquet(f"{home}/memories")
        R.write_index(held.select("id", "text"), f"{home}/index")
        fields, names = R.fts_fields(held)
        R.write_trigrams(fields, f"{home}/trigrams", names)
        return spark.range(1)

    seconds["store_build"] = timed(build)
    table = lambda name: spark.read.parquet(f"{home}/{name}")
    # a hundred recalls in one plan: queries are the first words of documents
    asked = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(100).select(F.col("doc_id").alias("query_id"), F.concat(F.array_join(F.slice(F.split(F.substring("text", 1, 200), " "), 1, 4), " "), F.lit(" 2024-01-15")).alias("query"))
    seconds["recall_100_queries"] = timed(lambda: R.recall(asked, table("memories"), table("bridge"), table("edges"), index=R.read_index(spark, f"{home}/index"), trigrams=R.read_trigrams(spark, f"{home}/trigrams"))["kept"])
    seconds["recall_100_without_index"] = timed(lambda: R.recall(asked, V.memories(spark, sf_dir, whole=False), V.entity_bridge(spark, sf_dir), V.edges(spark, sf_dir))["kept"])
    shutil.rmtree(home, ignore_errors=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

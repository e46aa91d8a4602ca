"""Migrations, health, embedders that fail, chunks written in one job."""

import time
from datetime import datetime

import pytest

from recollect.engine import SCHEMA_VERSION, Engine
from recollect.sources import store as S
from recollect.sources.embedding import embedder

NOW = datetime(2024, 2, 1)


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.setup()
    return e


def test_migrations_are_ordered_repeatable_and_stamped(engine):
    assert engine.schema_version() == SCHEMA_VERSION and engine.migrate() == {}
    engine.append("memories", engine.rows("id long, layer string, statement string, learned_at timestamp, weight long", (1, "raw", "old row", NOW, 3), (2, "raw", None, None, None)))
    engine.table("memories").commit(engine.read("memories").drop("trend", "turns", "last_accessed"))
    before = engine.table("memories").version()
    want = {"memories": ["turns", "last_accessed", "trend", "hash"]}
    dry = engine.migrate()
    assert set(dry["memories"]) >= {"turns", "last_accessed", "trend", "hash"} and engine.table("memories").version() == before
    assert set(engine.migrate(dry_run=False)["memories"]) >= set(want["memories"])
    row = {r["id"]: r for r in engine.read("memories").collect()}
    assert (row[1]["turns"], row[1]["last_accessed"], row[1]["trend"], row[1]["weight"]) == (0, NOW, "new", 3) and row[1]["hash"].startswith("sha256:")
    assert (row[2]["last_accessed"], row[2]["hash"], row[2]["weight"]) == (None, None, 5)
    assert engine.migrate() == {} and engine.migrate(dry_run=False) == {}
    engine.table("memories").rollback(before)
    assert engine.migrate() != {}


def test_newer_stores_are_refused(engine):
    engine.note("schema", NOW, "", SCHEMA_VERSION + 1)
    with pytest.raises(RuntimeError, match="newer|version"):
        engine.migrate()


def test_doctor_reads_memories_once_for_their_rules(engine):
    engine.append("memories", engine.rows("id long, layer string, status string, statement string, strength double, frequency long", (1, "raw", "active", "one", 2.0, 1), (1, "odd", "lost", " ", 0.5, 1)))
    found = {r["name"]: (r["status"], r["message"]) for r in engine.doctor().collect()}
    assert found["unique_ids"] == ("error", "1") and found["ranges"][0] == "error"
    assert all(k in found["ranges"][1] for k in ("odd_layer", "odd_status", "no_statement", "bad_strength"))


def model(path, hangs):
    """Loads a model that hangs as long as a file is there."""
    import os

    def load():
        def of(texts):
            if os.path.exists(path):
                if hangs:
                    time.sleep(3)
                raise RuntimeError("down")
            return [None if not t else [1.0, 2.0] if t != "odd" else [1.0] if len(t) == 3 else None for t in texts]

        return of

    return load


@pytest.mark.parametrize("hangs", [False, True])
def test_a_model_that_fails_is_asked_again_later(spark, tmp_path, hangs):
    down = tmp_path / "down"
    down.write_text("")
    texts = spark.createDataFrame([(i, "odd" if i == 3 else f"text {i}") for i in range(40)], "key long, text string").coalesce(1)
    embed = embedder(model(str(down), hangs), seconds=0.5, cool_down=1.0, dimension=2, name=f"m{hangs}{tmp_path}")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        began = time.monotonic()
        assert embed(texts).count() == 0
        assert time.monotonic() - began < 20  # ten batches, one wait
        down.unlink()
        time.sleep(1.5)
        assert embed(texts).count() == 39
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_chunks_are_one_job_whatever_their_number(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "id * 2 AS v", "CASE WHEN id < 1900 THEN id div 100 END AS chunk")

    def jobs(df):
        tracker, group = spark.sparkContext.statusTracker(), f"g{time.monotonic()}"
        spark.sparkContext.setJobGroup(group, "chunks")
        done = S.write_chunks(df, f"file://{tmp_path}/c")
        n = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return done, n

    first, many = jobs(rows)
    assert len(first["written"]) == 20
    second, one = jobs(rows.withColumn("v", rows["v"] + (rows["id"] == 5).cast("int")))
    assert second == {"written": ["000000"], "deleted": []} and abs(many - one) <= 3
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == 2000

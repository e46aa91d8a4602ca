"""What is written stays: two writers, appends, steps of streams that are repeated, maintenance that resets."""

from datetime import datetime, timedelta

import pytest

from recollect.engine import SCHEMAS, Engine
from recollect.sources import logs
from recollect.sources.logs import Log
from recollect.sources.store import Table, Taken
from recollect.streaming import pipelines as P

NOW = datetime(2024, 2, 1)
TURNS = "conv_id long, turn long, text string"
SCHEMA = "id long, v string"


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.setup()
    return e


def files(path):
    return sorted(str(p) for p in path.rglob("*.parquet"))


def test_rows_read_before_another_commit_are_refused(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.commit(spark.createDataFrame([(1, "a")], SCHEMA))
    mine = t.read().unionByName(spark.createDataFrame([(3, "mine")], SCHEMA))
    t.commit(t.read().unionByName(spark.createDataFrame([(2, "theirs")], SCHEMA)))
    with pytest.raises(Taken):
        t.commit(mine)
    assert sorted(r["id"] for r in t.read().collect()) == [1, 2]
    t.update(lambda base: base.unionByName(spark.createDataFrame([(3, "mine")], SCHEMA)))
    assert sorted(r["id"] for r in t.read().collect()) == [1, 2, 3]


def test_an_engine_that_was_slower_reads_again(engine, spark):
    other = Engine(spark, engine.path)
    engine.learn(engine.rows(TURNS, (1, 1, "remember that the port is 8443")))
    seen = []

    def change(mem):
        if not seen:
            seen.append(other.learn(other.rows(TURNS, (2, 1, "always run the linter before pushing"))))
        return mem.selectExpr("*").withColumn("weight", mem["weight"] + 1), (mem.count(),)

    assert engine.changed(change) == (2,)
    assert [r["weight"] for r in engine.read("memories").collect()] == [6, 6]


def test_an_append_reads_and_rewrites_nothing(engine, tmp_path):
    store = tmp_path / "store"
    signal = lambda i: engine.rows("memory_id long, ts timestamp, ord long, signal string", (i, NOW, i, "neutral"))
    added = []
    for i in range(4):
        before = set(files(store))
        engine.append("feedback", signal(i))
        added.append(len(set(files(store)) - before))
        assert before <= set(files(store))
    assert len(set(added)) == 1 and engine.read("feedback").count() == 4


def test_a_recall_writes_as_many_files_whatever_the_store_holds(engine, tmp_path):
    engine.learn(engine.rows(TURNS, *[(i, 1, f"remember that service number {i} runs on port 80{i:02d}") for i in range(5)]))
    q = engine.rows("query_id long, query string", (1, "service number port"))
    added = []
    for i in range(3):
        before = set(files(tmp_path / "store"))
        engine.recall(q, NOW + timedelta(days=i))
        added.append(len(set(files(tmp_path / "store")) - before))
    assert len(set(added)) == 1
    last = engine.read("overlay").groupBy("id").agg({"turns": "max", "last_accessed": "max"}).collect()
    assert {tuple(r)[1:] for r in last} == {(3, NOW + timedelta(days=2))} or {tuple(r)[1:] for r in last} == {(NOW + timedelta(days=2), 3)}


def test_compaction_keeps_rows_steps_and_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    log = Log(spark, f"file://{tmp_path}/log", SCHEMA)
    row = lambda i: spark.createDataFrame([(i, "x")], SCHEMA)
    assert log.read().count() == 0 and log.compact() == 0
    assert [log.append(row(i), ("s", i)) for i in range(3)] == [True] * 3
    log.append(row(10))

    def fold(df):
        log.append(row(11))
        return df

    assert log.compact(fold) == 4
    assert sorted(r["id"] for r in log.read().collect()) == [0, 1, 2, 10, 11]
    assert not log.append(row(2), ("s", 2)) and log.append(row(3), ("s", 3)) and log.last("s") == 3 and log.last("t") is None
    assert log.sweep() == []
    monkeypatch.setattr(logs, "STALE_MS", -1)
    assert len(log.sweep()) == 4
    assert log.compact() == 3 and not log.append(row(3), ("s", 3))
    monkeypatch.setattr(logs, "STALE_MS", -1)
    log.sweep()
    assert sorted(r["id"] for r in log.read().collect()) == [0, 1, 2, 3, 10, 11] and not log.append(row(1), ("s", 1))


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", SCHEMA)
    with pytest.raises(Exception):  # noqa: B017
        log.append(spark.createDataFrame([(1, "a")], SCHEMA).selectExpr("id", "raise_error('lost') AS v"), ("s", 0))
    assert log.batches() == [] and log.append(spark.createDataFrame([(1, "a")], SCHEMA), ("s", 0))


def state_of(e):
    rows = lambda name, *drop: sorted((tuple(r) for r in e.read(name).drop(*drop).collect()), key=str)
    return {name: rows(name, "ts", "learned_at", "valid_from", "last_accessed") for name in ("memories", "bridge", "episodes")}


@pytest.mark.parametrize("fails", ["bridge", "episodes"])
def test_a_step_that_failed_half_way_is_repeated_whole(spark, tmp_path, fails):
    turns = [(1, 1, "remember that the deploy script needs v1.2.3 of build-tool"), (1, 2, "always run the linter before pushing"), (1, 3, "hello")]
    calm = Engine(spark, f"file://{tmp_path}/calm")
    calm.setup()
    calm.learn(calm.rows(TURNS, *turns), NOW, step=("s", 0))
    e = Engine(spark, f"file://{tmp_path}/torn")
    e.setup()
    real, broken = e.append, [fails]

    def append(name, df, step=None):
        if name in broken:
            raise OSError("lost")
        real(name, df, step)

    e.append = append
    with pytest.raises(OSError, match="lost"):
        e.learn(e.rows(TURNS, *turns), NOW, step=("s", 0))
    broken.clear()
    done = e.learn(e.rows(TURNS, *turns), NOW, step=("s", 0))
    assert done == {"added": 2, "seen": 0} and state_of(e) == state_of(calm)
    assert e.learn(e.rows(TURNS, *turns), NOW, step=("s", 0)) == {"added": 2, "seen": 0} and state_of(e) == state_of(calm)


def test_maintenance_starts_anew_after_each(engine):
    for i in range(21):
        engine.note_batch("s", i, 1)
    assert engine.learned_since_maintenance() == 21 and engine.has_seen("s", 20) and not engine.has_seen("s", 21)
    engine.note("maintain", datetime(2020, 1, 1))
    assert engine.learned_since_maintenance() == 0
    engine.note_batch("s", 21, 4)
    assert engine.learned_since_maintenance() == 4


def test_streams_date_what_they_learn_by_their_clock(spark, engine, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, 1, "user", f"remember that port {i} belongs to the api")], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
    days = iter(range(10))
    at = lambda: NOW + timedelta(days=next(days))
    P.serve(P.source(spark, f"file://{tmp_path}/turns", per_trigger=1), engine, f"file://{tmp_path}/state", every=2, now=at).awaitTermination()
    assert sorted(r["learned_at"] for r in engine.read("memories").collect()) == [NOW + timedelta(days=i) for i in range(3)]
    assert engine.read("state").where("name = 'maintain'").count() == 1 and engine.learned_since_maintenance() == 1


def raw(e, i, **more):
    row = {"id": i, "layer": "raw", "statement": f"thing {i}", "text": f"thing {i}", "learned_at": datetime(2024, 1, 1), "last_accessed": datetime(2024, 1, 1), "strength": 0.8, "storage": 0.5, "confidence": 5, "status": "active"} | more
    kinds = {f.split()[0]: f for f in SCHEMAS["memories"].split(", ")}
    e.append("memories", e.rows(", ".join(kinds[n] for n in row), tuple(row.values())))


def test_decay_counts_from_the_last_touch(engine):
    raw(engine, 1)
    raw(engine, 2, last_accessed=datetime(2024, 1, 31))
    raw(engine, 3, last_accessed=None)
    assert engine.decay(datetime(2024, 1, 31, 11)) == 2
    got = {r["id"]: (round(r["strength"], 3), r["status"]) for r in engine.read("memories").collect()}
    assert got[2] == (0.8, "active") and got[1] == got[3] and got[1][0] < 0.5


def test_actions_on_many(engine):
    for i in range(1, 5):
        raw(engine, i, status="retired" if i == 1 else "locked" if i == 2 else "active")
    ids = engine.rows("id long", (1,), (2,), (2,), (99,))
    assert engine.act(ids, "activate") == 2
    assert {r["id"]: r["status"] for r in engine.read("memories").collect()} == dict.fromkeys(range(1, 5), "active")
    assert engine.act(ids, "retire") == 2 and engine.act(engine.rows("id long", (3,)), "delete") == 1
    assert {r["id"]: r["status"] for r in engine.read("memories").collect()} == {1: "retired", 2: "retired", 4: "active"}


def test_entities_are_linked_once(engine):
    raw(engine, 1, statement="uses build-tool")
    engine.link()
    assert {r["entity"] for r in engine.read("bridge").collect()} == {"build-tool"}
    n = len(engine.log("bridge").batches())
    engine.link()
    assert len(engine.log("bridge").batches()) == n
    raw(engine, 2, statement="uses other-tool and build-tool")
    engine.link()
    assert sorted((r["memory_id"], r["entity"]) for r in engine.read("bridge").collect()) == [(1, "build-tool"), (2, "build-tool"), (2, "other-tool")]


def test_observations_keep_evidence_and_history(spark, tmp_path):
    from test_engine import memories, stand_in
    from test_engine import raw as plain

    from recollect.engine import Config
    from recollect.sources.embedding import embedder

    e = Engine(spark, f"file://{tmp_path}/store", Config(cluster_similarity=0.97), embed=embedder(stand_in()))
    e.setup()
    memories(e, plain(1, "run the unit tests before each release"), plain(2, "run the unit tests before every release"))
    e.append("bridge", e.rows("memory_id long, entity string, type string", (1, "unit-tests", "tool"), (2, "unit-tests", "concept"), (2, "release", "event")))
    e.consolidate(NOW)
    memories(e, plain(11, "run unit tests before the next release"), plain(12, "run unit tests before that next release"))
    e.consolidate(NOW + timedelta(days=1))
    o = e.read("memories").where("layer = 'observation'").first()
    assert (o["evidence"], o["sources"], o["proof"]) == (4, 4, 4)
    assert {(r["source_id"], r["event"], r["quote"][:8]) for r in e.read("sources").collect()} == {(1, "created", "run the "), (2, "created", "run the "), (11, "updated", "run unit"), (12, "updated", "run unit")}
    assert [(r["event"], r["sources"]) for r in e.history().orderBy("at").collect()] == [("created", [1, 2]), ("updated", [11, 12])]
    assert {(r["entity"], r["type"]) for r in e.read("bridge").where(f"memory_id = {o['id']}").collect()} == {("unit-tests", "tool"), ("release", "event")}

from datetime import datetime, timedelta

import pytest

from recollect.engine import SCHEMAS, Config, Engine
from recollect.sources.embedding import embedded, embedder

NOW = datetime(2024, 2, 1)
TURNS = "conv_id long, turn long, text string"
SIGNALS = "memory_id long, ts timestamp, ord long, signal string, context string"


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.setup()
    return e


def memories(e, *rows):
    """Writes memories given as dicts; what they leave out is null or a default."""
    names = sorted({k for r in rows for k in r})
    kinds = {f.split()[0]: f for f in SCHEMAS["memories"].split(", ")}
    e.append("memories", e.rows(", ".join(kinds[n] for n in names), *[tuple(r.get(n) for n in names) for r in rows]))


def by_id(e, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in e.read("memories").collect()}


def test_life_of_a_store(engine, spark):
    e = engine
    assert e.setup() == [] and e.migrate() == {}
    turns = e.rows(TURNS, (1, 1, "remember that the deploy script needs v1.2.3 of build-tool"), (1, 2, "hello"), (2, 1, "always run the linter before pushing"))
    assert e.learn(turns) == {"added": 2, "seen": 0}
    later = NOW + timedelta(days=3)
    assert e.learn(turns.limit(1), later) == {"added": 0, "seen": 1}
    seen = {r["statement"][:6]: (r["frequency"], r["learned_at"], r["last_accessed"]) for r in e.read("memories").collect()}
    assert seen == {"the de": (2, NOW, later), "run th": (1, NOW, NOW)}
    assert {r["entity"] for r in e.read("bridge").collect()} == {"v1.2.3", "build-tool"}
    assert e.read("episodes").count() == 4
    q = e.rows("query_id long, query string", (1, "linter pushing"), (2, "zzzz"))
    text = {r["query_id"]: r["text"] for r in e.recall(q).collect()}
    assert "### Consider\n[" in text[1] and "run the linter before pushing" in text[1] and text[2] == "<memory-context>\n(no relevant memories)\n</memory-context>"
    assert e.read("overlay").count() == 1
    assert e.tell("tabs in yaml files", polarity="dont") == {"added": 1, "seen": 0}
    assert e.maintain("rem", datetime(2024, 3, 1))["decayed"] == 3
    chosen = e.read("memories").select("id")
    assert {r["action"] for r in e.prune(chosen, dry_run=False).collect()} == {"retired"}
    assert set(by_id(e, "status").values()) == {"retired"} and all("pruned" in t for t in by_id(e, "tags").values())
    assert e.reflect("anything") is None and e.status().count() >= 1
    assert {r["name"]: r["n"] for r in e.counts().collect()}["memories"] == 3


def test_feedback_is_folded_in_order(engine):
    memories(engine, {"id": 1, "storage": 0.5, "strength": 0.5, "confidence": 5, "status": "active"}, {"id": 2, "storage": 0.1, "strength": 0.1, "confidence": 1, "status": "locked"}, {"id": 3, "storage": 0.5, "strength": 0.5, "confidence": 5, "status": "active"})
    at = datetime(2024, 1, 30)
    ups = [(1, at, i, "positive", None) for i in range(8)] + [(1, at, 8 + i, "negative", None) for i in range(2)]
    engine.feedback(engine.rows(SIGNALS, *ups, *[(2, at, i, "negative", None) for i in range(4)]), NOW)
    got = by_id(engine, "storage", "strength", "confidence", "status", "positive", "negative", "adopted")
    assert got[1] == (0.7, 0.7, 8, "active", 8, 2, 8)
    assert got[2] == (0.0, 0.0, 1, "locked", 0, 4, 0) and got[3][:4] == (0.5, 0.5, 5, "active")
    engine.feedback(engine.rows(SIGNALS, (1, at, 99, "negative", None)), datetime(2024, 6, 1))
    assert by_id(engine, "status")[1] == "active"  # three in all, none of them recent
    engine.feedback(engine.rows(SIGNALS, (1, at, 100, "negative", None)), NOW)
    assert by_id(engine, "status", "confidence")[1] == ("retired", 6)


def raw(i, text, polarity="do", **more):
    return {"id": i, "layer": "raw", "statement": text, "text": text, "scope": "global", "domain": "general", "tags": ["t"], "learned_at": NOW - timedelta(days=9 - i % 7), "strength": 0.4 + i / 100, "storage": 0.5, "frequency": 1, "confidence": 5, "polarity": polarity, "status": "active"} | more


def stand_in():
    """Loads a stand-in for a model: how often each letter stands in a text, as a unit vector."""

    def letters(texts):
        out = []
        for t in texts:
            v = [t.lower().count(chr(97 + i)) for i in range(26)]
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else None)
        return out

    return lambda: letters


def test_consolidation_end_to_end(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", Config(cluster_similarity=0.97), embed=embedder(stand_in()))
    e.setup()
    memories(e, raw(1, "run the unit tests before each release"), raw(2, "run the unit tests before every release"), raw(3, "prefer tabs over spaces"), raw(4, "prefer spaces over tabs", "dont"), raw(5, "nothing like the others at all, zzz"))
    assert e.consolidate() == {"merged": 1, "updated": 0, "conflicts": 1, "skipped": 1}
    made = e.read("memories").where("layer = 'observation'").first()
    assert made["statement"] == "run the unit tests before every release" and (made["proof"], made["trend"], made["confidence"], made["strength"]) == (2, "new", 6, 0.42)
    assert {(r["src"], r["dst"], r["type"], r["weight"]) for r in e.read("edges").collect()} == {(3, 4, "semantic", 0.5), (4, 3, "semantic", 0.5), (made["id"], 1, "evidence", 0.8), (made["id"], 2, "evidence", 0.8)}
    assert by_id(e, "consolidated")[1] is True and by_id(e, "consolidated")[3] is False
    # a second pass finds nothing new but the conflict; two more of the kind strengthen the observation
    assert e.consolidate() == {"merged": 0, "updated": 0, "conflicts": 1, "skipped": 1}
    memories(e, raw(11, "run unit tests before the next release"), raw(12, "run unit tests before that next release"))
    assert e.consolidate()["updated"] == 1
    now = e.read("memories").where("layer = 'observation'").collect()
    assert len(now) == 1 and (now[0]["proof"], now[0]["trend"]) == (4, "strengthening")
    assert e.read("sources").count() == 4


def test_experiences_are_induced_once(engine):
    rows = [raw(i, f"observed thing number {i}", layer="observation", proof=2) for i in range(1, 4)] + [raw(9, "elsewhere", layer="observation", tags=["u"])]
    memories(engine, *rows)
    assert engine.induce() == {"induced": 1, "known": 0}
    made = engine.read("memories").where("layer = 'experience'").first()
    assert made["statement"].startswith("Repeated pattern across 3 memories: ") and made["proof"] == 6 and made["pattern"] == "recurring"
    assert {r["source_id"] for r in engine.read("sources").collect()} == {1, 2, 3}
    assert engine.induce() == {"induced": 0, "known": 1}
    engine.forget(engine.rows("id long", (made["id"],)))
    assert by_id(engine, "status")[made["id"]] == "active"  # only raw memories are forgotten


def test_vectors_are_computed_once(spark, tmp_path):
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "")], "key string, text string")
    cache = spark.createDataFrame([("a", [1.0] * 26), ("b", [1.0])], "key string, embedding array<float>")
    all_, new = embedded(texts, cache, embedder(stand_in()), 26)
    assert {r["key"] for r in new.collect()} == {"b"} and {r["key"] for r in all_.collect()} == {"a", "b"}


def test_recall_by_vectors_and_models(spark, tmp_path):
    answers = {"reflect": '```json\n{"title": "T", "statement": "tests first", "confidence": 12}\n```', "learn": '[{"statement": "the port is 8443"}]'}

    def complete(prompt):
        if prompt.startswith("fail"):
            raise RuntimeError
        return answers["reflect" if prompt.startswith("Synthesize") else "learn"]

    e = Engine(spark, f"file://{tmp_path}/store", embed=embedder(stand_in()), complete=complete)
    e.setup()
    memories(e, *[raw(i, f"unit tests run {w}", layer="observation", proof=i) for i, w in ((1, "first"), (2, "often"))])
    out = e.recall(e.rows("query_id long, query string", (1, "tests unit run")), explain=True)
    assert out["semantic"].count() == 2 and e.read("vectors").count() == 2
    assert e.reflect("unit tests") == "tests first"
    model = e.read("memories").where("layer = 'mental_model'").first()
    assert (model["title"], model["confidence"], model["proof"], model["weight"]) == ("T", 10, 3, 7)
    turns = e.rows(TURNS, (1, 1, "anything"), (1, 2, "fail: remember that rules still apply"))
    assert e.learn(turns, model=True) == {"added": 2, "seen": 0}


def test_episodes_and_recovery(engine):
    assert engine.recovery_context() == ""
    engine.capture(engine.rows("conv_id long, turn long, text string, assistant string", (1, 1, "hi   there", "hello")), datetime(2024, 1, 1))
    engine.checkpoint("release", datetime(2024, 1, 2), next_steps=["a", "b", "c", "d"])
    assert engine.recovery_context() == "### Recent Session Context\n- [2024-01-01T00:00 turn] User: hi there | Assistant: hello\n- [2024-01-02T00:00 checkpoint:release] release\n  next: a; b; c"


def test_rows_by_hand(engine):
    body = "statement string, status string, scope string, domain string, tags string, polarity string, confidence string, weight string"
    engine.create(engine.rows(body, (" use spaces ", None, None, None, "a, b", None, "12", None), ("", None, None, None, None, None, None, None)))
    assert by_id(engine, "statement", "confidence", "weight", "status", "domain")[1] == ("use spaces", 10, 5, "active", "manual")
    engine.patch(engine.rows("id long, confidence long, status string", (1, -3, "locked")))
    assert by_id(engine, "confidence", "status")[1] == (1, "locked")


def test_doctor_repairs(engine):
    memories(engine, raw(1, "one"), raw(2, "two", strength=1.5, valid_from=datetime(2020, 1, 1)))
    engine.append("edges", engine.rows("src long, dst long, type string, weight double", (1, 2, "causal", 1.0), (1, 77, "causal", 1.0)))
    engine.append("bridge", engine.rows("memory_id long, entity string", (88, "x")))
    found = {r["name"]: r["status"] for r in engine.doctor().collect()}
    assert (found["graph"], found["temporal"], found["ranges"], found["index"], found["unique_ids"], found["schema"]) == ("warning", "warning", "error", "warning", "ok", "ok")
    found = {r["name"]: r["status"] for r in engine.doctor(repair=True).collect()}
    assert (found["graph"], found["index"], found["writers"]) == ("ok", "ok", "ok")
    assert engine.read("edges").count() == 1 and engine.read("index").count() == 2


def test_old_schemas_migrate(engine):
    engine.table("memories").commit(engine.read("memories").drop("trend", "title"))
    assert engine.migrate() == {"memories": ["title", "trend"]}
    engine.migrate(dry_run=False)
    assert engine.migrate() == {}


def test_streams_learn_once_and_maintain(spark, engine, tmp_path):
    from recollect.streaming import pipelines as P

    for i in range(2):
        spark.createDataFrame([(i, 1, "user", f"remember that port {i} belongs to the api")], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
    for _ in range(2):
        P.serve(P.source(spark, f"file://{tmp_path}/turns", per_trigger=1), engine, f"file://{tmp_path}/state", every=2).awaitTermination()
    assert engine.read("memories").count() == 2
    assert engine.read("state").where("name = 'maintain'").count() == 1
    assert engine.has_seen(f"file://{tmp_path}/state", 1) and not engine.has_seen(f"file://{tmp_path}/state", 2)


def test_config_precedence():
    c = Config().merged({"budget": "4096"}, {"budget": 100})
    assert c.budget == 100
    with pytest.raises(KeyError):
        Config().merged({"nope": 1})


def test_settings_are_kept_and_resolved(engine, tmp_path):
    assert engine.configure(budget=77).budget == 77 and engine.configure().budget == 77 and engine.configure(reset=True).budget == 2048
    with pytest.raises(KeyError):
        engine.configure(nope=1)
    (tmp_path / "c.json").write_text('{"budget": 1, "graph_batch": 2}')
    c = Config.resolved(f"{tmp_path}/c.json", {"RECOLLECT_BUDGET": "5", "OTHER": "x"}, consolidate_batch=9)
    assert (c.budget, c.graph_batch, c.consolidate_batch) == (5, 2, 9) and "budget" in Config.keys()

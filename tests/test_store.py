import pytest

from recollect.sources import store as S


def test_yaml_keeps_order_and_rejects(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- {id: x, n: 1}\n- {n: 2}\n- {id: y, n: 3}\n")
    (tmp_path / "b.yaml").write_text(": : broken")
    good, bad = S.read_yaml(spark, f"file://{tmp_path}", "id string, n int")
    assert [(r["id"], r["n"]) for r in good.orderBy("file", "pos").collect()] == [("x", 1), ("y", 3)]
    assert bad.count() == 2


def test_versions_and_conflicts(spark, tmp_path):
    t = S.Table(spark, f"file://{tmp_path}/t")
    assert t.commit(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")) == 1
    assert t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")) == 2
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, t.read(1).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(RuntimeError):
        t.commit(t.read(), base=1)
    t.remove(spark.createDataFrame([(1,)], "id long"))
    assert t.read().count() == 2 and t.vacuum(1) == [1, 2]


def test_pack_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    S.export_pack({"memories": rows}, f"file://{tmp_path}/pack")
    fresh, counts = S.import_pack(spark, f"file://{tmp_path}/pack", "memories", rows.where("id = 1"))
    assert [tuple(r) for r in fresh.collect()] == [(2, "b")] and tuple(counts.first()) == (2, 1, 1, 0)
    assert spark.read.json(f"file://{tmp_path}/pack").where("table = 'stats:memories'").first()["row"] == '{"rows":2}'


def test_packs_go_by_hash_or_id_and_count_errors(spark, tmp_path):
    ddl = "id long, layer string, hash string"
    rows = spark.createDataFrame([(1, "raw", "x"), (2, "raw", "x"), (3, "raw", "y"), (4, "observation", "x"), (5, "observation", "z")], ddl)
    S.export_pack({"memories": rows}, f"file://{tmp_path}/pack")
    (tmp_path / "pack" / "more.json").write_text("no json\n")
    known = spark.createDataFrame([(4, "observation", "q"), (9, "raw", "y")], ddl)
    fresh, counts = S.import_pack(spark, f"file://{tmp_path}/pack", "memories", known, {"raw": "hash", "": "id"})
    assert sorted(r["id"] for r in fresh.collect()) == [1, 5] and tuple(counts.first()) == (5, 2, 3, 1)


def test_graph_documents(spark, tmp_path):
    (tmp_path / "graph.yaml").write_text("entities: {api: {type: project, memory_ids: [a, b]}}\nedges:\n- {from: a, to: b, type: causal, weight: 0.5}\n- {from: b, to: a, type: causal, weight: 1}\n")
    bridge, edges = S.read_graph(spark, f"file://{tmp_path}/graph.yaml")
    assert sorted(map(tuple, bridge.collect())) == [("a", "api", "project"), ("b", "api", "project")]
    assert [tuple(r) for r in edges.orderBy("ord").collect()] == [("a", "b", "causal", 0.5, 0), ("b", "a", "causal", 1.0, 1)]
    (tmp_path / "bad.yaml").write_text(": : no")
    assert S.read_graph(spark, f"file://{tmp_path}/bad.yaml")[0].count() == 0


def test_chunks_come_before_the_hot_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, ids in (("0001.yaml", "[{id: a}, {id: b}]"), ("0002.yaml", "[{id: c}, {id: a}]"), ("000-hot.yaml", "[{id: z}]")):
        (tmp_path / "d" / name).write_text(ids)
    good, _ = S.read_yaml(spark, f"file://{tmp_path}/d", "id string")
    assert [r["id"] for r in S.in_order(good, "000-hot.yaml").orderBy("ord").collect()] == ["a", "b", "c", "a", "z"]


def test_only_changed_chunks_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    rows = spark.range(10).selectExpr("id", "id * 2 AS v", "CASE WHEN id < 8 THEN id div 4 END AS chunk")
    assert S.write_chunks(rows, path) == {"written": ["000000", "000001", "hot"], "deleted": []}
    assert S.write_chunks(rows, path) == {"written": [], "deleted": []}
    less = rows.where("id <> 9 and chunk is null or chunk = 0")
    assert S.write_chunks(less, path) == {"written": ["hot"], "deleted": ["000001"]}
    assert spark.read.parquet(path).count() == 5


def test_updates_meet_and_versions_come_back(spark, tmp_path):
    t = S.Table(spark, f"file://{tmp_path}/t")
    t.commit(spark.createDataFrame([(1,)], "id long"))
    seen = []

    def change(df):
        if not seen:  # another writer is faster once
            seen.append(1)
            t.commit(df.selectExpr("id + 10 AS id"))
        return df.selectExpr("id + 100 AS id")

    assert t.update(change) == 3 and [r["id"] for r in t.read().collect()] == [111]
    assert t.rollback(1) == 4 and [r["id"] for r in t.read().collect()] == [1]


def test_a_failed_write_leaves_nothing_in_the_way(spark, tmp_path):
    t = S.Table(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    t.commit(rows)
    with pytest.raises(Exception):  # noqa: B017
        t.commit(rows.selectExpr("id", "raise_error('lost') AS v"))
    assert t.versions() == [1] and t.commit(rows) == 2 and t.leftovers() == []


def test_of_two_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    t = S.Table(spark, f"file://{tmp_path}/t")
    t.commit(spark.createDataFrame([(0, "a")], "id long, v string"))

    def write(i):
        try:
            return t.commit(spark.createDataFrame([(i, "w")], "id long, v string"), base=1)
        except RuntimeError:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, range(4)))
    assert sorted(g for g in got if g) == [2] and t.versions() == [1, 2] and t.read().count() == 1


def test_claims_of_lost_writers_expire(spark, tmp_path, monkeypatch):
    t = S.Table(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    t.commit(rows)
    (tmp_path / "t" / "_claim-2").write_text("")
    with pytest.raises(RuntimeError):
        t.commit(rows)
    monkeypatch.setattr(S, "STALE_MS", -1)
    assert t.commit(rows) == 2

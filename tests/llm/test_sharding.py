"""Sharding against its law on small tables."""

from __future__ import annotations

import zlib

import pytest

from recollect.llm.sharding import OVERHEAD, in_shards, write_shards


def brute(rows: list[tuple], shards: int) -> list[tuple]:
    """What the law says of (key, text) rows, one after the other."""
    body = [(k, (t or "").encode()) for k, t in rows]
    body.sort(key=lambda x: (x[0] is None, x[0] or 0, len(x[1]), zlib.crc32(x[1])))
    total, before, out, slots = sum(len(b) + OVERHEAD for _, b in body), 0, [], {}
    for k, b in body:
        size = len(b) + OVERHEAD
        s = (2 * before + size) * shards // (2 * total)
        out.append((k, size, zlib.crc32(b), s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
        before += size
    return out


def by_law(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [
    *[(i * 37 % 101, "wörd " * (i % 13)) for i in range(300)],
    (None, None), (None, "no id"), (5, None), (6, ""), (7, "long " * 20000),
    *[(9, "the same")] * 150, *[(9, f"other {i % 3}") for i in range(20)],
]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_rows_follow_the_law(spark, shards):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    got = by_law(in_shards(df, shards))
    assert got == sorted(brute(ROWS, shards), key=str)
    sizes = {}
    for _, size, _, shard, _ in got:
        sizes[shard] = sizes.get(shard, 0) + size
    target = sum(sizes.values()) / shards
    assert all(abs(sizes.get(s, 0) - target) <= 100016 for s in range(shards))


def test_one_key_of_a_third_is_cut(spark):
    rows = [(1, "same")] * 400 + [(i, "other") for i in range(2, 802)]
    got = by_law(in_shards(spark.createDataFrame(rows, "doc_id long, text string"), 12))
    assert got == sorted(brute(rows, 12), key=str)
    assert len({r[3] for r in got if r[0] == 1}) >= 4


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert in_shards(none).count() == 0
    odd = spark.createDataFrame([(1, "a", 7, "x", 3), (2, None, 8, "y", 4)], "doc_id long, text string, shard int, part string, size int")
    got = {r["doc_id"]: r for r in in_shards(odd, 2, carry=["shard", "part", "size"]).collect()}
    assert (got[1]["shard"], got[2]["shard"]) == (0, 1)
    assert tuple(got[2]["carried"]) == (8, "y", 4)
    with pytest.raises(ValueError, match="shard"):
        in_shards(odd, 0)


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, slot int")
    write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r[0] for r in back.select("slot_").collect()) == list(range(len(ROWS)))
    got = sorted((r["shard"], r["slot"], r["doc_id"] is None, r["doc_id"] or 0) for r in back.collect())
    assert [x[2:] for x in got] == sorted(x[2:] for x in got)

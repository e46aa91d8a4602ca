"""Each registered query holds its contract: columns, types, rows and fixed rules."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest

from recollect.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
pytest.importorskip("public_tokenizers")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

CONTRACTS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op9_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall())


@pytest.fixture(scope="module")
def rows(spark):
    held = {}

    def of(name):
        if name not in held:
            df = QUERIES[name](spark, SF)
            held[name] = (df.schema, df.collect())
        return held[name]

    return of


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_rows(rows, texts, name):
    schema, got = rows(name)
    want = CONTRACTS[name].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in schema][: len(want)] == want
    if name not in ("op3_packing", "op7_embeddings", "op11_collocations", "op12_codes"):
        assert sorted(r["doc_id"] for r in got) == sorted(texts)


def held_out(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_folds_cuts_and_ranges(rows):
    for name, modulus, rest in (("op1_toxicity", 4, 2), ("op6_langid", 4, 2), ("op2_lm_scoring", 10, 0)):
        assert all(r["held_out"] == held_out(r["doc_id"], modulus, rest) for r in rows(name)[1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows("op1_toxicity")[1])
    langs = {x[0] for x in duckdb.sql(f"select distinct lang from read_parquet('{SF}/documents.parquet')").fetchall()}
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in langs | {"und"} for r in rows("op6_langid")[1])


def test_base_scores_by_brute_force(rows, texts):
    import math
    from collections import Counter

    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), None] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if not held_out(i, 10, 0) for w in ws)
    n, v = sum(count.values()), len(count)
    for r in rows("op2_lm_scoring")[1]:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def test_sequences_are_gapless_and_whole(rows, texts):
    got = rows("op3_packing")[1]
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024 and {r["doc_id"] for r in got} == set(texts)
    assert len(at) <= 1.05 * -(-sum(at.values()) // 1024)
    by = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == by.get(r["doc_id"], 0)
        assert r["piece"] == 0 or r["length"] == 1024
        by[r["doc_id"]] = r["start"] + r["length"]


def test_media_payloads(rows, texts):
    for r in rows("op5_media")[1]:
        raw = (texts[r["doc_id"]] or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r["media_bytes"] >= len(pay)


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def test_license_phrases_by_brute_force(rows, texts):
    for r in rows("op8_licenses")[1]:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[r["doc_id"]] or "").translate(LOW))
        hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(hits), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_pieces_round_trip(rows):
    assert all(r["round_trip"] for r in rows("op4_sentencepiece")[1])


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql_gives_the_same_rows(rows, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    schema, got = rows(name)
    want = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in schema.names]
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import hnsw, media, packing
from recollect.llm import sentencepiece as S

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "Hello world! It's naïve ▁ 漢字\n\n x", "a" * 700, "xyz" * 200 + " end", "été où  là", "\x00\x7f", "<|endoftext|>", "Hello world! It's naïve ▁ 漢字\n\n x"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(["the", "ing", " ", "  ", "é", "q", "\n", "漢", "z9", "'s"]) for _ in range(rng.randrange(60))) for _ in range(n)]


# ---------------------------------------------------------------- packing


def check_runs(counts, runs, size):
    seen = Counter()
    fill: dict[int, list[tuple[int, int]]] = {}
    ranks: dict[int, list[range]] = {}
    for n, first, copies, seq, at in runs:
        seen[n] += copies
        ranks.setdefault(n, []).append(range(first, first + copies))
        for i in range(copies):
            fill.setdefault(seq + i, []).append((at, n))
    assert seen == Counter({k: v for k, v in counts.items() if v})
    for n, rs in ranks.items():
        assert sorted(x for r in rs for x in r) == list(range(counts[n]))
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= size
    return len(fill)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    lengths = [min(64, 1 + int(rng.expovariate(1 / rng.choice([5, 20, 40])))) for _ in range(rng.randrange(1, 400))]
    counts = Counter(lengths)
    n = check_runs(counts, packing.plan(counts, 64), 64)
    assert n >= -(-sum(lengths) // 64)
    bins: list[int] = []  # best fit decreasing, piece by piece
    for x in sorted(lengths, reverse=True):
        fits = [i for i, used in enumerate(bins) if used + x <= 64]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += x
        else:
            bins.append(x)
    assert n <= len(bins) + 1


def test_plan_of_nothing():
    assert packing.plan({}, 64) == []


def test_fast_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    encode = packing.encoder(BPE)
    for t in [t or "" for t in TEXTS] + random_texts(200):
        assert encode(t).tolist() == own.encode(t, add_special_tokens=False).ids


def added_tokens() -> list[str]:
    with open(BPE, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def test_added_tokens_are_what_the_tokenizer_makes_of_them():
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(BPE), packing.encoder(BPE)
    for mark in added_tokens():
        for t in (f"a {mark} b", mark, mark * 3, f"x{mark}", f"{mark[:-1]} {mark} é"):
            assert encode(t).tolist() == own.encode(t, add_special_tokens=False).ids
    assert encode("a <|endoftext|> b").tolist() == own.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_only_plain_byte_level_files_have_ranks():
    with open(BPE, encoding="utf-8") as f:
        model = json.load(f)
    assert len(packing.ranks_of(model)) == len(model["model"]["vocab"]) - len([t for t in added_tokens() if t in model["model"]["vocab"]])
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        assert packing.ranks_of(model | change) is None
    assert packing.ranks_of(model | {"model": model["model"] | {"merges": model["model"]["merges"][::-1]}}) is None


def test_packing_of_texts_with_added_tokens(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "plain")]
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect()}
    for i, t in rows:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i]["length"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_packing_on_tables(spark):
    texts = [*TEXTS, *random_texts(80), " ".join(["word"] * 400)]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(None, "x y", 9), (3, "again", 9), (3, "again", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = [r.asDict() for r in packing.pack(docs, BPE, size=64, end=2, salt_rows=7).collect()]
    by_seq: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    encode = packing.encoder(BPE)
    want = Counter()
    for i, t, _ in rows:
        ids = np.append(encode(t or ""), np.uint32(2)).astype("<u4")
        head = len(ids) % 64 or 64
        starts = [0, *range(head, len(ids), 64)]
        for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.pack(docs.where("doc_id > 999"), BPE).count() == 0


# ----------------------------------------------------------- SentencePiece


def best_score(p, b):
    best = [0.0]
    for n in range(1, len(b) + 1):
        best.append(max([best[n - 1] + p.byte_score] + [best[n - k] + p.score_of[b[n - k : n]][0] for k in range(1, min(n, p.longest) + 1) if b[n - k : n] in p.score_of]))
    return best[-1]


def test_viterbi_is_best_and_exact():
    p = S.pieces(MODEL)
    scores = {i: s for s, i in p.score_of.values()}
    value = lambda ids: sum(scores.get(i, p.byte_score) for i in ids)
    texts = TEXTS + random_texts(150)
    ids, first, _, _ = S.encode_column(p, pa.array(texts, pa.string()), longest_part=50)
    for i, t in enumerate(texts):
        raw, mine = (t or "").encode(), ids[first[i] : first[i + 1]]
        assert S.decode_ids(p, mine).tobytes() == raw
        assert abs(value(mine.tolist()) - best_score(p, raw)) < 1e-6
        stream = S.Stream(p)
        parts = [x for j in range(0, len(raw), 7) for x in stream.feed(raw[j : j + 7])] + stream.end()
        assert abs(value(parts) - best_score(p, raw)) < 1e-6 and S.decode_ids(p, np.array(parts, dtype=np.int64)).tobytes() == raw


def test_stream_commits_within_a_window():
    p = S.pieces(MODEL)
    stream = S.Stream(p)
    early = stream.feed(b"the quick brown fox jumps over the lazy dog " * 20)
    assert len(early) > 100 and stream.widest < 4 * p.longest


def test_stream_takes_time_by_the_byte():
    import time

    p = S.pieces(MODEL)
    began = time.perf_counter()
    for text in (b"x" * 100_000, b"thandering" * 10_000):
        stream = S.Stream(p)
        ids = stream.feed(text) + stream.end()
        assert S.decode_ids(p, np.array(ids)).tobytes() == text and stream.widest <= p.longest
    assert time.perf_counter() - began < 20
    few = S.Stream(p)
    few.feed(b"thandering" * 10_000)
    assert len(few.steps) < 20 * p.longest


def test_encode_and_decode_tables(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1)], "doc_id long, text string, ids int")
    enc = S.encode(docs, MODEL)
    back = {r["doc_id"]: r["text"] for r in S.decode(enc, MODEL).collect()}
    assert back == {**dict(enumerate(TEXTS)), None: "x"}
    assert all(r["round_trip"] for r in S.digest(docs, MODEL).collect())
    assert S.digest(docs.where("doc_id > 99"), MODEL).count() == 0


# ------------------------------------------------------------------- media


def g711(code, law):
    """Textbook expansion of one code."""
    if law == "mu":
        code = ~code & 0xFF
        size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
        return -size if code & 0x80 else size
    code ^= 0x55
    size, e = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = size + 8 if e == 0 else (size + 0x108) << (e - 1)
    return size if code & 0x80 else -size


def test_expansion_tables():
    assert media.MU.tolist() == [g711(i, "mu") for i in range(256)]
    assert media.A.tolist() == [g711(i, "a") for i in range(256)]


def adpcm_one(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for b in block[4:]:
        for c in (b & 15, b >> 4):
            step = int(media.STEPS[index])
            diff = (step >> 3) + (step if c & 4 else 0) + (step >> 1 if c & 2 else 0) + (step >> 2 if c & 1 else 0)
            value = max(-32768, min(32767, value - diff if c & 8 else value + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][c & 7]))
            out.append(value)
    return out


def test_adpcm_blocks_in_step():
    blocks = np.random.default_rng(0).integers(0, 256, (40, 64), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [adpcm_one(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_stored_texts_are_lossless(spark, codec):
    docs = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(TEXTS)] + [(None, "x", b"m")], "doc_id long, text string, media binary")
    rows = media.store_texts(docs, codec, with_media=True).collect()
    for r in rows:
        raw = ((TEXTS[r["doc_id"]] if r["doc_id"] is not None else "x") or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert media.read_wave(bytes(r["media"])).payload == padded
    assert next(r["feature"] for r in rows if r["doc_id"] == 3) == next(r["feature"] for r in rows if r["doc_id"] == 9)
    pcm = media.decode_audio(media.store_texts(docs, codec, with_media=True)).collect()
    for r in pcm:
        a = media.read_wave(bytes(r["pcm"]))
        assert (a.tag, a.rate, len(a.payload)) == (media.PCM, 16000, 2 * r["n_samples"])
    assert media.store_texts(docs.where("doc_id > 99"), codec).count() == 0


def test_resampling_keeps_samples_and_tones():
    t = np.arange(800) / 8000
    x = (8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    y = media.resample(x, 2)
    assert np.array_equal(y[::2], x)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert np.abs(y[40:-40] - want[40:-40]).max() < 60


@pytest.mark.parametrize("data", [None, b"", b"RIFF", b"RIFF\0\0\0\0WAVEfmt \xff\xff\0\0", media.wave(b"\0" * 64, media.MULAW)[:-10]])
def test_broken_files_are_none(data):
    assert media.read_wave(data) is None


# -------------------------------------------------------------- embeddings


def brute_links(x, least=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= least
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[link[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            return link.sum(1), label
        label = new


def vectors(seed=0, n=500, d=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x[100:160] = x[0] + 0.2 * rng.standard_normal((60, d))  # a gradual group
    x[200:220] = x[1]  # copies
    x[230] = 3 * x[1]
    return x.astype(np.float32)


def test_near_vectors_match_brute_force(spark):
    x = vectors()
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, [None] + [1.0] * 23, 1), (905, [1.0] * 5, 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: r for r in hnsw.near_vectors(df, shards=3).collect()}
    links, label = brute_links(x.astype(np.float64))
    wrong = [i for i in range(len(x)) if (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) != (links[i], label[i], label[i] == i)]
    assert not wrong
    for i, *_ in odd[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, None)


def test_no_vectors(spark):
    assert hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(x)
    ef = hnsw.audit(g, 0.95)
    q = g.x[:200] + 0.05 * rng.standard_normal((200, 32)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, _, _ = g.search(q, ef)
    truth = np.argsort(-(q @ g.x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(truth.tolist(), ids.tolist(), strict=True)]) >= 0.95
    assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in g.adj[0])

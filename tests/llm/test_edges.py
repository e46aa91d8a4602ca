"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for each operator on texts."""

import pytest
from pyspark.sql import functions as F

from recollect.llm import hpylm, langid, licenses, media, minhash, packing, sentencepiece, substrings, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
CLASH = ("score", "toxicity", "lang_pred", "n_words", "n_bytes", "chunk", "bucket", "kept", "component_id", "piece", "start", "length", "labels", "media", "class", "n_tokens", "learn")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


def toxic(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    return toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))


OPERATORS = {
    "toxicity": toxic,
    "lm": lambda spark, docs: hpylm.lm_scores(docs, F.lit(True)),
    "packing": lambda spark, docs: packing.pack(docs, tokenizers.path("byte_bpe_50k.json")).where("piece = 0"),
    "pieces": lambda spark, docs: sentencepiece.digest(docs, tokenizers.path("piece_bpe_32k.model")),
    "media": lambda spark, docs: media.store_texts(docs),
    "language": lambda spark, docs: langid.identify(docs.select("doc_id", "text"), langid.train(docs)),
    "licenses": lambda spark, docs: licenses.scan_licenses(docs),
    "near": lambda spark, docs: minhash.near_duplicates(docs),
    "substrings": lambda spark, docs: substrings.dedup_substrings(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_place(spark, name):
    long = "tala moru, kipa selo. idiot\n" * 20_000
    rows = [(1, "tala moru kipa", "aa"), (1, "tala moru kipa", "aa"), (1, "straf krunt idiot", "bb"), (None, None, None), (None, "tala", None), (2, "", "aa"), (3, None, "bb"), (4, long, "aa"), (5, long, "aa"), (6, " \t\n", None)]
    out = OPERATORS[name](spark, frame(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)
    drop = {"doc_id", "component_id", "sequence_id", "offset", "text", "kept", "n_removed", "kept_sha256"}
    values = lambda r: {k: v for k, v in r.asDict().items() if k not in drop}
    of = {i: [values(r) for r in out if r["doc_id"] == i] for i in (1, 2, 3, 4, 5)}
    assert of[2] == of[3] and len(of[2]) == 1  # null as empty
    assert of[4] == of[5] and of[4] != of[2]  # equal texts, equal values, however long
    assert sum(values(r) in of[1][:1] for r in out if r["doc_id"] == 1) >= 1 and len({str(v) for v in of[1]}) <= 2  # repeated rows are alike


def test_letters_of_all_planes_are_letters(spark):
    docs = spark.createDataFrame([(1, chr(0x30010) * 30), (2, chr(0x20010) * 30), (3, "12 \U0001f600 !!"), (4, "tala moru")], "doc_id long, text string")
    model = langid.train(spark.createDataFrame([(i, "tala moru kipa selo", "aa") for i in range(9)] + [(i, "straf krunt blort", "bb") for i in range(9, 20)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert (got[3], got[4]) == ("und", "aa") and "und" not in (got[1], got[2])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    assert OPERATORS[name](spark, frame(spark, [(1, "x", "aa")]).where("doc_id > 5")).collect() == []


def test_language_model_does_not_depend_on_batches(spark):
    docs = spark.createDataFrame([(i, f"tala moru w{i % 7} kipa w{i % 11}") for i in range(300)], "doc_id long, text string")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    try:
        for size, parts in ((10_000, 2), (7, 5)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got.append({r["doc_id"]: r["score"] for r in hpylm.lm_scores(docs.repartition(parts), F.col("doc_id") % 3 > 0).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got[0].keys() == got[1].keys() and all(abs(got[0][i] - got[1][i]) < 1e-6 for i in got[0])

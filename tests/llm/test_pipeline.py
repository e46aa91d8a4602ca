import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture()
def sf_dir(spark, tmp_path):
    rng = random.Random(0)
    words = ["".join(rng.choice(["ta", "lo", "mi", "ser", "und", "ing"]) for _ in range(rng.randrange(1, 4))) for _ in range(500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage = say(70)
    rows, labels = [], []
    for i in range(400):
        t, bad = say(rng.randrange(60, 200)), i % 5 == 0
        if bad:
            t[3], t[30] = "moron", "idiot"
        if i in (41, 42, 43):
            t = t[:50] + passage + t[50:]
        rows.append([i, " ".join(t), "aa", "s", 0])
        labels.append((i, 1, int(bad)))
    rows[301][1] = rows[201][1]
    rows[302][1] = rows[202][1] + " more"
    rows[303][1] = "12 345 !!"
    rows[304][1] = None
    d = f"file://{tmp_path}/sf"
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    toxic = {i for i in range(400) if i % 5 == 0}
    assert len(toxic & ids["toxicity"]) <= 4 and len(set(range(400)) - toxic - ids["toxicity"]) <= 4
    assert ids["toxicity"] - ids["language"] == {303, 304} & ids["toxicity"]
    assert ids["language"] - ids["near_duplicates"] == {301, 302} & ids["language"]
    assert ids["substrings"] == ids["near_duplicates"] == ids["packing"]
    before = {r["doc_id"]: r["text"] for r in seen["near_duplicates"].collect()}
    after = {r["doc_id"]: r for r in seen["substrings"].collect()}
    cut = {i for i in before if before[i] != after[i]["text"]}
    assert cut == {42, 43} and all(len(before[i].split()) - len(after[i]["text"].split()) >= 70 - 2 for i in cut)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect()} == {tuple(r) for r in seen["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()}


def test_further_columns_may_clash(spark, sf_dir):
    extra = ["toxicity", "lang_pred", "score", "n_words", "chunk", "kept_text", "carried", "kept", "class", "bands", "piece", "set"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in extra))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == columns
            assert all(r[c] == f"{c}{r['doc_id']}" for r in docs.collect() for c in extra)
    assert docs.count() > 0


def test_empty_and_null_rows(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, None, None, None), (7, "", None, None, None), (None, "ta lo", "aa", None, 1)], some.schema)
    for docs in (some.where("doc_id < 0"), odd):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
            docs.count()


def test_packing_stage_takes_added_tokens_as_the_tokenizer_does(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["length"] for r in corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()}
    assert got == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in ((1, "a <|endoftext|> b"), (2, "a b"))}

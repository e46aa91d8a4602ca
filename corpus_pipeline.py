"""A training corpus from raw documents: five stages, each on all that the one before it kept.

All stages take null and repeated ids, null, empty and very long texts and further columns of any
name; an empty table gives an empty result.  Rows that repeat an id are judged each by its text,
but for near-duplicates, where an id goes if none of its rows is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import langid, toxicity
from recollect.llm.common import fresh, stored
from recollect.llm.minhash import near_duplicates
from recollect.llm.packing import pack
from recollect.llm.substrings import dedup_substrings

TOXIC, AMBIGUOUS, REPEAT, SEQUENCE, END = 0.5, 0.502, 50, 1024, 2


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; null and empty texts stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "toxicity")
    return toxicity.score(docs, model, name=score).where(F.col(score) < TOXIC).select(docs.columns)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show: texts without letters and ties go."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    out = langid.identify(docs, langid.train(docs), names=(lang, score))
    return out.where((F.col(lang) != "und") & (F.col(score) >= AMBIGUOUS)).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group; rows without an id stay."""
    groups = near_duplicates(docs)
    gone = groups.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of REPEAT words that one of a smaller doc_id has too."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = dedup_substrings(docs, window=REPEAT, carry=carry, with_text=True)
    own = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    kept = {c: F.col(f"carried.`{c}`") for c in carry} | own
    return out.select(*(kept.get(c, F.col(c)).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of SEQUENCE tokens; null and empty texts are the end token alone."""
    import public_tokenizers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE, END)


STAGES = [
    ("toxicity", without_toxic),
    ("language", with_language),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("packing", packed),
]

#: Trained models, tokenizers and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _batched(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches small enough for two workers beside a small executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _held_out(modulus: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.toxicity import score, train

    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    _batched(spark)
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", _held_out(4, 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.hpylm import lm_scores

    held = _held_out(10, 0)
    _batched(spark)
    out = lm_scores(_docs(spark, sf_dir), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recollect.llm.packing import pack

    _batched(spark)
    return pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from recollect.llm.sentencepiece import digest

    _batched(spark)
    return digest(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.media import store_texts

    _batched(spark)
    return store_texts(_docs(spark, sf_dir))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.langid import identify, train

    docs = _docs(spark, sf_dir)
    _batched(spark)
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.hnsw import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.licenses import scan_licenses

    _batched(spark)
    return scan_licenses(_docs(spark, sf_dir))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.minhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), k=4, percent=80)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.substrings import dedup_substrings

    return dedup_substrings(_docs(spark, sf_dir), window=13)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_lm_scoring, op3_packing, op4_sentencepiece, op5_media, op6_langid, op7_embeddings, op8_licenses, op9_minhash, op10_substrings)}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"coalesce({_LOWER}, '')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
u AS (SELECT list_sort(sh) AS sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY 1),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM u),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, root) AS (SELECT rep, rep FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id,
       s.doc_id = coalesce(c.root, s.doc_id) AS kept
FROM s LEFT JOIN u ON list_sort(s.sh) = u.sh LEFT JOIN c ON c.id = u.rep
"""

OP10_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS lo FROM g GROUP BY win HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (win) WHERE f.lo < g.doc_id),
gone AS (SELECT doc_id, list(i) AS places FROM cut GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(places, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

ORACLE_SQL = {"op7_embeddings": OP7_SQL, "op9_minhash": OP9_SQL, "op10_substrings": OP10_SQL}


# ----------------------------------------- phrases, codes of vectors, shards


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.phrases import collocations

    return collocations(_docs(spark, sf_dir))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.codes import compress

    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.sharding import in_shards

    out = in_shards(_docs(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES |= {f.__name__: f for f in (op11_collocations, op12_codes, op13_sharding)}


def _lloyd_sql(rounds: int = 6) -> str:
    """Rounds of assignment and floored means, a part of a vector as a list of 8ths."""
    near = lambda i: f"""
a{i} AS MATERIALIZED (SELECT vec_id, label, p, v, min_by(j, (d, j)) AS j, min(d) AS d FROM
      (SELECT x.vec_id, x.label, x.p, x.v, b.j, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{i} b USING (p)) GROUP BY vec_id, label, p, v),"""  # noqa: E731
    move = lambda i: f"""
s{i} AS (SELECT p, j, k, sum(e) AS s, count(*) AS c FROM (SELECT p, j, unnest(v) AS e, unnest(range(len(v))) AS k FROM a{i - 1}) GROUP BY p, j, k),
m{i} AS (SELECT p, j, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY k) AS v FROM s{i} GROUP BY p, j),
b{i} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.v, b.v) AS v FROM b{i - 1} b LEFT JOIN m{i} m ON m.p = b.p AND m.j = b.j),"""  # noqa: E731
    steps = near(0) + "".join(move(i) + near(i) for i in range(1, rounds + 1))
    return f"""
WITH g AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 4096) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM g, range(8) t(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM g ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT p, j, v FROM x JOIN f USING (vec_id)),{steps}
h AS (SELECT sha256(string_agg(e, ',' ORDER BY p, j, k)) AS h FROM (SELECT p, j, unnest(range(len(v))) AS k, CAST(unnest(v) AS VARCHAR) AS e FROM b{rounds})),
o AS (SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.h AS codebooks_sha256 FROM o, h
"""


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
o AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, k FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM o GROUP BY lang, phrase, k HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, k, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (SELECT lang, phrase, a, x, array_to_string(ws[1 : x], ' ') AS first, array_to_string(ws[x + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS x FROM kept)),
s AS (SELECT cut.lang, cut.phrase, a, n, x, CAST(l.f AS HUGEINT) AS l, CAST(r.f AS HUGEINT) AS r, 1000 * CAST(a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
      FROM cut JOIN n USING (lang) JOIN f l ON l.lang = cut.lang AND l.phrase = cut.first JOIN f r ON r.lang = cut.lang AND r.phrase = cut.rest),
b AS (SELECT lang, phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

OP13_SQL = """
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1) AS bs FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(t.t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM b, t),
p AS (SELECT *, coalesce(sum(size) OVER w, 0) AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS LAST, size, crc) AS pos FROM c
      WINDOW w AS (ORDER BY doc_id NULLS LAST, size, crc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CAST((2 * before + size) * 40 // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

ORACLE_SQL |= {"op11_collocations": OP11_SQL, "op12_codes": _lloyd_sql(), "op13_sharding": OP13_SQL}

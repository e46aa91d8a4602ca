"""Life cycle: decay, learning, feedback, merging, induction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions import rules as R


def batch_decay(memories: DataFrame, now: datetime = X.NOW, least_days: float = 0.5) -> DataFrame:
    """(id, layer, old_status, new_status, new_strength, new_confidence) of the memories that a decay pass changes.

    Experiences, locked and retired memories and those touched within half a day are left alone;
    age counts from the day of the last touch, of untouched ones from that of learning.
    """
    day = F.to_timestamp(F.to_date(F.coalesce("last_accessed", "learned_at")))
    m = memories.withColumn("days", X.days_since(day, now)).where("layer <> 'experience' and status not in ('locked', 'retired')").where(F.col("days") >= least_days)
    strength = X.decayed_strength(F.col("strength"), "layer", F.col("weight"), F.col("days"))
    return m.select(
        "id",
        "layer",
        F.col("status").alias("old_status"),
        X.status_of(strength).alias("new_status"),
        F.round(strength, 6).alias("new_strength"),
        X.decayed_confidence(F.col("confidence"), F.col("weight"), F.col("days")).alias("new_confidence"),
    )


def candidates(turns: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, rule_ord, rule, kind, polarity, domain, tags, statement, confidence of each candidate of each turn.

    Every rule gives at most one candidate, from its first match; equal statements of a turn
    stay once, those that fail the quality gate go.
    """
    t = F.col("_t")
    rows = turns.select(*key, X.strip_context(text).alias("_t")).withColumn("_l", F.lower("_t"))
    meant = (F.length("_t") > 0) & ~X.any_of(F.col("_l"), R.META_MARKERS)

    def one(i: int, r: R.Extraction) -> Column:
        groups = {f"{{{g}}}": F.regexp_extract(t, r.pattern, g) for g in (1, 2) if f"{{{g}}}" in r.statement}
        parts, rest = [], r.statement
        for mark, g in groups.items():
            head, rest = rest.split(mark, 1)
            parts += [F.lit(head), X.clean_capture(g) if r.clean else g]
        said = F.concat(*parts, F.lit(rest))
        fields = (F.lit(i).alias("rule_ord"), F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.polarity).cast("string").alias("polarity"), F.lit(r.domain).alias("domain"), F.lit(",".join(r.tags)).alias("tags"), said.alias("statement"), F.lit(r.confidence).alias("confidence"))
        return F.when(X.any_of(F.col("_l"), r.hints) & t.rlike(r.pattern), F.struct(*fields))

    found = X.exploded(rows, F.when(meant, F.array(*[one(i, r) for i, r in enumerate(R.EXTRACTIONS)])), "c").select(*key, "c.*")
    first = F.row_number().over(Window.partitionBy(*key, "statement").orderBy("rule_ord"))
    return found.where(X.quality_gate("statement")).withColumn("_n", first).where("_n = 1").drop("_n")


def dedup_actions(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows (id, text) with hash, action ADD or SKIP, and target: the first row of each content hash.

    known (id, hash) are memories already there.  Copies are counted per hash before any join,
    so that a hash that most rows share is one row on the build side.
    """
    hashed = rows.select("id", X.content_hash("text").alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("id").alias("target"))
    if known is not None:
        first = first.join(known.groupBy("hash").agg(F.min("id").alias("old")), "hash", "left").select("hash", F.coalesce("old", "target").alias("target"))
    # equal or both null: else each text would be hashed once more, to look for nulls
    out = hashed.join(first.withColumnRenamed("hash", "_h"), F.col("hash").eqNullSafe(F.col("_h")), "left")
    return out.select("id", "hash", F.when(F.col("id") == F.col("target"), "ADD").otherwise("SKIP").alias("action"), "target")


#: What a positive and a negative signal move, and between which bounds.
MOVES = {"storage": (0.1, -0.15, 0.0, 1.0), "strength": (0.05, -0.1, 0.0, 1.0), "confidence": (1.0, -1.0, 1.0, 10.0)}


def feedback_fold(log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(memory_id, storage, strength, confidence, positive, negative) after a log (memory_id, ts, ord, signal).

    start: (memory_id, storage, strength, confidence) before it; 0.5, 0.5 and 5 where unknown.
    Each signal shifts a value and holds it in bounds, so order counts.  Such steps in a row are
    one shift between two bounds: signals are folded by the hour, hours by memory, and a memory
    of a third of all signals is no single fold.
    """
    far = 1e9
    zero = F.struct(*[F.struct(F.lit(0.0).alias("by"), F.lit(-far).alias("low"), F.lit(far).alias("high")).alias(k) for k in MOVES])

    def after(state: Column, by: Column, low: Column, high: Column) -> Column:
        held = lambda v: F.least(F.greatest(v + by, low), high)
        return F.struct((state["by"] + by).alias("by"), held(state["low"]).alias("low"), held(state["high"]).alias("high"))

    def step(state: Column, x: Column) -> Column:
        up, down = x["signal"] == "positive", x["signal"] == "negative"
        parts = []
        for k, (plus, minus, low, high) in MOVES.items():
            by = F.when(up, plus).when(down, minus).otherwise(0.0)
            # a signal holds a value on the side to which it moves it
            parts.append(after(state[k], by, F.when(down, low).otherwise(-far), F.when(up, high).otherwise(far)).alias(k))
        return F.struct(*parts)

    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    count = lambda k: F.count_if(F.col("signal") == k)
    hours = log.groupBy("memory_id", hour.alias("hour")).agg(F.array_sort(F.collect_list(F.struct("ts", "ord", "signal"))).alias("xs"), count("positive").alias("positive"), count("negative").alias("negative"))
    folded = hours.select("memory_id", "positive", "negative", F.struct("hour", F.aggregate("xs", zero, step).alias("s")).alias("h"))
    whole = folded.groupBy("memory_id").agg(F.array_sort(F.collect_list("h")).alias("hs"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    first = {"storage": F.lit(0.5), "strength": F.lit(0.5), "confidence": F.lit(5.0)}
    if start is not None:
        known = start.select(F.col("memory_id"), *[F.col(k).cast("double").alias(f"_{k}") for k in MOVES])
        whole = whole.join(known, "memory_id", "left")
        first = {k: F.coalesce(f"_{k}", v) for k, v in first.items()}
    last = lambda k: F.aggregate("hs", first[k], lambda v, h: F.least(F.greatest(v + h["s"][k]["by"], h["s"][k]["low"]), h["s"][k]["high"]))
    return whole.select("memory_id", F.round(last("storage"), 6).alias("storage"), F.round(last("strength"), 6).alias("strength"), F.round(last("confidence")).cast("long").alias("confidence"), "positive", "negative")


def feedback_summary(log: DataFrame, last: int = 10) -> DataFrame:
    """(memory_id, positive, negative, neutral, total, recent): counts, and the last signals, newest first."""
    newest = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("ts"), F.desc("ord")))
    few = log.withColumn("_n", newest).where(F.col("_n") <= last).groupBy("memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "signal"))), lambda x: x["signal"]), ",").alias("recent"))
    counts = log.groupBy("memory_id").agg(*[F.count_if(F.col("signal") == k).alias(k) for k in ("positive", "negative", "neutral")], F.count("*").alias("total"))
    return counts.join(few, "memory_id")


def recent_negatives(log: DataFrame, now: datetime = X.NOW, days: int = 30, limit: int = 3) -> DataFrame:
    """(memory_id, recent, retire): negative signals of the last days, and whether they retire the memory."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    recent = F.count_if((F.col("signal") == "negative") & (F.col("ts").cast("timestamp") >= since)).alias("recent")
    return log.groupBy("memory_id").agg(recent).withColumn("retire", F.col("recent") >= limit)


def merge_clusters(members: DataFrame) -> DataFrame:
    """One observation a cluster (seed): maxima, sums, union of tags, the strongest statement with its scope and domain.

    The sort for the representative keeps the first of equals by id; polarity conflicts are told.
    """
    order = F.struct(F.round(-(F.col("confidence") + 0.01 * F.length("statement")), 6), F.col("id"))
    return members.groupBy("seed").agg(
        F.count("*").alias("members"),
        F.count("*").alias("evidence"),
        F.count_distinct("id").alias("sources"),
        F.round(F.max("strength"), 6).alias("strength"),
        F.round(F.max("storage"), 6).alias("storage"),
        F.sum("frequency").alias("frequency"),
        F.sum("turns").alias("turns"),
        F.max("weight").alias("weight"),
        F.least(F.lit(10), X.js_round(F.avg("confidence") + 1)).cast("long").alias("confidence"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ",").alias("tags"),
        F.min("learned_at").alias("learned_at"),
        F.min_by("statement", order).alias("statement"),
        F.min_by("scope", order).alias("scope"),
        F.min_by("domain", order).alias("domain"),
        (F.count_distinct("polarity") > 1).alias("conflict"),
    )


def induction_members(memories: DataFrame) -> DataFrame:
    """Observations and models that may support an experience, with their group's key.

    The key holds scope, domain and the first three tags; without tags the first entity (a column
    `entity`, if there is one), without that the first six words.
    """
    said = F.concat_ws(" ", *[c for c in ("title", "statement") if c in memories.columns])
    tags = F.array_join(F.slice(F.array_sort("tags"), 1, 3), "+")
    words = F.array_join(F.slice(X.token_set(said, backtick=True), 1, 6), "+")
    entity = F.col("entity") if "entity" in memories.columns else F.lit(None).cast("string")
    what = F.coalesce(F.nullif(tags, F.lit("")), F.nullif(entity, F.lit("")), words)
    base = memories.where("layer in ('observation', 'mental_model') and status in ('active', 'candidate')")
    key = F.concat_ws("|", F.coalesce("scope", F.lit("global")), F.coalesce("domain", F.lit("general")), what)
    return base.withColumn("key", key).withColumn("said", F.lower(said))


def induction_groups(memories: DataFrame, least: int = 3, sources: DataFrame | None = None) -> DataFrame:
    """One row a key of `least` members or more, with what an experience takes from them.

    sources (memory_id, source_id) of live experiences: a group of which one of them has two
    members already (or its only one) is left out.
    """
    keyed = induction_members(memories)
    tags = keyed.select("key", "id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("key", "tag").agg(F.count("*").alias("n"))
    order = F.struct((-(F.col("n") >= 2).cast("int")).alias("o"), "tag")
    few = tags.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(order))).where("_r <= 12").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "tag"))), lambda x: x["tag"]), ",").alias("tags"))
    shared = tags.where("n >= 2").groupBy("key").agg(F.count("*").alias("shared"))
    best = F.struct(F.round(-(F.col("confidence") + 0.01 * F.length("statement")), 6), "id")
    seen = F.coalesce("learned_at", "valid_from") if "valid_from" in memories.columns else F.col("learned_at")
    kinds = [F.max(F.col("said").rlike(words)).alias(f"is_{kind}") for kind, words in R.PATTERN_KINDS]
    out = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("proof").alias("proof"), F.avg("confidence").alias("conf"), F.sum("weight").alias("w"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.min_by("statement", best).alias("top"), F.min_by("scope", "id").alias("scope"), F.min_by("domain", "id").alias("domain"), F.max("strength").alias("strength"), F.max("storage").alias("storage"), F.sum("frequency").alias("frequency"), F.sum("turns").alias("turns"), *kinds)
    kind = F.lit("recurring")
    for k, _ in reversed(R.PATTERN_KINDS):
        kind = F.when(F.col(f"is_{k}"), k).otherwise(kind)
    out = out.withColumn("pattern", kind).drop(*[f"is_{k}" for k, _ in R.PATTERN_KINDS])
    out = out.where(F.col("members") >= least).join(shared, "key", "left").join(few, "key", "left")
    if sources is not None:
        overlap = keyed.select("key", F.col("id").alias("source_id")).join(sources, "source_id").groupBy("key", "memory_id").agg(F.count("*").alias("both"))
        known = overlap.join(out.select("key", "members"), "key").where(F.col("both") >= F.least("members", F.lit(2))).select("key").distinct()
        out = out.join(known, "key", "left_anti")
    return out.withColumn("score", F.round(F.col("proof") + F.col("conf") / 2 + 0.5 * F.coalesce("shared", F.lit(0)), 6))


def experiences(groups: DataFrame, most: int = 5) -> DataFrame:
    """The experiences that a run induces: the `most` best groups, in words and numbers."""
    n = F.col("members")
    out = groups.orderBy(F.desc("score"), "key").limit(most)
    return out.select(
        "key",
        F.concat(F.lit("Repeated pattern across "), n.cast("string"), F.lit(" memories: "), F.col("top")).alias("statement"),
        "tags",
        "pattern",
        X.clamp(X.js_round(F.col("conf") + F.least(F.lit(2.0), n / 3.0)), 1, 10).cast("long").alias("confidence"),
        X.clamp(X.js_round(F.col("w") / n), 1, 10).cast("long").alias("weight"),
        F.greatest(n, F.col("proof")).alias("occurrence"),
        "first_seen",
        "last_seen",
    )


def evidence_lines(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, id, line): the numbered members behind each key, in id order: a row each, as a group may be large."""
    m = induction_members(memories).join(keys.select("key"), "key")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), "statement") if "title" in memories.columns else F.col("statement")
    n = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    return m.withColumn("n", n).select("key", F.col("n").cast("long").alias("n"), "id", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), title).alias("line"))

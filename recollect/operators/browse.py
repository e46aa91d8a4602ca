"""Looking things up: lists, details, evidence, episodes, and rows made or changed by hand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions import rules as R


def point(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the wanted ids (id), of an index or of vectors alike; unknown ids give none."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key)


def listed(memories: DataFrame, layer: str = "all", status: str = "all", most: int = 50) -> DataFrame:
    """Memories of a layer and a status, newest first, each with the number of all that fit (total)."""
    some = memories
    for name, value in (("layer", layer), ("status", status)):
        some = some if value == "all" else some.where(F.col(name) == value)
    total = some.agg(F.count("*").alias("total"))
    return some.orderBy(F.desc("learned_at"), "id").limit(most).join(F.broadcast(total))


def experiences(memories: DataFrame, status: str = "all", most: int = 50) -> DataFrame:
    """Experiences of a status, those seen last first."""
    some = memories.where("layer = 'experience'")
    some = some if status == "all" else some.where(F.col("status") == status)
    return some.withColumn("seen", F.coalesce("last_seen", "learned_at")).orderBy(F.desc("seen"), "id").limit(most)


def evidence_of(sources: DataFrame, memories: DataFrame) -> DataFrame:
    """(owner, pos, id, ...) of source lists (owner, ids): each source that is still there, in its order."""
    one = sources.select("owner", F.posexplode("ids").alias("pos", "id"))
    return one.join(memories, "id")


def associated(links: DataFrame, memories: DataFrame) -> DataFrame:
    """(src, id, type, weight, statement, status) of association lists (src, associations) whose targets are there."""
    one = links.select("src", F.explode("associations").alias("a")).select("src", F.col("a.target").alias("id"), F.col("a.type").alias("type"), F.col("a.weight").alias("weight"))
    return one.join(memories.select("id", "statement", "status"), "id")


def last_signals(log: DataFrame, k: int) -> DataFrame:
    """The last k signals of each memory, newest first by rank."""
    order = Window.partitionBy("memory_id").orderBy(F.desc("ts"), F.desc("ord"))
    return log.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def entity_nodes(bridge: DataFrame) -> DataFrame:
    """(entity, memories): the graph's nodes and how many memories name each."""
    return bridge.groupBy("entity").agg(F.count_distinct("memory_id").alias("memories"))


# ------------------------------------------------------------------- episodes


def episodes(turns: DataFrame, kind: str = "turn") -> DataFrame:
    """An episode of each pair (conv_id, turn, ts, user, assistant): a summary and up to 1,000 characters of context."""
    both = F.concat_ws("\n---\n", F.nullif("user", F.lit("")), F.nullif("assistant", F.lit("")))
    return turns.select("conv_id", "turn", "ts", F.lit(kind).alias("kind"), X.summarize_turn(F.col("user"), F.col("assistant")).alias("summary"), F.substring(both, 1, 1000).alias("context"))


def checkpoint(labels: DataFrame) -> DataFrame:
    """Labelled episodes of (ts, label, summary, tags, next_steps, context): the label stands in for a missing summary."""
    none = F.array().cast("array<string>")
    return labels.select("ts", F.lit("checkpoint").alias("kind"), F.coalesce("summary", "label").alias("summary"), F.concat(F.array(F.lit("checkpoint")), F.coalesce("tags", none)).alias("tags"), "label", F.coalesce("next_steps", none).alias("next_steps"), "context")


def recovery_context(rows: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """(by, text): the last episodes of each group, oldest first, a line each, with the first three next steps.

    rows (by, ts, ord, kind, label, summary, next_steps) of kinds summary, checkpoint and turn.
    """
    newest = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("ord"))
    some = rows.where("kind in ('summary', 'checkpoint', 'turn')").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    label = F.when((F.col("kind") == "checkpoint") & (F.coalesce("label", F.lit("")) != ""), F.concat(F.lit("checkpoint:"), "label")).otherwise(F.col("kind"))
    line = F.concat(F.lit("- ["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit(" "), label, F.lit("] "), "summary")
    steps = F.when(F.size("next_steps") > 0, F.concat(F.lit("\n  next: "), F.array_join(F.slice("next_steps", 1, 3), "; "))).otherwise("")
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.concat(line, steps).alias("l")))), lambda x: x["l"])
    return some.groupBy(*by).agg(F.concat(F.lit("### Recent Session Context\n"), F.array_join(lines, "\n")).alias("text"))


def insights(turns: DataFrame, last: int = 6) -> DataFrame:
    """(conv_id, turn, insight) to keep before a conversation is compressed: user turns among its last messages that hold a marker."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    said = X.strip_context("text")
    some = turns.withColumn("_n", back).where((F.col("_n") <= last) & (F.col("role") == "user")).withColumn("said", said)
    return some.where((F.length("said") > 0) & X.any_of(F.col("said"), R.INSIGHT_MARKERS)).select("conv_id", "turn", F.substring("said", 1, 200).alias("insight"))


# -------------------------------------------------------------- rows by hand


def number_within(text: Column, fallback: Column, low: float = 1, high: float = 10) -> Column:
    """A number between bounds; the fallback where there is none."""
    n = F.expr(f"try_cast({text} as double)") if isinstance(text, str) else text.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), fallback).otherwise(X.clamp(n, low, high))


def created(bodies: DataFrame, now: datetime = X.NOW) -> DataFrame:
    """Raw memories of what users typed (statement, status, scope, domain, tags, polarity, confidence, weight, all text).

    Without a statement there is none; unknown words take defaults, numbers are held between 1 and 10.
    """
    c = F.col
    said = F.trim("statement")
    some = bodies.where(F.coalesce(F.length(said), F.lit(0)) > 0)
    return some.select(
        *[x for x in bodies.columns if x not in ("statement", "status", "scope", "domain", "tags", "polarity", "confidence", "weight")],
        said.alias("statement"),
        F.lit("raw").alias("layer"),
        F.when(c("status").isin("candidate", "locked"), c("status")).otherwise("active").alias("status"),
        F.coalesce("scope", F.lit("global")).alias("scope"),
        F.coalesce("domain", F.lit("manual")).alias("domain"),
        X.string_list("tags").alias("tags"),
        F.when(c("polarity").isin("do", "dont"), c("polarity")).alias("polarity"),
        number_within(c("confidence"), F.lit(7.0)).alias("confidence"),
        number_within(c("weight"), F.lit(5.0)).alias("weight"),
        F.lit(0.8).alias("strength"),
        F.lit(1.0).alias("storage"),
        F.lit(now).cast("timestamp").alias("learned_at"),
        X.content_hash(said).alias("hash"),
    )


def patched(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories with changes (id and any of its columns): what is null stays, confidence and weight are held in bounds."""
    names = [c for c in changes.columns if c != "id" and c in memories.columns]
    m = memories.join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in names]), "id", "left")
    kind = {f.name: f.dataType for f in memories.schema}

    def value(c: str) -> Column:
        if c not in names:
            return F.col(c)
        if c in ("confidence", "weight"):
            return F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(number_within(F.col(f"_{c}").cast("string"), F.col(c).cast("double")).cast(kind[c])).alias(c)
        return F.coalesce(f"_{c}", c).alias(c)

    return m.select(*[value(c) for c in memories.columns])


def forgotten(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """memories after the ids were forgotten: raw ones are retired, no others, and none is deleted."""
    m = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    status = F.when(F.col("_hit").isNotNull() & (F.col("layer") == "raw"), "retired").otherwise(F.col("status"))
    return m.withColumn("status", status).select(memories.columns)


def acted(memories: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """memories after an action on ids (id), whatever their layer and status: retire, activate or delete."""
    if action == "delete":
        return memories.join(ids.select("id"), "id", "left_anti").select(memories.columns)
    status = {"retire": "retired", "activate": "active"}[action]
    m = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return m.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).select(memories.columns)

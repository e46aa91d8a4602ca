"""Administration: counts, reviews, integrity, merging of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions import rules as R


def store_stats(memories: DataFrame) -> DataFrame:
    return memories.groupBy("layer", "status").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table, as counted for entities, edges, feedback and the index."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def folder_bytes(spark, path: str) -> int:
    """Bytes of all files below a path, by its file system's own sum."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def index_rows(memories: DataFrame) -> DataFrame:
    """A row of the search index for each memory: one shape for all layers.

    A raw memory is called engram; models are trusted 8 where no confidence is known, others 5;
    a model's update is its refreshing (a column `refreshed`, if there is one).
    """
    c = F.col
    none = F.lit(None).cast("timestamp")
    refreshed = c("refreshed") if "refreshed" in memories.columns else none
    return memories.select(
        "id",
        F.when(c("layer") == "raw", "engram").otherwise(c("layer")).alias("layer"),
        "status",
        "statement",
        F.array_join("tags", " ").alias("tags"),
        F.coalesce("scope", F.lit("")).alias("scope"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce("confidence", F.when(c("layer") == "mental_model", 8).otherwise(5)).cast("long").alias("confidence"),
        X.activation_value("strength", "storage").alias("activation"),
        c("learned_at").alias("created_at"),
        F.when(c("layer") == "mental_model", F.coalesce(refreshed, "learned_at")).otherwise(c("learned_at")).alias("updated_at"),
    )


def rebuilt_index(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """A whole index anew; a row keeps its activation if it was touched after the memory was."""
    old = previous.select("id", F.col("activation").alias("_a"), F.col("updated_at").alias("_at"), F.col("created_at").alias("_made"))
    later = F.col("_at") > F.col("updated_at")
    out = fresh.join(old, "id", "left").withColumn("activation", F.when(later, F.col("_a")).otherwise(F.col("activation")))
    return out.withColumn("updated_at", F.when(later, F.col("_at")).otherwise(F.col("updated_at"))).drop("_a", "_at", "_made")


def upserted_index(index: DataFrame, rows: DataFrame) -> DataFrame:
    """index with rows put in: new values win, the day of creation stays."""
    old = index.select("id", F.col("created_at").alias("_made"))
    new = rows.join(old, "id", "left").withColumn("created_at", F.coalesce("_made", "created_at")).drop("_made")
    return index.join(rows.select("id"), "id", "left_anti").unionByName(new.select(index.columns))


def temporal_consistency(memories: DataFrame) -> DataFrame:
    """(id, learned_at, valid_from) of raw memories that hold before they were learned."""
    return memories.where("layer = 'raw' and learned_at > valid_from").select("id", "learned_at", "valid_from")


def review(memories: DataFrame) -> DataFrame:
    """id, score and reasons of the memories that review rules name; rules as in recollect.functions.rules."""
    c = F.col
    live = c("status").isin("active", "candidate")
    bare = live & (c("domain") == "general") & (F.size("tags") == 0)
    short = lambda n: bare & (c("confidence") <= 5) & (F.length(F.trim("statement")) <= n)
    source = c("origin")
    rules: list[tuple[str, int, Column]] = [
        ("dogfood/test tag", 3, F.exists("tags", lambda t: F.lower(t).isin(*R.TEST_TAGS))),
        ("test domain", 2, F.lower(c("domain")).isin(*R.TEST_DOMAINS)),
        ("test source", 2, source.rlike(R.TEST_SOURCE)),
        ("test marker", 3, F.concat_ws("\n", c("statement"), source).rlike(R.TEST_MARKERS)),
        ("low-context engineering fragment", 2, short(80) & F.trim("statement").rlike(R.ENGINEERING)),
        ("low-context conversational fragment", 2, short(40) & F.trim("statement").rlike(R.CONVERSATIONAL)),
        ("malformed extraction artifact", 4, bare & (c("statement").rlike(R.MALFORMED) | source.rlike(R.MALFORMED))),
        ("low-confidence candidate", 1, (c("status") == "candidate") & (c("confidence") <= 4)),
        ("negative feedback", 2, c("negative") > c("positive")),
    ]
    hit = lambda p: F.coalesce(p, F.lit(False))
    score = sum((F.when(hit(p), w).otherwise(0) for _, w, p in rules), F.lit(0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(hit(p), F.lit(name)) for name, _, p in rules])), "; ")
    return memories.select("id", "layer", "status", score.cast("long").alias("score"), reasons.alias("reasons")).where("score > 0")


def holds(query: str, *fields: str) -> Column:
    """Whether an id, a statement, a source, a domain or a tag holds a query, whatever its case."""
    q = query.lower()
    return F.exists("tags", lambda t: F.lower(t).contains(q)) | F.concat_ws("\n", *[F.lower(F.col(f).cast("string")) for f in fields or ("id", "statement", "origin", "domain")]).contains(q)


def prune_choice(memories: DataFrame, tag: str | None = None, query: str | None = None) -> DataFrame:
    """(id, score, reasons) to prune: those with a tag (that hold a query), or those that a review names."""
    some = memories.where(holds(query)) if query else memories
    found = review(some.where("status <> 'retired'" if tag is None else F.array_contains("tags", tag)))
    if tag is None:
        return found.select("id", "score", "reasons")
    own = some.where(F.array_contains("tags", tag)).select("id")
    return own.join(found.select("id", "score", "reasons"), "id", "left").select("id", F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce("reasons", F.lit(f"tag:{tag}")).alias("reasons"))


def retired(memories: DataFrame, ids: DataFrame, today: Column) -> DataFrame:
    """memories after the ids retired: tagged as pruned and valid no longer; experiences stay as they are."""
    hit = F.col("_hit").isNotNull() & (F.col("layer") != "experience") & ~F.col("status").isin("locked", "retired")
    m = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    new = {"status": F.when(hit, "retired").otherwise(F.col("status")), "tags": F.when(hit, F.array_union("tags", F.array(F.lit("pruned")))).otherwise(F.col("tags")), "valid_until": F.when(hit, F.coalesce("valid_until", today)).otherwise(F.col("valid_until"))}
    return m.select(*[new.get(c, F.col(c)).alias(c) for c in memories.columns])


def prune_actions(memories: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, action, reason) of chosen ids: locked and retired ones are skipped, others retire."""
    m = chosen.select("id").join(memories.select("id", "status"), "id")
    why = F.when(F.col("status") == "locked", "locked").when(F.col("status") == "retired", "already retired")
    return m.select("id", F.when(why.isNull(), "retired").otherwise("skipped").alias("action"), F.coalesce(why, F.lit("selected")).alias("reason"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges one of whose ends is no memory, and which end."""
    ids = memories.select("id")
    gone = lambda end: edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select("src", "dst", "type", F.lit(end).alias("missing"))
    return gone("src").union(gone("dst"))


def _outside() -> list[Column]:
    """Counts of values that lie outside their field's range."""
    bad = {"strength": (0, 1), "storage": (0, 1), "confidence": (1, 10), "weight": (1, 10), "frequency": (1, None)}
    out = lambda k, a, b: (F.col(k) < a) | ((F.col(k) > b) if b is not None else F.lit(False))
    return [F.count_if(out(k, a, b)).alias(f"bad_{k}") for k, (a, b) in bad.items()]


def range_violations(memories: DataFrame) -> DataFrame:
    """How many values of each field lie outside their range."""
    return memories.agg(*_outside())


def health_counts() -> list[Column]:
    """Counts, over memories, of rows and of those that break a rule: for an aggregate or an observation while they are read."""
    known = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    return [
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id").isNull()).alias("no_id"), F.count_if(F.coalesce(F.trim("statement"), F.lit("")) == "").alias("no_statement"),
        F.count_if(known("layer", R.ID_PREFIXES)).alias("odd_layer"), F.count_if(known("status", R.STATUSES)).alias("odd_status"),
        F.count_if((F.col("layer") == "raw") & (F.col("valid_from") < F.col("learned_at"))).alias("early"), *_outside(),
    ]


def health(memories: DataFrame) -> DataFrame:
    """One row of health_counts, from one reading of the columns that they need."""
    return memories.agg(*health_counts())


def index_diff(index: DataFrame, source: DataFrame) -> DataFrame:
    """(action, n): rows (id, hash) added, updated or removed between an index and its source."""
    both = index.select("id", F.col("hash").alias("old")).join(source.select("id", F.col("hash").alias("new")), "id", "full_outer")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated").otherwise("same")
    return both.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def three_way_merge(latest: DataFrame, current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(id, value) of latest with our changes since the snapshot: what we deleted goes, what we added or changed wins.

    If an id stands twice in current, rows can't be told apart by it, and current is taken as it is.
    """
    twice = current.groupBy("id").count().where("count > 1").limit(1).agg((F.count("*") > 0).alias("_twice"))
    whole = current.select("id", "value").join(F.broadcast(twice)).where("_twice").drop("_twice")
    return _merged(latest, current, snapshot).join(F.broadcast(twice)).where("not _twice").drop("_twice").unionByName(whole)


def _merged(latest: DataFrame, current: DataFrame, snapshot: DataFrame) -> DataFrame:
    side = lambda df, p: df.select("id", F.col("value").alias(p), F.lit(True).alias(f"in_{p}"))
    m = side(latest, "l").join(side(current, "c"), "id", "full_outer").join(side(snapshot, "s"), "id", "full_outer")
    here = lambda p: F.coalesce(F.col(f"in_{p}"), F.lit(False))
    ours = here("c") & (~here("s") | ~F.col("c").eqNullSafe(F.col("s")))
    deleted = here("s") & ~here("c")
    return m.where(~deleted & (here("l") | ours)).select("id", F.when(ours, F.col("c")).otherwise(F.col("l")).alias("value"))


def overlay(base: DataFrame, delta: DataFrame, *values: str) -> DataFrame:
    """base with the values of each id's latest overlay row where there is one."""
    last = delta.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*values), "at").alias("_new"))
    out = base.join(last, F.col("id") == F.col("_id"), "left")
    return out.withColumns({v: F.coalesce(f"_new.{v}", v) for v in values}).drop("_id", "_new")


def chunk_numbers(rows: DataFrame, size: int, key: str = "id") -> DataFrame:
    """rows with chunk: the newest `size` by key are hot (chunk null), older ones in chunks of `size` from 0.

    Ranks come from counts by range, not from one sorted task: keys are cut into ranges and those
    into ranges of ranges; each is counted, and ranked within the next wider one.
    """
    fine, wide = F.floor(F.col(key) / 4096), F.floor(F.col(key) / (4096 * 4096))
    per = rows.groupBy(fine.alias("_fine"), wide.alias("_wide")).agg(F.count("*").alias("_n"))
    before = lambda by: F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = per.withColumn("_a", before(Window.partitionBy("_wide").orderBy("_fine")))
    outer = per.groupBy("_wide").agg(F.sum("_n").alias("_n")).withColumn("_b", before(Window.orderBy("_wide")))
    ahead = inner.join(F.broadcast(outer.select("_wide", "_b")), "_wide").select("_fine", (F.col("_a") + F.col("_b")).alias("_ahead"))
    total = rows.agg(F.count("*").alias("_total"))
    own = F.row_number().over(Window.partitionBy("_fine").orderBy(key))
    ranked = rows.withColumn("_fine", fine).join(ahead, "_fine").withColumn("_i", F.col("_ahead") + own - 1).join(F.broadcast(total))
    chunk = F.when(F.col("_i") < F.col("_total") - size, F.floor(F.col("_i") / size))
    return ranked.select(*rows.columns, chunk.alias("chunk"))


def chunk_layout(rows: DataFrame, size: int) -> DataFrame:
    """(chunk, n, first_id, last_id) of rows (id) in chunks as chunk_numbers deals them."""
    return chunk_numbers(rows, size).groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: dict[str, float], buckets: int = 1024) -> DataFrame:
    """key and the value at ceil((n - 1) * share) of its sorted values, for each named share.

    Values are counted by equal ranges between the key's extremes first; only those of the
    ranges that hold a wanted rank are counted one by one.  No key's values meet in one row.
    """
    v = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    ends = v.groupBy(F.col("_k").alias("_e")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * buckets), F.lit(buckets - 1))).otherwise(0)
    placed = v.join(ends, F.col("_k").eqNullSafe(F.col("_e"))).select("_k", "_v", at.cast("int").alias("_b"))
    per = placed.groupBy("_k", "_b").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_k").orderBy("_b")
    per = per.withColumn("_ahead", F.sum("_n").over(by) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy("_k")))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q")) for n, q in shares.items()]))
    want = per.select("*", named.alias("_w")).withColumn("_rank", F.ceil((F.col("_all") - 1) * F.col("_w.q")) + 1)
    want = want.where((F.col("_rank") > F.col("_ahead")) & (F.col("_rank") <= F.col("_ahead") + F.col("_n"))).select(F.col("_k").alias("_wk"), F.col("_b").alias("_wb"), (F.col("_rank") - F.col("_ahead")).alias("_rank"), F.col("_w.name").alias("name"))
    here = want.select("_wk", "_wb").distinct()
    same = F.col("_k").eqNullSafe(F.col("_wk")) & (F.col("_b") == F.col("_wb"))
    one = placed.join(here, same, "left_semi").groupBy("_k", "_b", "_v").agg(F.count("*").alias("_n"))
    one = one.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_k", "_b").orderBy("_v")))
    hit = one.join(want, same).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    return hit.groupBy(F.col("_k").alias(key)).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in shares])


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, user, assistant): each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return out.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user"), F.col("next_text").alias("assistant"))

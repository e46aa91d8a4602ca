"""One object over a store of versioned tables: set up, learn, recall, maintain, review, repair."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.operators import admin as A
from recollect.operators import browse as B
from recollect.operators import consolidate as K
from recollect.operators import lifecycle as L
from recollect.operators import retrieval as R
from recollect.sources.embedding import Embed, embedded
from recollect.sources.logs import Log, Step
from recollect.sources.store import Table, Taken, stored

SCHEMA_VERSION = 6
MEMORY = (
    "id long, layer string, title string, statement string, text string, scope string, domain string, tags array<string>, learned_at timestamp, valid_from timestamp, valid_until timestamp, "
    "last_accessed timestamp, refreshed timestamp, last_seen timestamp, strength double, storage double, frequency long, turns long, weight long, confidence long, polarity string, consolidated boolean, "
    "status string, trend string, pattern string, positive long, negative long, adopted long, proof long, evidence long, sources long, hash string"
)
SCHEMAS = {
    "memories": MEMORY,
    "bridge": "memory_id long, entity string, type string",
    "edges": "src long, dst long, type string, weight double",
    "sources": "memory_id long, source_id long, event string, quote string, at timestamp, noted timestamp",
    "vectors": "id long, hash string, embedding array<float>",
    "index": "id long, layer string, status string, statement string, tags string, scope string, domain string, confidence long, activation double, created_at timestamp, updated_at timestamp",
    "feedback": "memory_id long, ts timestamp, ord long, signal string, context string",
    "episodes": "conv_id long, turn long, ts timestamp, kind string, summary string, context string, tags array<string>, label string, next_steps array<string>",
    "overlay": "id long, at timestamp, turns long, last_accessed timestamp",
    "state": "seq long, name string, at timestamp, detail string, added long",
}
#: Tables whose rows change; all others are logs.
TABLES = ("memories", "index")
#: Values that columns added by later schema versions take in older rows.
DEFAULTS = {"turns": 0, "adopted": 0, "proof": 1, "evidence": 0, "sources": 0, "positive": 0, "negative": 0, "weight": 5, "confidence": 5, "consolidated": False, "trend": "new"}
#: What a model is told when it reflects.
REFLECT = "Synthesize a mental model from these observations:\n\n{observations}\n\nQuery context: {query}"


@dataclass
class Config:
    """Settings: defaults, then the store's own, then what the caller gives."""

    budget: int = 2048
    persist_recall: str = "overlay"  # or memories, or off
    induction_evidence: int = 3
    cluster_similarity: float = 0.85
    consolidate_batch: int = 50
    graph_batch: int = 100
    dimension: int = 0  # of vectors; 0: any
    most_bytes: int = 1 << 40  # of a table's folder, before the doctor warns

    def merged(self, *others: dict) -> Config:
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        out = asdict(self)
        for o in others:
            unknown = set(o) - set(known)
            if unknown:
                raise KeyError(f"no such setting: {', '.join(sorted(unknown))}")
            out |= {k: known[k](v) for k, v in o.items()}
        return Config(**out)

    @staticmethod
    def keys() -> list[str]:
        return [f.name for f in fields(Config)]

    @staticmethod
    def resolved(file: str | None = None, env: dict[str, str] | None = None, prefix: str = "RECOLLECT_", **given) -> Config:
        """Defaults, then a JSON file's settings, then those of an environment under a prefix, then what is given."""
        said = {}
        if file:
            with open(file, encoding="utf-8") as f:
                said = json.load(f)
        named = {k[len(prefix) :].lower(): v for k, v in (env or {}).items() if k.startswith(prefix)}
        return Config().merged(said, {k: v for k, v in named.items() if k in Config.keys()}, given)


class Engine:
    """Plans over the store's tables; every step takes `now`, so results can be repeated.

    embed and complete are where an embedding model and a language model plug in: embed takes
    (key, text) to (key, embedding), complete a prompt to an answer.  Without them vectors, and
    what a model would say, are left out.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embed: Embed | None = None, complete: Callable[[str], str] | None = None):
        self.spark, self.path, self.config, self.embed, self.complete = spark, path.rstrip("/"), config or Config(), embed, complete

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path}/{name}")

    def log(self, name: str) -> Log:
        return Log(self.spark, f"{self.path}/{name}", SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        return self.table(name).read() if name in TABLES else self.log(name).read()

    def changed(self, change: Callable[[DataFrame], tuple[DataFrame, tuple[int, ...]]], step: Step | None = None, tries: int = 3) -> tuple[int, ...]:
        """Commits what change makes of the memories, and gives the counts it has beside them.

        The version that change reads is the one that the commit follows; if another writer was
        faster, change reads anew.  A step of a stream that the memories hold already changes
        nothing and gives the counts that were noted with it.
        """
        t = self.table("memories")
        for left in range(tries - 1, -1, -1):
            base = t.version()
            done = t.done(base, step) if step else None
            if done is not None:
                return done
            rows, counts = change(t.read(base))
            try:
                t.commit(rows, base, step, counts)
                return counts
            except Taken:
                if not left:
                    raise
        raise AssertionError

    def configure(self, now: datetime = X.NOW, reset: bool = False, **changes) -> Config:
        """The store's own settings, changed or reset and kept; unknown names are an error."""
        kept = self.read("state").where("name = 'config'").orderBy(F.desc("seq")).select("detail").limit(1).collect()
        own = {} if reset or not kept else json.loads(kept[0]["detail"])
        self.config = Config().merged(own, changes)
        if changes or reset:
            self.note("config", now, json.dumps(own | changes))
        return self.config

    def note(self, name: str, now: datetime, detail: str = "", added: int = 0, step: Step | None = None) -> None:
        """Appends to the store's state; seq tells what came after what, whatever the times say."""
        seq = self.read("state").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        self.log("state").append(self.rows(SCHEMAS["state"], (seq, name, now, detail, added)), step)

    # ------------------------------------------------------------ set-up, schema

    def setup(self) -> list[str]:
        """Creates the tables that are missing, empty; gives their names."""
        made = []
        for name, ddl in SCHEMAS.items():
            if name in TABLES and not self.table(name).versions():
                self.table(name).commit(self.spark.createDataFrame([], ddl))
                made.append(name)
            elif name not in TABLES and not self.log(name).exists():
                self.log(name).create()
                made.append(name)
        if len(made) == len(SCHEMAS):
            self.note("schema", X.NOW, "new", SCHEMA_VERSION)
        return made

    def schema_version(self) -> int:
        """The version that the store was last brought to; 0 if none was noted."""
        return self.read("state").where("name = 'schema'").agg(F.coalesce(F.max("added"), F.lit(0))).first()[0]

    def migrate(self, dry_run: bool = True, now: datetime = X.NOW) -> dict[str, list[str]]:
        """What the steps of MIGRATIONS would change, by table, in order; unless dry_run, changes it and notes the version.

        Steps look at the rows, so one that was taken already changes nothing, and a run that
        failed half-way can be repeated.  A store of a newer version is refused.  Earlier
        versions of a table stay until vacuumed, so a migration can be taken back.
        """
        at = self.schema_version()
        if at > SCHEMA_VERSION:
            raise RuntimeError(f"the store is of schema version {at}; this engine knows {SCHEMA_VERSION} at most")
        changed: dict[str, list[str]] = {}
        for step in MIGRATIONS:
            for name, what in step(self, dry_run).items():
                changed.setdefault(name, []).extend(w for w in what if w not in changed.get(name, []))
        if not dry_run and (changed or at < SCHEMA_VERSION):
            self.note("schema", now, ", ".join(s.__name__ for s in MIGRATIONS), SCHEMA_VERSION)
        return changed

    def lacking_columns(self, dry_run: bool) -> dict[str, list[str]]:
        """Columns that older tables lack get their defaults; logs are read by name, so theirs are null."""
        missing: dict[str, list[str]] = {}
        for name in TABLES:
            want = self.spark.createDataFrame([], SCHEMAS[name]).schema
            have = self.read(name)
            lack = [f for f in want if f.name not in have.columns]
            if lack:
                missing[name] = [f.name for f in lack]
                if not dry_run:
                    add = [F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in lack]
                    self.table(name).update(lambda rows, add=add, want=want: rows.select("*", *add).select(want.names))
        return missing

    def filled(self, values: dict[str, Column], dry_run: bool) -> dict[str, list[str]]:
        """Columns of memories that some row lacks a value of, and which then get it."""
        mem = self.read("memories")
        some = [c for c in values if c in mem.columns]
        empty = mem.agg(*[F.count_if(F.col(c).isNull() & values[c].isNotNull()).alias(c) for c in some]).first()
        short = [c for c in some if empty[c]]
        if short and not dry_run:
            self.table("memories").update(lambda rows: rows.withColumns({c: F.coalesce(F.col(c), values[c].cast(rows.schema[c].dataType)) for c in short}))
        return {"memories": short} if short else {}

    def rows(self, ddl: str, *values: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(values), ddl)

    def shaped(self, name: str, df: DataFrame) -> DataFrame:
        """df as rows of a table: missing columns are null or have their default."""
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in want])

    def append(self, name: str, df: DataFrame, step: Step | None = None) -> None:
        """Adds rows: to a log as a batch that reads nothing, to the memories as a change of them."""
        rows = self.shaped(name, df)
        if name in TABLES:
            self.table(name).update(lambda base: base.unionByName(rows))
        else:
            self.log(name).append(rows, step)

    def numbered(self, new: DataFrame, by: str, memories: DataFrame) -> DataFrame:
        """new with ids after the memories' last one, in the order of the hexadecimal string `by`, counted per leading byte so that no task sorts all."""
        start = memories.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = new.withColumn("_lead", F.substring(by, 1, 2))
        ahead = fresh.groupBy("_lead").agg(F.count("*").alias("_c")).withColumn("_ahead", F.coalesce(F.sum("_c").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        number = F.row_number().over(Window.partitionBy("_lead").orderBy(by))
        return fresh.join(ahead.drop("_c"), "_lead").withColumn("id", (start + F.col("_ahead") + number).cast("long")).drop("_lead", "_ahead")

    # ------------------------------------------------------------------- learning

    def said(self, turns: DataFrame) -> DataFrame:
        """Candidates of turns by rules."""
        return L.candidates(turns, ["conv_id", "turn"]).select("conv_id", "turn", "rule_ord", "statement", "polarity", "domain", F.split("tags", ",").alias("tags"), F.col("confidence").cast("long").alias("confidence"))

    def told(self, turns: DataFrame) -> DataFrame:
        """Candidates of turns by the language model; turns of which it makes nothing go by rules."""
        complete = self.complete

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                answers = []
                for text in batch["text"].to_pylist():
                    try:
                        answers.append(complete(text or ""))
                    except Exception:  # noqa: BLE001  a model that fails leaves the turn to the rules
                        answers.append(None)
                yield pa.record_batch([batch["conv_id"], batch["turn"], pa.array(answers, pa.string())], names=["conv_id", "turn", "answer"])

        plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), X.strip_context("text").alias("text"))
        got = stored(plain.where("text <> ''").mapInArrow(ask, "conv_id long, turn long, answer string"), "answers")
        facts = got.select("conv_id", "turn", F.posexplode(X.facts("answer")).alias("rule_ord", "f")).select("conv_id", "turn", "rule_ord", "f.statement", "f.polarity", F.lit("general").alias("domain"), F.array().cast("array<string>").alias("tags"), "f.confidence")
        rest = turns.join(facts.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_anti")
        return facts.unionByName(self.said(rest))

    def learn(self, turns: DataFrame, now: datetime = X.NOW, model: bool = False, step: Step | None = None) -> dict[str, int]:
        """Learns from user turns (conv_id, turn, text): new statements are added, known ones seen again.

        New memories bring their entities, every turn an episode.  model: ask the language model
        first.  step: of the stream that the turns come from; what a step has written is not
        written again, so a step that failed anywhere can be repeated whole.
        """
        found = (self.told if model and self.complete else self.said)(turns).withColumn("hash", X.content_hash("statement"))
        per = stored(found.groupBy("hash").agg(F.count("*").alias("n"), *[F.min_by(c, F.struct("conv_id", "turn", "rule_ord")).alias(c) for c in ("statement", "polarity", "domain", "tags", "confidence")]), "learned")
        at = F.lit(now).cast("timestamp")

        def change(mem: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
            known = mem.groupBy("hash").agg(F.min("id").alias("known"))
            both = stored(per.join(known, "hash", "left"), "both")
            new = both.where("known is null").withColumn("order", F.substring("hash", 8, 64))
            new = self.shaped("memories", self.numbered(new, "order", mem).select(
                "id", F.lit("raw").alias("layer"), "statement", F.col("statement").alias("text"), F.lit("global").alias("scope"), "domain", "tags", at.alias("learned_at"), at.alias("valid_from"), at.alias("last_accessed"),
                F.lit(0.8).alias("strength"), F.lit(0.5).alias("storage"), F.col("n").alias("frequency"), "confidence", "polarity", F.lit("candidate").alias("status"), "hash",
            ))
            seen = both.where("known is not null").select(F.col("known").alias("id"), F.col("n").alias("more"))
            again = F.col("more").isNotNull()
            bumped = mem.join(seen, "id", "left").withColumn("frequency", F.col("frequency") + F.coalesce("more", F.lit(0))).withColumn("last_accessed", F.when(again, at).otherwise(F.col("last_accessed")))
            counts = both.agg(F.count_if(F.col("known").isNull()), F.count_if(F.col("known").isNotNull())).first()
            return bumped.select(mem.columns).unionByName(new.select(mem.columns)), tuple(counts)

        added, seen = self.changed(change, step)
        if added:
            first = self.read("memories").join(per.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.min_by("statement", "id").alias("statement"), F.min("id").alias("id"))
            self.append("bridge", self.lacking(self.named(first)), step)
        self.capture(turns, now, step=step)
        return {"added": added, "seen": seen}

    def named(self, memories: DataFrame) -> DataFrame:
        """(memory_id, entity, type) that statements name."""
        return X.exploded(memories.select("id", "statement"), X.entities("statement"), "e").select(F.col("id").alias("memory_id"), F.col("e.name").alias("entity"), F.col("e.type").alias("type")).distinct()

    def lacking(self, named: DataFrame) -> DataFrame:
        """Those of (memory_id, entity, ...) that the graph has not."""
        return named.join(self.read("bridge").select("memory_id", "entity"), ["memory_id", "entity"], "left_anti")

    def tell(self, statement: str, now: datetime = X.NOW, polarity: str | None = None) -> dict[str, int]:
        """Learns one statement, marked as something to remember or not to do."""
        text = statement if polarity is None else ("不要：" if polarity == "dont" else "记住：") + statement
        return self.learn(self.rows("conv_id long, turn long, text string", (0, 0, text)), now)

    def capture(self, turns: DataFrame, now: datetime = X.NOW, kind: str = "turn", step: Step | None = None) -> None:
        """Appends an episode of each turn (conv_id, turn, text, and assistant and ts if there are any)."""
        side = F.col("assistant") if "assistant" in turns.columns else F.lit(None).cast("string")
        ts = F.col("ts").cast("timestamp") if "ts" in turns.columns else F.lit(now).cast("timestamp")
        self.append("episodes", B.episodes(turns.select("conv_id", "turn", ts.alias("ts"), F.col("text").alias("user"), side.alias("assistant")), kind), step)

    def checkpoint(self, label: str, now: datetime = X.NOW, summary: str | None = None, next_steps: list[str] | None = None, tags: list[str] | None = None, context: str | None = None) -> None:
        """Appends a labelled episode."""
        row = self.rows("ts timestamp, label string, summary string, tags array<string>, next_steps array<string>, context string", (now, label, summary, tags or [], next_steps or [], context))
        self.append("episodes", B.checkpoint(row))

    def recovery_context(self, most: int = 5) -> str:
        """The last episodes as text; empty without any."""
        e = self.read("episodes").withColumn("ord", F.coalesce("conv_id", F.lit(0)) * 1_000_000 + F.coalesce("turn", F.lit(0))).orderBy(F.desc("ts"), F.desc("ord")).limit(most).withColumn("all", F.lit(1))
        got = B.recovery_context(e, ["all"], most).first()
        return got["text"] if got else ""

    def feedback(self, signals: DataFrame, now: datetime = X.NOW, step: Step | None = None) -> None:
        """Appends signals (memory_id, ts, ord, signal, context) and folds them, in order, into their memories.

        A memory with a new negative signal and three in the last 30 days retires, unless locked.
        step: of the stream that they come from, so that a step may be repeated.
        """
        self.append("feedback", signals, step)
        recent = L.recent_negatives(self.read("feedback"), now).where("retire").select(F.col("memory_id").alias("id"), "retire")

        def change(mem: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
            folded = L.feedback_fold(signals, mem.select(F.col("id").alias("memory_id"), "storage", "strength", "confidence"))
            f = folded.select(F.col("memory_id").alias("id"), F.col("storage").alias("_storage"), F.col("strength").alias("_strength"), F.col("confidence").alias("_confidence"), F.col("positive").alias("_p"), F.col("negative").alias("_n"))
            m = mem.join(f, "id", "left").join(recent, "id", "left")
            p, n = F.coalesce("_p", F.lit(0)), F.coalesce("_n", F.lit(0))
            gone = (n > 0) & F.coalesce("retire", F.lit(False)) & (F.col("status") != "locked")
            m = m.withColumns({c: F.coalesce(f"_{c}", c) for c in ("storage", "strength", "confidence")} | {"positive": F.col("positive") + p, "negative": F.col("negative") + n, "adopted": F.col("adopted") + p})
            m = m.withColumn("status", F.when(gone, "retired").otherwise(F.col("status"))).withColumn("last_accessed", F.when(F.col("_storage").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("last_accessed")))
            return m.select(mem.columns), ()

        self.changed(change, step)

    # ------------------------------------------------------------------ by hand

    def create(self, bodies: DataFrame, now: datetime = X.NOW) -> None:
        """Adds raw memories that users typed, as recollect.operators.browse.created takes them."""
        made = B.created(bodies, now).withColumn("order", F.substring("hash", 8, 64)).withColumn("text", F.col("statement")).withColumn("frequency", F.lit(1)).withColumn("valid_from", F.col("learned_at")).withColumn("last_accessed", F.col("learned_at"))
        made = stored(made, "made")
        self.table("memories").update(lambda mem: mem.unionByName(self.shaped("memories", self.numbered(made, "order", mem))))

    def patch(self, changes: DataFrame) -> None:
        self.table("memories").update(lambda mem: B.patched(mem, changes))

    def forget(self, ids: DataFrame) -> None:
        self.table("memories").update(lambda mem: B.forgotten(mem, ids))


    # ------------------------------------------------------------------ retrieval

    def vectors(self) -> DataFrame:
        """(id, embedding) of all memories that have one; those without, or whose text changed, are computed first.

        New vectors are added to the log; one of a text that is no longer there finds no memory.
        """
        texts = self.read("memories").select(F.concat_ws(":", F.col("id").cast("string"), X.content_hash("statement")).alias("key"), "id", F.col("statement").alias("text"))
        held = self.read("vectors").select(F.concat_ws(":", F.col("id").cast("string"), "hash").alias("key"), "embedding").dropDuplicates(["key"])
        if self.embed is not None:
            _, new = embedded(texts, held, self.embed, self.config.dimension or None)
            new = stored(new, "vectors")
            if not new.isEmpty():
                self.append("vectors", new.select(F.substring_index("key", ":", 1).cast("long").alias("id"), F.substring_index("key", ":", -2).alias("hash"), "embedding"))
                # those that took the place of a vector of another length come first
                held = new.unionByName(held.join(new.select("key"), "key", "left_anti"))
        return held.join(texts.select("key", "id"), "key").select("id", "embedding")

    def recall(self, queries: DataFrame, now: datetime = X.NOW, explain: bool = False) -> DataFrame | dict[str, DataFrame]:
        """Injection text of each query (query_id, query), or every step's rows; touches what it injects."""
        memories = A.overlay(self.read("memories"), self.read("overlay"), "turns", "last_accessed")
        vectors = None
        if self.embed is not None:
            vectors = self.vectors()
            asked = self.embed(queries.select(F.col("query_id").alias("key"), F.col("query").alias("text"))).select(F.col("key").alias("query_id"), "embedding")
            queries = queries.join(stored(asked, "asked"), "query_id", "left")
        out = R.recall(queries, memories, self.read("bridge"), self.read("edges"), vectors, now=now, budget=self.config.budget)
        out["kept"] = stored(out["kept"], "kept")
        if self.config.persist_recall != "off":
            at = F.lit(now).cast("timestamp")
            touched = out["kept"].where("layer <> 'experience'").groupBy("id").agg((F.max("turns") + 1).cast("long").alias("turns")).select("id", at.alias("at"), "turns", at.alias("last_accessed"))
            if self.config.persist_recall == "overlay":
                self.append("overlay", touched)
            else:
                self.table("memories").update(lambda mem: A.overlay(mem, touched, "turns", "last_accessed").select(mem.columns))
        return out if explain else R.injection(out["kept"], queries)

    def reflect(self, question: str, now: datetime = X.NOW) -> str | None:
        """A model that the language model makes of the observations a recall finds, if there are two at least.

        Its answer is JSON (title, statement, domain, confidence); the new memory is written with
        its sources.  Gives the statement.
        """
        q = self.rows("query_id long, query string", (1, question))
        kept = R.recall(q, self.read("memories"), self.read("bridge"), self.read("edges"), now=now, budget=4096)["kept"]
        found = kept.where("layer = 'observation'").orderBy("rank").select("id", "title", "statement", "proof", "confidence").collect()
        if self.complete is None or len(found) < 2:
            return None
        lines = [f"[{i}] {r['title'] or r['statement']}\n    Evidence: {r['proof']} sources, confidence: {r['confidence']}/10" for i, r in enumerate(found, 1)]
        answer = self.complete(REFLECT.format(observations="\n\n".join(lines), query=question))
        try:
            made = json.loads(answer.replace("```json", "").replace("```", "").strip())
            said = str(made.get("statement") or "")
        except (AttributeError, ValueError):
            return None
        row = {"layer": "mental_model", "title": made.get("title") or "Synthesized Mental Model", "statement": said, "text": said, "scope": "global", "domain": made.get("domain") or "general", "learned_at": now, "valid_from": now, "last_accessed": now, "refreshed": now, "strength": 0.9, "storage": 1.0, "frequency": 1, "weight": 7, "confidence": min(10, int(made.get("confidence") or 7)), "status": "active", "trend": "new", "proof": sum(r["proof"] or 0 for r in found)}
        ddl = ", ".join(f for f in MEMORY.split(", ") if f.split()[0] in row)
        one = self.rows(ddl, tuple(row[f.split()[0]] for f in ddl.split(", "))).withColumn("tags", F.array().cast("array<string>")).withColumn("hash", X.content_hash("statement"))
        one = stored(one.withColumn("order", F.substring("hash", 8, 64)), "model")

        def change(mem: DataFrame) -> tuple[DataFrame, tuple[int]]:
            new = stored(self.shaped("memories", self.numbered(one, "order", mem)), "model")
            return mem.unionByName(new.select(mem.columns)), (new.first()["id"],)

        (number,) = self.changed(change)
        self.append("sources", self.rows("memory_id long, source_id long", *[(number, r["id"]) for r in found]))
        return said

    # ---------------------------------------------------------------- maintenance

    def consolidate(self, now: datetime = X.NOW) -> dict[str, int]:
        """Merges similar unmerged memories into observations, or adds them to known ones; conflicting ones are linked.

        Each source of an observation is kept with what it said, when, and the event that brought it.
        """
        at, bridge, vectors, sources = F.lit(now).cast("timestamp"), self.read("bridge"), self.vectors(), self.read("sources")
        kept: dict[str, DataFrame] = {}

        def change(mem: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
            out = {k: stored(v, k) for k, v in K.consolidate(mem, bridge, vectors, sources, self.config.consolidate_batch, self.config.cluster_similarity).items()}
            made = out["merged"].withColumn("order", F.sha2(F.col("seed").cast("string"), 256))
            new = stored(self.numbered(made, "order", mem).select("seed", "id", F.lit("observation").alias("layer"), F.substring("statement", 1, 80).alias("title"), "statement", F.col("statement").alias("text"), "scope", "domain", F.split("tags", ",").alias("tags"), "learned_at", F.col("learned_at").alias("valid_from"), at.alias("last_accessed"), "strength", "storage", "frequency", "turns", "weight", "confidence", F.lit("active").alias("status"), F.lit("new").alias("trend"), F.col("members").alias("proof"), "evidence", "sources", X.content_hash("statement").alias("hash")), "merged")
            created = out["calm"].join(new.select("seed", F.col("id").alias("memory_id")), "seed").select("memory_id", F.col("id").alias("source_id"), F.lit("created").alias("event"))
            links = out["sources"].withColumn("event", F.lit("updated")).unionByName(created)
            said = mem.select(F.col("id").alias("source_id"), F.substring("statement", 1, 200).alias("quote"), F.coalesce("learned_at", at).alias("at"))
            kept.update(out, new=new, links=stored(links.join(said, "source_id").withColumn("noted", at), "links"))
            updated = out["updated"].withColumn("last_accessed", at)
            rest = mem.join(updated.select("id"), "id", "left_anti").join(out["marked"].withColumn("_m", F.lit(True)), "id", "left").withColumn("consolidated", F.coalesce("_m", "consolidated")).select(mem.columns)
            seeds = lambda name: out[name].select("seed").distinct().count()
            counts = new.count(), updated.count(), seeds("clusters") - seeds("calm"), K.unmerged(mem, self.config.consolidate_batch).count() - out["clusters"].count()
            return rest.unionByName(updated.select(mem.columns)).unionByName(self.shaped("memories", new).select(mem.columns)), counts

        counts = self.changed(change)
        links = kept["links"]
        self.append("sources", links)
        self.append("bridge", self.lacking(K.entities_of_sources(links, bridge, "memory_id")))
        self.append("edges", links.select(F.col("memory_id").alias("src"), F.col("source_id").alias("dst"), F.lit("evidence").alias("type"), F.lit(0.8).alias("weight")).unionByName(kept["evolution"]))
        return dict(zip(("merged", "updated", "conflicts", "skipped"), counts, strict=True))

    def history(self) -> DataFrame:
        """(memory_id, at, event, sources): what brought each observation its sources, oldest first by at."""
        return self.read("sources").where("event is not null").groupBy("memory_id", F.col("noted").alias("at"), "event").agg(F.sort_array(F.collect_set("source_id")).alias("sources"))

    def induce(self, now: datetime = X.NOW) -> dict[str, int]:
        """Writes the experiences that repeated observations and models add up to, with their sources; known ones don't come again."""
        at, held_by = F.lit(now).cast("timestamp"), self.read("sources")
        kept: dict[str, DataFrame] = {}

        def change(mem: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
            live = mem.where("layer = 'experience' and status <> 'retired'").select(F.col("id").alias("memory_id"))
            every = L.induction_groups(mem, self.config.induction_evidence)
            groups = stored(L.induction_groups(mem, self.config.induction_evidence, held_by.join(live, "memory_id")), "groups")
            found = L.experiences(groups).join(groups.select("key", "scope", "domain", "strength", "storage", "frequency", "turns"), "key")
            new = stored(self.numbered(found.withColumn("order", F.sha2("key", 256)), "order", mem).select("key", "id", F.lit("experience").alias("layer"), F.substring("statement", 1, 80).alias("title"), "statement", F.col("statement").alias("text"), "scope", "domain", F.split("tags", ",").alias("tags"), at.alias("learned_at"), F.col("first_seen").alias("valid_from"), "last_seen", at.alias("last_accessed"), "strength", "storage", "frequency", "turns", "weight", "confidence", F.lit("active").alias("status"), F.lit("new").alias("trend"), "pattern", F.col("occurrence").alias("proof"), X.content_hash("statement").alias("hash")), "induced")
            kept["links"] = stored(L.induction_members(mem).select("key", F.col("id").alias("source_id")).join(new.select("key", F.col("id").alias("memory_id")), "key").select("memory_id", "source_id"), "links")
            return mem.unionByName(self.shaped("memories", new).select(mem.columns)), (new.count(), every.count() - groups.count())

        induced, known = self.changed(change)
        self.append("sources", kept["links"])
        return {"induced": induced, "known": known}

    def decay(self, now: datetime = X.NOW) -> int:
        def change(mem: DataFrame) -> tuple[DataFrame, tuple[int]]:
            d = stored(L.batch_decay(mem, now).select("id", "new_status", "new_strength", "new_confidence"), "decay")
            m = mem.join(d, "id", "left")
            m = m.withColumn("status", F.coalesce("new_status", "status")).withColumn("strength", F.coalesce("new_strength", "strength")).withColumn("confidence", F.coalesce(F.col("new_confidence").cast("long"), "confidence"))
            return m.select(mem.columns), (d.count(),)

        return self.changed(change)[0]

    def link(self, whole: bool = False, now: datetime = X.NOW) -> int:
        """Entities of memories that came since the last pass (of all, if whole), and time and co-access edges of the first `graph_batch`, that the graph lacks.

        A pass notes the last id whose statement it has looked at; patched statements need a whole one.
        """
        mem, old = self.read("memories"), self.read("edges")
        upto = 0 if whole else self.read("state").where("name = 'linked'").agg(F.coalesce(F.max("added"), F.lit(0))).first()[0]
        last = mem.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        if last > upto:
            self.append("bridge", self.lacking(self.named(mem.where(F.col("id") > upto))))
        first = stored(mem.select("id").orderBy("id").limit(self.config.graph_batch), "first")
        bridge = self.read("bridge")
        new = R.temporal_edges(mem, left=first).select("src", "dst", F.lit("temporal").alias("type"), "weight").unionByName(R.coaccess_edges(bridge, left=first).select("src", "dst", F.lit("co_accessed").alias("type"), "weight"))
        new = stored(new.join(old.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "type").distinct(), ["src", "dst", "type"], "left_anti").select(old.columns), "edges")
        n = new.count()
        if n:
            self.append("edges", new)
        if last > upto:
            self.note("linked", now, added=last)
        return n

    def sync_index(self, whole: bool = False) -> dict[str, int]:
        """Brings the search index up to the memories: what changed, or (whole) all of it; a row keeps a later activation."""
        rows, diff = self.shaped("index", A.index_rows(self.read("memories"))), self.index_state()
        if whole or set(diff) - {"same"}:
            self.table("index").update(lambda old: A.rebuilt_index(rows, old).select(old.columns))
        return diff

    def compact(self, least: int = 16) -> dict[str, int]:
        """Folds logs of `least` batches or more into one batch each; gives how many each had.

        The overlay keeps the last row of each memory, vectors one row of each text; other logs
        keep all their rows.
        """
        last = lambda df: df.groupBy("id").agg(*[F.max_by(c, "at").alias(c) for c in df.columns if c != "id"]).select(df.columns)
        folds = {"overlay": last, "vectors": lambda df: df.dropDuplicates(["id", "hash"])}
        return {name: n for name in SCHEMAS if name not in TABLES and (n := self.log(name).compact(folds.get(name), least))}

    def maintain(self, mode: str = "light", now: datetime = X.NOW) -> dict[str, int]:
        """light: graph; deep: consolidation and induction first; rem: decay before those.  A failure is noted, then raised."""
        done: dict[str, int] = {}
        try:
            if mode == "rem":
                done["decayed"] = self.decay(now)
            if mode in ("deep", "rem"):
                done |= self.consolidate(now)
                done |= self.induce(now)
            done["edges"] = self.link(now=now)
            self.sync_index()
            self.compact()
        except Exception as e:
            self.note("failed", now, f"{mode}: {type(e).__name__}")
            raise
        self.note("maintain", now, mode)
        return done

    # ------------------------------------------------------------------ streaming

    def has_seen(self, stream: str, number: int) -> bool:
        """Whether a stream's step was taken to its end."""
        last = self.log("state").last(stream)
        return last is not None and last >= number

    def note_batch(self, stream: str, number: int, added: int, now: datetime = X.NOW) -> None:
        self.note("batch", now, f"{stream} {number}", added, (stream, number))

    def learned_since_maintenance(self) -> int:
        """Statements that streams added since the last maintenance, by the order in which states were noted."""
        state = self.read("state")
        last = state.where("name = 'maintain'").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        return state.where((F.col("name") == "batch") & (F.col("seq") > last)).agg(F.coalesce(F.sum("added"), F.lit(0))).first()[0]

    # ------------------------------------------------------------- administration

    def status(self) -> DataFrame:
        return A.store_stats(self.read("memories"))

    def counts(self) -> DataFrame:
        """(name, n): rows of each table, and the store's bytes."""
        size = self.rows("name string, n long", ("bytes", A.folder_bytes(self.spark, self.path)))
        return A.table_counts({name: self.read(name) for name in SCHEMAS}).unionByName(size)

    def review(self) -> DataFrame:
        return A.review(self.read("memories").withColumn("origin", F.lit("")))

    def prune(self, chosen: DataFrame, dry_run: bool = True, now: datetime = X.NOW) -> DataFrame:
        """What pruning the chosen ids does; unless dry_run, retires and tags them."""
        actions = stored(A.prune_actions(self.read("memories"), chosen), "actions")
        if not dry_run:
            self.table("memories").update(lambda mem: A.retired(mem, A.prune_actions(mem, chosen).where("action = 'retired'"), F.lit(now).cast("timestamp")))
        return actions

    def act(self, ids: DataFrame, action: str) -> int:
        """Retires, activates or deletes memories (id) of any layer and status; gives how many there were."""
        hit = ids.select("id").distinct()

        def change(mem: DataFrame) -> tuple[DataFrame, tuple[int]]:
            return B.acted(mem, hit, action).select(mem.columns), (mem.join(hit, "id", "left_semi").count(),)

        return self.changed(change)[0]

    def doctor(self, repair: bool = False) -> DataFrame:
        """(name, status, message): checks of every table.

        repair: adds missing columns, drops what hangs in the air, rebuilds the index, removes
        claims and stages that lost writers left.
        """
        lost = [name for name in SCHEMAS if not (self.table(name).versions() if name in TABLES else self.log(name).exists())]
        if lost:
            return self.rows("name string, status string, message string", ("tables", "error", str(lost)))
        if repair:
            self.migrate(dry_run=False)
            ids = self.read("memories").select("id")
            for name, ends in (("edges", ("src", "dst")), ("bridge", ("memory_id",)), ("sources", ("memory_id", "source_id"))):
                log = self.log(name)
                read = log.batches()
                rows = keep = log.read(read)
                for end in ends:
                    keep = keep.join(ids.withColumnRenamed("id", end), end, "left_semi")
                log.replace(keep.select(rows.columns), read)
            self.sync_index(whole=True)
            for name in SCHEMAS:
                (self.table(name) if name in TABLES else self.log(name)).sweep()
        mem, edges, bridge = self.read("memories"), self.read("edges"), self.read("bridge")
        ids = mem.select("id")
        loose = A.dangling(edges, mem).count() + bridge.join(ids.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti").count()
        # one reading of the memories: rules are counted while their ids are grouped
        seen = Observation("health")
        twice = A.duplicate_ids(mem.observe(seen, *A.health_counts()), "id").count()
        bad = {k: v for k, v in seen.get.items() if v and k not in ("rows", "early")}
        early = seen.get["early"]
        old = self.lacking_columns(dry_run=True)
        stale = {k: v for k, v in self.index_state().items() if k != "same"}
        size = A.folder_bytes(self.spark, self.path)
        left = [name for name in SCHEMAS if (self.table(name) if name in TABLES else self.log(name)).leftovers()]
        check = lambda name, wrong, level: (name, level if wrong else "ok", str(wrong or ""))
        return self.rows(
            "name string, status string, message string",
            ("tables", "ok", str(len(SCHEMAS))), check("schema", old, "warning"), check("unique_ids", twice, "error"), check("graph", loose, "warning"), check("temporal", early, "warning"), check("ranges", bad, "error"),
            check("index", stale, "warning"), ("embedding", "ok" if self.embed else "warning", "" if self.embed else "no model: no semantic list"), check("size", size if size > self.config.most_bytes else 0, "warning"), check("writers", left, "warning"),
        )

    def index_state(self) -> dict[str, int]:
        rows, old = self.shaped("index", A.index_rows(self.read("memories"))), self.read("index")
        mark = lambda df: df.select("id", F.xxhash64(*[c for c in rows.columns if c not in ("id", "activation", "updated_at")]).cast("string").alias("hash"))
        return {r["action"]: r["n"] for r in A.index_diff(mark(old), mark(rows)).collect()}


def add_columns(engine: Engine, dry_run: bool) -> dict[str, list[str]]:
    return engine.lacking_columns(dry_run)


def fill_touch_and_hash(engine: Engine, dry_run: bool) -> dict[str, list[str]]:
    """Rows from before these were kept: touched when learned, hashed by their statement."""
    return engine.filled({"last_accessed": F.col("learned_at"), "hash": X.content_hash("statement")}, dry_run)


def fill_defaults(engine: Engine, dry_run: bool) -> dict[str, list[str]]:
    """Counters and marks that are null in rows written by hand."""
    return engine.filled({c: F.lit(v) for c, v in DEFAULTS.items()}, dry_run)


#: Steps that bring a store to SCHEMA_VERSION, in order; each may be repeated.
MIGRATIONS: tuple[Callable[[Engine, bool], dict[str, list[str]]], ...] = (add_columns, fill_touch_and_hash, fill_defaults)

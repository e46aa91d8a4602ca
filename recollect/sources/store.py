"""Tables on disk: YAML documents in, versioned Parquet in and out, packs.

A table is a folder of versions.  A commit writes its rows beside them and then moves them to
version N + 1; it fails if another writer has that already.  So readers never see a half-written
table, a write that fails leaves nothing in the way, and no lock is held while data is written.
Paths go through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect.sources.logs import Step, mark_of


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; gone when the application ends.

    Where none is named, a local run takes a temporary folder; on a cluster, whose executors
    couldn't reach that, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="recollect-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/recollect/{spark.sparkContext.applicationId}")
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return f"{base.rstrip('/')}/recollect/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ----------------------------------------------------------------------- YAML


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import yaml

    for batch in batches:
        rows = []
        for name, text in zip(batch["file"].to_pylist(), batch["value"].to_pylist(), strict=True):
            try:
                loaded = yaml.safe_load(text or "")
            except yaml.YAMLError:
                rows.append((name, 0, None))  # a broken file has no rows, but is not forgotten
                continue
            for i, item in enumerate(loaded if isinstance(loaded, list) else [loaded] if loaded else []):
                rows.append((name, i, json.dumps(item, ensure_ascii=False, default=str)))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "pos", "json"])


def read_yaml(spark: SparkSession, path: str, schema: StructType | str, valid: str = "id is not null") -> tuple[DataFrame, DataFrame]:
    """Rows of YAML lists (or single documents) under path that meet `valid`, and those that don't.

    Good rows carry file and pos, so chunks keep their order and their repeats; rejects keep
    their JSON, null for a file that doesn't parse.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    raw = text.mapInArrow(_parse, "file string, pos long, json string")
    rows = raw.withColumn("r", F.from_json("json", schema)).select("file", "pos", "json", "r.*").withColumn("_ok", F.coalesce(F.expr(valid), F.lit(False)))
    return rows.where("_ok").drop("_ok", "json"), rows.where("not _ok").select("file", "pos", "json")


def in_order(rows: DataFrame, hot: str) -> DataFrame:
    """rows of read_yaml with ord: chunk files by name, then the hot file, each in its own order; repeats stay."""
    tail = (F.col("file") == hot).cast("int")
    return rows.withColumn("ord", F.struct(tail.alias("hot"), F.col("file"), F.col("pos")))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bridge, edges) of graph documents: a map of entities with their memories, and a list of edges.

    A broken document gives neither.
    """
    entity = "struct<type:string,memory_ids:array<string>>"
    doc, _ = read_yaml(spark, path, f"entities map<string,{entity}>, edges array<struct<`from`:string,`to`:string,type:string,weight:double>>", "entities is not null or edges is not null")
    named = doc.select(F.explode(F.map_entries("entities")).alias("e")).select(F.explode("e.value.memory_ids").alias("memory_id"), F.col("e.key").alias("entity"), F.col("e.value.type").alias("type"))
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.type", "e.weight", "ord")
    return named.distinct(), edges


# --------------------------------------------------------------------- chunks


def write_chunks(rows: DataFrame, path: str) -> dict[str, list[str]]:
    """Writes rows (with a column chunk, null for the hot ones) in folders by chunk, and only those chunks that changed, in one job.

    Chunks that rows no longer have are deleted.  Gives the names of those written and deleted.
    A chunk's mark is its number of rows and a sum over them; marks of the last write lie beside
    the chunks, in a table that readers of the chunks don't see.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "chunk"]
    named = rows.withColumn("chunk", F.coalesce(F.lpad(F.col("chunk").cast("string"), 6, "0"), F.lit("hot")))
    marks = stored(named.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("sum")), "marks")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_marks")
    before = stored(spark.read.schema(marks.schema).parquet(f"{path}/_marks") if fs.exists(place) else marks.limit(0), "marks")
    same = marks.join(before, ["chunk", "n", "sum"], "left_semi")
    changed = stored(marks.join(same.select("chunk"), "chunk", "left_anti").select("chunk"), "changed")
    new = sorted(r[0] for r in changed.collect())
    if new:
        few = F.broadcast(changed) if len(new) <= 10_000 else changed
        # a chunk that is written again takes the place of its folder, others stay
        named.join(few, "chunk", "left_semi").select(*names, "chunk").repartition("chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
    gone = sorted(r[0] for r in before.join(marks, "chunk", "left_anti").select("chunk").collect())
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunk={name}"), True)
    if new or gone:
        marks.write.mode("overwrite").parquet(f"{path}/_marks")
    return {"written": new, "deleted": gone}


# ------------------------------------------------------------------- versions

#: After so many milliseconds a claim without its version was left by a lost writer.
STALE_MS = 600_000


class Taken(RuntimeError):
    """Another writer has committed since the rows were read."""


class Table:
    """A versioned table of rows with a key."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1]))

    def version(self) -> int:
        """The last version, or 0."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v={found[-1] if version is None else version}")

    def read_by(self, rows: DataFrame) -> int | None:
        """The oldest version of this table that rows are computed from, if any."""
        own = f"{self._fs(self.path)[1].toUri().getPath()}/v="
        seen = [re.search(re.escape(own) + r"(\d+)/", unquote(f)) for f in rows.inputFiles()]
        return min((int(m[1]) for m in seen if m), default=None)

    def marks(self, version: int) -> dict[str, tuple[int, ...]]:
        """By stream, the number of the last step that a version holds, and what was noted of it."""
        fs, p = self._fs(f"{self.path}/v={version}")
        names = [s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else [])]
        return {n.split("-")[1]: tuple(map(int, n.split("-")[2:])) for n in names if n.startswith("_step-")}

    def done(self, version: int, step: Step) -> tuple[int, ...] | None:
        """What was noted of a step (of a stream, numbers rising) if a version holds it or a later one."""
        stream, number = mark_of(step)
        has = self.marks(version).get(stream)
        return has[1:] if has and has[0] >= number else None

    def commit(self, rows: DataFrame, base: int | None = None, step: Step | None = None, note: tuple[int, ...] = ()) -> int:
        """Writes rows as the version after base; fails (Taken) if that exists.

        base: the version that rows were made from; by default the one that they read of this
        table, or the last one if they read none.  A claim, which one writer alone can create,
        covers the move only; one that a lost writer left is void after STALE_MS.  A step and
        what is noted of it become known with the version itself.
        """
        if base is None:
            base = self.read_by(rows)
        found = self.versions()
        new = (base if base is not None else found[-1] if found else 0) + 1
        fs, stage = self._fs(f"{self.path}/_stage-{uuid.uuid4().hex}")
        claim, place = (self._fs(f"{self.path}/{n}")[1] for n in (f"_claim-{new}", f"v={new}"))
        taken = Taken(f"version {new} of {self.path} is taken; merge with the latest and commit again")
        if new in found or found and new < found[-1]:
            raise taken
        marks = self.marks(new - 1)
        if step is not None:
            stream, number = mark_of(step)
            marks[stream] = (number, *note)
        try:
            rows.write.mode("errorifexists").parquet(stage.toString())
            for stream, values in marks.items():
                fs.createNewFile(self._fs(f"{stage.toString()}/_step-{stream}-{'-'.join(map(str, values))}")[1])
            if fs.exists(claim) and not fs.exists(place) and time.time() * 1000 - fs.getFileStatus(claim).getModificationTime() > STALE_MS:
                fs.delete(claim, False)
            if fs.exists(place) or not fs.createNewFile(claim):
                raise taken
            try:
                if fs.exists(place) or not fs.rename(stage, place):
                    raise taken
            finally:
                fs.delete(claim, False)
        finally:
            fs.delete(stage, True)
        return new

    def upsert(self, rows: DataFrame) -> int:
        """Replaces rows of the same key, adds others."""
        return self.update(lambda base: base.join(rows.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def remove(self, keys: DataFrame) -> int:
        return self.update(lambda base: base.join(keys.select(self.key), self.key, "left_anti"))

    def leftovers(self) -> list[str]:
        """Stages and claims that no writer can still hold."""
        fs, p = self._fs(self.path)
        old = time.time() * 1000 - STALE_MS
        return [s.getPath().toString() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName().startswith(("_stage-", "_claim-")) and s.getModificationTime() < old]

    def sweep(self) -> list[str]:
        """Deletes the leftovers of lost writers."""
        out = self.leftovers()
        for path in out:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return out

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 3) -> int:
        """Commits what change makes of the latest rows; if another writer was faster, of the rows it left."""
        for left in range(tries - 1, -1, -1):
            base = self.version()
            try:
                return self.commit(change(self.read(base)), base)
            except Taken:
                if not left:
                    raise
        raise AssertionError

    def rollback(self, version: int) -> int:
        """Makes an earlier version the latest again."""
        return self.commit(self.read(version), self.version())

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes all but the last versions."""
        old = self.versions()[:-keep]
        for v in old:
            fs, p = self._fs(f"{self.path}/v={v}")
            fs.delete(p, True)
        return old


# ---------------------------------------------------------------------- packs


def export_pack(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON line a row, with its table's name, and a line a table that counts its rows: a pack that any store can take in."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row"))
        stats = df.agg(F.count("*").alias("rows")).select(F.lit(f"stats:{name}").alias("table"), F.to_json(F.struct("rows")).alias("row"))
        out = rows.union(stats) if out is None else out.union(rows).union(stats)
    out.write.json(path)


def import_pack(spark: SparkSession, path: str, name: str, known: DataFrame, key: str | dict[str, str] = "id") -> tuple[DataFrame, DataFrame]:
    """(new rows of table `name`, counts): rows whose key is known stay out.

    key: a column, or one by layer with "" for all others, as raw memories go by their content
    hash and the rest by id.  Of equal keys in the pack the first by id stays.  counts: seen,
    imported, skipped and errors, which are lines that are no JSON.
    """
    rows = stored(spark.read.schema("table string, row string, broken string").option("columnNameOfCorruptRecord", "broken").json(path), "pack")
    new = rows.where(F.col("table") == name).select(F.from_json("row", known.schema).alias("r")).select("r.*")
    keys = {"": key} if isinstance(key, str) else key
    parts = []
    for layer, column in keys.items():
        mine = F.lit(True) if layer == "" and len(keys) == 1 else F.col("layer").eqNullSafe(layer) if layer else ~F.coalesce(F.col("layer").isin(*[k for k in keys if k]), F.lit(False))
        part = new.where(mine).join(known.select(column), column, "left_anti")
        first = F.row_number().over(Window.partitionBy(column).orderBy(*(["id"] if "id" in known.columns else [column])))
        parts.append(part.withColumn("_n", first).where("_n = 1").select(known.columns))
    fresh = parts[0]
    for p in parts[1:]:
        fresh = fresh.unionByName(p)
    bad = rows.agg(F.count_if(F.col("broken").isNotNull()).alias("errors"))
    counts = new.agg(F.count("*").alias("seen")).join(fresh.agg(F.count("*").alias("imported"))).join(bad)
    return fresh, counts.select("seen", "imported", (F.col("seen") - F.col("imported")).alias("skipped"), "errors")


# ------------------------------------------------------------------ synthetic


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """n memories over ten topics whose attributes follow from their number: a store for benchmarks."""
    topics = ("query planning", "index layout", "cache policy", "schema change", "test data", "release notes", "log review", "access rules", "cost report", "backup plan")
    i = F.col("i")
    topic = F.element_at(F.array(*map(F.lit, topics)), (i % 10 + 1).cast("int"))
    return spark.range(n).withColumnRenamed("id", "i").select(
        i.alias("id"),
        F.when(i % 20 == 0, "mental_model").when(i % 20 <= 3, "observation").otherwise("raw").alias("layer"),
        F.concat(F.lit("Note "), i.cast("string"), F.lit(" on "), topic, F.lit(" for project "), (i % 7).cast("string")).alias("text"),
        F.concat(F.lit("project:"), (i % 7).cast("string")).alias("scope"),
        topic.alias("domain"),
        (0.2 + i % 80 / 100.0).alias("strength"),
        (1 + i % 10).alias("confidence"),
    )


def synthetic_edges(spark: SparkSession, n: int) -> DataFrame:
    """(src, dst, type, weight) of a synthetic store: every 50th memory leads back to the one before it."""
    i = F.col("id")
    return spark.range(n).where((i % 50 == 0) & (i > 0)).select(i.alias("src"), (i - 1).alias("dst"), F.lit("semantic").alias("type"), F.lit(0.7).alias("weight"))

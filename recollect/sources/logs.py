"""Logs: rows that are only ever added.

A log is a folder of batches.  An append writes one batch and reads nothing, so its cost does not
depend on what is there.  A batch may have a name: one that the log holds already, or held before
it was compacted, is not written again, so whoever repeats a step after a failure repeats it by
name.  Compaction puts one batch in the place of those that it read; later ones stay as they are.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: After so many milliseconds what is left of a lost or replaced batch may go.
STALE_MS = 600_000
_FORMER, _STAGE, _BATCH = "_former", "_stage-", "batch="

#: A step of a stream: the stream's name and the step's number, which rises.
Step = tuple[str, int]


def mark_of(step: Step) -> tuple[str, int]:
    """The step's stream as a short name for files, and its number."""
    return hashlib.sha256(step[0].encode()).hexdigest()[:16], step[1]


class Log:
    """A log of rows of a schema (DDL)."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs(self.path)
        return fs.exists(p)

    def create(self) -> None:
        fs, p = self._fs(self.path)
        fs.mkdirs(p)

    def _former(self, batch: str) -> list[str]:
        """The batches that a compacted one stands for."""
        fs, p = self._fs(f"{self.path}/{batch}/{_FORMER}")
        if not batch.startswith(_BATCH + "c-") or not fs.exists(p):
            return []
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()

    def _all(self) -> tuple[list[str], set[str]]:
        """Folders of batches, and the names of those that others stand for."""
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        found = [n for n in names if n.startswith(_BATCH)]
        return found, {f for n in found for f in self._former(n)}

    def batches(self) -> list[str]:
        """Names of the batches that make up the log."""
        found, former = self._all()
        return sorted(n for n in found if n not in former)

    def last(self, stream: str) -> int | None:
        """The number of a stream's last step in the log."""
        found, former = self._all()
        head = f"{_BATCH}s-{mark_of((stream, 0))[0]}-"
        return max((int(n[len(head) :]) for n in {*found, *former} if n.startswith(head)), default=None)

    def read(self, batches: list[str] | None = None) -> DataFrame:
        names = self.batches() if batches is None else batches
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names))

    def _write(self, rows: DataFrame, name: str, former: list[str] = ()) -> None:
        """Writes beside the log, then moves: a batch is there whole or not at all."""
        fs, stage = self._fs(f"{self.path}/{_STAGE}{uuid.uuid4().hex}")
        try:
            rows.write.option("compression", "zstd").parquet(stage.toString())
            if former:
                out = fs.create(self._fs(f"{stage.toString()}/{_FORMER}")[1])
                out.write(bytearray("\n".join(former).encode()))
                out.close()
            if not fs.rename(stage, self._fs(f"{self.path}/{name}")[1]):
                raise RuntimeError(f"batch {name} of {self.path} was not moved into place")
        finally:
            fs.delete(stage, True)

    def append(self, rows: DataFrame, step: Step | None = None) -> bool:
        """Adds rows as a batch, of a stream's step if given; False if the log has had that step."""
        if step is None:
            self._write(rows, f"{_BATCH}{uuid.uuid4().hex}")
            return True
        last = self.last(step[0])
        if last is not None and last >= step[1]:
            return False
        stream, number = mark_of(step)
        self._write(rows, f"{_BATCH}s-{stream}-{number}")
        return True

    def compact(self, fold: Callable[[DataFrame], DataFrame] | None = None, least: int = 2) -> int:
        """One batch in the place of all there are (of `least` or more), folded if asked; gives how many it replaced.

        What others append meanwhile stays.  Replaced batches are left for those who read them,
        until a sweep.
        """
        names = self.batches()
        if len(names) < least:
            return 0
        rows = self.read(names)
        self._write(rows if fold is None else fold(rows), f"{_BATCH}c-{uuid.uuid4().hex}", self._names(names))
        return len(names)

    def _names(self, batches: list[str]) -> list[str]:
        """The batches, what they stand for if it is still there, and the last step of each stream among all these."""
        found, former = self._all()
        keep = {*batches, *(f for b in batches for f in self._former(b) if f in found)}
        steps: dict[str, int] = {}
        for n in {*batches, *former}:
            if n.startswith(_BATCH + "s-"):
                head, _, number = n.rpartition("-")
                steps[head] = max(steps.get(head, 0), int(number))
        return sorted(keep | {f"{head}-{number}" for head, number in steps.items()})

    def replace(self, rows: DataFrame, read: list[str]) -> None:
        """Puts rows in the place of the batches that they were made from."""
        self._write(rows, f"{_BATCH}c-{uuid.uuid4().hex}", self._names(read) or ["batch=none"])

    def leftovers(self) -> list[str]:
        """Replaced batches and stages of lost writers that nobody can be reading or writing."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        old, (_, former) = time.time() * 1000 - STALE_MS, self._all()
        return [s.getPath().toString() for s in fs.listStatus(p) if (s.getPath().getName() in former or s.getPath().getName().startswith(_STAGE)) and s.getModificationTime() < old]

    def sweep(self) -> list[str]:
        out = self.leftovers()
        for path in out:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return out

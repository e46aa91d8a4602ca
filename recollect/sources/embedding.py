"""Vectors of texts: a model's answers by batch, and a cache that is asked first."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[DataFrame], DataFrame]


#: By name of a model, when a worker that it failed in asks it again.
_asleep: dict[str, float] = {}


def _within(seconds: float, work: Callable, *args):
    """What work gives, or TimeoutError after so many seconds (0: without a limit); work that hangs is left behind."""
    if not seconds:
        return work(*args)
    got: list = []

    def run() -> None:
        try:
            got.append((work(*args), None))
        except BaseException as e:  # noqa: BLE001  handed to the caller
            got.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise TimeoutError
    if got[0][1] is not None:
        raise got[0][1]
    return got[0][0]


def embedder(load: Callable[[], Callable[[list[str]], list[list[float] | None]]], seconds: float = 0, cool_down: float = 60, dimension: int = 0, name: str = "model") -> Embed:
    """From load(), which makes a model once a task, the function from (key, text) to (key, embedding).

    A text that the model gives no vector for, or one that is not of the dimension (0: any) or
    not finite, has no row.  Loading and each call have `seconds`; a model that fails or takes
    longer leaves its batch without vectors, and the worker asks it again after `cool_down`
    seconds, so that a broken model costs a worker one wait and not one a batch.
    """

    def sound(v: list[float] | None) -> bool:
        return v is not None and (not dimension or len(v) == dimension) and all(x is not None and math.isfinite(x) for x in v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            got: list[tuple] = []
            if time.monotonic() >= _asleep.get(name, 0):
                try:
                    model = model or _within(seconds, load)
                    found = _within(seconds, model, batch["text"].to_pylist())
                    got = [(k, v) for k, v in zip(batch["key"].to_pylist(), found, strict=True) if sound(v)]
                except Exception:  # noqa: BLE001  a model that fails leaves texts without vectors, for the next pass
                    model, _asleep[name] = None, time.monotonic() + cool_down
            yield pa.record_batch([pa.array([k for k, _ in got], batch["key"].type), pa.array([v for _, v in got], pa.list_(pa.float32()))], names=["key", "embedding"])

    def embed(texts: DataFrame) -> DataFrame:
        return texts.select("key", "text").mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, embedding array<float>")

    return embed


def embedded(texts: DataFrame, cache: DataFrame, embed: Embed, dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors of texts, those that were computed): cached ones (key, embedding) first, the rest by embed.

    A cached vector of another dimension counts as missing, as after a change of model.
    """
    fit = cache if dimension is None else cache.where(F.size("embedding") == dimension)
    kept = fit.select("key", "embedding").join(texts.select("key"), "key", "left_semi")
    new = embed(texts.where("text is not null").join(fit.select("key"), "key", "left_anti")).select("key", "embedding")
    return kept.unionByName(new), new

"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text gives longest
matches.  A text is parsed greedily into phrases, each the longest that occurs in the sample;
the language that needs the fewest phrases, normalised by the text's letters and the sample's
length, wins.  Texts are parsed in lock step, all segments of a batch and all languages at
once, over one dense transition table.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import appended, crc_of_id, text_bytes
from recollect.llm.sampling import bounded_sample

CLASSES, BREAK, SHARED = 128, 1, 16  # most classes; the break; those that rare letters share
SEGMENT = 192


def automaton(codes: list[int], classes: int) -> np.ndarray:
    """Transitions of the suffix automaton of codes: states x classes, -1 where there is none."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(step), classes), -1, dtype=np.int32)
    for s, d in enumerate(step):
        table[s, list(d)] = list(d.values())
    return table


class LanguageModel:
    """Automata of all languages in one table.

    An entry holds the next row's offset, doubled, plus 1 if a phrase ends there.  Whatever is
    no letter is one word break, however long; a phrase that begins with a break is free.  Only
    the samples travel: each worker builds the table when it first needs it, and keeps it.
    """

    def __init__(self, samples: dict[str, str]):
        self.samples, self.langs, self.built = samples, sorted(samples), False

    def __reduce__(self):
        return _kept, (tuple(sorted(self.samples.items())),)

    def ready(self) -> LanguageModel:
        if not self.built:
            self.built = True
            self._build()
        return self

    def _build(self) -> None:
        folded = {k: self.samples[k].lower() for k in self.langs}
        seen = Counter(c for t in folded.values() for c in t if c.isalpha())
        self.own = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))][: CLASSES - SHARED - 2]
        lut = self.lut()
        classes = 2 + SHARED + len(self.own)
        self.bits, parts, roots, base = [], [], [], 0
        for k in self.langs:
            codes = lut[np.frombuffer(folded[k].encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int64)
            codes = codes[np.concatenate(([True], ~((codes[1:] == BREAK) & (codes[:-1] == BREAK))))] if len(codes) else codes
            t = automaton(codes.tolist(), classes)
            root = t[0].copy()
            miss = t < 0
            to = np.where(miss, np.where(root < 0, 0, root), t)
            miss[0] = True  # a phrase starts at the root
            miss[:, BREAK] = False
            if root[BREAK] >= 0:
                to[root[BREAK], BREAK] = root[BREAK]
            kind = np.int32 if 2 * (base + t.size) < 1 << 31 else np.int64
            parts.append(((to.astype(kind) * kind(classes) + kind(base)) * kind(2) + miss).ravel())
            roots.append(base)
            base += t.size
            self.bits.append(np.log2(max(2, len(codes))))
        kind = np.int32 if 2 * base < 1 << 31 else np.int64
        self.table = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.roots = np.array(roots, dtype=kind)

    def lut(self) -> np.ndarray:
        """Class of each code point: own letters, shared classes of other letters, or a break."""
        self.ready()
        lut = np.full(0x110000, BREAK, dtype=np.uint8)
        points = np.arange(0x80, 0x40000)  # no letters beyond
        letters = [p for p in points.tolist() if chr(p).isalpha()]
        lut[letters] = [2 + p % SHARED for p in letters]
        for i, c in enumerate(self.own):
            code = 2 + SHARED + i
            for p in {c, c.upper(), unicodedata.normalize("NFC", c)}:
                if len(p) == 1:
                    lut[ord(p)] = code
        for p in range(65, 91):
            lut[p] = lut[p + 32] = lut[p + 32] if lut[p + 32] != BREAK else 2 + p % SHARED
        return lut

    def phrases(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each language in each segment of codes."""
        order = np.argsort(-size, kind="stable")
        st, left = start[order], size[order]
        state = np.repeat(self.roots[:, None], len(st), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        for j in range(int(left[0]) if len(left) else 0):
            k = int(np.searchsorted(-left, -j, "left"))
            v = self.table.take(state[:, :k] + codes[st[:k] + j])
            count[:, :k] += v & 1
            state[:, :k] = v >> 1
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def rates(self, column, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter under each language (languages x rows), and letters of each row."""
        buf, off = text_bytes(column)
        head = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        first = head[off]
        codes = lut[np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")].astype(np.int32)
        letters = np.diff(np.concatenate(([0], np.cumsum(codes != BREAK)))[first])
        pieces = -(-np.diff(first) // SEGMENT)
        row = np.repeat(np.arange(len(pieces)), pieces)
        start = first[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        count = self.phrases(codes, start, np.minimum(first[row + 1] - start, SEGMENT))
        total = np.zeros((len(self.langs), len(pieces)))
        for i in range(len(self.langs)):
            total[i] = np.bincount(row, weights=count[i], minlength=len(pieces))
        return total * np.array(self.bits)[:, None] / np.maximum(letters, 1), letters

    def judge(self, column, lut: np.ndarray) -> tuple[list[str], np.ndarray]:
        rate, letters = self.rates(column, lut)
        if not self.langs:
            return ["und"] * len(letters), np.zeros(len(letters))
        best = rate.argmin(0)
        low = np.sort(rate, axis=0)
        score = low[1] / np.maximum(low[0] + low[1], 1e-9) if len(self.langs) > 1 else np.ones(len(letters))
        known = letters > 0
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


@lru_cache(maxsize=1)
def _kept(samples: tuple[tuple[str, str], ...]) -> LanguageModel:
    """The model of samples, one a worker."""
    return LanguageModel(dict(samples))


def train(docs: DataFrame, rows: int = 8) -> LanguageModel:
    """A model of the labelled rows of docs (doc_id, text, lang) outside the held-out quarter.

    Bounded sample: at most `rows` distinct texts a language, in hash order, whole; lines that
    they share count once.  An automaton grows with the text that it holds, hence few rows.
    Null texts, languages and ids teach nothing; without any the model knows no language.
    """
    known = docs.where("lang is not null and text is not null").where(F.pmod(crc_of_id(), F.lit(4)) != 2)
    known = known.select(F.col("lang").cast("string").alias("lang"), "text").where("text rlike '\\\\p{L}'")
    samples: dict[str, str] = {}
    lines: dict[str, list[str]] = {}
    for r in bounded_sample(known, "lang", "text", rows).collect():
        lines.setdefault(r["lang"], []).extend(r["text"].split("\n"))
    for lang, own in sorted(lines.items()):
        samples[lang] = "\n".join(sorted(set(own)))
    return LanguageModel(samples)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (0 to 1; 0.5 is a tie of the two best) of each row.

    Null, empty or letterless text, or a model without languages: `und`, 0.  Ties go to the
    first language by name.  Rows, null keys and repeated ones stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        m = shared.value
        lut = m.lut()

        def of(column):
            lang, score = m.judge(column, lut)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return of

    return appended(docs, text, f"{names[0]} string, {names[1]} double", judge)

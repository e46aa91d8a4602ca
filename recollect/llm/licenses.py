"""License scan: Aho-Corasick finds phrases and identifier tags, a shunting-yard parser reads expressions.

Texts are compared as words: A-Z lower-cased, a word is a run of digits, ASCII letters and
characters beyond ASCII.  One automaton pass over the words, joined by single spaces, finds all
notice phrases and the tag of identifier lines; the expression behind a tag is then parsed and
evaluated from the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases of well-known licenses, and identifiers that name a family.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "cc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "isc license": "isc",
    "eclipse public license": "epl",
    "unlicense": "unlicense",
}
TAG = "spdx license identifier"
#: Families by the start of an identifier, and how much each restricts use.
FAMILIES = {"agpl": "agpl", "apache": "apache", "bsd": "bsd", "cc-by": "cc-by", "cc0": "cc0", "epl": "epl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense"}
RESTRICTS = {"public-domain": 0.05, "cc0": 0.05, "unlicense": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.15, "cc-by": 0.3, "cc": 0.3, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "gpl": 0.7, "agpl": 0.8, "reserved": 1.0}

WORD = np.zeros(256, dtype=np.uint8) + 32
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    WORD[_a:_b] = np.arange(_a, _b)
WORD[65:91] = np.arange(97, 123)
TO_WORDS = WORD.tobytes()
IN_LINE = re.compile(r"spdx-license-identifier\s*:\s*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str] | None:
    """Reverse Polish form of a license expression by shunting-yard; None if malformed.

    with binds closest, then and, then or; all are left-associative and case-insensitive.
    A comment's end or other text behind a complete expression is left out.
    """
    out: list[str] = []
    ops: list[str] = []
    operand = True  # whether one is due
    for token in TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if not operand:
                break
            ops.append(token)
        elif token == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        elif low in RANK:
            if operand:
                return None
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        else:
            if not operand:
                break
            out.append(low)
            operand = False
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def family(identifier: str) -> str:
    for start in sorted(FAMILIES, key=len, reverse=True):
        if identifier == start or identifier.startswith((f"{start}-", f"{start} ")):
            return FAMILIES[start]
    return "other"


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels and restriction: or offers the milder side, and holds both, with eases its license by half."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in RANK:
            label = family(token)
            stack.append(({label}, RESTRICTS.get(label, 0.5)))
            continue
        (a, x), (b, y) = stack[-2:]
        del stack[-2:]
        stack.append((a, x / 2) if token == "with" else (a | b, min(x, y) if token == "or" else max(x, y)))
    return stack[0]


def _automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(f" {p} ", p)
    found.make_automaton()
    return found


def scan(text: str, phrases: dict[str, str], automaton: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    """n_words, n_base, first_word, last_word, base labels, all labels, restriction score."""
    words = text.encode("utf-8", "replace").translate(TO_WORDS).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    starts, base, labels, tagged, held = [], set(), set(), False, []
    for end, phrase in automaton.iter(joined):
        if phrase == TAG:
            tagged = True
            continue
        label = phrases[phrase]
        labels.add(label)
        if phrase in BASE:
            base.add(label)
            starts.append(end - len(phrase))
    if tagged:
        for m in IN_LINE.finditer(text):
            postfix = parse(m[1])
            if postfix:
                own, x = evaluate(postfix)
                labels |= own
                held.append(x)
    held += [RESTRICTS.get(x, 0.5) for x in labels] if not held else [RESTRICTS[x] for x in base]
    at = [joined.count(" ", 0, s) - 1 for s in (min(starts), max(starts))] if starts else [None, None]
    return len(words), len(starts), at[0], at[1], sorted(base), sorted(labels), max(held, default=0.0)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id and RESULT for each row of docs (doc_id, text).

    Null and empty text: no words, no places, empty labels, score 0.  Overlapping places all
    count.  Rows, null ids and repeated ones stay as they are.
    """
    phrases = {**(NOTICES if notices is None else notices), **BASE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton({**phrases, TAG: ""})
        for batch in batches:
            rows = [scan(t or "", phrases, automaton) for t in batch["text"].to_pylist()]
            n, k, a, b, base, labels, score = zip(*rows, strict=True) if rows else ([],) * 7
            ints = [pa.array(x, pa.int64()) for x in (n, k, a, b)]
            texts = [pa.array([",".join(v) for v in x], pa.string()) for x in (base, labels)]
            yield pa.record_batch([batch["doc_id"], *ints, *texts, pa.array(score, pa.float64())], names=["doc_id", *(c.split()[0] for c in RESULT.split(", "))])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, {RESULT}")

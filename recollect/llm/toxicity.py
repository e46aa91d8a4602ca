"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Windows.  A sentence is read through windows of letters: each of its words, each run of three
or more words of one letter (a word spelt apart), and two neighbouring words that together are
short (a word split in two; the break is a sign, too).  Only letters and signs that stand for letters count; all other
signs inside a window are skipped, so that dots or stars between letters change nothing.  A
window's begin and end count as signs.

Kernel.  That of two windows sums, over all runs of four signs that both hold in order, with at
most SPAN signs from first to last, the product of LAM**span, over the windows' norms: letters
put into a word lower a match but don't end it.

Learning.  Sentences of labelled rows are bags of windows: no window of a clean sentence is
toxic, and a toxic row has at least one that is.  Landmark windows of both kinds give Nystroem
features; a squared-hinge machine learns on them in rounds (a several-instance machine): the
first takes each window by how much oftener toxic rows hold it, the later ones each toxic row's
best windows, with insults that had letters put in beside them, against the clean windows that
came closest.  The machine is linear in the kernel values, so its weights sum into one table
over runs of four signs, and scoring a window needs no landmark.

Rows.  A row's score grows with the margins of its best window and of all windows beyond zero,
and never falls with either.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common as C
from recollect.llm.sampling import bounded_sample

LETTERS, JOIN, EDGE, OTHER, SKIP = 32, 0, 27, 28, 255  # classes of signs: a to z are 1 to 26
SPAN, LAM, WINDOW, STRIDE = 7, 0.7, 24, 12
JOINED = 12  # letters, at most, of two neighbouring words that are also read as one window
LOSS = 20.0  # weight of the losses beside the machine's norm
TOP = 4.0  # margins count up to here
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")
#: Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _byte_classes() -> np.ndarray:
    """Class of each byte of UTF-8; other letters than a to z take one of four by their last byte."""
    out = np.full(256, SKIP, dtype=np.uint8)
    for i in range(26):
        out[97 + i] = out[65 + i] = i + 1
    for a, b in LOOKALIKES.items():
        out[ord(a)] = ord(b) - 96
    out[0x80:0xC0] = OTHER + (np.arange(0x80, 0xC0) & 3)
    return out


BYTE = _byte_classes()
ALIKE = np.zeros(256, dtype=bool)
ALIKE[[ord(a) for a in LOOKALIKES]] = True


@dataclass
class Units:
    """Distinct windows of a batch as codes cc[start : start + size], with hashes; each place's window and row."""

    cc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    token: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def units(column) -> Units:
    """The windows of each row of a string column."""
    buf, off = C.text_bytes(column)
    none = np.zeros(0, np.int64)
    parts, done = [(np.zeros(0, np.uint8), none, none, none, np.zeros(0, C.U))], 0
    for i, j in C._slices(off):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e = C.spans(b, o)
        if not len(s):
            continue
        row = np.searchsorted(o, s, "right") - 1
        cls = BYTE[b]
        # a sign stands for a letter only before the last true letter of its word
        true = np.flatnonzero((cls != SKIP) & ~ALIKE[b])
        last = np.concatenate(([-1], true))[np.searchsorted(true, e)]
        alike = np.flatnonzero(ALIKE[b])
        cls[alike[alike > last[np.searchsorted(s, alike, "right") - 1]]] = SKIP
        letter = cls != SKIP
        cls[e[e < o[row + 1]]] = JOIN
        keep = cls != SKIP
        rank, pure = (np.concatenate(([0], np.cumsum(v))) for v in (keep, letter))
        lines = np.searchsorted(np.flatnonzero(b == 10), s)
        ends = np.concatenate(([0], np.cumsum(np.isin(b[e - 1], (33, 46, 63)))))[:-1] + lines
        ok = pure[e] > pure[s]
        s, e, row, ends = s[ok], e[ok], row[ok], ends[ok]
        x, y, n = rank[s], rank[e], pure[e] - pure[s]
        one, near = n == 1, row[1:] == row[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~(one[1:] & one[:-1] & near)))[: len(s)])
        final = np.append(first[1:], len(s)) - 1
        spelt = final - first >= 2
        first, final = first[spelt], final[spelt]
        sizes = n[1:] + n[:-1]
        two = np.flatnonzero(near & (ends[1:] == ends[:-1]) & (sizes <= JOINED) & (sizes >= 4))
        cc = np.concatenate((cls[keep], cls[letter]))
        a = np.concatenate((x, x[two], pure[s[first]] + rank[-1]))
        z = np.concatenate((y, y[two + 1], pure[e[final]] + rank[-1]))
        parts.append((cc, a + done, z - a, np.concatenate((row, row[two], row[first])) + i, C.span_hashes(cc, a, z)))
        done += len(cc)
    cc, start, size, rows, h = (np.concatenate(v) for v in zip(*parts, strict=True))
    own, at, token = np.unique(h, return_index=True, return_inverse=True)
    return Units(cc, start[at], size[at], token, rows, own)


def units_of_many(texts: list[str], block: int = 4096) -> Units:
    """units() of many texts at a fraction of its memory: blocks keep their distinct windows only."""
    cc, size, token, row, hashes, done = [np.zeros(0, np.uint8)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, C.U)], 0
    for lo in range(0, len(texts), block):
        u = units(pa.array(texts[lo : lo + block], pa.string()))
        start = np.cumsum(u.size) - u.size
        cc.append(u.cc[np.repeat(u.start - start, u.size) + np.arange(int(u.size.sum()))])
        size.append(u.size.astype(np.int32))
        hashes.append(u.hash)
        token.append((u.token + done).astype(np.int32))
        row.append((u.row + lo).astype(np.int32))
        done += len(u.size)
    C.tidy()
    own, at, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    del hashes
    back = back.astype(np.int32)
    for i in range(len(token)):  # block by block, so that no second copy of all places is made
        token[i] = back[token[i]]
    token, row = np.concatenate(token), np.concatenate(row)
    cc, size = np.concatenate(cc), np.concatenate(size)
    start = (np.cumsum(size, dtype=np.int64) - size)[at]
    size = size[at]
    first = np.cumsum(size, dtype=np.int64) - size
    out = np.empty(int(size.sum()), np.uint8)
    for lo in range(0, len(size), 1 << 15):
        some = slice(lo, lo + (1 << 15))
        move = np.repeat(start[some] - first[some], size[some])
        to = int(first[lo])
        out[to : to + len(move)] = cc[move + np.arange(to, to + len(move))]
    return Units(out, first, size, token, row, own)


def _weights(n: int):
    for i in range(n - 3):
        for j in range(i + 1, min(n - 2, i + SPAN - 2)):
            for k in range(j + 1, min(n - 1, i + SPAN - 1)):
                for m in range(k + 1, min(n, i + SPAN)):
                    yield i, j, k, m, LAM ** (m - i + 1)


NORM = np.array([1.0] * 4 + [np.sqrt(sum(w * w for *_, w in _weights(n))) for n in range(4, WINDOW + 3)])


def kernel(cc: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sum over the gapped runs of each window of its weight times the table's row, over the window's norm.

    rows: the table's row of each run, if the table holds some only.  Windows of under three
    letters give 0; of longer ones than WINDOW the best overlapping part counts.
    """
    out = np.zeros((len(start), *table.shape[1:]), dtype=np.float32)
    for n in np.unique(size[size >= 3]).tolist():
        at = np.flatnonzero(size == n)
        if n <= WINDOW:
            out[at] = _same_length(cc, start[at], n, table, rows)
        else:
            best = np.full((len(at), *table.shape[1:]), -np.inf, dtype=np.float32)
            for shift in [*range(0, n - WINDOW, STRIDE), n - WINDOW]:
                np.maximum(best, _same_length(cc, start[at] + shift, WINDOW, table, rows), out=best)
            out[at] = best
    return out


def _same_length(cc: np.ndarray, start: np.ndarray, n: int, table: np.ndarray, rows: np.ndarray | None, block: int = 1 << 13) -> np.ndarray:
    out = np.zeros((len(start), *table.shape[1:]), dtype=np.float32)
    for lo in range(0, len(start), block):
        at = start[lo : lo + block]
        m = np.full((n + 2, len(at)), EDGE, dtype=np.int32)
        m[1:-1] = cc[at + np.arange(n)[:, None]]
        a, b, c = m << 15, m << 10, m << 5
        o = out[lo : lo + block]
        for i, j, k, l, w in _weights(n + 2):
            key = a[i] + b[j]
            key += c[k]
            key += m[l]
            o += np.float32(w) * (table.take(key) if rows is None else table[rows[key]])
    return out / np.float32(NORM[n + 2])


def features(cc: np.ndarray, start: int, size: int) -> dict[int, float]:
    """The weights of a window's runs, over its norm."""
    out: dict[int, float] = {}
    c = [EDGE, *cc[start : start + min(size, WINDOW)].tolist(), EDGE]
    for i, j, k, m, w in _weights(len(c)):
        key = (c[i] << 15) + (c[j] << 10) + (c[k] << 5) + c[m]
        out[key] = out.get(key, 0.0) + w / NORM[len(c)]
    return out


def _as_arrays(f: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of features, at a tenth of a dict's memory."""
    return np.fromiter(f, np.int32, len(f)), np.fromiter(f.values(), np.float64, len(f))


@dataclass
class ToxicityModel:
    table: np.ndarray  # weight of each run of four signs
    bias: float
    doc: np.ndarray  # of the row's best margin, of its windows beyond zero, 1

    def margins(self, u: Units) -> np.ndarray:
        """Margins of the windows, at most TOP; windows of one or two letters are beyond doubt."""
        m = np.minimum(kernel(u.cc, u.start, u.size, self.table) + np.float32(self.bias), np.float32(TOP))
        return np.where(u.size < 3, np.float32(-1), m)

    def scores(self, column) -> np.ndarray:
        u = units(column)
        return 1 / (1 + np.exp(-_row_features(self.margins(u)[u.token], u.row, len(column)) @ self.doc))


def _row_features(margin: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    best = np.full(rows, -1.0)
    np.maximum.at(best, row, margin)
    more = np.bincount(row, weights=np.maximum(margin, 0), minlength=rows)
    return np.stack([best, np.log1p(more), np.ones(rows)], 1)


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps on the rows within the margin; z's last column is 1."""
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        a = y * (z @ w.astype(np.float32)) < 1
        square, to = np.zeros_like(ridge), np.zeros_like(w)
        for lo in range(0, len(z), 4096):  # by blocks, so that no copies of all rows are made
            some = lo + np.flatnonzero(a[lo : lo + 4096])
            za = z[some]
            zw = (za * weight[some, None]).T
            square += zw @ za
            to += zw @ y[some]
        new = np.linalg.solve(ridge + 2 * c * square, 2 * c * to)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, none but the last (the constant's) below 0."""
    on = np.ones(x.shape[1], dtype=bool)
    while True:
        w, z = np.zeros(int(on.sum())), x[:, on]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.05 * np.eye(len(w))
            w += np.clip(np.linalg.solve(h, z.T @ (y - p) - 0.05 * w), -2, 2)
        out = np.zeros(x.shape[1])
        out[on] = w
        if (out[:-1] >= 0).all():
            return out
        on[:-1] &= out[:-1] > 0


def _altered(u: Units, window: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts and sizes of the windows with one and two letters, and with a break, put in."""
    codes, sizes = [], []
    for w in window:
        c = u.cc[u.start[w] : u.start[w] + u.size[w]]
        for signs in (rng.integers(1, 27, 1), rng.integers(1, 27, 2), [JOIN]):
            codes.append(np.insert(c, np.sort(rng.integers(1, max(2, len(c)), len(signs))), signs).astype(np.uint8))
            sizes.append(len(codes[-1]))
    size = np.array(sizes, dtype=np.int64)
    return (np.concatenate(codes) if codes else np.zeros(0, np.uint8)), np.cumsum(size) - size, size


def fit(texts: list[str], toxic: np.ndarray, prior: float, landmarks: int = 256, rounds: int = 4, seed: int = 1) -> ToxicityModel:
    """A model of labelled texts; prior: share of toxic rows where it will be used."""
    toxic = np.asarray(toxic, dtype=bool)
    odds = np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    flat = ToxicityModel(np.zeros(LETTERS**4, np.float32), -1.0, np.array([0.0, 0.0, odds]))
    if not toxic.any() or toxic.all():
        return flat
    rng = np.random.default_rng(seed)
    sentences, of = [], []
    for i, t in enumerate(texts):
        some = [p for p in SENTENCE.split(t) if p and not p.isspace()]
        sentences += some
        of += [i] * len(some)
    of = np.array(of, dtype=np.int64)
    u = units_of_many(sentences)
    n, lines = len(u.start), len(sentences)
    del sentences
    C.tidy()
    tune = np.zeros(len(texts), dtype=bool)  # rows that calibrate, and of which no window is learnt
    for kind in (np.flatnonzero(toxic), np.flatnonzero(~toxic)):
        tune[rng.permutation(kind)[: int(0.3 * len(kind))]] = True
    row = of[u.row].astype(np.int32)
    pairs = row * np.int64(n)
    pairs += u.token
    pairs = np.unique(pairs[~tune[row]])
    word = pairs % n
    bad = toxic[pairs // n]
    df_t, df_c = np.bincount(word[bad], minlength=n), np.bincount(word[~bad], minlength=n)
    n_t, n_c = max(1, (toxic & ~tune).sum()), max(1, (~toxic & ~tune).sum())
    del pairs, word, bad
    C.tidy()
    total, share = df_t + df_c, n_t / (n_t + n_c)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(df_t > 0, df_t * np.log(df_t / (total * share)), 0) + np.where(df_c > 0, df_c * np.log(df_c / (total * (1 - share))), 0))
    more = df_t * n_c > 4 * df_c * n_t  # windows that may be toxic; all others in clean sentences are not
    long = u.size >= 3
    seeds = np.flatnonzero(long & more)
    seeds = seeds[np.argsort(-g2[seeds], kind="stable")][: max(50, 2 * int(n_t))]
    weight = g2[seeds]
    clean = np.flatnonzero(long & (df_c > 0) & ~more)
    if not len(seeds) or not len(clean):
        return flat
    root = np.sqrt(df_c[clean])
    negative = rng.choice(clean, min(len(clean), 8000), replace=False, p=root / root.sum())
    hard = np.zeros(0, np.int64)
    model = flat
    for step in range(rounds):
        # landmarks: windows of toxic and of clean sentences
        heavy = seeds[np.argsort(-weight, kind="stable")]
        others = np.concatenate([hard[: landmarks // 4], rng.choice(negative, min(len(negative), landmarks // 4), replace=False)])
        marks = np.unique(np.concatenate([heavy[: landmarks - len(others)], others]))
        own = [_as_arrays(features(u.cc, int(u.start[m]), int(u.size[m]))) for m in marks]
        keys = np.unique(np.concatenate([k for k, _ in own])).astype(np.int64)
        rows = np.zeros(LETTERS**4, dtype=np.int32)
        rows[keys] = np.arange(1, len(keys) + 1)
        phi = np.zeros((len(keys) + 1, len(marks)), dtype=np.float32)
        for i, f in enumerate(own):
            phi[rows[f[0]], i] = f[1]
        del own
        val, vec = np.linalg.eigh((phi.T @ phi).astype(np.float64))
        ok = val > 1e-6 * val.max()
        base = vec[:, ok] / np.sqrt(val[ok])
        cc, at, size = _altered(u, heavy[: 400 if step else 0], rng)
        codes = np.concatenate([u.cc, cc])
        train = np.concatenate([seeds, negative, hard])
        start, length = np.concatenate([u.start[train], at + len(u.cc)]), np.concatenate([u.size[train], size])
        z = kernel(codes, start, length, phi, rows)
        z = z @ base.astype(np.float32)
        # the constant's column, and below a window like no landmark, which is clean
        z, low = np.ones((len(z) + 1, z.shape[1] + 1), np.float32), z
        z[:-1, :-1], z[-1, :-1] = low, 0
        del low
        y = np.concatenate([np.where(np.arange(len(train)) < len(seeds), 1.0, -1.0), np.ones(len(size))])
        each = np.concatenate([weight, 1 + np.log1p(df_c[train[len(seeds) :]]), np.repeat(np.sort(weight)[::-1][: len(size) // 3], 3) / 3])
        each *= np.where(y > 0, 1 / each[y > 0].sum(), 3 / each[y < 0].sum()) * len(y)
        y, each = np.append(y, -1.0), np.append(each, len(y) / 4)
        w = _svm(z, y, each, LOSS)
        table = flat.table.copy()
        table[keys] = (phi @ (base @ w[:-1]))[1:]
        model = ToxicityModel(table, float(w[-1]), flat.doc)
        del phi, z, codes  # the next round's take their place
        C.tidy()
        m = model.margins(u)
        # the windows of clean sentences that came closest are the next round's hard ones
        new = np.flatnonzero(long & (m > -0.7) & (df_c > 0) & ~more)
        hard = np.union1d(hard, new[np.argsort(-m[new], kind="stable")][:4000])
        hard = hard[np.argsort(-m[hard], kind="stable")]
        # toxic rows' best windows, and those beyond zero, are its witnesses
        top = np.full(len(texts), -np.inf)
        cand = ~tune[row] & toxic[row] & more[u.token] & long[u.token]
        np.maximum.at(top, row[cand], m[u.token[cand]])
        took = cand & (m[u.token] > -0.5) & ((m[u.token] >= top[row]) | (m[u.token] > 0))
        if not took.any():
            break
        seen = np.unique(row[took] * np.int64(n) + u.token[took]) % n
        seeds, weight = np.unique(seen, return_counts=True)
        weight = np.sqrt(weight)
    margin = model.margins(u)[u.token]
    # rows, their best sentences and their best windows alone calibrate, so that one insult is enough
    calm = tune if toxic[tune].any() and not toxic[tune].all() else np.ones(len(texts), dtype=bool)
    rows_x = _row_features(margin, row, len(texts))
    line = _row_features(margin, u.row, lines)
    order = np.lexsort((-line[:, 0] - line[:, 1], of))
    lead = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))]
    alone = rows_x[:, 0]
    x = np.concatenate([rows_x[calm], line[lead[calm[of[lead]]]], np.stack([alone, np.log1p(np.maximum(alone, 0)), np.ones(len(alone))], 1)[calm]])
    t = np.concatenate([toxic[calm], toxic[of[lead[calm[of[lead]]]]], toxic[calm]])
    doc = _logistic(x, t.astype(float))
    rate = min(max(t.mean(), 1e-3), 1 - 1e-3)
    doc[2] += odds - np.log(rate / (1 - rate))
    return ToxicityModel(model.table, model.bias, doc)


def _fitted(prior: float):
    """One row with the model of all rows (text, toxic) that a task gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for b in batches for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True)]
        rows.sort()
        C.tidy()
        model = C.apart(fit, [t for t, _ in rows], np.array([y for _, y in rows], dtype=int), prior)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = 1800) -> ToxicityModel:
    """Learns from labelled rows outside the held-out quarter.

    Bounded sample: at most `rows` ids a class, in hash order, of which whole texts are read;
    scoring reads all rows.  Null labels, ids and texts teach nothing; of labels of one id the
    highest counts.  Without rows of both classes every score is the share of toxic rows.  One
    task fits the machine, so that the driver holds no more than the finished model.
    """
    seen = labels.where("toxic is not null and doc_id is not null").where(F.pmod(C.crc_of_id(), F.lit(4)) != 2)
    seen = seen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    some = bounded_sample(seen, "toxic", "doc_id", rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    one = texts.join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    got = one.select("text", "toxic").repartition(1).mapInArrow(_fitted(prior), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], np.zeros(0, dtype=int), prior)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with toxicity (0 to 1) of each row, by its whole text.  Null and empty text: that of no words.

    Rows, null keys and repeated ones stay as they are; equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return C.appended(docs, text, f"{name} double", lambda: lambda column: [pa.array(shared.value.scores(column), pa.float64())], 256)

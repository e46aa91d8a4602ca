"""Language-model scoring with a hierarchical Pitman-Yor model.

A word's restaurant is its context: the word before it, or the row's begin.  All of these share one
parent, the restaurant without context, whose base is uniform over the words that training saw
and one for all others.

    word after the word before it  ->  word  ->  uniform

Tables are sampled by Gibbs in blocks.  A sweep draws the parent's probabilities from its
seating, then the number of tables of every entry (a word in a context), and then the parent's
tables from the customers that these send.  Table numbers come from their conditional over all of
an entry's customers, by generalized Stirling numbers, so a sweep reaches an entry of a million
customers as it does one of two; sizes of tables don't enter predictive probabilities and are
summed out.  All customers of a word sit in one bucket of the exchange, so buckets sample side by
side and meet in the restaurants' totals: each bucket sends what it has of a restaurant to the
bucket of its context, which answers the sums.  A first run sets the tables of each restaurant,
and those of the parent, for the second.  Predictive probabilities are averaged over samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common as C

U = np.uint64
END = U(0xE0F0E0F0E0F0E0F1)  # key of the token that ends a text
BEGIN = U(0)  # context of a row's first word
WHOLE = ~U(0xFFFF)  # the bits of a word's key that name it as a context
TOP, CLASSES, RECENT = 256, 12, 8
CONTEXTS = CLASSES + 1  # the last one: no frequent word yet


# ------------------------------------------------------------------ contexts


@dataclass
class Classes:
    """Keys of the frequent words, sorted, and the class of each."""

    keys: np.ndarray
    of: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each word among the frequent ones, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def contexts(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Context of each token: the class that leads among the last RECENT frequent words of its row."""
        found = self.find(h)
        top = np.flatnonzero(found >= 0)
        before = np.searchsorted(top, np.arange(len(h)))  # frequent words ahead of a token
        start = np.searchsorted(top, first)[C.row_of(first)]  # and of its row
        if not len(top):
            return np.full(len(h), CLASSES)
        low = np.maximum(np.arange(1, len(top) + 1) - RECENT, np.searchsorted(top, first)[:-1][C.row_of(first)[top]])
        own, best, lead = self.of[found[top]], np.zeros(len(top), dtype=np.int32), np.zeros(len(top), dtype=np.int8)
        for k in range(CLASSES):
            total = np.concatenate(([0], np.cumsum(own == k, dtype=np.int32)))
            votes = total[1:] - total[low]
            lead = np.where(votes > best, k, lead)
            best = np.maximum(best, votes)
        return np.where(before > start, lead[np.maximum(before - 1, 0)], CLASSES).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of a batch and how often it is there."""
    for batch in batches:
        h, _ = C.word_hashes(batch["text"], C.LOWER)
        keys, n = np.unique(h, return_counts=True)
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def _followers(keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys) ** 2, dtype=np.int64)
        for batch in batches:
            h, first = C.word_hashes(batch["text"], C.LOWER)
            found = Classes(keys, np.zeros(len(keys))).find(h)
            top = np.flatnonzero(found >= 0)
            row, w = C.row_of(first)[top], found[top]
            same = row[1:] == row[:-1]
            total += np.bincount(w[:-1][same] * len(keys) + w[1:][same], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    return run


def cluster(follow: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """Classes of words by who follows whom: spectral coordinates, then k means from the farthest points."""
    m = follow + follow.T + 1e-3
    root = np.sqrt(m.sum(1))
    val, vec = np.linalg.eigh(m / root[:, None] / root[None])
    x = vec[:, -min(k, len(m)) :]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    weight = m.sum(1)
    centres = [x[weight.argmax()]]
    while len(centres) < min(k, len(m)):
        far = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[(far * np.sqrt(weight)).argmax()])
    c = np.array(centres)
    for _ in range(30):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([np.average(x[own == i], axis=0, weights=weight[own == i]) if (own == i).any() else c[i] for i in range(len(c))])
    return own


def classes(train: DataFrame) -> Classes:
    """Frequent words of the training rows and their classes; at most TOP words reach the driver."""
    top = train.mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(TOP).collect()
    keys = np.sort(np.array([r["key"] for r in top], dtype=np.int64).view(U))
    if not len(keys):
        return Classes(keys, np.zeros(0, np.int64))
    follow = np.zeros(len(keys) ** 2)
    for r in train.mapInArrow(_followers(keys), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        follow[r["pair"]] = r["n"]
    return Classes(keys, cluster(follow.reshape(len(keys), -1)))


# --------------------------------------------------------------- restaurants


class Seating:
    """Customers and tables of entries (a dish in a restaurant), table by table.

    Moves one customer of an entry at a time: what the draws of `Tables` are tested against.
    """

    def __init__(self, customers: np.ndarray, discount: float, strength: float, rng: np.random.Generator):
        self.c, self.d, self.theta, self.rng = customers.astype(np.int64), discount, strength, rng
        # start: about a table each time the customers double, evenly filled
        t = np.where(self.c > 0, 1 + np.log2(np.maximum(self.c, 1)).astype(np.int64) // 2, 0)
        self.own = np.repeat(np.arange(len(self.c)), t)
        rank = np.arange(len(self.own)) - np.repeat(np.cumsum(t) - t, t)
        self.size = self.c[self.own] // t[self.own] + (rank < self.c[self.own] % t[self.own])

    @property
    def t(self) -> np.ndarray:
        return np.bincount(self.own, minlength=len(self.c))

    def leave(self, at: np.ndarray) -> None:
        """One random customer of each of the entries `at` (distinct) gets up."""
        total = np.concatenate(([0], np.cumsum(self.size)))
        pick = total[np.searchsorted(self.own, at)] + (self.rng.random(len(at)) * self.c[at]).astype(np.int64)
        self.size[np.searchsorted(total, pick, "right") - 1] -= 1
        self.c[at] -= 1
        keep = self.size > 0
        self.own, self.size = self.own[keep], self.size[keep]

    def enter(self, at: np.ndarray, base: np.ndarray, tables: np.ndarray) -> None:
        """A customer takes a seat at each of the entries `at` (distinct).

        base: the dish's probability in the parent; tables: of the whole restaurant, by entry.
        """
        t = self.t[at]
        new = (self.theta + self.d * tables) * base
        old = np.maximum(self.c[at] - self.d * t, 0)
        opens = (self.rng.random(len(at)) * (new + old) < new) | (t == 0)
        sit = at[~opens]
        if len(sit):
            total = np.concatenate(([0], np.cumsum(self.size - self.d)))
            first, last = np.searchsorted(self.own, sit), np.searchsorted(self.own, sit, "right")
            pick = total[first] + self.rng.random(len(sit)) * (total[last] - total[first])
            self.size[np.clip(np.searchsorted(total, pick, "right") - 1, first, last - 1)] += 1
        self.c[at] += 1
        where = np.searchsorted(self.own, at[opens])
        self.own, self.size = np.insert(self.own, where, at[opens]), np.insert(self.size, where, 1)


#: Up to so many customers, table numbers are drawn from the whole list of their probabilities.
SMALL = 64
NODES = 32
#: Rows of a block of work, so that its matrices stay small.
BLOCK = 4096


def _falling(f, low: float, n: int, steps: int = 26) -> np.ndarray:
    """For n falling functions of u, f(u) = 0 between low and 0, by bisection."""
    a, b = np.full(n, low), np.zeros(n)
    for _ in range(steps):
        m = (a + b) / 2
        up = f(m) > 0
        a, b = np.where(up, m, a), np.where(up, b, m)
    return (a + b) / 2


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithm of the generalized Stirling numbers S_d(c, t) over c!, for 1 <= t <= c.

    S_d(c, t) d**t t! / c! is the coefficient of x**c in (1 - (1 - x)**d)**t.  The integral for it
    runs along a parabola in log x around the cut from 1 on, through the saddle point.
    """
    c, t = c.astype(float), t.astype(float)
    if len(c) > BLOCK:
        return np.concatenate([log_stirling(c[i : i + BLOCK], t[i : i + BLOCK], d) for i in range(0, len(c), BLOCK)])
    if not len(c):
        return np.zeros(0)

    def slope(u):  # of the saddle point, by u = log(1 - x)
        return d * -np.expm1(u) * np.exp((d - 1) * u) / -np.expm1(d * u) - c / t

    u = _falling(slope, -700.0 * min(1.0, 1 / (1 - d)) / 2, len(c), 20)
    with np.errstate(divide="ignore"):
        s = -np.log(-np.expm1(u))
    near = s * c < 0.2
    s = np.clip(s, 4 / c, 40.0)
    x = np.exp(-s)
    curve = 2 * s * s * c * (1 + x * (1 - d) / -np.expm1(-s) - c / t)
    end = np.minimum(np.pi / (2 * s), 7 / np.sqrt(np.maximum(curve, np.where(near, 8.0, 1.0))))
    v = (np.arange(NODES) + 0.5) / NODES * end[:, None]
    z = -s[:, None] * (1 + 1j * v) ** 2
    e = t[:, None] * np.log(1 - (-np.expm1(z)) ** d) - c[:, None] * z
    top = e.real.max(1)
    whole = ((1 + 1j * v) * np.exp(e - top[:, None])).real.sum(1) * end / NODES
    k = t + 1
    log_t = (k - 0.5) * np.log(k) - k + 0.5 * math.log(2 * math.pi) + 1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5)
    return np.log(np.maximum(2 * s / np.pi * whole, 1e-300)) + top - log_t - t * math.log(d)


@lru_cache(maxsize=8)
def small_stirling(d: float) -> np.ndarray:
    """Logarithms of S_d(c, t) for c and t up to SMALL."""
    out = np.full((SMALL + 1, SMALL + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(SMALL + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(SMALL):
            stay = np.where(c - t * d > 0, out[c] + np.log(np.maximum(c - t * d, 1e-300)), -np.inf)
            out[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], out[c, :-1])))
    return out


def middle(c: np.ndarray, d: float, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of p(t) ~ S_d(c, t) weight**t for large c, nearly.

    The number of tables is a Poisson number and c the sum of their sizes; besides, the table that
    holds most of a sum of few tables always exists.
    """
    u = _falling(lambda u: np.log(weight) + np.log(-np.expm1(u)) + (d - 1) * u - np.log(c), -700.0, len(c))
    mean = weight / d * -np.expm1(d * u)
    return np.minimum(1 + mean, c), np.sqrt(np.maximum(mean - c / (1 - (1 - d) * np.expm1(u) * np.exp(-u)), 0.3))


def _list_up(c: np.ndarray, d: float, weight: np.ndarray, most: int) -> np.ndarray:
    """Running sums of S_d(c, t) weight**t over t from 1 to most, up to a factor by entry."""
    p = small_stirling(d)[c, 1 : most + 1] + np.log(weight)[:, None] * np.arange(1, most + 1)
    return np.cumsum(np.exp(p - p.max(1, keepdims=True, initial=-np.inf)), axis=1)


def _blocks(chosen: np.ndarray) -> list[np.ndarray]:
    at = np.flatnonzero(chosen)
    return [at[i : i + BLOCK] for i in range(0, len(at), BLOCK)]


#: Bounds of customers between which lists are of one length.
BANDS = ((2, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, SMALL))


def expected(c: np.ndarray, d: float, weight: np.ndarray) -> np.ndarray:
    """Mean of p(t) ~ S_d(c, t) weight**t; nearly, above SMALL customers."""
    out = np.minimum(c, 1).astype(float)
    for low, high in BANDS:
        for at in _blocks((c >= low) & (c <= high)):
            p = _list_up(c[at], d, weight[at], high)
            out[at] = high - (p[:, :-1] / p[:, -1:]).sum(1)
    at = np.flatnonzero(c > SMALL)
    out[at] = middle(c[at].astype(float), d, weight[at])[0]
    return out


class Tables:
    """Numbers of tables of entries with `c` customers, drawn from p(t) ~ S_d(c, t) weight**t.

    weight: of a new table, (strength + discount * tables of the restaurant) * base.  A draw is
    independent of the last one up to SMALL customers; above, it is a Metropolis step as wide as
    the distribution, which starts in its middle.
    """

    def __init__(self, c: np.ndarray, discount: float, weight: np.ndarray, rng: np.random.Generator):
        self.d, self.rng = discount, rng
        self.c, self.t = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        self.log = np.zeros(len(c))
        self.arrive(c, weight)

    def arrive(self, c: np.ndarray, weight: np.ndarray) -> None:
        """The entries have c customers from now on."""
        new = np.flatnonzero((c != self.c) & (c > SMALL))
        self.c = c.astype(np.int64)
        self.t = np.minimum(np.maximum(self.t, self.c > 0), self.c)
        if len(new):
            fresh = new[self.log[new] == 0]
            self.t[fresh] = np.clip(np.rint(middle(self.c[fresh].astype(float), self.d, weight[fresh])[0]), 1, self.c[fresh])
            self.log[new] = log_stirling(self.c[new], self.t[new], self.d)

    def draw(self, weight: np.ndarray) -> None:
        self.t = np.where(self.c < 2, self.c, self.t)
        for low, high in BANDS:
            for at in _blocks((self.c >= low) & (self.c <= high)):
                p = _list_up(self.c[at], self.d, weight[at], high)
                self.t[at] = 1 + (self.rng.random(len(at))[:, None] * p[:, -1:] > p).sum(1)
        at = np.flatnonzero(self.c > SMALL)
        wide = middle(self.c[at].astype(float), self.d, weight[at])[1]
        step = np.rint(self.rng.normal(0, 2.0 * wide)).astype(np.int64)
        to = self.t[at] + step
        fine = (to >= 1) & (to <= self.c[at]) & (step != 0)
        at, to, step = at[fine], to[fine], step[fine]
        log = log_stirling(self.c[at], to, self.d)
        yes = np.log(self.rng.random(len(at))) < log - self.log[at] + step * np.log(weight[at])
        self.t[at[yes]], self.log[at[yes]] = to[yes], log[yes]


@dataclass
class Totals:
    """What all buckets know of the restaurants: customers and tables by context, and the parent's."""

    customers: np.ndarray
    tables: np.ndarray
    root_tables: float
    types: int
    tokens: int
    discount: float
    root_discount: float
    strength: float = 1.0
    root_customers: float = 0.0

    def root(self, c: np.ndarray, t: np.ndarray, sent: float, share: float) -> np.ndarray:
        """Probability of words without context, from their customers and tables there.

        sent: customers there of the bucket's words, which are `share` of all.
        """
        whole = self.strength + max(sent / share if share > 0 else self.root_customers or self.tables.sum(), 1)
        return (c - self.root_discount * t) / whole + (self.strength + self.root_discount * self.root_tables) / whole / (self.types + 1)

    def word(self, context: np.ndarray, c: np.ndarray, t: np.ndarray, root: np.ndarray) -> np.ndarray:
        whole = self.strength + self.customers[context]
        return (c - self.discount * t) / whole + (self.strength + self.discount * self.tables[context]) / whole * root


def sample(word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, totals: Totals, burn_in: int, samples: int, gap: int, seed: int, share: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Gibbs sampling of a bucket's entries (word, context, customers).

    Gives each entry's averaged predictive probability, the tables of each context, of the
    parent, and each word's averaged probability in the parent.  share: the part of the parent's
    customers that the bucket's words hold, so that its probabilities stay of one whole.
    """
    return _sampled(word, context, count, n_words, totals, burn_in, samples, gap, seed, share)[:4]


def _sampled(word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, totals: Totals, burn_in: int, samples: int, gap: int, seed: int, share: float = 1.0):
    """What sample() gives, and each word's customers in the parent at the end."""
    rng = np.random.default_rng(seed)
    per_word = lambda t: np.bincount(word, weights=t, minlength=n_words).astype(np.int64)
    wide = totals.strength + totals.discount * totals.tables[context]
    flat = np.full(n_words, (totals.strength + totals.root_discount * totals.root_tables) / (totals.types + 1))
    # start: as if the tables of a context were dealt out like its customers
    start = np.bincount(word, weights=count * (totals.tables / np.maximum(totals.customers, 1))[context], minlength=n_words)
    # entries of one customer have one table, whatever is drawn
    many = np.flatnonzero(count > 1)
    word_m, wide_m, t = word[many], wide[many], np.minimum(count, 1).astype(np.int64)
    lone = per_word(np.where(count == 1, 1, 0))
    sent = lambda: lone + np.bincount(word_m, weights=own.t, minlength=n_words).astype(np.int64)
    own = Tables(count[many], totals.discount, wide_m * totals.root(start, np.zeros(n_words), start.sum(), share)[word_m], rng)
    root = Tables(sent(), totals.root_discount, flat, rng)
    mean, mean_root = np.zeros(len(word)), np.zeros(n_words)
    tables, root_tables = np.zeros(len(totals.customers)), 0.0
    for step in range(burn_in + samples * gap):
        # the parent's probabilities themselves, given which a word's contexts are independent
        seated = np.where(root.c > 0, rng.gamma(np.maximum(root.c - root.d * root.t, 1e-9)), 0)
        own.draw(wide_m * totals.root(seated, np.zeros(n_words), root.c.sum(), share)[word_m])
        root.arrive(sent(), flat)
        root.draw(flat)
        if step >= burn_in and (step - burn_in) % gap == gap - 1:
            p = totals.root(root.c, root.t, root.c.sum(), share)
            t[many] = own.t
            mean += totals.word(context, count, t, p[word]) / samples
            mean_root += p / samples
            tables += np.bincount(context, weights=t, minlength=len(tables)) / samples
            root_tables += root.t.sum() / samples
    return mean, tables, root_tables, mean_root, root.c


#: Factors of the weight of new tables at which table numbers are foretold.
FACTORS = 4.0 ** np.arange(-1, 6)


def foretell(word: np.ndarray, context: np.ndarray, count: np.ndarray, totals: Totals, root: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tables of each context, and of the parent, at each of FACTORS.

    root: each word's probability in the parent, sent: its customers there.
    """
    weight = (totals.strength + totals.discount * totals.tables[context]) * root[word]
    own = [np.bincount(context, weights=expected(count, totals.discount, f * weight), minlength=len(totals.customers)) for f in FACTORS]
    return np.array(own), foretell_root(totals, sent)


def foretell_root(totals: Totals, sent: np.ndarray) -> np.ndarray:
    """Expected tables of the parent at each of FACTORS; sent: each word's customers there."""
    flat = np.full(len(sent), (totals.strength + totals.root_discount * totals.root_tables) / (totals.types + 1))
    return np.array([expected(sent, totals.root_discount, f * flat).sum() for f in FACTORS])


def settled(used: float, drawn: float, foretold: np.ndarray, discount: float, strength: float) -> float:
    """The number of tables of a restaurant that reproduces itself.

    drawn: tables sampled with `used` ones in the weights; foretold: expected ones at FACTORS.
    """
    at = int(np.flatnonzero(FACTORS == 1)[0])
    if drawn <= 0 or foretold[at] <= 0:
        return drawn
    fine = np.linspace(np.log(FACTORS[0]), np.log(FACTORS[-1]), 4001)
    tables = np.exp(np.interp(fine, np.log(FACTORS), np.log(foretold))) * drawn / foretold[at]
    short = np.flatnonzero(strength + discount * tables <= np.exp(fine) * (strength + discount * used))
    return float(tables[short[0] if len(short) else -1])


# ------------------------------------------------------------------ exchange
#
# A chunk's entries are its distinct (word, context) pairs, in the order of the words' keys and
# then the contexts'.  A bucket keeps its distinct entries with their training counts, and for
# each chunk which of them it holds.  Blobs hold their values byte plane by byte plane, compressed
# here: the shuffle's own compression leaves most of what differences and numbers could lose.  So
# are texts, which are shuffled twice.


def turned(vals: bytes, width: int) -> bytes:
    """Values of `width` bytes as compressed planes."""
    return C.zipped(np.ascontiguousarray(np.frombuffer(vals, np.uint8).reshape(-1, width).T).tobytes())


def turned_back(planes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(C.unzipped(planes), np.uint8).reshape(width, -1).T)


def _zipped_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in C.pieces_of(batches):
        texts = pc.fill_null(part["text"].cast(pa.binary()), b"")
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array([C.zipped(t.as_buffer()) for t in texts], pa.binary()))


def _texts(table: pa.Table) -> pa.Array:
    return pa.array([C.unzipped(t.as_buffer()) for t in table["text"]], pa.large_binary())


def entries(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key and context of each entry, the entry of each token, and where each row's tokens start."""
    h, first = C.word_hashes(column, C.LOWER)
    h, first = np.insert(h, first[1:], END), first + np.arange(len(first))
    keys, token = np.unique(h, return_inverse=True)
    before = np.concatenate(([0], token + 1))[: len(h)]
    before[first[:-1]] = 0
    code, entry = np.unique(token * np.int64(len(keys) + 1) + before, return_inverse=True)
    names = np.concatenate(([BEGIN], keys & WHOLE))
    return keys[code // (len(keys) + 1)], names[code % (len(keys) + 1)], entry, first


def _send(bits: int):
    def run(table: pa.Table) -> pa.Table:
        C.tidy()
        keys, context, entry, first = entries(_texts(table))
        learn = table["learn"].to_numpy().astype(bool)
        count = np.bincount(entry, weights=learn[C.row_of(first)], minlength=len(keys)).astype("<u4")
        both = np.column_stack([count.view(np.uint8).reshape(-1, 4), context.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]])
        return C.table_of(_sends(table["chunk"][0].as_py(), keys, both, 10, bits), C.EXCHANGE_ARROW)

    return run


def _sends(chunk: int, keys: np.ndarray, vals: np.ndarray, width: int, bits: int) -> list[tuple]:
    return [(b, c, C.zipped(k), turned(v, width)) for b, c, k, v in C.sends(chunk, keys, vals, bits)]


def _gathered(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As C.gathered, of what _sends made; values are rows of bytes."""
    table = table.sort_by("chunk")
    keys = [C.unpack(C.unzipped(b.as_buffer())) for b in table["keys"]]
    vals = [turned_back(b.as_buffer(), width) for b in table["vals"]]
    return table["chunk"].to_numpy(), np.array([len(k) for k in keys]), np.concatenate(keys), np.concatenate(vals)


MERGED = "bucket int, kinds binary, contexts binary, context binary, count binary, chunks binary, lengths binary, entry binary, stats binary"
MERGED_ARROW = pa.schema([("bucket", pa.int32()), *((c.split()[0], pa.binary()) for c in MERGED.split(", ")[1:])])


def _steps(x: np.ndarray) -> bytes:
    return turned(np.diff(x, prepend=0).astype("<i4").tobytes(), 4)


def _stepped(blob: bytes) -> np.ndarray:
    return np.cumsum(turned_back(blob, 4).view("<i4").ravel(), dtype=np.int64)


def _merge(table: pa.Table) -> pa.Table:
    C.tidy()
    chunks, lengths, keys, both = _gathered(table, 10)
    n = np.ascontiguousarray(both[:, :4]).view("<u4").ravel()
    named = np.zeros((len(both), 8), np.uint8)
    named[:, 2:] = both[:, 4:]
    words, word = np.unique(keys, return_inverse=True)
    contexts, context = np.unique(named.view("<u8").ravel(), return_inverse=True)
    code, entry = np.unique(word * np.int64(len(contexts)) + context, return_inverse=True)
    count = np.bincount(entry, weights=n).astype("<i8")
    word, context = code // len(contexts), code % len(contexts)
    seen = count > 0
    per_word = np.bincount(word, weights=count, minlength=len(words))
    contexts_of = np.bincount(word[seen], minlength=len(words))
    stats = np.array([count.sum(), seen.sum(), (count == 1).sum(), (count == 2).sum(), (contexts_of == 1).sum(), (contexts_of == 2).sum(), (per_word > 0).sum()], "<f8")
    kinds = np.bincount(word, minlength=len(words)).astype("<i4")
    blobs = (turned(kinds.tobytes(), 4), C.zipped(C.pack(contexts)), _steps(context), turned(count.tobytes(), 8), chunks.astype("<i4"), lengths.astype("<i4"), _steps(entry), stats)
    return C.table_of([(table["bucket"][0].as_py(), *(b if isinstance(b, bytes) else b.tobytes() for b in blobs))], MERGED_ARROW)


SEATS = [("c", "<f8"), ("t", "<f8")]  # of a restaurant: customers, tables


def _opened(row: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many words a bucket has, and the word, restaurant and customers of its entries."""
    kinds = turned_back(row["kinds"], 4).view("<i4").ravel()
    return len(kinds), np.repeat(np.arange(len(kinds)), kinds), _stepped(row["context"]), turned_back(row["count"], 8).view("<i8").ravel()


def _restaurants(row: dict) -> np.ndarray:
    return C.unpack(C.unzipped(row["contexts"]))


def _seats(bucket: int, contexts: np.ndarray, context: np.ndarray, count: np.ndarray, tables: np.ndarray, bits: int) -> list[tuple]:
    """What a bucket has of each restaurant, to the buckets of their contexts."""
    both = np.rec.fromarrays([np.bincount(context, weights=count, minlength=len(contexts)), tables], dtype=SEATS)
    return _sends(bucket, contexts, both, 16, bits)


def _first_seats(bits: int):
    """Restaurants before any draw: a tenth more tables than words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                contexts, (_, _, context, count) = _restaurants(r), _opened(r)
                tables = 1.1 * np.bincount(context[count > 0], minlength=len(contexts))
                yield from C.table_of(_seats(r["bucket"], contexts, context, count, tables, bits), C.EXCHANGE_ARROW).to_batches()

    return run


def _together(table: pa.Table) -> pa.Table:
    """To each bucket, customers and tables of whole restaurants."""
    C.tidy()
    chunks, lengths, keys, raw = _gathered(table, 16)
    part = raw.view(SEATS).ravel()
    own, at = np.unique(keys, return_inverse=True)
    both = np.rec.fromarrays([np.bincount(at, weights=part[k], minlength=len(own))[at] for k in ("c", "t")], dtype=SEATS)
    return _turned_rows(C.answers(chunks, lengths, table["bucket"][0].as_py(), both), 16)


def _turned_rows(replies: pa.Table, width: int) -> pa.Table:
    vals = pa.array([turned(v, width) for v in replies["vals"].to_pylist()], pa.binary())
    return replies.set_column(replies.schema.get_field_index("vals"), "vals", vals)


def _told(replies: pa.Table, dtype: list) -> np.ndarray:
    """What all buckets answered, in the order of the keys that were sent to them."""
    width = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(turned_back(v, width).tobytes() for v in replies.sort_by("bucket")["vals"].to_pylist()), dtype)


ANSWER = [("n", "<u8"), ("p", "<f4")]
PARENT = -1  # bucket of the rows that tell of the parent


def _run(totals: Totals, shares: dict[int, float], burn_in: int, samples: int, gap: int, bits: int, reply: bool):
    """Samples a bucket; gives its tables in each restaurant and in the parent, drawn and foretold, or the chunks' answers."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        C.tidy()
        if not len(table):
            return (C.REPLY_ARROW if reply else C.EXCHANGE_ARROW).empty_table()
        r = table.to_pylist()[0]
        n_words, word, context, count = _opened(r)
        seats = _told(told, SEATS)
        own = replace(totals, customers=seats["c"], tables=seats["t"])
        mean, tables, root_tables, root, sent = _sampled(word, context, count, n_words, own, burn_in, samples, gap, r["bucket"], shares[r["bucket"]])
        if not reply:
            parent = np.concatenate([[root_tables], foretell_root(own, sent)])
            rows = [*_seats(r["bucket"], _restaurants(r), context, count, tables, bits), (PARENT, r["bucket"], parent.tobytes(), np.array([tables.sum()]).tobytes())]
            return C.table_of(rows, C.EXCHANGE_ARROW)
        total = np.bincount(word, weights=count, minlength=n_words)[word]
        out = np.rec.fromarrays([total.astype("<u8"), np.log10(np.maximum(mean, 1e-300)).astype("<f4")], dtype=ANSWER)
        chunks, lengths = (np.frombuffer(r[c], "<i4") for c in ("chunks", "lengths"))
        return _turned_rows(C.answers(chunks, lengths, r["bucket"], out[_stepped(r["entry"])]), 12)

    return run


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(totals: Totals):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip((c.split()[0] for c in RESULT.split(", ")), kinds, strict=True)))

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        C.tidy()
        if not len(table):
            return schema.empty_table()
        _, _, entry, first = entries(_texts(table))
        told = _told(replies, ANSWER)
        count = told["n"].astype(np.float64)
        base = np.log10((count + 0.1) / (totals.tokens + 0.1 * (totals.types + 1)))
        rows = C.row_of(first)
        known, low, own = (np.bincount(rows, weights=v[entry], minlength=len(table)) for v in ((count > 0).astype(float), base, told["p"].astype(np.float64)))
        columns = [table["doc_id"], np.diff(first), np.rint(known).astype(np.int64), np.full(len(table), totals.tokens), low, own]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=schema)

    return run


def lm_scores(docs: DataFrame, learn, burn_in: int = 10, samples: int = 5, gap: int = 2) -> DataFrame:
    """RESULT for each row of docs (doc_id, text); learn: a boolean column, true where a row trains.

    Tokens are the words of the text, A-Z lower-cased, and one end.  score is the log10
    probability of them all, base_score that of smoothed word counts.  Null text is empty text:
    the end alone.  Null ids and repeated rows are scored, and train, like any other.  Without
    training rows every word has the uniform base's probability.
    """
    n = C.chunk_count(docs)
    bits = C.bucket_bits(n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(True)).cast("int").alias("learn"))
    src = C.chunked(rows, n, "doc_id", "text", "learn").mapInArrow(_zipped_texts, "doc_id long, text binary, learn int, chunk int")
    sent = src.groupBy("chunk").applyInArrow(_send(bits), C.EXCHANGE)
    merged = C.stored(sent.groupBy("bucket").applyInArrow(_merge, MERGED), "entries")
    by = {r["bucket"]: np.frombuffer(r["stats"], "<f8") for r in merged.select("bucket", "stats").collect()}
    customers, pairs, once, twice, root_once, root_twice, types = np.array(list(by.values()) or [np.zeros(7)]).sum(0)
    share = lambda a, b: float(np.clip(a / max(1.0, a + 2 * b), 0.05, 0.95))
    none = np.zeros(0)
    totals = Totals(none, none, types, int(types), int(customers), share(once, twice), share(root_once, root_twice), root_customers=1.1 * pairs)
    part = lambda n: {k: v / max(sum(n.values()), 1) for k, v in n.items()}
    shares = part({k: float(v[1]) for k, v in by.items()})
    seated = merged.select("bucket", "contexts", "kinds", "context", "count")
    seats = seated.mapInArrow(_first_seats(bits), C.EXCHANGE)
    told = seats.groupBy("bucket").applyInArrow(_together, C.REPLY)
    drawn = C.stored(seated.groupBy("bucket").cogroup(told.groupBy("chunk")).applyInArrow(_run(totals, shares, burn_in, 2, gap, bits, False), C.EXCHANGE), "seats")
    parents = drawn.where(F.col("bucket") == PARENT).collect()
    own = {r["chunk"]: float(np.frombuffer(r["vals"], "<f8")[0]) for r in parents}
    t = np.array([np.frombuffer(r["keys"], "<f8") for r in parents] or [np.zeros(len(FACTORS) + 1)]).sum(0)
    shares = part(own)
    totals = replace(totals, root_customers=sum(own.values()), root_tables=settled(totals.root_tables, t[0], t[1:], totals.root_discount, totals.strength))
    told = drawn.where(F.col("bucket") != PARENT).groupBy("bucket").applyInArrow(_together, C.REPLY)
    answering = merged.select("bucket", "kinds", "context", "count", "chunks", "lengths", "entry")
    replies = answering.groupBy("bucket").cogroup(told.groupBy("chunk")).applyInArrow(_run(totals, shares, burn_in, samples, gap, bits, True), C.REPLY)
    return src.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(totals), RESULT)

"""Restaurants of a hierarchical Pitman-Yor model of three words, sampled by Gibbs.

Level 3 has a restaurant for every two words before (u v), level 2 one for every word before (v),
level 1 a single one, over a uniform base of the known words and one unknown.  A customer that
opens a table is a customer of the level below: (u v) w of (v) w, (v) w of w.  A cell is what one
restaurant serves of one word; it is known by its customers and tables.  A move takes a customer
of every cell out and seats it again, given all others: with the chance `alone` it had a table to
itself, which then goes, and its customer below with it; it opens a table by the weight of the
level below against that of the tables there are.  The moves of all cells go side by side.

`Restaurants` has a part of the contexts' cells.  Level 1, and contexts that other parts share, stay
as they were when the parts last met, but for the part's own changes."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

#: customers up to which the chance of a table of one's own is by the exact recursion
EXACT = 64
#: customers that go to a level below in steps of one, in a move
STEPS = 16


@functools.cache
def _chances(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of S(c-1, t-1) / S(c, t), S being the generalised Stirling numbers: the ratios up to EXACT, and
    logarithms of customers a table against the share of tables of one, for larger cells."""
    s = np.zeros((EXACT + 1, EXACT + 1))
    out = np.zeros((EXACT + 1, EXACT + 1))
    s[1, 1] = out[1, 1] = 1
    for c in range(2, EXACT + 1):
        t = np.arange(1, c + 1)
        s[c, 1 : c + 1] = s[c - 1, :c] + (c - 1 - discount * t) * s[c - 1, 1 : c + 1]
        out[c, 1 : c + 1] = s[c - 1, :c] / s[c, 1 : c + 1]
    # sizes of tables are nearly independent, with chances d (1-d)(2-d).. x^n / n!; x gives their mean
    x = np.concatenate([np.geomspace(1e-9, 0.5, 400), 1 - np.geomspace(0.5, 1e-15, 600)[1:]])
    rest = -np.expm1(discount * np.log1p(-x))
    return out, np.log(x * discount * np.exp((discount - 1) * np.log1p(-x)) / rest), discount * x / rest


def alone(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Chance that a customer has a table to itself, given its cell's customers and tables."""
    exact, mean, share = _chances(discount)
    c = np.minimum(customers, EXACT)
    large = tables / np.maximum(customers, 1) * np.interp(np.log(np.maximum(customers, 1) / np.maximum(tables, 1)), mean, share)
    return np.where((tables <= 1) & (customers > 1), 0.0, np.where(customers <= EXACT, exact[c, np.minimum(tables, c)], large))


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each cell's customers: the next opens one with a chance of
    weight / (seated - discount * tables + weight).  One at a time up to 500 customers; then a
    fiftieth more at a time, by binomial draws at the chance in the middle of the step."""
    tables = np.minimum(customers, 1)
    some = np.flatnonzero(customers > 1)
    some = some[np.argsort(-customers[some], kind="stable")]
    c, a, t, i = customers[some], weight[some], np.ones(len(some), np.int64), 1
    while len(c) and i < c[0]:
        n = int(np.searchsorted(-c, -i, "left"))
        step = 1 if i < 500 else i // 50
        p = np.clip(a[:n] / (i - discount * t[:n] + a[:n]), 0, 1)
        if step > 1:
            steps = (np.minimum(c[:n] - i, step) - 1) / 2
            p = np.clip(a[:n] / (i + steps - discount * (t[:n] + p * steps) + a[:n]), 0, 1)
        t[:n] += rng.random(n) < p if step == 1 else rng.binomial(np.minimum(c[:n] - i, step), p)
        i += step
    tables[some] = t
    return tables


def strength_sums(customers: np.ndarray, tables: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Auxiliary draws by which a level's strength is sampled: (sum of y, sum of -log x)."""
    some = (customers > 1) & (tables > 0)
    customers, tables = customers[some], tables[some].astype(np.int64)
    if not len(tables):
        return np.zeros(2)
    x = np.maximum(rng.beta(strength + 1, customers - 1), 1e-300)
    place = np.arange(int((tables - 1).sum())) - np.repeat(np.cumsum(tables - 1) - (tables - 1), tables - 1) + 1
    return np.array([(rng.random(len(place)) * (strength + discount * place) < strength).sum(), -np.log(x).sum()])


def drawn_strength(sums: np.ndarray, rng: np.random.Generator) -> float:
    """From its posterior, the prior being Gamma(1, 1)."""
    return float(max(1e-3, rng.gamma(1 + sums[0]) / (1 + sums[1])))


@dataclass
class Settings:
    """folds, held: documents whose crc32(doc_id as text) mod folds is held are not learnt from.
    rounds: times that all parts meet after the start; moves: of every cell before each; keep: last
    rounds whose probabilities are averaged.  part_bytes: of the texts that a task has at a time;
    bucket_tokens: of the cells that it has at a time."""

    folds: int = 7
    held: int = 2
    rounds: int = 3
    moves: int = 6
    keep: int = 2
    seed: int = 11
    part_bytes: int = 12_000_000
    bucket_tokens: int = 1_500_000


@dataclass
class Level:
    """What all parts know of each round (first the start): discounts and strengths of the levels 1,
    2, 3, customers and tables at level 1."""

    words: int = 0
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    strengths: list[tuple[float, float, float]] = field(default_factory=list)
    roots: list[tuple[float, float]] = field(default_factory=list)

    def root(self, k: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of words at level 1 after round k, from their customers and tables."""
        (d, _, _), (s, _, _), (c, t) = self.discounts, self.strengths[k], self.roots[k]
        return (customers - d * tables + (s + d * t) / (self.words + 1)) / (s + c)


class Restaurants:
    """Cells by pair (v, w) and context (u, v); pairs by word and context v."""

    def __init__(self, count, pair, context, word, before, sizes: tuple[int, int, int]):
        """sizes: contexts (u, v), contexts v, words."""
        self.count, self.pair, self.context, self.word, self.before = count, pair, context, word, before
        self.contexts, self.befores, self.words = sizes
        self.tables = np.minimum(count, 1)
        self.customers2 = np.bincount(pair, self.tables, minlength=len(word)).astype(np.int64)
        self.tables2 = np.minimum(self.customers2, 1)
        self.some = np.flatnonzero(count > 1)

    def own(self) -> tuple[np.ndarray, ...]:
        """Its customers and tables by context (u, v), by context v, and customers by word."""
        by = lambda at, x, n: np.bincount(at, x, minlength=n).astype(np.int64)
        return by(self.context, self.count, self.contexts), by(self.context, self.tables, self.contexts), by(self.before, self.customers2, self.befores), by(self.before, self.tables2, self.befores), by(self.word, self.tables2, self.words)

    def met(self, level: Level, k: int, customers3, tables3, customers2, tables2, root: np.ndarray) -> None:
        """Takes the totals of round k: by context over all parts, and the words' probabilities."""
        self.d, self.s = level.discounts, level.strengths[k]
        self.all3, self.open3, self.all2, self.open2, self.root = customers3.astype(np.float64), tables3.astype(np.float64), customers2.astype(np.float64), tables2.astype(np.float64), root

    def below(self, pairs, without=0) -> np.ndarray:
        """Probabilities at level 2; without: customers of each pair that are taken out."""
        at, c = self.before[pairs], self.customers2[pairs] - without
        t = np.minimum(self.tables2[pairs], c)
        return (c - self.d[1] * t + (self.s[1] + self.d[1] * self.open2[at]) * self.root[self.word[pairs]]) / (self.s[1] + self.all2[at] - without)

    def probability(self) -> np.ndarray:
        """Of each cell's word after its context."""
        at = self.context
        return (self.count - self.d[2] * self.tables + (self.s[2] + self.d[2] * self.open3[at]) * self.below(self.pair)) / (self.s[2] + self.all3[at])

    def _change2(self, pairs: np.ndarray, customers, tables) -> None:
        self.customers2[pairs] += customers
        self.tables2[pairs] += tables
        at = self.before[pairs]
        if not np.isscalar(customers):
            self.all2 += np.bincount(at, customers, minlength=self.befores)
        elif customers:
            self.all2 += customers * np.bincount(at, minlength=self.befores)
        self.open2 += np.bincount(at, tables, minlength=self.befores)

    def _weight2(self, pairs: np.ndarray) -> np.ndarray:
        return (self.s[1] + self.d[1] * self.open2[self.before[pairs]]) * self.root[self.word[pairs]]

    def _arrive2(self, pairs: np.ndarray, n: np.ndarray, rng) -> None:
        """n more customers of each pair; beyond STEPS several at a time."""
        for left in range(STEPS, 0, -1):
            if not len(pairs):
                return
            now = -(-n // left)
            a = self._weight2(pairs)
            p = np.clip(a / (self.customers2[pairs] - self.d[1] * self.tables2[pairs] + a), 0, 1)
            opened = rng.binomial(now, p)
            opened = np.where(self.customers2[pairs] == 0, np.maximum(opened, 1), opened)
            self._change2(pairs, now, opened)
            n = n - now
            pairs, n = pairs[n > 0], n[n > 0]

    def _leave2(self, pairs: np.ndarray, n: np.ndarray, rng) -> None:
        for left in range(STEPS, 0, -1):
            if not len(pairs):
                return
            now = -(-n // left)
            c, t = self.customers2[pairs], self.tables2[pairs]
            closed = rng.binomial(now, alone(c, t, self.d[1]))
            # a table is left as long as customers are, no more tables than customers
            closed = np.clip(closed, np.maximum(0, t - (c - now)), np.where(c > now, t - 1, t))
            self._change2(pairs, -now, -closed)
            n = n - now
            pairs, n = pairs[n > 0], n[n > 0]

    def move(self, rng: np.random.Generator) -> None:
        d, s, some = self.d[2], self.s[2], self.some
        if len(some):
            c, t, at, pair = self.count[some], self.tables[some], self.context[some], self.pair[some]
            gone = (rng.random(len(some)) < alone(c, t, d)).astype(np.int64)
            self.open3 -= np.bincount(at, gone, minlength=self.contexts)
            t = t - gone
            a = (s + d * self.open3[at]) * self.below(pair, gone)
            opened = (rng.random(len(some)) < a / (c - 1 - d * t + a)).astype(np.int64)
            self.open3 += np.bincount(at, opened, minlength=self.contexts)
            self.tables[some] = t + opened
            net = np.bincount(pair, opened - gone, minlength=len(self.word)).astype(np.int64)
            more, less = np.flatnonzero(net > 0), np.flatnonzero(net < 0)
            self._leave2(less, -net[less], rng)
            self._arrive2(more, net[more], rng)
        two = np.flatnonzero(self.customers2 > 1)
        if len(two):
            gone = (rng.random(len(two)) < alone(self.customers2[two], self.tables2[two], self.d[1])).astype(np.int64)
            self._change2(two, 0, -gone)
            a = self._weight2(two)
            opened = rng.random(len(two)) * (self.customers2[two] - 1 - self.d[1] * self.tables2[two] + a) < a
            self._change2(two, 0, opened.astype(np.int64))

    def seat_all(self, rng: np.random.Generator) -> None:
        """Seats everyone for the first time, customer by customer."""
        c3, t3, c2, t2, _ = self.own()
        self.tables = seat(self.count, (self.s[2] + self.d[2] * self.open3[self.context]) * self.below(self.pair), self.d[2], rng)
        customers2 = np.bincount(self.pair, self.tables, minlength=len(self.word)).astype(np.int64)
        tables2 = seat(customers2, self._weight2(np.arange(len(self.word))), self.d[1], rng)
        self.customers2, self.tables2 = customers2, tables2
        now = self.own()
        self.open3 += now[1] - t3
        self.all2 += now[2] - c2
        self.open2 += now[3] - t2

    def sample(self, first: bool, moves: int, rng: np.random.Generator) -> None:
        if first:
            self.seat_all(rng)
        for _ in range(moves):
            self.move(rng)

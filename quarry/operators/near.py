"""Near-duplicate search: a set of query texts against a library, by grams, then a longest common subsequence, then the ratio.

The ratio of two texts is 2 M / S: M characters in matching blocks, S in both texts.  Three
upper bounds of it are tried before it is computed, the cheapest first:

1. *Lengths*: M is at most the shorter text.
2. *Grams*: k blocks of M characters hold at least M - (gram - 1) k common grams, and between
   two blocks stands a character that matches nothing, so k <= S - 2 M + 1.  Common grams U
   are counted with repetition.  If a pair needs T of them and the query has n, then of any P
   of the query's grams at least T - (n - P) are in the other text: the P rarest grams are
   indexed, and a library text meets only the queries that share enough of them.  A merge of
   the sorted grams counts U for those that are left.
   Short grams are shared by chance, so texts of some length are sieved by longer ones first:
   the blocks that hold the grams that a pair needs hold longer ones too (``longer_grams``).
   A pair that would reach its count only by grams outside its blocks has more blocks than
   ``run`` allows, see below.
3. *Characters*: M is at most the number of common characters, whatever their order.

Matching blocks are found from the runs of ``SEED`` characters or more that two texts share.
Where these cover too little, the longest common subsequence is tried first: the blocks are one.

The second bound is exact, but below a threshold of about 0.9 it rules nothing out.  With
``run`` pairs of more than M / run + 2 blocks may be ruled out too: blocks shorter than that
on average, as where single characters are replaced all over a text.  Library texts of
``LONG`` characters or more take longer grams and runs (``SIZES``).  ``complete`` in the result
says whether something could have been ruled out so.  ``run=None`` rules out nothing that
could reach the threshold.

A query keeps its best hits so far, and a text that cannot beat them is not compared
further, so a group of thousands of near copies costs little; the scores to beat stay in a
worker from one task to the next.  Queries go to the tasks in blocks of at most
``BLOCK_CHARS`` characters and of like lengths, equal ones once.  A block reads the library
texts of lengths that it allows, where they lie, and only hits move.
"""

from __future__ import annotations

import difflib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.history import _kept
from quarry.operators.similarity import CRITICAL, STRICT, THRESHOLD, TOP, VARIANT, classify, common_length

RUN, LONG = 8, 2000
#: Gram, hashed counts, and how many times run is asked for: of library texts below LONG characters, and of the others.
SIZES = ((5, 8192, 1), (8, 32768, 2))
CHARACTERS = 64
#: Indexed grams beyond those that one common gram would need, as a share of a query's grams; bits of a gram's place in the index.
MARGIN, BITS = 0.1, 23
#: Grams that so many queries have, and one of so many, are kept as rows of one byte a query.
ROW, SHARE = 256, 32
#: Characters from which on common runs are looked up, and how many pairs of their places a character of both texts may have.
SEED, SEEDS = 8, 8
#: The subsequence is tried first where such runs cover less than this share of what a pair needs.
COVERED = 0.75
#: Grams of queries that a worker keeps sorted.
GRAMS = 2_000_000
#: Common grams a character of both texts from which on the exact bound is used; the longest grams with it.
EXACT, LONGEST = 0.1, 12
#: The same of the longer grams by which pairs are sieved first, and how many of them a pair needs at least for that.
SIEVE, SIEVED = 0.05, 12
#: Cells of a table of both texts from which on matching blocks are searched with arrays.
CELLS = 40_000
BLOCK_CHARS = 8_000_000
CHUNK = 512
MEMO = 20_000
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_MULTIPLY), -1, 1 << 64))


def _exact(threshold: float, gram: int) -> float:
    """A share of both texts' characters: pairs of the threshold have so many grams in common, less gram - 1, for certain."""
    return (gram - 0.5) * threshold - (gram - 1)


def gram_size(threshold: float, run: int | None, size: int = 0) -> int:
    """Characters in a gram: as SIZES says, more where the exact bound is used and still rules out enough."""
    gram = SIZES[size][0]
    if run and _exact(threshold, gram) >= EXACT:
        while gram < LONGEST and _exact(threshold, gram + 1) >= EXACT:
            gram += 1
    return gram


def least_grams(threshold: float, run: int | None, size: int = 0, gram: int = 0) -> tuple[float, float]:
    """(a, b): pairs with fewer than a S - b common grams of a size are ruled out: for certain, where that rules out enough, else as run assumes."""
    gram, times = gram or SIZES[size][0], SIZES[size][2]
    exact = _exact(threshold, gram)
    assumed = (1 - (gram - 1) / (run * times)) * threshold / 2 if run else 0.0
    return (exact, float(gram - 1)) if not run or exact >= EXACT else (assumed, 2.0 * (gram - 1))


def longer_grams(a: float, b: float, gram: int, least: float = SIEVE) -> tuple[float, float, int]:
    """(a, b, gram) of the longest grams of which pairs need at least a share, given how many of a size their matching blocks hold.

    Blocks of g characters or more number at most (M - U) / (g - 1), as each holds g - 1 characters besides its grams; so many grams less are
    there of g + 1 characters, and M is at most S / 2.
    """
    while (more := (gram * a - 0.5) / (gram - 1)) >= least - 1e-9:
        a, b, gram = more, gram * b / (gram - 1), gram + 1
    return a, b, gram


def complete(threshold: float, run: int | None) -> bool:
    """Whether no pair of the threshold is ruled out, whatever its blocks."""
    return all(least_grams(threshold, run, i) == least_grams(threshold, None, i) for i in range(len(SIZES)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


Grams = tuple[np.ndarray, np.ndarray]


def _hashes(text: str, gram: int) -> np.ndarray:
    """Hashes of a text's grams, in order; none for a shorter text."""
    c = _points(text)
    if len(c) < gram:
        return np.empty(0, np.uint64)
    h = np.zeros(len(c) - gram + 1, np.uint64)
    for i in range(gram):
        h *= _MULTIPLY
        h += c[i : len(c) - gram + 1 + i]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(text: str, gram: int) -> Grams:
    """Sorted hashes of a text's grams and how often each stands there; none for a shorter text."""
    return np.unique(_hashes(text, gram), return_counts=True)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ...: n places for each."""
    ends = np.cumsum(n)
    out = np.repeat(first - ends + n, n)
    out += np.arange(len(out))
    return out


def common_grams(x: Grams, y: Grams) -> int:
    """Size of the intersection of two multisets."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if not len(x[0]):
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    return int(np.minimum(x[1], y[1][at])[y[0][at] == x[0]].sum())


def _roots(grams: list[Grams], dims: int) -> np.ndarray:
    """A row of square roots of hashed counts per text: their products bound common grams from above."""
    out = np.empty((len(grams), dims), np.float32)
    for i, (g, n) in enumerate(grams):
        out[i] = np.bincount((g % np.uint64(dims)).astype(np.int64), n, dims)
    return np.sqrt(out, out=out)


def _characters(text: str) -> np.ndarray:
    """Counts of a text's characters, hashed: common counts bound common characters from above."""
    return np.bincount((_points(text) % np.uint64(CHARACTERS)).astype(np.int64), minlength=CHARACTERS).astype(np.int32)


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; what both begin and end with is not searched."""
    n = min(len(a), len(b))
    x, y = _points(a[:n]), _points(b[:n])
    head = n if (x == y).all() else int((x != y).argmax())
    x, y = _points(a[head:][::-1][: n - head]), _points(b[head:][::-1][: n - head])
    tail = n - head if (x == y).all() else int((x != y).argmax())
    return head + tail + common_length(a[head : len(a) - tail], b[head : len(b) - tail])


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(i, j, n) of the longest run that two arrays of code points share: the first in a, and of those the first in b."""

    def hashes(c: np.ndarray, n: int, power: int, prefix: np.ndarray) -> np.ndarray:
        return prefix[n:] - prefix[: len(c) - n + 1] * np.uint64(power)

    def prefixes(c: np.ndarray) -> np.ndarray:
        # Prefix sums of c[k] * M^(len - 1 - k), read backwards by multiplying: kept as h[k + 1] = h[k] * M + c[k].
        steps = np.empty(len(c) + 1, np.uint64)
        inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(c), _INVERSE, np.uint64)]))
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(c), _MULTIPLY, np.uint64)]))
        steps[0] = 0
        np.cumsum((c + np.uint64(1)) * _MIX * inverse[1:], out=steps[1:])
        return steps * powers

    pa_, pb = prefixes(a), prefixes(b)
    low, high, best = 0, min(len(a), len(b)), (0, 0, 0)
    while low < high:
        n = (low + high + 1) // 2
        power = pow(int(_MULTIPLY), n, 1 << 64)
        x, y = hashes(a, n, power, pa_), hashes(b, n, power, pb)
        found = np.isin(x, y)
        i = int(found.argmax())
        if found[i]:
            j = int((y == x[i]).argmax())
            if not (a[i : i + n] == b[j : j + n]).all():
                raise ArithmeticError("two runs of one hash")
            low, best = n, (i, j, n)
        else:
            high = n - 1
    return best


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def seeds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of SEED characters each, and where they stand."""
    x = _hashes(text, SEED)
    order = np.argsort(x)
    return x[order], order


def common_runs(a: str, b: str, of_a: tuple[np.ndarray, np.ndarray] | None = None, of_b: tuple[np.ndarray, np.ndarray] | None = None) -> Runs | None:
    """(i, j, n): the longest runs of SEED characters or more that two texts share, from i in a and j in b; None if there are too many places.  of_a, of_b: their seeds."""
    (x, at), (y, order) = of_a or seeds(a), of_b or seeds(b)
    first = np.searchsorted(y, x)
    n = np.searchsorted(y, x, "right") - first
    if n.sum() > SEEDS * (len(a) + len(b)):
        return None
    i = np.repeat(at, n)
    j = order[_spread(first, n)]
    at = np.lexsort((i, i - j))
    i, j = i[at], j[at]
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(i), 1), bool), (np.diff(i) != 1) | (np.diff(j) != 1)]))
    return i[starts], j[starts], np.diff(np.append(starts, len(i))) + SEED - 1


def covered(runs: Runs, size: int) -> int:
    """Characters of the first text that lie in a run."""
    steps = np.bincount(runs[0], minlength=size + 1) - np.bincount(runs[0] + runs[2], minlength=size + 1)
    return int((np.cumsum(steps) > 0).sum())


def matched(a: str, b: str, least: float, runs: Runs | None = None) -> int:
    """Characters in the matching blocks of two texts: the longest first, then left and right of it; 0 as soon as there cannot be so many as least."""
    if runs is None:
        runs = common_runs(a, b)
    total, room, todo = 0, min(len(a), len(b)), [(0, len(a), 0, len(b), runs)]
    while todo:
        low, high, left, right, runs = todo.pop()
        room -= min(high - low, right - left)
        n = 0
        if runs is not None:
            i, j, n_all = runs
            cut = np.maximum(np.maximum(low - i, left - j), 0)
            sizes = np.minimum(np.minimum(high - i, right - j), n_all) - cut
            some = np.flatnonzero(sizes >= SEED)
            runs = (i[some] + cut[some], j[some] + cut[some], sizes[some])
            if len(some):
                longest = np.flatnonzero(runs[2] == runs[2].max())
                best = longest[np.lexsort((runs[1][longest], runs[0][longest]))[0]]
                i, j, n = (int(r[best]) for r in runs)
        if not n:
            x, y = a[low:high], b[left:right]
            if len(x) * len(y) <= CELLS:
                if not set(x).isdisjoint(y):
                    total += sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            else:
                i, j, n = _longest(_points(x), _points(y))
                i, j = i + low, j + left
        if n:
            total += n
            for p, q, r, t in ((low, i, left, j), (i + n, high, j + n, right)):
                if p < q and r < t:
                    todo.append((p, q, r, t, runs))
                    room += min(q - p, t - r)
        if total + room < least:
            return 0
    return total


class Index:
    """The rarest grams of query texts of a range of lengths, to be met by library texts of one size; made when first asked.

    A sieve is an index of longer grams: a pair that has too few of them cannot have enough of the others in its matching blocks.
    """

    def __init__(self, queries: "Queries", size: int, low: int, high: int, run: int | None, sieve: bool = False):
        self.gram, self.low, self.lengths = gram_size(queries.threshold, run, size), low, queries.lengths[low:high]
        self.texts, self.share = [t for _, t in queries.texts[low:high]], queries.share
        self.a, self.b = least_grams(queries.threshold, run, size, self.gram)
        self.size, self.sieve, self.made = size, sieve, False
        if sieve:
            self.a, self.b, self.gram = longer_grams(self.a, self.b, self.gram)
        self.sorted: dict[int, Grams] = {}
        self.marks: dict[int, np.ndarray] = {}
        self.room = GRAMS

    def _make(self) -> None:
        self.made = True
        n = np.maximum(self.lengths - self.gram + 1, 0)
        least = self.a * (self.lengths + np.maximum(self.lengths / self.share, LONG if self.size else 0)) - self.b
        # Of a sieve's few grams needed half may be among the most frequent, which are not indexed.
        some = np.ceil(np.clip(n - least / 2 if self.sieve else n - least + 1 + MARGIN * n, 0, n)).astype(np.int64)
        some[self.a * self.lengths * (1 + self.share) <= self.b] = 0  # no length needs a common gram
        self.spare = n - some
        self.bits = min(BITS, max(10, int(some.sum()).bit_length() + 1))
        often = np.zeros(1 << self.bits, np.int32)
        for i in np.flatnonzero(some):
            np.add.at(often, self.places(_hashes(self.texts[i], self.gram)), np.int32(1))
        chosen = [np.empty(0, np.int32)]
        for i in np.flatnonzero(some):
            at = self.places(_hashes(self.texts[i], self.gram))
            chosen.append((at if some[i] == n[i] else at[np.argpartition(often[at], some[i] - 1)[: some[i]]]).astype(np.int32))
        at = np.concatenate(chosen)
        chosen.clear()
        many = np.bincount(at, minlength=1 << self.bits).astype(np.int32)
        # What is in a row is not in a list; a query's further grams of the same place are.
        often[:] = -1
        frequent = np.flatnonzero(many > max(ROW, len(n) // SHARE))
        often[frequent] = np.arange(len(frequent))
        self.frequent, self._rows = frequent, np.zeros((len(frequent), len(n)), np.uint8)
        owner = np.repeat(np.arange(len(n), dtype=np.int32), some)
        inside = np.flatnonzero(often[at] >= 0)
        row, mine = often[at[inside]].astype(np.int64), owner[inside].astype(np.int64)
        _, first = np.unique(row * len(n) + mine, return_index=True)
        self._rows[row[first], mine[first]] = 1
        rest = np.ones(len(at), bool)
        rest[inside[first]] = False
        order = at[rest].astype(np.int64) << 32 | owner[rest]
        del at, owner, chosen, inside, row, mine, first, rest, often, many
        order.sort()
        self.starts = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(order >> 32, minlength=1 << self.bits), out=self.starts[1:])
        self.queries = order.astype(np.int32)  # the lower half

    @property
    def rows(self) -> np.ndarray:
        if not self.made:
            self._make()
        return self._rows

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def grams(self, i: int) -> Grams:
        """A query's sorted grams."""
        if i not in self.sorted:
            if self.room < 0:
                self.sorted.clear()
                self.room = GRAMS
            self.sorted[i] = gram_hashes(self.texts[i], self.gram)
            self.room -= len(self.sorted[i][0])
        return self.sorted[i]

    def signs(self, i: int) -> np.ndarray:
        """16 bits of each of a query's grams."""
        if i not in self.marks:
            self.marks[i] = (_hashes(self.texts[i], self.gram) >> np.uint64(48)).astype(np.uint16)
        return self.marks[i]

    def enough(self, places: np.ndarray, text: str) -> np.ndarray:
        """Which of some queries, none shorter than a gram, have as many grams, by their signs, in a text as a pair needs."""
        there = np.zeros(1 << 16, np.uint8)
        there[(_hashes(text, self.gram) >> np.uint64(48)).astype(np.int64)] = 1
        if not len(places):
            return np.empty(0, bool)
        signs = [self.signs(i) for i in places.tolist()]
        starts = np.cumsum([0, *(len(x) for x in signs[:-1])])
        found = np.add.reduceat(there.take(np.concatenate(signs)), starts, dtype=np.int64)
        return found >= self.a * (self.lengths[places] + len(text)) - self.b - 1e-6

    def _sum(self, rows: list[int], low: int, high: int) -> np.ndarray:
        """The sum of at most 255 rows."""
        out = np.zeros(high - low, np.uint8)
        for r in rows:
            np.add(out, self._rows[r, low:high], out=out)
        return out

    def candidates(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Queries that may have enough grams in common with a text, and how many at most."""
        low = int(np.searchsorted(self.lengths, math.ceil(len(text) / self.share - 1e-6)))
        high = int(np.searchsorted(self.lengths, math.floor(len(text) * self.share + 1e-6), "right"))
        if low >= high:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if not self.made:
            self._make()
        # Each place once, and in order, so that what is looked up lies in order too.
        at = np.sort(self.places(_hashes(text, self.gram)))
        new = np.ones(len(at), bool)
        np.not_equal(at[1:], at[:-1], out=new[1:])
        at = at[new]
        first = self.starts[at].astype(np.int64)
        found = self.queries[_spread(first, self.starts[at + 1] - first)]
        most = np.bincount(found, minlength=len(self.lengths))[low:high] + self.spare[low:high]
        if len(self._rows) and len(at):
            rows = np.flatnonzero(at[np.minimum(np.searchsorted(at, self.frequent), len(at) - 1)] == self.frequent)
            for i in range(0, len(rows), 255):
                most += self._sum(rows[i : i + 255].tolist(), low, high)
        some = np.flatnonzero(most >= self.a * (self.lengths[low:high] + len(text)) - self.b - 1e-6)
        return low + some, most[some]


class Queries:
    """Query texts in order of length and the best hits so far."""

    def __init__(self, texts: list[tuple[str, str]], threshold: float, keep: int, run: int | None):
        self.texts = sorted(texts, key=lambda x: len(x[1]))
        self.lengths = np.array([len(t) for _, t in self.texts], np.int64)
        self.counts = np.array([_characters(t) for _, t in self.texts]).reshape(-1, CHARACTERS)
        self.threshold, self.keep = threshold, keep
        self.share = (2 - threshold) / threshold  # no text that is so many times longer can reach the threshold
        last, first = int(np.searchsorted(self.lengths, LONG * self.share + 1, "right")), int(np.searchsorted(self.lengths, LONG / self.share - 1))
        self.indexes = (Index(self, 0, 0, last, run), Index(self, 1, first, len(texts), run))
        self.sieves = (Index(self, 0, 0, last, run, True), Index(self, 1, first, len(texts), run, True))
        #: Library texts of so many characters are sieved; shorter ones meet an index of the queries that their lengths allow.
        self.sieved = [(SIEVED + s.b) / (s.a * (1 + 1 / self.share)) if s.gram > i.gram else math.inf for s, i in zip(self.sieves, self.indexes)]
        self.short = Index(self, 0, 0, min(last, int(np.searchsorted(self.lengths, min(self.sieved[0], LONG) * self.share + 1, "right"))), run)
        self.best: list[list[tuple[float, str, bool]]] = [[] for _ in texts]
        #: Scores that hits of earlier tasks make too few: what is below one is not among the best of the whole library.
        self.floors = [0.0] * len(texts)
        self.memo: dict[tuple[int, str], float] = {}
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.room = GRAMS
        #: The library text that was compared last.
        self.last: tuple[str, tuple[np.ndarray, np.ndarray]] = ("", seeds(""))

    def start(self) -> None:
        """Begins another part of the library."""
        for q, hits in enumerate(self.best):
            if len(hits) >= self.keep:
                self.floors[q] = max(self.floors[q], -hits[-1][0])
        self.best = [[] for _ in self.best]

    def beaten(self, q: int, bound: float, key: str) -> bool:
        """Whether a hit of at most this score cannot be among the best."""
        hits = self.best[q]
        return bound < self.threshold or round(bound, 3) < self.floors[q] or (len(hits) >= self.keep and (-round(bound, 3), key) >= (hits[-1][0], hits[-1][1]))

    def sorted_seeds(self, q: int, text: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Seeds of a query and of a library text; the text's are kept until the next one, a query's for longer."""
        if self.last[0] != text:
            self.last = (text, seeds(text))
        if q not in self.seeds:
            if self.room < 0:
                self.seeds.clear()
                self.room = GRAMS
            self.seeds[q] = seeds(self.texts[q][1])
            self.room -= len(self.seeds[q][0])
        return self.seeds[q], self.last[1]

    def ratio(self, q: int, text: str, key: str) -> float:
        """The ratio, or 0 where it is below the threshold or beaten."""
        own = self.texts[q][1]
        if own == text:
            return 1.0
        size = len(own) + len(text)
        if (q, text) not in self.memo:
            worst = -self.best[q][-1][0] if len(self.best[q]) >= self.keep else 0.0
            least = max(self.threshold, max(worst, self.floors[q]) - 0.001) * size / 2 - 1e-6  # lower scores round to worse ones
            runs = common_runs(own, text, *self.sorted_seeds(q, text))
            if (runs is None or covered(runs, len(own)) < COVERED * least) and self.beaten(q, 2 * subsequence(own, text) / size, key):
                return 0.0
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[q, text] = 2 * matched(own, text, least, runs) / size
        return self.memo[q, text]

    def compare(self, rows: list[tuple[str, str]]) -> None:
        """Meets some library texts (key, text) with the queries of allowed lengths."""
        for key, text in rows:
            self.meet([key], text)

    def meet(self, keys: list[str], text: str | None) -> None:
        """Meets a library text, of as many keys as have it, with the queries of allowed lengths."""
        if text:
            size = len(text) >= LONG
            if len(text) >= self.sieved[size]:
                first, index = self.sieves[size], self.indexes[size]
            else:
                first = index = self.indexes[1] if size else self.short
            self._compare(first, index, sorted(keys)[: self.keep], text)

    def _compare(self, first: Index, index: Index, keys: list[str], text: str) -> None:
        """first finds the queries to be met; it and index hold the same ones."""
        key = keys[0]
        places, common = first.candidates(text)
        if first.sieve:
            few = index.enough(places, text)
            places, common = places[few], common[few]
        if not len(places):
            return
        asked, sizes = places + first.low, first.lengths[places] + len(text)
        most = np.minimum(self.counts[asked], _characters(text)).sum(axis=1)
        # M - (gram - 1) (S - 2 M + 1) <= U.
        within = lambda u, s, gram: (u + (gram - 1) * (s + 1)) / (2 * gram - 1)
        bounds = 2 * np.minimum(most, within(common, sizes, first.gram)) / sizes
        order = np.flatnonzero(bounds >= self.threshold)
        order = order[np.argsort(-bounds[order], kind="stable")]
        grams = None
        for i, q, bound in zip(places[order].tolist(), asked[order].tolist(), bounds[order].tolist()):
            if self.beaten(q, bound, key):
                continue
            own = self.texts[q][1]
            if own != text:
                grams = grams or gram_hashes(text, index.gram)
                shared, size = common_grams(grams, index.grams(i)), len(own) + len(text)
                if shared < index.a * size - index.b or self.beaten(q, 2 * within(shared, size, index.gram) / size, key):
                    continue
            r = self.ratio(q, text, key)
            if r >= self.threshold and not self.beaten(q, r, key):
                other = set(re.findall(CRITICAL, own)) != set(re.findall(CRITICAL, text))
                self.best[q] = sorted([*self.best[q], *((-round(r, 3), k, other) for k in keys)])[: self.keep]

    def hits(self) -> Iterator[tuple[str, str, float, bool]]:
        for (query, _), found in zip(self.texts, self.best):
            for score, key, variant in found:
                yield query, key, -score, variant


_made: dict[str, Queries] = {}


def _search(texts: list[tuple[str, str]], name: str, threshold: float, keep: int, run: int | None):
    """Best hits of each query in a task's part of the library."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made.clear()
            _made[name] = Queries(texts, threshold, keep, run)
        queries = _made[name]
        queries.start()
        for batch in batches:
            # Each text of a batch once.
            texts_of = batch.column("norm").dictionary_encode()
            keys: list[list[str]] = [[] for _ in texts_of.dictionary]
            for key, at in zip(batch.column("key").to_pylist(), texts_of.indices.to_pylist()):
                if at is not None:
                    keys[at].append(key)
            for a in range(0, len(keys), CHUNK):
                for i, text in enumerate(texts_of.dictionary.slice(a, CHUNK).to_pylist(), a):
                    queries.meet(keys[i], text)
        columns = list(zip(*queries.hits())) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.bool_()))], ["query", "right", "score", "variant"])

    return run_task


def _blocks(texts: DataFrame) -> list[tuple[Column, tuple[int, int] | None]]:
    """Conditions that part texts (query, norm) into blocks of about BLOCK_CHARS characters, and the lengths in each; like lengths lie together."""
    size = F.length("norm")
    groups = texts.groupBy(F.floor(F.log(2.0, size) * 16).alias("g")).agg(F.sum(size).alias("total"), F.min(size).alias("low"), F.max(size).alias("high")).orderBy("g").collect()  # a few hundred
    out: list[tuple[Column, tuple[int, int] | None]] = []
    total, low, high = 0, 0, 0
    for g in [*groups, None]:
        if total and (g is None or total + g["total"] > BLOCK_CHARS):
            parts = math.ceil(total / BLOCK_CHARS)
            within = size.between(low, high)
            out += [(within & (F.pmod(F.crc32(F.col("query").cast("binary")), F.lit(parts)) == i), (low, high)) for i in range(parts)]
            total = 0
        if g is not None:
            total, low, high = total + g["total"], low if total else g["low"], g["high"]
    return out or [(F.lit(True), None)]


def _stored(rows: DataFrame) -> DataFrame:
    """rows (key, norm) computed once: a table of small files, so that its tasks are alike, where spark.checkpoint.dir names a folder, else the cache."""
    folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return rows.persist()
    path = f"{folder.rstrip('/')}/near-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", 5000).parquet(path)
    return rows.sparkSession.read.schema("key string, norm string").parquet(path)


def near(batch: DataFrame, library: DataFrame, threshold: float = THRESHOLD, top: int = TOP, run: int | None = RUN) -> DataFrame:
    """For each row of a batch (key, norm) the most similar other rows of the library (key, norm): left, right, score, rank, verdict and complete.

    The veto: pairs whose critical tokens differ are variants.  Empty texts are skipped (see
    index_status).  Keys are strings; a row never finds its own key.  Batch and library are made
    once, and a block reads the library's texts of like lengths.
    """
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    asked = _kept(batch.filter(F.length("norm") > 0).select("key", "norm", digest.alias("query")))
    some = asked.groupBy("query").agg(F.first("norm").alias("norm"))
    blocks = _blocks(some)
    rows = library.select(F.coalesce("key", F.lit("")).alias("key"), "norm")
    if len(blocks) > 1:
        rows = _stored(rows)
    share = (2 - threshold) / threshold
    found: DataFrame | None = None
    for mine, lengths in blocks:
        texts = [(r["query"], r["norm"]) for r in some.filter(mine).collect()]  # about BLOCK_CHARS in all, or one text that is longer
        like = rows
        if len(blocks) > 1:
            like = rows.filter(F.length("norm").between(math.floor(lengths[0] / share), math.ceil(lengths[1] * share)))
        hits = like.mapInArrow(_search(texts, uuid.uuid4().hex, threshold, top + 1, run), "query string, right string, score double, variant boolean")
        found = hits if found is None else found.unionByName(hits)
    best = W.partitionBy("query").orderBy(F.desc("score"), "right")
    few = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top + 1).drop("n")
    pairs = asked.select(F.col("key").alias("left"), "query").join(few, "query").filter(F.col("left") != F.col("right"))
    rank = F.row_number().over(W.partitionBy("left").orderBy(F.desc("score"), "right"))
    verdict = F.when(F.col("variant"), VARIANT).otherwise(classify(F.col("score")))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= top).select("left", "right", "score", "rank", verdict.alias("verdict"), F.lit(complete(threshold, run)).alias("complete"))


def same_items(batch: DataFrame, library: DataFrame, threshold: float = STRICT) -> DataFrame:
    """The best other row of the library for each row of a batch (key, norm) that is more similar than the threshold: such an item is not taken in, variant or not."""
    return near(batch, library, threshold, 1).filter(F.col("score") > threshold).select("left", "right", "score", "verdict", "complete")


def index_status(rows: DataFrame, key: str, norm: Column) -> DataFrame:
    """How much of a library can be found at all: total, indexed, skipped (their text is empty), coverage, ready and the first three keys skipped."""
    empty = F.length(F.coalesce(norm, F.lit(""))) == 0
    counted = rows.select(F.col(key).alias("key"), empty.alias("empty"))
    totals = counted.agg(F.count("*").alias("total"), F.count_if(~F.col("empty")).alias("indexed"), F.count_if("empty").alias("skipped"))
    first = counted.filter("empty").orderBy("key").limit(3).agg(F.sort_array(F.collect_list("key")).alias("first_skipped"))  # three rows
    coverage = F.when(F.col("total") > 0, F.round(F.col("indexed") / F.col("total"), 4)).otherwise(1.0)
    return totals.crossJoin(F.broadcast(first)).select("total", "indexed", "skipped", coverage.alias("coverage"), (F.col("skipped") == 0).alias("ready"), "first_skipped")  # one row each

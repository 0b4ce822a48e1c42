"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

The words of many documents are laid end to end, each document with words and an end of its own, so that no repeat crosses documents. Prefix
doubling sorts the suffixes and keeps the classes of all lengths 2^k; these give the LCP array, and compare any two stretches in a few look-ups.
LCP intervals come from the nearest smaller values on both sides. The test then follows Stoye and Gusfield, without a tree: of each
interval of depth d, all children but the largest are walked, and for a suffix i the ranks of i + d and i - d are looked up in the interval. A hit whose next words
differ is a branching square. Squares that reach back far enough are rotated to the left as far as the period lasts, and squares of one
stretch are merged into a run of the smallest period. All steps are array operations over the batch; the walk is O(n log n) words.

Cases: a null or empty text has no words, no runs and the digest of nothing; a null id has no digest, so its text is taken as it is; repeated
rows are rows of their own; an empty table gives none; of other columns, whatever their names, none is read. A text of any
length is one unit of work, with memory of about 8 log2(n) bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import sliced

#: A run is at least so long, and at least so many periods.
LEAST, TIMES = 6, 4
#: Words of documents that are laid end to end, about.
BATCH_WORDS = 1 << 16


class Suffixes:
    """The suffix array of a sequence of longs in which the last element is unique, with the classes of all stretches of 2^k elements."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        rank, size = self._first(seq)
        self.levels = [rank]
        h = 1
        open_ = np.flatnonzero(size[rank] > 1)
        while len(open_):
            # Order the members of each class by the class that follows; what is equal in both stays one class.
            a, b = rank[open_], rank[open_ + h]
            order = np.lexsort((b, a))
            at, a, b = open_[order], a[order], b[order]
            new_a = np.r_[True, a[1:] != a[:-1]]
            new = new_a | np.r_[True, b[1:] != b[:-1]]
            place = np.arange(len(at))
            head = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_a, place, 0))
            rank = rank.copy()
            rank[at] = a + head
            self.levels.append(rank)
            h *= 2
            alone = new & np.r_[new[1:], True]
            open_ = np.sort(at[~alone])
        self.rank = rank
        self.order = np.empty(n, np.int32)
        self.order[rank] = np.arange(n, dtype=np.int32)

    @staticmethod
    def _first(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each element's class, numbered by the place of its first member in sorted order, and sizes at these places."""
        _, inverse, counts = np.unique(seq, return_inverse=True, return_counts=True)
        starts = np.cumsum(counts) - counts
        size = np.zeros(len(seq), np.int64)
        size[starts] = counts
        return starts[inverse].astype(np.int32), size

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of what the suffixes at a and at b (never equal) have in common."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            step = same.astype(np.int64) << k
            out, a, b = out + step, a + step, b + step
        return out

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of what ends just before a and just before b in common (a < b)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = a >= 1 << k
            same = fits & (self.levels[k][np.where(fits, a - (1 << k), 0)] == self.levels[k][np.where(fits, b - (1 << k), 1)])
            step = same.astype(np.int64) << k
            out, a, b = out + step, a - step, b - step
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether stretches of a length (1 or more) at a and b are equal."""
        out = np.zeros(len(a), bool)
        level = np.floor(np.log2(length)).astype(np.int64)
        for k in np.unique(level[level < len(self.levels)]):
            on = np.flatnonzero(level == k)
            rank, x, y, last = self.levels[k], a[on], b[on], length[on] - (1 << int(k))
            out[on] = (rank[x] == rank[y]) & (rank[x + last] == rank[y + last])
        return out


def nearest_smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place with a value above 0, the nearest one on the left and on the right that holds a smaller value (-1 and len(x), if none)."""
    n = len(x)
    least = [x]  # least[k][i]: the smallest of 2^k values from i on
    while 2 << (len(least) - 1) <= n and least[-1].max(initial=0) > 0:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    right, left = np.arange(n), np.arange(n)
    for k in range(len(least) - 1, -1, -1):
        fits = right + (1 << k) <= n
        right = np.where(fits & (least[k][np.where(fits, right, 0)] >= x), right + (1 << k), right)
        start = left - (1 << k) + 1
        fits = start >= 0
        left = np.where(fits & (least[k][np.where(fits, start, 0)] >= x), start - 1, left)
    return left, right


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, end), and which range each is from."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def squares(s: Suffixes, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The branching squares: (start, half their length)."""
    n = len(seq)
    lcp = np.zeros(n, np.int64)  # of each suffix in order with the one before
    near = np.flatnonzero(s.levels[0][s.order[1:]] == s.levels[0][s.order[:-1]]) + 1
    lcp[near] = s.common(s.order[near - 1], s.order[near])
    left, right = nearest_smaller(lcp)
    # Places with one value and the same bounds split one interval, ranks [left, right), into its children.
    k = near[np.lexsort((near, right[near], left[near]))]
    lo, hi, depth = left[k], right[k], lcp[k]
    if not len(k):
        return k, k
    new = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
    interval = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    starts = np.concatenate([np.where(new, lo, np.r_[0, k[:-1]]), k[np.r_[first[1:], len(k)] - 1]])
    ends = np.concatenate([k, hi[first]])
    of = np.concatenate([interval, np.arange(len(first))])
    order = np.lexsort((ends - starts, of))  # the last child of each interval is its largest
    order = order[np.r_[of[order][1:] == of[order][:-1], False]]
    ranks, child = _spread(starts[order], ends[order])
    at = first[of[order][child]]
    i, d, lo, hi = s.order[ranks].astype(np.int64), depth[at], lo[at], hi[at]
    found = []
    for start, other in ((i, i + d), (i - d, i - d)):
        on = np.flatnonzero((other >= 0) & (other < n))
        r = s.rank[other[on]]
        on = on[(r >= lo[on]) & (r < hi[on])]
        a, half = start[on], d[on]
        keep = (a + 2 * half < n) & (seq[np.minimum(a + half, n - 1)] != seq[np.minimum(a + 2 * half, n - 1)])
        found.append((a[keep], half[keep]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a sequence whose last element is unique: (start, end, period), by start, then period."""
    none = np.zeros(0, np.int64)
    if len(seq) <= LEAST:
        return none, none, none
    s = Suffixes(seq)
    start, half = squares(s, seq)
    # Whole length at least: so much must stand before the square's end with its period.
    least = np.maximum(LEAST, TIMES * half)
    end = start + 2 * half
    on = end >= least
    start, half, least, end = start[on], half[on], least[on], end[on]
    on = s.equal(end - least, end - least + half, least - half)
    start, half, end = start[on], half[on], end[on]
    start = start - s.common_before(start, start + half)
    order = np.lexsort((half, end, start))
    start, half, end = start[order], half[order], end[order]
    on = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, half, end = start[on], half[on], end[on]
    order = np.lexsort((half, start))
    return start[order], end[order], half[order]


def repeat_words(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on, the p words from a are repeated; None, if the document stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _answer(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple:
    listed = "".join(f"{a},{b - a},{p}\n" for a, b, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True))
    if not len(start):
        kept, best = words, (None, None, None, None)
    else:
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, end, -1)
        kept = words[np.cumsum(drop[:-1]) == 0]
        i = np.lexsort((period, start, start - end))[0]
        a, length, p = int(start[i]), int(end[i] - start[i]), int(period[i])
        best = (a, length, p, 1000 * length // p)
    return len(start), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept.tolist())).hexdigest()


def _solve(docs: list[tuple[int | None, np.ndarray, np.ndarray]]) -> list[tuple]:
    """Rows of documents (id, their distinct words, the number of each word)."""
    base = 0
    parts = []
    for _, distinct, ids in docs:
        parts += [ids + base, [base + len(distinct)]]  # words of its own and an end
        base += len(distinct) + 1
    start, end, period = runs(np.concatenate(parts))
    offsets = np.cumsum([0, *(len(ids) + 1 for _, _, ids in docs)])
    cut = np.searchsorted(start, offsets)
    out = []
    for j, (doc_id, distinct, ids) in enumerate(docs):
        on = slice(cut[j], cut[j + 1])
        out.append((doc_id, *_answer(distinct[ids], start[on] - offsets[j], end[on] - offsets[j], period[on])))
    return out


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def out(docs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_solve(docs), strict=True), types, strict=True)], names=names)

    docs, n = [], 0
    for batch in sliced(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            changed = repeat_words(doc_id, len(words))
            if changed:
                a, p = changed
                ids[a:] = ids[a + np.arange(len(ids) - a) % p]
            distinct = np.empty(len(number), object)
            distinct[:] = list(number)
            docs.append((doc_id, distinct, ids))
            n += len(words)
            if n >= BATCH_WORDS:
                yield out(docs)
                docs, n = [], 0
    if docs:
        yield out(docs)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """By document: the number of its runs, its longest, digests of all runs and of the words that are left when runs keep one period."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_rows, SCHEMA)

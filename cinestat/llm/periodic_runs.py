"""Periodic runs of words: stretches that repeat with a fixed period.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least max(``MIN_LENGTH``, ``MIN_POWER`` x q) words that no
neighbouring word extends with period q.

Method: maximal pairs of a document's suffixes, from a bottom-up walk over its
LCP-interval tree. A run [s, s + n) of period q is a match of n - q words
between s and s + q that can be extended on neither side, that is, a maximal
pair; and a maximal pair at distance q whose match has at least
(``MIN_POWER`` - 1) x q words is a run with a period of q. Nothing is extended
afterwards. A run of more than twice the least power is also found with
multiples of its period; the smallest distance at the same place is its period.

- Every interval keeps its suffixes by their left word (class lists) and in
  order. Two children are joined by looking up the smaller one's suffixes in the
  larger one, so a suffix is moved at most log n times. Suffixes of different
  children differ on the right; those of different classes differ on the left.
- Only pairs within a third of the interval's depth are looked for. Of three
  matches i < j < k that lie that close, j and k have the same left word (it
  stands inside the match at i). So the later matches of a suffix within reach
  are of one class, and of the earlier ones only the first can be of another:
  what is looked at is what is found.
- A pair's match has five words or more (with these limits), so the tree is
  needed from there on, and only stretches covered by windows of that many words that recur in the same stretch enter it (the two
  sides of a run's pair touch, so they share a stretch).

Documents are whole: a task takes them in Arrow batches and works on some
``CHUNK_BYTES`` of text at once, or on one longer document (about 30 integers a
word of its repeating stretches). There is no shuffle.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have no
words and no runs; repeated rows and rows without id are treated like any other;
other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinestat.llm.common import arrow_map, named, prepare

MIN_LENGTH = 6
MIN_POWER = 4
CHUNK_BYTES = 2 << 20

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Interval:
    """Suffixes below an LCP interval: in order, and by their left word."""

    __slots__ = ("order", "lists")

    def __init__(self, at: int, left: int):
        self.order = [at]
        self.lists = {left: [at]}

    def take(self, other: _Interval) -> None:
        _merge(self.order, other.order)
        for c, at in other.lists.items():
            mine = self.lists.get(c)
            if mine is None:
                self.lists[c] = at
            elif len(mine) < len(at):
                _merge(at, mine)
                self.lists[c] = at
            else:
                _merge(mine, at)


def _merge(into: list[int], more: list[int]) -> None:
    if 16 * len(more) < len(into):
        for x in more:
            insort(into, x)
    else:
        into.extend(more)
        into.sort()


def maximal_pairs(sa: list[int], lcp: list[int], left: list[int], part: int, found: dict[tuple[int, int], int]) -> None:
    """Maximal pairs of the suffixes ``sa`` whose distance is at most the match's
    length over ``part``, as found[start, end] = smallest distance; lcp[r] is the
    match of sa[r - 1] and sa[r], left[i] the word before i."""

    def join(a: _Interval, b: _Interval, depth: int) -> _Interval:
        small, large = (a, b) if len(a.order) < len(b.order) else (b, a)
        reach, order = depth // part, large.order
        for c, positions in small.lists.items():
            for p in positions:
                at = bisect_left(order, p)
                if at < len(order) and order[at] - p <= reach:
                    later = left[order[at]]
                    if later != c:
                        same = large.lists[later]
                        for k in range(bisect_left(same, p), len(same)):
                            q = same[k] - p
                            if q > reach:
                                break
                            key = p, p + q + depth
                            if found.get(key, q) >= q:
                                found[key] = q
                if at and p - order[at - 1] <= reach:
                    first = order[bisect_left(order, p - reach)]
                    if left[first] != c:
                        key = first, p + depth
                        if found.get(key, p - first) >= p - first:
                            found[key] = p - first
        large.take(small)
        return large

    depths, open_ = [], []
    now = _Interval(sa[0], left[sa[0]])
    for r in range(1, len(sa) + 1):
        depth = lcp[r] if r < len(sa) else -1
        while depths and depths[-1] > depth:
            now = join(open_.pop(), now, depths.pop())
        if r == len(sa):
            return
        if depths and depths[-1] == depth:
            open_[-1] = join(open_[-1], now, depth)
        else:
            depths.append(depth)
            open_.append(now)
        now = _Interval(sa[r], left[sa[r]])


def _recurring(words: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Positions whose window of ``width`` words recurs in its own stretch of
    such positions. Windows are compared by hash; a collision keeps a position
    too many, which the tree then tells apart."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)  # 2^64 / golden ratio
    for k in range(width):
        h = (h ^ words[k:k + n].astype(np.uint64)) * mul
        h ^= h >> np.uint64(31)
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    group = doc[at].astype(np.uint64)
    while len(at):
        key = (h[at] ^ (group * mul)) * mul
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.all():
            break
        at = at[twice]
        if len(at):
            group = _stretches(at, doc, width).astype(np.uint64)
    return at


def _stretches(at: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the stretches that the windows at ``at`` cover without a gap."""
    return np.concatenate([[0], np.cumsum((np.diff(at) > width) | (np.diff(doc[at]) != 0))])


def _suffixes(x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP values of the stretches in ``x`` (end[i]: where i's
    stretch ends; no value is in two stretches), by prefix doubling. The ranks of
    every doubling are kept, and the LCP values are read off them."""
    m = len(x)
    at = np.arange(m)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    levels, k = [rank.astype(np.int32)], 1
    while True:
        far = at + k
        second = np.where(far < end, rank[np.minimum(far, m - 1)], 0)
        key = rank * (m + 1) + second
        order = np.argsort(key)
        s = key[order]
        dense = np.concatenate([[1], 1 + np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(m, np.int64)
        rank[order] = dense
        if dense[-1] == m:
            break
        k *= 2
        levels.append(rank.astype(np.int32))
    i, j, n = order[:-1], order[1:], np.zeros(m - 1, np.int64)
    for t in range(len(levels) - 1, -1, -1):
        a, b = i + n, j + n
        inside = (a < end[i]) & (b < end[j])
        equal = inside & (levels[t][np.minimum(a, m - 1)] == levels[t][np.minimum(b, m - 1)])
        n[equal] += 1 << t
    return order, np.concatenate([[0], n])


def find_runs(words: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH,
              min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start; ``doc`` numbers the document
    of each word, ascending, and no run crosses documents."""
    part = min_power - 1
    least = min(max(part * q, min_length - q) for q in range(1, max(min_length, 1) + 1))  # a pair's shortest match
    at = _recurring(words, doc, least)
    if not len(at):
        return []
    first = np.flatnonzero(np.diff(_stretches(at, doc, least), prepend=-1))
    start, last = at[first], at[np.concatenate([first[1:], [len(at)]]) - 1]
    size = last - start + least
    base = np.concatenate([[0], np.cumsum(size)])
    # every stretch with the words its last window covers
    stretch = np.repeat(np.arange(len(size)), size)
    place = np.arange(base[-1]) - base[stretch] + start[stretch]
    wide = int(words.max()) + 1
    sa, lcp = _suffixes(stretch * wide + words[place], base[stretch + 1])
    left = np.where((place > 0) & (doc[place] == doc[place - 1]), words[place - 1], -1)

    # the tree from depth `least` on falls into intervals; those without two suffixes close enough hold no run
    cut = np.flatnonzero(lcp < least)
    group = np.cumsum(lcp < least) - 1
    by = np.argsort(group * len(sa) + sa)
    gap = np.full(len(sa), len(sa) + 1)
    gap[1:] = np.where(group[by[1:]] == group[by[:-1]], np.diff(sa[by]), len(sa) + 1)
    hold = np.flatnonzero(np.minimum.reduceat(gap, cut) * part <= np.maximum.reduceat(np.where(lcp < least, 0, lcp), cut))
    found: dict[tuple[int, int], int] = {}
    lefts, ends = left.tolist(), np.concatenate([cut, [len(sa)]])
    for g in hold.tolist():
        a, b = ends[g], ends[g + 1]
        maximal_pairs(sa[a:b].tolist(), lcp[a:b].tolist(), lefts, part, found)
    return sorted((int(place[s]), e - s, q) for (s, e), q in found.items() if e - s >= min_length)


def _scan(min_length: int, min_power: int):
    def chunk(ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
        split = [(t or b"").split() for t in texts]  # bytes: ASCII white space only
        sizes = np.array([len(s) for s in split])
        flat = [w for s in split for w in s]
        runs: list[list[dict]] = [[] for _ in split]
        drop = np.zeros(len(flat) + 1, np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)])
        if flat:
            codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(split)), sizes)
            for s, n, q in find_runs(codes, doc, min_length, min_power):
                d = int(doc[s])
                runs[d].append({"start": s - int(base[d]), "length": n, "period": q})
                drop[s + q] += 1
                drop[s + n] -= 1
        gone = np.cumsum(drop) > 0
        out = []
        for d, s in enumerate(split):
            if runs[d]:
                keep = ~gone[base[d]:base[d + 1]]
                s = [w for w, k in zip(s, keep.tolist(), strict=True) if k]
            out.append(b" ".join(s))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, RUNS),
                                           pa.array(out, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes | None] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or b"")
                if size >= CHUNK_BYTES:
                    yield chunk(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield chunk(ids, texts)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_power: int = MIN_POWER) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: its runs by start and period,
    and its words without those that a run repeats after its first period,
    joined by one blank."""
    if min_power < 2:
        raise ValueError("a run needs at least two periods")
    prepare(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").cast("binary").alias("text"))
    found = arrow_map(rows, _scan(min_length, min_power),
                      "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))

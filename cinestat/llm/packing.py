"""Mixture-controlled packing of documents into training sequences.

Each source is a queue of tokens (its documents in file order, each closed by a
separator id). A deficit round-robin serves the queues: in every window of
``window`` tokens a queue's counter earns its share of the window, whole tokens
are served, and the fraction that is left stays as its deficit for the next
window. After w windows the counter of a queue with weight g of G has earned
g * window * w / G tokens, so served tokens and deficit follow from w alone:
``Rotation.served`` and ``Rotation.deficit``. Any task can therefore take up the
rotation at any window with the deficits carried into it, and partitions need
no token of one another. When a queue runs dry the others share its part (a new
epoch with carried counters).

The served tokens form one stream, cut every ``length`` tokens; the rest at the
end is cut into powers of two. No sequence needs padding. Default targets are
the queues' own token counts, so that all run dry together and every window
holds the corpus mixture; other targets are given as ``{source: weight}``.

Spark passes: tokenise and write packed ids with each partition's running count
per queue; add up counts per (queue, partition) for the queues' offsets; cut.
Only one row per queue reaches the driver. With more than ``max_queues`` distinct
sources, every source with a target and the ``max_queues / 2`` largest by bytes
stay queues of their own; only the rest, without targets, share queues by hash.
A target whose source is not in the table is an error.

Defined results: a null text is empty (its separator alone); a null source is
the queue of the empty name; repeated rows are packed as often as they occur; an
empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinestat.llm.bytebpe import loaded
from cinestat.llm.common import arrow_map, named, prepare, written

LENGTH = 1024
WINDOW = 64 * LENGTH
SEPARATOR = 0
MAX_QUEUES = 1024
SHARED = "\0shared "  # before the number of a queue that small sources share

TOKEN_SCHEMA = "part long, doc_id long, queue string, ids binary, n long, before long"
PIECE_SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
                "window long, queue string, ids binary")


class Epoch:
    """Windows during which the same queues hold tokens."""

    def __init__(self, position: int, first_window: int, begun: list[int], left: list[int], weights: list[int], window: int):
        self.position, self.first_window = position, first_window
        self.begun, self.left, self.window = begun, left, window
        active = [bool(n) for n in left]
        self.weights = [g if a else 0 for g, a in zip(weights, active, strict=True)]
        if not any(self.weights):  # only queues without a target are left
            self.weights = list(left)
        self.total = sum(self.weights)
        # the epoch ends with the window in which its first queue runs dry
        self.windows = min(-(-n * self.total // (g * window)) for n, g in zip(left, self.weights, strict=True) if g)

    @lru_cache(maxsize=4096)  # noqa: B019  an epoch lives as long as its task
    def served(self, w: int) -> tuple[int, ...]:
        """Tokens that each queue has given before the epoch's window w."""
        return tuple(min(n, g * self.window * w // self.total) for n, g in zip(self.left, self.weights, strict=True))

    def deficit(self, w: int) -> tuple[float, ...]:
        """What each counter carries into window w, below one token."""
        return tuple(g * self.window * w % self.total / self.total for g in self.weights)

    def window_of(self, q: int, token: int) -> int:
        """The window that serves the queue's token."""
        return -(-(token + 1) * self.total // (self.weights[q] * self.window)) - 1


class Rotation:
    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW,
                 length: int = LENGTH):
        self.queues = sorted(totals)
        self.index = {q: i for i, q in enumerate(self.queues)}
        self.length = length
        left = [totals[q] for q in self.queues]
        self.tokens = sum(left)
        if targets is None:
            weights = list(left)
        else:
            weights = [round(targets.get(q, 0) * (1 << 32)) for q in self.queues]
        self.epochs: list[Epoch] = []
        begun, position, first = [0] * len(left), 0, 0
        while any(left):
            e = Epoch(position, first, begun, left, weights, window)
            self.epochs.append(e)
            given = e.served(e.windows)
            begun = [b + n for b, n in zip(begun, given, strict=True)]
            left = [n - m for n, m in zip(left, given, strict=True)]
            position += sum(given)
            first += e.windows
        # where sequences begin after the last full one
        self.full = self.tokens // length * length
        self.tail, at = [], self.full
        for bit in reversed(range(max(length.bit_length(), 1))):
            if (self.tokens - self.full) >> bit & 1:
                self.tail.append((at, 1 << bit))
                at += 1 << bit

    def runs(self, queue: str, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
        """The queue's tokens a..b as (first, last + 1, place in the stream, window)."""
        q = self.index[queue]
        for e in self.epochs:
            lo, hi = e.begun[q], e.begun[q] + e.served(e.windows)[q]
            x, end = max(a, lo), min(b, hi)
            while x < end:
                w = e.window_of(q, x - lo)
                now, after = e.served(w), e.served(w + 1)
                y = min(end, lo + after[q])
                place = e.position + sum(now) + sum(after[:q]) - sum(now[:q]) + (x - lo - now[q])
                yield x, y, place, e.first_window + w
                x = y

    def sequence(self, place: int) -> tuple[int, int, int]:
        """(sequence, offset in it, tokens to its end) of a place in the stream."""
        if place < self.full:
            return place // self.length, place % self.length, self.length - place % self.length
        for i, (at, size) in enumerate(self.tail):
            if place < at + size:
                return self.full // self.length + i, place - at, at + size - place
        raise ValueError(f"no place {place} in a stream of {self.tokens} tokens")

    def pieces(self, queue: str, a: int, b: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(first token, tokens, sequence, offset, window) of the tokens a..b."""
        for x, y, place, w in self.runs(queue, a, b):
            while x < y:
                s, off, room = self.sequence(place)
                n = min(room, y - x)
                yield x, n, s, off, w
                x += n
                place += n


def _tokenise(path: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        # two bytes an id where the vocabulary allows it
        kind = "<u2" if max(bpe.tok.get_vocab_size(), separator + 1) <= 1 << 16 else "<u4"
        end = np.uint32(separator)
        counts: dict[str, int] = {}
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            queues = b.column("queue").to_pylist()
            ids = [np.append(bpe.ids(t), end) for t in texts]
            before = []
            for q, x in zip(queues, ids, strict=True):
                before.append(counts.get(q, 0))
                counts[q] = before[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("doc_id"), b.column("queue"),
                 pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array(before, pa.int64())],
                names=["part", "doc_id", "queue", "ids", "n", "before"])
    return run


def _cut(rotation: Rotation):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "queue", "ids")}
            for doc, q, raw, n, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "queue", "ids", "n", "at")), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                for x, m, s, off, w in rotation.pieces(q, at, at + n):
                    first = x - at
                    for k, v in zip(cols, (doc, first, m, n, s, off, w, q, ids[4 * first:4 * (first + m)]), strict=True):
                        cols[k].append(v)
            kinds = dict(queue=pa.string(), ids=pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()], names=list(cols))
    return run


def queue_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 separator: int = SEPARATOR, max_queues: int = MAX_QUEUES, targets: dict[str, float] | None = None) -> DataFrame:
    """Tokenised documents with their place in their partition's part of a queue."""
    source = F.coalesce(named(source_col).cast("string"), F.lit(""))
    if docs.select(source.alias("s")).distinct().limit(max_queues + 1).count() > max_queues:
        sizes = (docs.select(source.alias("s"), F.coalesce(F.octet_length(named(text_col)), F.lit(0)).cast("long").alias("n"))
                 .groupBy("s").agg(F.sum("n").alias("n")))
        # at most max_queues / 2 rows
        large = {r["s"] for r in sizes.orderBy(F.desc("n"), "s").limit(max(max_queues // 2, 1)).collect()}
        own = sorted(large | set(targets or ()))
        shared = max(max_queues - len(own), max_queues // 2, 1)
        source = F.when(source.isin(own), source).otherwise(
            F.concat(F.lit(SHARED), F.pmod(F.xxhash64(source), F.lit(shared)).cast("string")))
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), named(id_col).cast("long").alias("doc_id"),
                       source.alias("queue"), named(text_col).alias("text"))
    return written(arrow_map(rows, _tokenise(path, separator), TOKEN_SCHEMA), "pack-tokens")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         targets: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW,
         separator: int = SEPARATOR, max_queues: int = MAX_QUEUES) -> DataFrame:
    """One row per piece: (doc_id, start, length, doc_tokens, sequence_id,
    offset, window, queue, ids), ``ids`` as little-endian unsigned 32-bit."""
    prepare(docs.sparkSession)
    tokens = queue_tokens(docs, path, id_col, text_col, source_col, separator, max_queues, targets)
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("part_tokens"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(parts.withColumn("base", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0))), "pack-offsets")
    # one row per queue, max_queues at most
    totals = {r["queue"]: r["t"] for r in offsets.groupBy("queue").agg(F.sum("part_tokens").alias("t")).collect()}
    if totals and (missing := sorted(set(targets or ()) - set(totals))):
        raise ValueError(f"targets without documents: {missing[:10]}")
    rotation = Rotation(totals, targets, window, length)
    rows = (tokens.join(offsets.select("queue", "part", "base"), ["queue", "part"])
            .select("doc_id", "queue", "ids", "n", (F.col("base") + F.col("before")).alias("at")))
    return arrow_map(rows, _cut(rotation), PIECE_SCHEMA)

"""Near-duplicate groups by 64-bit SimHash and covering locality-sensitive hashing.

A fingerprint bit is set if it is set in over half of the hashes of the text's
word shingles. Two fingerprints are linked when they differ in at most
``radius`` bits, and a group is a connected component of links.

Candidates come from covering masks. Every bit position i gets a vector phi(i)
of radius + 1 bits; for each of the 2^(radius+1) - 1 non-zero vectors v, the mask
of v holds the positions with <phi(i), v> = 1. The at most ``radius`` positions
in which a linked pair differs span a space with a non-zero orthogonal vector, so
some mask avoids all of them: every linked pair collides in some table. No link
is lost, whatever the data.

A bucket is the set of distinct fingerprints that agree under one mask. Buckets
above ``limit`` are found by a partially aggregated count and split by covering
masks over their free bits, again and again: with few free bits left, a bucket
cannot hold more than 2^free distinct fingerprints, so the splitting ends and no
task ever holds more than ``limit``. Inside a bucket a search in blocks emits a
spanning forest of the links (fewer rows than members), never all pairs.

Defined results: a null or empty text has fingerprint 0, linked like any other;
a null id counts as larger than every id (its component takes a real id if it
has one); repeated rows share their group; rows that repeat an id with another
text join their groups; an empty table gives an empty table; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinestat.llm.common import UPPER, arrow_map, broadcast_if_small, fresh, named, prepare, row_key, written

SHINGLE = 3
RADIUS = 3
LIMIT = 1024
SEED = 42
BITS = 64
# levels of splitting; the last one leaves at most 8 free bits at radius 3
DEPTH = 3
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned; the whole word sequence is one shingle if it is too short."""
    words = (text or b"").translate(_LOWER).split()  # at blank, tab, LF, VT, FF and CR
    if not words:
        return 0
    joined, n, h = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = np.zeros(BITS, np.int64)
    count = n - shingle + 1
    for i in range(0, count, _CHUNK):
        a = starts[i:min(i + _CHUNK, count)].tolist()
        b = ends[i + shingle - 1:i + shingle - 1 + len(a)].tolist()
        hashes = np.fromiter((h(joined[x:y], seed) for x, y in zip(a, b, strict=True)), "<u8", len(a))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(total * 2 > count).tolist()))


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over the positions; any ``radius`` of them are
    avoided by at least one mask."""
    dim = radius + 1
    phi = {p: k % ((1 << dim) - 1) + 1 for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (phi[p] & v).bit_count() & 1) for v in range(1, 1 << dim)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def mask_tree(depth: int, radius: int = RADIUS) -> list[list[tuple[int, int, int]]]:
    """Per level the (parent, table, mask) rows; a child's mask holds its parent's."""
    tables = (1 << (radius + 1)) - 1
    levels, last = [], [(0, 0)]
    for _ in range(depth):
        rows = []
        for parent, mask in last:
            free = [p for p in range(BITS) if not mask >> p & 1]
            rows += [(parent, parent * (tables + 1) + k + 1, mask | m) for k, m in enumerate(covering_masks(free, radius))]
        levels.append(rows)
        last = [(t, m) for _, t, m in rows]
    return levels


def _forest(fp: np.ndarray, rep: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that span the components of one bucket of distinct fingerprints."""
    todo = np.arange(1, len(fp))
    seeds = [0]
    while len(todo) or seeds:
        if not seeds:
            seeds, todo = [int(todo[0])], todo[1:]
        s = seeds.pop()
        near = np.bitwise_count(fp[todo] ^ fp[s]) <= radius
        if near.any():
            found = todo[near].tolist()
            todo = todo[~near]
            seeds += found
            yield from ((int(rep[s]), int(rep[x])) for x in found)
        if not len(todo):
            return


def _bucket_links(radius: int):
    """Over rows sorted by (table, key): links inside each bucket."""
    def solve(t, k, fp, rep) -> list[tuple[int, int]]:
        cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
        two = lo[hi - lo == 2]
        close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        out = list(zip(rep[close].tolist(), rep[close + 1].tolist(), strict=True))
        for a, b in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist(), strict=True):
            out += _forest(fp[a:b], rep[a:b], radius)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy() for c in ("table", "key", "fp", "rep")]
            now[2] = now[2].view(np.uint64)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            # the last bucket may go on in the next batch
            last = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1]) + 1 \
                if now[0][0] != now[0][-1] or now[1][0] != now[1][-1] else 0
            held = [x[last:] for x in now]
            if last:
                yield _links(solve(*(x[:last] for x in now)))
        if held is not None:
            yield _links(solve(*held))
    return run


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, text_key, fp) for every row; fp as a signed 64-bit
    integer, ``text_key`` a hash that tells texts of one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), b.column("text_key"),
                 pa.array([_signed(fingerprint(t, shingle)) for t in texts], pa.int64())], names=["doc_id", "row_key", "text_key", "fp"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), row_key(named(id_col), named(text_col)).alias("row_key"),
                       text_key(named(text_col)).alias("text_key"), named(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, row_key long, text_key long, fp long")


def near_links(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints (``fps``: fp), enough of them
    to connect every group."""
    spark = fps.sparkSession
    levels = mask_tree(DEPTH, radius)
    most = 1 << max(BITS - (m % (1 << BITS)).bit_count() for _, _, m in levels[-1])
    if limit < most:
        raise ValueError(f"limit must be at least {most}: the last level's buckets may hold as many fingerprints")
    links = None
    rows = fps.select("fp", F.col("fp").alias("rep"))
    for level in levels:
        if "parent" not in rows.columns:  # the first level's masks are a literal
            masked = rows.select("*", F.inline(F.array(*(F.struct(F.lit(t).alias("table"), F.lit(_signed(m)).alias("mask")) for _, t, m in level))))
        else:
            # 225 or 3375 masks: a fixed bound
            masks = spark.createDataFrame([(p, t, _signed(m)) for p, t, m in level], "parent int, table int, mask long")
            masked = rows.join(F.broadcast(masks), "parent")
        keyed = (masked
                 .select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep"))
        large = written(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
                        .select("table", "key"), "simhash-large")
        none = large.isEmpty()
        small = keyed if none else keyed.join(large, ["table", "key"], "left_anti")
        found = arrow_map(small.repartition("table", "key").sortWithinPartitions("table", "key", "fp"),
                          _bucket_links(radius), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if none:
            break
        rows = written(keyed.join(large, ["table", "key"], "left_semi")
                       .select(F.col("table").alias("parent"), "fp", "rep"), "simhash-split")
    return links


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest
    node of its component. Large-star / small-star rounds over written tables,
    until every node hangs on its root; hubs are handled by aggregated minima
    and joins, so no task gathers a node's neighbours."""
    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
                "components")
    while True:
        roles = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unsettled = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if unsettled.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = written(small, "components")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, limit: int) -> DataFrame:
    """(doc_id, row_key, text_key, fp, root): root is the smallest fingerprint of
    the row's group."""
    prepare(docs.sparkSession)
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    fps = written(rows.select("fp").distinct(), "simhash-distinct")
    roots = connected(near_links(fps, radius, limit)).withColumnRenamed("node", "fp")
    return written(rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-groups")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, row_key, fp, component), one row per row of ``docs``;
    ``component`` is the smallest row key of the group. Fingerprints are linked,
    not rows: texts that share an id do not join their groups."""
    groups = _grouped(docs, id_col, text_col, shingle, radius, limit)
    least = groups.groupBy("root").agg(F.min("row_key").alias("component"))
    return groups.join(least, "root").select("doc_id", "row_key", "fp", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id
    (of several texts with that id, the one with the smallest hash); all columns
    as they are. Rows are decided by id and text."""
    groups = _grouped(docs, id_col, text_col, shingle, radius, limit)
    first = groups.groupBy("root").agg(F.min(F.struct("row_key", "text_key")).alias("first"))
    per_key = groups.groupBy("root", "row_key", "text_key").agg(F.count(F.lit(1)).alias("copies")).join(first, "root")
    key, text, k_key, k_text = fresh(docs, "key", "text_key", "listed_key", "listed_text")
    stays = F.struct("row_key", "text_key") == F.col("first")
    listed = written(per_key.where(~stays | (F.col("copies") > 1))
                     .select(F.col("row_key").alias(k_key), F.col("text_key").alias(k_text), stays.alias("stays")), "simhash-drops")
    rows = docs.withColumn(key, row_key(named(id_col), named(text_col))).withColumn(text, text_key(named(text_col)))
    match = (named(key) == named(k_key)) & (named(text) == named(k_text))
    left = rows.join(broadcast_if_small(listed, 24), match, "left_anti").drop(key, text)
    again = listed.where("stays")
    if again.isEmpty():
        return left
    return left.unionByName(rows.join(broadcast_if_small(again, 24), match, "left_semi").dropDuplicates([key, text]).drop(key, text))

"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z. A digest shared by a
large part of the corpus would send all its rows to one reducer, so frequent
digests take another road:

1. every input partition runs Misra-Gries with ``counters`` counters; a digest
   with more than N/counters rows survives in at least one partition,
2. the summaries are merged (the same rule, group by group, so that no task
   reads more than a bounded number of entries) to at most ``counters``
   candidates,
3. one map-side aggregation over all rows verifies the candidates: exact count
   and largest id. The winners, at most ``counters`` rows, are broadcast,
4. rows of a winner are decided in place, without a shuffle; all other rows are
   shuffled by digest, where a group is at most N/counters rows by
   construction.

Defined results: a null text counts as empty; a row with a null id loses to any
row with one; of repeated rows (same id, same text) one stays; an empty table
gives an empty table; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinestat.llm.common import arrow_map, ascii_lower, broadcast_if_small, fresh, named, prepare, written

COUNTERS = 1024
# partitions whose summaries one merge task reads
ROWS_A_BLOCK = 1 << 16  # rows made from a counted repetition at once
MERGE_WIDTH = 64


class MisraGries:
    """At most ``k`` counters. After n insertions each count is too low by at
    most n/(k+1), so an item seen more often than that is always present."""

    def __init__(self, k: int):
        self.k = k
        self.counts: dict[bytes, int] = {}

    def add(self, item: bytes, n: int = 1) -> None:
        c = self.counts
        if item in c:
            c[item] += n
        elif len(c) < self.k:
            c[item] = n
        else:
            cut = min(n, min(c.values()))
            self.counts = {x: v - cut for x, v in c.items() if v > cut}
            if n > cut:
                self.add(item, n - cut)

    def merge(self, items: dict[bytes, int]) -> None:
        """Add the counters, then take the (k+1)-th largest from all of them."""
        c = self.counts
        for x, v in items.items():
            c[x] = c.get(x, 0) + v
        if len(c) > self.k:
            cut = sorted(c.values(), reverse=True)[self.k]
            self.counts = {x: v - cut for x, v in c.items() if v > cut}


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mg, buffer = MisraGries(k), {}
        part = 0
        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            for x in b.column("digest").to_pylist():
                buffer[x] = buffer.get(x, 0) + 1
            if len(buffer) > 4 * k:
                mg.merge(buffer)
                buffer = {}
        mg.merge(buffer)
        kept = {x: v for x, v in mg.counts.items()}
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(kept), pa.int64()),
                                          "digest": pa.array(kept.keys(), pa.binary()),
                                          "n": pa.array(kept.values(), pa.int64())})
    return run


def _merged(k: int):
    def run(key, table):  # applyInArrow reads type hints; partial ones confuse it
        mg = MisraGries(k)
        parts: dict[int, dict[bytes, int]] = {}
        for p, x, n in zip(*(table.column(c).to_pylist() for c in ("part", "digest", "n")), strict=True):
            parts.setdefault(p, {})[x] = n
        for items in parts.values():
            mg.merge(items)
        return pa.table({"part": pa.array([key[0].as_py()] * len(mg.counts), pa.int64()),
                         "digest": pa.array(mg.counts.keys(), pa.binary()),
                         "n": pa.array(mg.counts.values(), pa.int64())})
    return run


def frequent_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, every one with more than N/counters rows
    among them (``digests``: a column ``digest``)."""
    parts = digests.rdd.getNumPartitions()
    s = arrow_map(digests.select(F.spark_partition_id().cast("long").alias("part"), "digest"), _summaries(counters),
                  "part long, digest binary, n long")
    for _ in range(max(1, math.ceil(math.log(max(parts, 2), MERGE_WIDTH)))):
        s = (s.withColumn("grp", F.floor(F.col("part") / MERGE_WIDTH))
             .groupBy("grp").applyInArrow(_merged(counters), "part long, digest binary, n long"))
    return s.select("digest")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept), one row per row of ``docs``."""
    prepare(docs.sparkSession)
    rows = written(docs.select(named(id_col).alias("doc_id"), text_digest(named(text_col)).alias("digest")),
                   "dedup-digests")
    candidates = written(frequent_candidates(rows, counters), "dedup-candidates")
    # at most `counters` rows of 32 bytes: the broadcasts have a fixed bound
    exact = (rows.join(F.broadcast(candidates), "digest")
             .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")))
    frequent = max(1, rows.count() // counters)
    winners = written(exact.where(F.col("group_size") > frequent), "dedup-winners")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    out = ["doc_id", "digest", "keep_id", "group_size", "kept"]
    # below the frequent ones a group has at most N / counters rows: counted, then joined back
    cold = marked.where(F.col("group_size").isNull()).select("doc_id", "digest")
    sizes = cold.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    told = marked.where(F.col("group_size").isNotNull()).unionByName(cold.join(sizes, "digest"))
    at_keep = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lost = told.where(~at_keep).withColumn("kept", F.lit(False))
    # usually one row a digest; repeated rows are counted before the shuffle, and one of them stays
    stay = (told.where(at_keep).groupBy("digest", "doc_id", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {ROWS_A_BLOCK}"))))
            .withColumn("copy", F.explode(F.sequence(F.col("block") * ROWS_A_BLOCK, F.least(F.col("copies"), (F.col("block") + 1) * ROWS_A_BLOCK) - 1)))
            .withColumn("kept", F.col("copy") == 0))
    return lost.select(out).unionByName(stay.select(out))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows ``exact_groups`` drops, all columns as they are.
    Rows are decided by id and digest; the list of those to go is anti-joined."""
    groups = written(exact_groups(docs, id_col, text_col, counters), "dedup-groups")
    dig, k_id, k_digest = fresh(docs, "digest", "listed_id", "listed_digest")
    per_key = groups.groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("copies"))
    listed = written(per_key.where(~F.col("stays") | (F.col("copies") > 1))
                     .select(F.col("doc_id").alias(k_id), F.col("digest").alias(k_digest), "stays"), "dedup-decisions")
    rows = docs.withColumn(dig, text_digest(named(text_col)))
    match = named(id_col).eqNullSafe(named(k_id)) & (named(dig) == named(k_digest))
    left = rows.join(broadcast_if_small(listed, 64), match, "left_anti").drop(dig)
    again = listed.where("stays")
    if again.isEmpty():
        return left
    # repeated rows of a kept document: one of each stays
    return left.unionByName(rows.join(broadcast_if_small(again, 64), match, "left_semi").dropDuplicates([id_col, dig]).drop(dig))

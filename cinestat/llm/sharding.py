"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes are aggregated per
slot; a versioned table maps slots to shards. Balancing only ever looks at and
edits the map (``slots`` rows, a fixed bound), never at the records: a new
shard, or a rebalance, moves whole slots.

Defined results: a null text has no bytes (its row still counts the fixed
overhead); a null key is replaced by a hash of the text; repeated rows share a
slot; an empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinestat.llm.common import named, prepare, written

SLOTS = 8192
ROW_OVERHEAD = 16
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long"

Slot = tuple[int, int, int]  # virtual slot, bytes, rows


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))),
                  F.lit(slots)).cast("int")


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + F.lit(ROW_OVERHEAD)


def slot_sizes(rows: DataFrame) -> list[Slot]:
    """Bytes and rows of each slot that has rows: at most ``slots`` rows reach
    the driver, whatever the input."""
    agg = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    return sorted((r["virtual_slot"], r["b"], r["n"]) for r in agg.collect())


def balanced_map(sizes: list[Slot], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: the largest slot first, each to the lightest shard. Slots
    without rows go round by number, so the map covers every slot."""
    heap = [(0, s) for s in range(shards)]
    out = {v: v % shards for v in range(slots)}
    for v, b, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (load + b, s))
    return out


def rebalanced_map(current: dict[int, int], sizes: list[Slot], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The map edited for ``shards`` shards: slots leave only shards above the
    mean (or shards that no longer exist) and go to the lightest one, until
    every shard lies within ``tolerance`` of the mean or no move helps."""
    out = dict(current)
    size = {v: b for v, b, _ in sizes}
    load = dict.fromkeys(range(shards), 0)
    homeless = []
    for v, s in out.items():
        if s in load:
            load[s] += size.get(v, 0)
        else:
            homeless.append(v)
    for v in sorted(homeless, key=lambda v: (-size.get(v, 0), v)):
        s = min(load, key=lambda s: (load[s], s))
        out[v] = s
        load[s] += size.get(v, 0)
    mean = sum(load.values()) / max(shards, 1)
    own: dict[int, list[int]] = {s: [] for s in load}
    for v, s in out.items():
        if size.get(v, 0):
            own[s].append(v)
    for s in sorted(load, key=lambda s: (-load[s], s)):
        for v in sorted(own[s], key=lambda v: (-size[v], v)):
            to = min(load, key=lambda x: (load[x], x))
            if load[s] <= mean * (1 + tolerance) or to == s:
                break
            if load[to] + size[v] <= max(mean * (1 + tolerance), load[s] - size[v]):
                out[v] = to
                load[s] -= size[v]
                load[to] += size[v]
    return out


def map_table(spark: SparkSession, mapping: dict[int, int], sizes: list[Slot], version: int) -> DataFrame:
    by = {v: (b, n) for v, b, n in sizes}
    return spark.createDataFrame([(version, v, s, *by.get(v, (0, 0))) for v, s in sorted(mapping.items())], MAP_SCHEMA)


def save_map(table: DataFrame, path: str) -> None:
    """Append a version; older versions stay readable."""
    table.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def newest_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]] | None:
    """The newest stored version and its map, a row a slot; None without any."""
    try:
        table = load_map(spark, path)
    except AnalysisException:
        return None
    rows = table.select("version", "virtual_slot", "shard").collect()
    return (rows[0]["version"], {r["virtual_slot"]: r["shard"] for r in rows}) if rows else None


def sized_rows(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    text = named(text_col)
    return docs.select(named(key_col).alias("doc_id"), row_size(text).alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                       virtual_slot(named(key_col), text, slots).alias("virtual_slot"))


def assign_shards(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the row's gapless place within its
    shard: rows are numbered inside each virtual slot (thousands of groups of
    equal expected size), and the map gives each slot its offset."""
    base = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(base), F.lit(0)).alias("base"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # the map has one row per virtual slot, a fixed number
    return (rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(places), "virtual_slot")
            .withColumn("slot", F.col("base") + F.col("nth") - 1).drop("base", "nth"))


def shard_documents(docs: DataFrame, shards: int, map_path: str, key_col: str = "doc_id", text_col: str = "text",
                    slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) under the newest map
    at ``map_path``: it is edited for the slots' sizes and the number of shards of
    now and stored as the next version, so rows move only with a slot that had to
    leave its shard. Without a stored map version 1 is built."""
    spark = prepare(docs.sparkSession)
    rows = written(sized_rows(docs, key_col, text_col, slots), "shard-rows")
    sizes = slot_sizes(rows)
    newest = newest_map(spark, map_path)
    if newest is None:
        version, mapping = 1, balanced_map(sizes, shards, slots)
    else:
        version, current = newest
        if len(current) != slots:
            raise ValueError(f"the map at {map_path} has {len(current)} slots")
        version, mapping = version + 1, rebalanced_map(current, sizes, shards)
    save_map(map_table(spark, mapping, sizes, version), map_path)
    return assign_shards(rows, load_map(spark, map_path, version))

"""Helpers shared by the document operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinestat.session import ensure_checkpoint_dir, scratch_path

# documents in one Arrow batch: bounds a Python worker's memory when texts are long
ARROW_ROWS = 512

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches (long
    texts), UTC, and a shared checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: later
    passes read the files, and a lost executor re-reads instead of recomputing.
    The schema is given, so an empty table keeps its columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# a list of rows up to this size is broadcast
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(rows: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` (a written table of rows of about ``row_bytes``) marked for a
    broadcast if they take at most ``most`` bytes; beyond that the join is left to
    the planner, which deals both sides out by the key."""
    return F.broadcast(rows) if rows.count() * row_bytes <= most else rows


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built from ``names`` that do not clash with ``df``'s own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"_{n}"
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        out.append(c)
    return out


def named(c: str) -> Column:
    """The column called exactly ``c`` (dots and blanks included)."""
    return F.col(f"`{c.replace('`', '``')}`")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def row_key(doc_id: Column, text: Column) -> Column:
    """The document's id as a long; a row without one gets a key from its text
    above 2^62, so that it sorts after every real id."""
    top = F.lit(1 << 62)
    return F.coalesce(doc_id.cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(top - 1).bitwiseOR(top))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def held_out(doc_id: Column) -> Column:
    """The fold kept out of every fit: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))

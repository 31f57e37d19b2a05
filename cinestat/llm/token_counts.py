"""Token counts per field and section, attributed by token offsets.

Encoding fields one by one would give other tokens than encoding the document.
So the whole document (its fields, each followed by a separator) is encoded
once; the tokens' character spans are joined to the spans of the sections, and
every token is counted exactly once or in parts that add up to one. Sections
tile the document: a separator or line end belongs to what it closes.

A token that crosses a boundary is allocated by the chosen rule:

* ``start``: to the section that holds its first character,
* ``most``: to the section that holds most of its characters, the first of
  equals,
* ``share``: to each section in proportion to the characters it holds.

A token that holds only a part of a character's bytes counts as spanning the
character. The spans and the sections of a document lie in one row, so the
interval join is a sorted search inside the task; documents move nowhere.

Defined results: a null field counts as empty; every field has at least one
section, empty ones with 0 tokens; repeated rows are counted as often as they
occur; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinestat.llm.bytebpe import loaded
from cinestat.llm.common import arrow_map, named, prepare

RULES = ("start", "most", "share")
SCHEMA = "doc_id long, field string, section int, start long, end long, n_tokens double, crossing long, doc_tokens long"


def char_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and last + 1 of tokens of the given byte sizes."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and crossing tokens that begin in it. ``bounds`` are
    the sections' first characters and, last, the document's length."""
    sections = len(bounds) - 1
    first = np.searchsorted(bounds[:-1], start, "right") - 1
    last = np.searchsorted(bounds[:-1], end - 1, "right") - 1
    cross = first != last
    crossing = np.bincount(first[cross], minlength=sections)
    if rule == "start":
        return np.bincount(first, minlength=sections).astype(float), crossing
    out = np.bincount(first[~cross], minlength=sections).astype(float)
    for a, b, i, j in zip(start[cross].tolist(), end[cross].tolist(), first[cross].tolist(), last[cross].tolist(), strict=True):
        part = np.minimum(bounds[i + 1:j + 2], b) - np.maximum(bounds[i:j + 1], a)
        if rule == "most":
            out[i + int(np.argmax(part))] += 1
        else:
            out[i:j + 1] += part / (b - a)
    return out, crossing


def _document(values: list[str], names: list[str], split: dict[str, str], separator: str) -> tuple[str, list, list[int]]:
    """The whole text, its (field, section number) list and their bounds."""
    sections, bounds, at = [], [], 0
    for name, v in zip(names, values, strict=True):
        cut = split.get(name)
        parts = [p + cut for p in v.split(cut)] if cut else [v]
        if cut:
            parts[-1] = parts[-1][:-len(cut)]
            if len(parts) > 1 and not parts[-1]:
                parts.pop()  # the text ends with a line end: no section after it
        parts[-1] += separator
        for k, p in enumerate(parts):
            sections.append((name, k))
            bounds.append(at)
            at += len(p)
    return separator.join(values) + separator, sections, [*bounds, at]


def attribute_tokens(docs: DataFrame, path: str, fields: list[str], id_col: str = "doc_id",
                     split: dict[str, str] | None = None, separator: str = "\n", rule: str = "most") -> DataFrame:
    """One row per section of each document. ``split`` names the fields that
    are cut into sections and the string that closes a section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    split = split or {}
    cols = [f"f{i}" for i in range(len(fields))]
    rows = docs.select(named(id_col).cast("long").alias("doc_id"),
                       *(F.coalesce(named(f).cast("string"), F.lit("")).alias(c) for f, c in zip(fields, cols, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sizes = bpe.byte_lengths()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "field", "section", "start", "end", "n_tokens", "crossing", "doc_tokens")}
            for doc, *values in zip(b.column("doc_id").to_pylist(), *(b.column(c).to_pylist() for c in cols), strict=True):
                text, sections, bounds = _document(values, fields, split, separator)
                ids = bpe.ids(text)
                start, end = char_spans(text, sizes[ids])
                n, crossing = allocate(start, end, np.array(bounds), rule)
                out["doc_id"] += [doc] * len(sections)
                out["field"] += [f for f, _ in sections]
                out["section"] += [k for _, k in sections]
                out["start"] += bounds[:-1]
                out["end"] += bounds[1:]
                out["n_tokens"] += n.tolist()
                out["crossing"] += crossing.tolist()
                out["doc_tokens"] += [len(ids)] * len(sections)
            kinds = dict(field=pa.string(), section=pa.int32(), n_tokens=pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return arrow_map(rows, run, SCHEMA)


def field_totals(sections: DataFrame) -> DataFrame:
    """Tokens per field over the corpus."""
    return sections.groupBy("field").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("sections"))

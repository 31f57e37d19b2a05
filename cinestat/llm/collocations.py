"""Phrase collocations of two and three words, by stripes.

A text is lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these
into words ``[^\\x20\\x09]+``. Everything is counted per language.

Stripes: every prefix keys an associative counter of next words. There are two
kinds of prefix, the empty one (its counter holds the words) and two words (its
counter holds the third, or the piece's end). Stripes of the same prefix are
merged elementwise, and one merged structure gives all that is asked for:

- a stripe's elements are the phrase's extensions (frequencies of three words),
- its total, the end included, is the prefix's frequency (two words; all words
  of the language for the empty prefix),
- its largest element is the most frequent phrase that the prefix begins; the
  same maximum over the phrases it ends comes from the frequent ones.

Each map task merges the stripes of some ``CHUNK`` words before anything is
shuffled and sends every reduce partition one block of stripes (prefixes, sizes,
next words and counts in arrays, words as numbers of the block's own list). A
block belongs to a partition by the hash of its prefixes; the empty prefix, which
every word is an element of, is split by the hash of the next word. So a hot
prefix reaches a partition as at most one stripe a chunk, already counted; a
reduce task folds the blocks it reads into what it has, and holds distinct
entries only. Prefixes and elements below ``min_count`` end there; what is left
is joined as tables.

``score`` = floor(``SCALE`` x a^2 / (l x r)) in decimals of 38 digits, exact for
frequencies up to 10^15.

Defined results: a null text counts as empty, a null language as ``und``; empty
texts add nothing; repeated rows count again; doc_id and other columns are not
read; an empty table gives an empty table. One piece (not one text) longer than
a task's memory is the limit of size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinestat.llm.common import UPPER, arrow_map, named, prepare, written

MIN_COUNT = 10
COVER_PCT = 50
TOP = 2000
SCALE = 1_000_000
CHUNK = 1 << 21  # words a task counts at once
SLICE = 8 << 20  # bytes of a text cut into words at once
SALTS = 32
BLOCK_ENTRIES = 1 << 15
BLOCKS_A_BATCH = 64

_MARK = b"."
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes.maketrans(UPPER.encode() + _BREAKS + b"\t", UPPER.lower().encode() + _MARK * len(_BREAKS) + b" ")
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")

BLOCK = ("part int, langs array<string>, words binary, lang array<int>, first array<int>, second array<int>, "
         "size array<int>, next array<int>, n array<long>")
COUNTS = "lang string, kind int, w1 binary, w2 binary, w3 binary, n long, most long"


def slices(text: bytes) -> Iterator[bytes]:
    """The text, cut at piece ends after every ``SLICE`` bytes."""
    a = 0
    while len(text) - a > SLICE:
        m = _BREAK.search(text, a + SLICE)
        if m is None:
            break
        yield text[a:m.start()]
        a = m.end()
    yield text[a:] if a else text


def tokens(text: bytes) -> list[bytes]:
    """Words, with a mark at the end of every piece."""
    return (text.translate(_NORMAL).replace(_MARK, b" . ") + b" .").split()


def fold(lang: np.ndarray, first: np.ndarray, second: np.ndarray, after: np.ndarray, n: np.ndarray,
         wide: int) -> tuple[np.ndarray, ...]:
    """Equal entries added up, sorted by prefix; all codes lie from -1 to ``wide`` - 2."""
    prefix = ((lang + 1) * wide + first + 1) * wide + second + 1
    at = np.argsort(prefix)
    rank = np.empty(len(at), np.int64)
    s = prefix[at]
    rank[at] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    key = rank * wide + after + 1
    at = np.argsort(key)
    s = key[at]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.add.reduceat(n[at], head)
    at = at[head]
    return lang[at], first[at], second[at], after[at], total


def _mixed(*codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)  # 2^64 / golden ratio
        h ^= h >> np.uint64(29)
    return h


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _stripes(parts: int):
    def chunk(langs: list[str], flat: list[bytes], of: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        w = coded.indices.to_numpy().astype(np.int64)
        lang = np.repeat(np.array([x for x, _ in of], np.int64), [k for _, k in of])
        mark = words.index(_MARK)
        real = w != mark
        wide = max(len(words), len(langs)) + 2
        one = np.flatnonzero(real)
        two = np.flatnonzero(real[:-1] & real[1:])  # a mark is always last
        none = np.full(len(one), -1)
        after = np.where(real[two + 2], w[two + 2], -1)
        entries = fold(np.concatenate([lang[one], lang[two]]), np.concatenate([none, w[two]]),
                       np.concatenate([none, w[two + 1]]), np.concatenate([w[one], after]),
                       np.ones(len(one) + len(two), np.int64), wide)
        lang, first, second, after, n = entries
        h = np.array([zlib.crc32(x) for x in words], np.uint64)
        hl = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)
        whole = first < 0
        part = (_mixed(hl[lang], np.where(whole, h[after], h[first]), np.where(whole, 0, h[second])) % np.uint64(parts)).astype(np.int64)
        at = np.argsort(part, kind="stable")
        lang, first, second, after, n, part = (x[at] for x in (lang, first, second, after, n, part))
        # blocks: of one partition, and of at most BLOCK_ENTRIES
        head = _heads(part)
        cut = np.concatenate([_heads(part, (np.arange(len(part)) - np.repeat(head, np.diff(head, append=len(part)))) // BLOCK_ENTRIES),
                              [len(part)]])
        known = np.array(words, object)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            used, codes = np.unique(np.concatenate([first[a:b], second[a:b], after[a:b], [-1]]), return_inverse=True)
            c1, c2, c3 = (codes[k * (b - a):(k + 1) * (b - a)] - 1 for k in range(3))
            head = _heads(lang[a:b], c1, c2)
            ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part[a]], pa.int32()), pa.array([langs], pa.list_(pa.string())),
                 pa.array([b" ".join(known[used[1:]].tolist())], pa.binary()),
                 ints(lang[a:b][head]), ints(c1[head]), ints(c2[head]), ints(np.diff(head, append=b - a)), ints(c3),
                 pa.array([n[a:b]], pa.list_(pa.int64()))],
                names=["part", "langs", "words", "lang", "first", "second", "size", "next", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        flat: list[bytes] = []
        of: list[tuple[int, int]] = []
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                code = langs.setdefault(lang, len(langs))
                for piece in slices(t.as_py()):
                    found = tokens(piece)
                    flat += found
                    of.append((code, len(found)))
                    if len(flat) >= CHUNK:
                        yield from chunk(list(langs), flat, of)
                        langs, flat, of = {lang: 0}, [], []
                        code = 0
        if flat:
            yield from chunk(list(langs), flat, of)
    return run


class Stripes:
    """Merged stripes of one reduce partition."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.langs: dict[str, int] = {}
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(5))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, langs: list[str], words: bytes, lang, first, second, size, after, n) -> None:
        code = np.array([*(self.words.setdefault(w, len(self.words)) for w in words.split(b" ")), -1], np.int64)  # -1 stays -1
        of = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        self.new.append((np.repeat(of[lang], size), np.repeat(code[first], size), np.repeat(code[second], size), code[after],
                         n.astype(np.int64)))
        self.waiting += len(n)
        if self.waiting > max(1 << 20, 2 * len(self.kept[0])):
            self.settle()

    def settle(self) -> None:
        if self.new:
            columns = [np.concatenate(c) for c in zip(self.kept, *self.new, strict=True)]
            self.kept = fold(*columns, max(len(self.words), len(self.langs)) + 2)
            self.new, self.waiting = [], 0

    def frequent(self, least: int) -> pa.RecordBatch:
        """Words of a language (kind 0, a part of them), and words (1), pairs (2,
        with their most frequent next word) and triples (3) from ``least`` on."""
        self.settle()
        lang, first, second, after, n = self.kept
        words, langs = np.array([*self.words, None], object), np.array([*self.langs, None], object)
        rows = []
        if len(lang):
            head = _heads(lang, first, second)
            total = np.add.reduceat(n, head)
            # an extension that is no candidate itself covers nothing
            most = np.maximum.reduceat(np.where((after >= 0) & (n >= least), n, 0), head)
            whole = first[head] < 0
            pair = ~whole & (total >= least)
            none = np.full(len(head), -1)
            rows.append((0, lang[head][whole], none[whole], none[whole], none[whole], total[whole], none[whole]))
            rows.append((2, lang[head][pair], first[head][pair], second[head][pair], none[pair], total[pair], most[pair]))
            one, three = (first < 0) & (n >= least), (first >= 0) & (after >= 0) & (n >= least)
            none = np.full(len(lang), -1)
            rows.append((1, lang[one], after[one], none[one], none[one], n[one], none[one]))
            rows.append((3, lang[three], first[three], second[three], after[three], n[three], none[three]))
        kinds = [np.full(len(r[1]), r[0]) for r in rows]
        joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (kinds, *([r[k] for r in rows] for k in range(1, 7)))]
        kind, lang, w1, w2, w3, n, most = joined if rows else [np.zeros(0, np.int64)] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(langs[lang].tolist(), pa.string()), pa.array(kind, pa.int32()),
             *(pa.array(words[w].tolist(), pa.binary()) for w in (w1, w2, w3)), pa.array(n, pa.int64()), pa.array(most, pa.int64())],
            names=["lang", "kind", "w1", "w2", "w3", "n", "most"])


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for b in batches:
            langs, words = b.column("langs").to_pylist(), b.column("words").to_pylist()
            for i in range(b.num_rows):
                stripes.add(langs[i], words[i], *(b.column(c)[i].values.to_numpy() for c in
                                                  ("lang", "first", "second", "size", "next", "n")))
        yield stripes.frequent(least)
    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, kind, w1, w2, w3, n, most): words (kind 1), pairs (2) and triples
    (3) with at least ``min_count`` occurrences; kind 0 adds up to all words."""
    spark = prepare(docs.sparkSession)
    # blocks are far longer than documents: few of them in an Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCKS_A_BATCH))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       named(text_col).cast("string").cast("binary").alias("text")).where(F.col("text").isNotNull())
    blocks = arrow_map(rows, _stripes(parts), BLOCK)
    merged = arrow_map(blocks.repartitionById(parts, F.col("part")), _merged(min_count), COUNTS)
    counts = written(merged.select("lang", "kind", *(F.col(w).cast("string").alias(w) for w in ("w1", "w2", "w3")), "n", "most"),
                     "phrase-counts")
    prepare(spark)
    return counts


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(15,0)")
    whole = F.lit(SCALE).cast("decimal(7,0)") * wide(a) * wide(a)
    return F.call_function("div", whole, wide(left) * wide(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 cover_pct: int = COVER_PCT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by
    score, then frequency, then phrase."""
    counts = phrase_counts(docs, text_col, lang_col, min_count)
    kind = lambda k, *cols: counts.where(F.col("kind") == k).select("lang", *cols)
    total = kind(0, "n").groupBy("lang").agg(F.sum("n").alias("n"))
    word = lambda w, f: kind(1, F.col("w1").alias(w), F.col("n").alias(f))
    pair = lambda v, w, f: kind(2, F.col("w1").alias(v), F.col("w2").alias(w), F.col("n").alias(f))

    triples = kind(3, "w1", "w2", "w3", F.col("n").alias("a"))
    ended = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("ended"))
    twos = (kind(2, "w1", "w2", F.col("n").alias("a"), "most").join(ended, ["lang", "w1", "w2"], "left")
            .where(100 * F.greatest("most", F.coalesce("ended", F.lit(0))) < cover_pct * F.col("a"))
            .join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
            .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r",
                    _score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    cut = lambda k, left, right: F.struct(_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"),
                                          F.col(left).alias("l"), F.col(right).alias("r"))
    threes = (triples.join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
              .join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
              .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                      F.least(cut(1, "l1", "r1"), cut(2, "l2", "r2")).alias("cut"))
              .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's phrases meet in one task only after each of its parts was cut to the top
    salted = twos.unionByName(threes).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*by))).where(F.col("_at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

"""BPE encoding and decoding through a minimal acyclic transducer.

The words of a word-level BPE vocabulary (lower-cased text, white space dropped,
an end-of-word mark) are encoded independently of one another, so the frequent
ones are compiled once:

1. count words over the whole corpus; each partition keeps its ``local_words``
   most frequent ones before the shuffle (the choice of words moves time, never
   results),
2. build an automaton of the ``lexicon_words`` most frequent words on the
   driver. States with the same suffixes are shared (incremental minimisation of
   sorted input), and transitions carry partial outputs whose sum along a word
   is its number in a table of id sequences,
3. broadcast its bytes (a few MB: bounded by ``lexicon_words``). A Python worker
   puts them into an unlinked temporary file and memory-maps it, so that its
   pages are shared with the page cache and hold no heap,
4. look up each batch's distinct words in one vectorised walk; words that the
   automaton lacks are merged exactly, pair by pair in rank order. A bounded
   cache keeps the ids of runs of visible characters met before.

Decoding joins the tokens of the ids by blanks, as a tokenizer file without a
decoder asks.

Defined results: a null text counts as empty and has no ids; special tokens'
strings in a text become their ids; truncation and padding of the file are
unused; repeated rows are encoded as often as they occur; an empty table gives
an empty table; other columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers
from tokenizers import Regex as LibraryRegex

from cinestat.llm.bytebpe import byte_of_character
from cinestat.llm.common import arrow_map, named, prepare, written

LEXICON_WORDS = 120_000
LOCAL_WORDS = 320_000
CACHE_LIMIT = 400_000
# bytes of words that are merged side by side, and words in one such block
SHORT = 32
MERGE_ROWS = 20_000
_NONE = np.iinfo(np.int32).max
# Unicode's White_Space characters
SPACES = "\t-\r \x85\xa0  -     　"
# str.split() also cuts at these separators, which are no white space here
_OTHER = "\x1c\x1d\x1e\x1f"
_SPACE_RUN = re.compile(f"[{SPACES}]+")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBPE:
    """The vocabulary file: normaliser, word pattern, merges, tokens.

    Text within Latin-1 is normalised and cut here; for other text the
    library's normaliser and word pattern are used, since two releases of
    Unicode class thousands of characters differently.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") \
            if self.specials else None
        vocab = model["vocab"]
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = t
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # words, and line feeds as marks between runs of visible characters
        self.word = regex.compile(pattern.replace(r"\s", SPACES) + "|\n")
        self.library_words = pre_tokenizers.Split(LibraryRegex(pattern), "removed", invert=True)
        self.library_normal = Tokenizer.from_file(path).normalizer
        end = model["end_of_word_suffix"]
        written = {b: c for c, b in byte_of_character().items()}
        self.inner = [vocab[written[b]] for b in range(256)]
        self.last = [vocab[written[b] + end] for b in range(256)]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # the same pairs as sorted arrays, with a last entry that no pair reaches
        keys = np.array([a * len(self.tokens) + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_key = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array([r for r, _ in self.pairs.values()], np.int32)[order], np.int32(_NONE))
        self.pair_new = np.append(np.array([x for _, x in self.pairs.values()], np.int32)[order], np.int32(0))

    def normalise(self, text: str) -> str:
        """NFC, white space as blanks, every character's own lower case."""
        return text.lower() if _latin(text) else self.library_normal.normalize_str(text)

    def chunks(self, text: str) -> list[str]:
        """The normalised text's runs of visible characters; no word spans two."""
        if any(c in text for c in _OTHER):
            return [c for c in _SPACE_RUN.split(text) if c]
        return text.split()

    def words(self, chunks: list[str]) -> list[str]:
        """The chunks' words in order, with a line feed after each chunk."""
        text = "\n".join([*chunks, ""])
        if _latin(text):
            return self.word.findall(text)
        out = []
        for c in chunks:
            out += self.word.findall(c) if _latin(c) else [w for w, _ in self.library_words.pre_tokenize_str(c)]
            out.append("\n")
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merges of many words: the pair of lowest rank first, the
        leftmost of equals. Words of up to ``SHORT`` bytes are merged together,
        one merge of each word a step."""
        out: list = [None] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))  # tight blocks
        for at in range(0, len(short), MERGE_ROWS):
            rows = short[at:at + MERGE_ROWS]
            for i, ids in zip(rows, self._merge_short([words[i] for i in rows]), strict=True):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self._merge_long(w)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; ``_NONE`` without one (-1 is no symbol)."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * len(self.tokens) + b, -1)
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE)

    def _merge_short(self, words: list[bytes]) -> list[list[int]]:
        n, width = len(words), max(map(len, words), default=0)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(n, width + 1)
        column = np.arange(width + 1)
        s = np.where(column < size[:, None] - 1, self.inner_ids[raw], np.where(column == size[:, None] - 1, self.last_ids[raw], np.int32(-1)))
        rank = self._ranks(s[:, :-1], s[:, 1:])  # of the pairs at i, i + 1
        row, done = np.arange(n), np.full((n, width + 1), -1, np.int32)
        while len(row):
            at = rank.argmin(1)
            open_ = rank[np.arange(len(row)), at] < _NONE
            done[row[~open_]] = s[~open_]
            row, s, rank, at = row[open_], s[open_], rank[open_], at[open_]
            if not len(row):
                break
            k = np.arange(len(row))
            new = self.pair_new[np.searchsorted(self.pair_key, s[k, at].astype(np.int64) * len(self.tokens) + s[k, at + 1])]
            s = np.take_along_axis(s, np.minimum(column + (column > at[:, None]), width), 1)
            s[:, -1] = -1
            s[k, at] = new
            rank = np.take_along_axis(rank, np.minimum(column[:-1] + (column[:-1] > at[:, None]), width - 1), 1)
            rank[:, -1] = _NONE
            rank[k, at] = self._ranks(new, s[k, at + 1])
            left = at > 0
            rank[k[left], at[left] - 1] = self._ranks(s[k[left], at[left] - 1], new[left])
        return [r[:m] for r, m in zip(done.tolist(), (done >= 0).sum(1).tolist(), strict=True)]

    def _merge_long(self, word: bytes) -> list[int]:
        s = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        n, pairs = len(s), self.pairs
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (p := pairs.get((s[i], s[j]))) is not None:
                heapq.heappush(heap, (p[0], i, p[1], s[i], s[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], gone[j], right[i] = new, True, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [x for x, g in zip(s, gone, strict=True) if not g]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self):
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0


def minimal_automaton(words: list[bytes]) -> list[_State]:
    """The states of the minimal acyclic automaton of the sorted, distinct
    words, children before parents, the root last."""
    register: dict[tuple, _State] = {}
    states: list[_State] = []
    root, path, before = _State(), [], b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            key = (child.final, *((c, x.number) for c, x in child.edges.items()))
            known = register.get(key)
            if known is None:
                child.number = len(states)
                child.words = child.final + sum(x.words for x in child.edges.values())
                states.append(child)
                register[key] = child
            else:
                parent.edges[label] = known

    for w in words:
        same = 0
        while same < min(len(w), len(before)) and w[same] == before[same]:
            same += 1
        settle(same)
        node = path[-1][2] if path else root
        for c in w[same:]:
            nxt = _State()
            node.edges[c] = nxt
            path.append((node, c, nxt))
            node = nxt
        node.final = True
        before = w
    settle(0)
    root.number = len(states)
    root.words = root.final + sum(x.words for x in root.edges.values())
    return [*states, root]


_PARTS = (("keys", "<i8"), ("targets", "<i4"), ("outputs", "<i4"), ("finals", "<u1"), ("offsets", "<i4"), ("ids", "<i4"))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of word -> ids as one block of bytes."""
    words = sorted(w for w in entries if w)
    states = minimal_automaton(words)
    keys, targets, outputs = [], [], []
    for s in states:
        n = int(s.final)
        for label, child in s.edges.items():  # in label order, since words came sorted
            keys.append(s.number * 256 + label)
            targets.append(child.number)
            outputs.append(n)
            n += child.words
    parts = {"keys": keys, "targets": targets, "outputs": outputs, "finals": [s.final for s in states],
             "offsets": np.cumsum([0, *(len(entries[w]) for w in words)]), "ids": [i for w in words for i in entries[w]]}
    blocks = [np.asarray(parts[k], kind).tobytes() for k, kind in _PARTS]
    head = np.array([len(states) - 1, max(map(len, words), default=0), *map(len, blocks)], "<i8").tobytes()
    pad = lambda b: b + bytes(-len(b) % 8)
    return head + b"".join(map(pad, blocks))


class Lexicon:
    """A compiled lexicon in any buffer, such as a memory map."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<i8", 2 + len(_PARTS))
        self.root, self.longest = int(head[0]), int(head[1])
        at = head.nbytes
        for (name, kind), size in zip(_PARTS, head[2:].tolist(), strict=True):
            setattr(self, name, np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8

    @classmethod
    def mapped(cls, block: bytes) -> Lexicon:
        with tempfile.TemporaryFile() as f:  # has no name: gone with the worker
            f.write(block)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for words the lexicon lacks: all words walk
        the automaton together, a byte a step."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        at = np.flatnonzero((size > 0) & (size <= self.longest))
        state, total = np.full(len(at), self.root), np.zeros(len(at), np.int64)
        for step in range(self.longest):
            key = state * 256 + flat[start[at] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            at, edge, total = at[hit], edge[hit], total[hit]
            state, total = self.targets[edge].astype(np.int64), total + self.outputs[edge]
            end = size[at] == step + 1
            done = end & (self.finals[state] == 1)
            out[at[done]] = total[done]
            at, state, total = at[~end], state[~end], total[~end]
            if not len(at):
                break
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number]:self.offsets[number + 1]]


class Encoder:
    """Encodes batches of texts. Chunks met before come from a bounded cache;
    the words of new ones are looked up in the lexicon or merged."""

    def __init__(self, bpe: WordBPE, lexicon: Lexicon, cache_limit: int = CACHE_LIMIT):
        self.bpe, self.lexicon, self.limit = bpe, lexicon, cache_limit
        self.lexicon_ids = lexicon.ids.tobytes()
        # two generations: what is still in use moves from the older to the younger
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        number = self.lexicon.numbers(raw)
        out = [b""] * len(words)
        hit = np.flatnonzero(number >= 0)
        lo, hi = 4 * self.lexicon.offsets[number[hit]], 4 * self.lexicon.offsets[number[hit] + 1]
        for i, a, b in zip(hit.tolist(), lo.tolist(), hi.tolist(), strict=True):
            out[i] = self.lexicon_ids[a:b]
        new = []
        for i in np.flatnonzero(number < 0).tolist():
            w = words[i]
            out[i] = self.known.get(w) or self.older.get(w) or b""
            if not out[i]:
                new.append(i)
        for i, ids in zip(new, self.bpe.merge([raw[i] for i in new]), strict=True):
            out[i] = self.known[words[i]] = np.array(ids, "<i4").tobytes()
        return out

    def _learn(self, chunks: list[str]) -> None:
        place = {"\n": 0}
        order = [place.setdefault(w, len(place)) for w in self.bpe.words(chunks)]
        ids = [b"", *self._words(list(place)[1:])]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.array(order, np.int64)
        ends = np.cumsum(sizes[at])[at == 0].tolist()
        flat = b"".join(map(ids.__getitem__, order))
        a = 0
        for c, b in zip(chunks, ends, strict=True):
            self.known[c] = flat[a:b]
            a = b

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        bpe = self.bpe
        pieces: list[list] = []  # per text: lists of chunks, and special ids between them
        for t in texts:
            if bpe.special_cut and any(s in t for s in bpe.specials):
                cut = bpe.special_cut.split(t)
                pieces.append([bpe.specials[p] if i % 2 else bpe.chunks(bpe.normalise(p)) for i, p in enumerate(cut)])
            else:
                pieces.append([bpe.chunks(bpe.normalise(t))])
        if len(self.known) > self.limit:
            self.known, self.older = {"": b""}, self.known
        found: set[str] = set()
        for p in pieces:
            for x in p:
                if not isinstance(x, int):
                    found.update(x)
        new = []
        for c in found.difference(self.known):
            ids = self.older.get(c)
            if ids is None:
                new.append(c)
            else:
                self.known[c] = ids
        self._learn(new)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(np.array([x], "<i4").tobytes() if isinstance(x, int) else b"".join(map(get, x)) for x in p), "<i4")
                for p in pieces]


_BPE: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    if path not in _BPE:
        _BPE[path] = WordBPE(path)
    return _BPE[path]


_ENCODER: dict[bytes, Encoder] = {}


def encoder(path: str, block: bytes) -> Encoder:
    """One encoder per Python worker, for the last lexicon used."""
    key = hashlib.sha256(path.encode() + block).digest()
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = Encoder(loaded(path), Lexicon.mapped(block))
    return _ENCODER[key]


def _count_words(path: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunks, counts = loaded(path), Counter(), Counter()

        def fold() -> None:
            each = iter(chunks.values())
            n = next(each, 0)
            for w in bpe.words(list(chunks)):
                if w == "\n":
                    n = next(each, 0)
                else:
                    counts[w] += n
            chunks.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = list(counts), list(counts.values())
            counts.clear()
            for a in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_pydict({"word": pa.array(words[a:a + (1 << 16)], pa.string()),
                                                  "n": pa.array(n[a:a + (1 << 16)], pa.int64())})

        for b in batches:
            for t in b.column("text").to_pylist():
                chunks.update(bpe.chunks((t or "").lower()))
            if len(chunks) > 2 * keep:
                fold()
                if len(counts) > keep:  # a full counter goes out as partial counts; none is dropped
                    yield from flush()
        fold()
        yield from flush()
    return run


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", local_words: int = LOCAL_WORDS) -> DataFrame:
    """(word, n) from the whole corpus: complete counts, whatever the partitions.
    A task holds about ``local_words`` words at once."""
    found = arrow_map(docs.select(named(text_col).alias("text")), _count_words(path, local_words), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS,
                  local_words: int = LOCAL_WORDS) -> bytes:
    prepare(docs.sparkSession)
    counts = written(frequent_words(docs, path, text_col, local_words), "word-counts")
    # a histogram of the counts' logarithms, at most some thousand rows, says which words can be among the most frequent;
    # without it every task would send its own most frequent ones
    size = F.floor(F.log2("n") * 16)
    enough, least = 0, 0
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["size"]):
        enough, least = enough + r["words"], r["size"]
        if enough >= lexicon_words:
            break
    top = counts.where(size >= least).orderBy(F.col("n").desc(), "word").limit(lexicon_words)
    bpe = loaded(path)
    # a word whose normal form differs is no entry: encoding looks normal forms up
    words = [r["word"] for r in top.select("word").collect()]
    words = [w.encode() for w in words if w and bpe.normalise(w) == w]
    return compile_lexicon(dict(zip(words, bpe.merge(words), strict=True)))


def encode_decode(docs: DataFrame, path: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for every row."""
    spark = prepare(docs.sparkSession)
    block = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        known = encoder(path, block.value)
        for b in batches:
            ids = known.encode([t or "" for t in b.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype("<i4")
            values = np.concatenate(ids) if ids else np.zeros(0, "<i4")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32())),
                 pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return arrow_map(docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")), run,
                     "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``: the text of the ids in ``ids_col``."""
    schema = rows.withColumn(out_col, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            text = pa.array([None if x is None else bpe.decode(x) for x in b.column(ids_col).to_pylist()], pa.string())
            cols = {c: b.column(c) for c in b.schema.names} | {out_col: text}
            yield pa.RecordBatch.from_arrays([cols[c] for c in schema.names], names=schema.names)

    return rows.mapInArrow(run, schema)

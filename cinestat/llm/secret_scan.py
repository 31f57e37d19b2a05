"""Secret scans: patterns, and a character network over all other candidates.

Candidates of a text are (a) the matches of three patterns, an assignment to a
secret's name, an access key id and a long hexadecimal string, and (b) every
other stretch of ``LONG`` or more characters of ``[A-Za-z0-9+/_.=-]`` with a
letter or digit. Every
candidate is scored by a convolutional network over its characters and those
around it. Pattern matches are always reported; the others when their score
reaches the threshold.

The network (numpy): an embedding of the character, its region (before, value,
after) one-hot, convolutions of width 3 and 5, the largest activation in every
region and the mean over the value, a hidden layer, one logit. A value longer
than the window is scored in overlapping windows, and its highest score counts.

Findings: rows (before, value, after, label) with label 1 for a secret.
``findings`` takes them from the table itself: pattern matches are 1, other
candidates 0, one row a distinct value, all values but those of the held-out fold
alone. A user's own labelled rows go to ``fit`` alike. Each secret is also learned
with values drawn anew from other alphabets (a drawn key is still a key) and with
the surroundings of a random row, so that the network does not only learn the
patterns' names.

A fifth of the values, by hash, is not trained on. On it the logits are calibrated
(Platt) and the thresholds set: for each shape of value (hexadecimal, capitals and
digits, others) the highest threshold that finds at least ``RECALL`` of the
secrets; a shape with fewer than ``LEAST`` secrets takes that of all.

Findings of up to ``CHUNK`` windows are learned in one task. More are dealt out by
hash into chunks of about that many, all of which are trained on: in each of
``EPOCHS`` rounds every chunk goes on from the shared parameters over its own rows,
then parameters and Adam's moments are averaged by rows. Platt's sums are added up
over the chunks, and a threshold is found as the exact rank among all secrets set
aside, by counts of their logits' leading bits.

Defined results: offsets are code points, end exclusive; null and empty texts have
no candidates; repeated rows and rows without id are scanned alike; with fewer than
``LEAST`` distinct values of either class nothing is learned, the scores are null and
only pattern matches are reported; other columns are left out; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinestat.llm.common import arrow_map, held_out, named, prepare, written

KINDS = ("assign", "access", "hex", "network")
LONG = 16
CHUNK = 1 << 14
EPOCHS = 8
LEAST = 8
RECALL = 0.99
BEFORE, VALUE, AFTER = 24, 48, 16
STEP = 32
_WIDTH = BEFORE + VALUE + AFTER

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("passw", "secret", "token", "api")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LONG},}}")
_SOLID = re.compile("[A-Za-z0-9]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("before", pa.string()),
                  ("value", pa.string()), ("after", pa.string())])


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) by start, then kind.

    Access keys and hexadecimal strings lie inside long stretches, so they are
    sought only there. A stretch that overlaps a pattern match is no other
    candidate."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    long = [m.span() for m in _RUN.finditer(text)]
    for a, b in long:
        out += [(m.start(), 1, m.end(), *m.span()) for m in _ACCESS.finditer(text, a, b)]
        out += [(m.start(), 2, m.end(), *m.span()) for m in _HEX.finditer(text, a, b)]
    out.sort()
    taken, k, others = out[:], 0, []
    reach = 0  # end of the matches that begin before the stretch's end
    for a, b in long:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= a and _SOLID.search(text, a, b):
            others.append((a, 3, b, a, b))
    return sorted(out + others)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = []
        for t in b.column("text"):
            t = t.as_py() or ""
            spans.append([{"kind": k, "start": s, "end": e, "before": t[max(0, v - BEFORE):v], "value": t[v:w], "after": t[w:w + AFTER]}
                          for s, k, e, v, w in candidates(t)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row, written once: all candidates with what is around them."""
    prepare(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    found = arrow_map(rows, _extract, "doc_id long, spans array<struct<kind:int,start:long,end:long,before:string,value:string,after:string>>")
    return written(found, "secret-candidates")


# --- the network ---------------------------------------------------------------

def encode(before: str, value: str, after: str) -> np.ndarray:
    """Character codes of the value's windows: 0 nothing, 1-95 printable ASCII,
    96 other ASCII, 97 beyond."""
    out = []
    for a in range(0, max(len(value) - VALUE + STEP, 1), STEP):
        left = (before + value[:a])[-BEFORE:]
        inner, right = value[a:a + VALUE], (value[a + VALUE:a + VALUE + AFTER] + after)[:AFTER]
        row = left.rjust(BEFORE, "\0") + inner.ljust(VALUE, "\0") + right.ljust(AFTER, "\0")
        c = np.frombuffer(row.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        out.append(np.where((c >= 32) & (c < 127), c - 31, np.where(c == 0, 0, np.where(c < 128, 96, 97))).astype(np.uint8))
    return np.array(out)


_REGION = np.zeros((_WIDTH, 3), np.float32)
_REGION[:BEFORE, 0] = _REGION[BEFORE:BEFORE + VALUE, 1] = _REGION[BEFORE + VALUE:, 2] = 1


class Network:
    """Parameters by name; forward and backward passes in float32."""

    WIDTHS, FILTERS, EMBED, HIDDEN = (3, 5), 24, 8, 32

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        depth = self.EMBED + 3
        self.p = {"embed": (rng.standard_normal((98, self.EMBED)) * 0.3).astype(np.float32)}
        for k in self.WIDTHS:
            self.p[f"conv{k}"], self.p[f"bias{k}"] = draw(k * depth, self.FILTERS), np.zeros(self.FILTERS, np.float32)
        self.p["hidden"], self.p["hidden_bias"] = draw(4 * self.FILTERS * len(self.WIDTHS), self.HIDDEN), np.zeros(self.HIDDEN, np.float32)
        self.p["out"], self.p["out_bias"] = draw(self.HIDDEN, 1), np.zeros(1, np.float32)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits, and what the backward pass needs."""
        n, depth = len(x), self.EMBED + 3
        inp = np.concatenate([self.p["embed"][x], np.broadcast_to(_REGION, (n, *_REGION.shape))], 2)
        inside = (x[:, BEFORE:BEFORE + VALUE] > 0).astype(np.float32)
        share = inside / np.maximum(inside.sum(1, keepdims=True), 1)
        saved, pooled = {"x": x, "share": share}, []
        for k in self.WIDTHS:
            m = _WIDTH - k + 1
            cols = np.lib.stride_tricks.sliding_window_view(inp, k, 1).transpose(0, 1, 3, 2).reshape(n, m, k * depth)
            act = np.maximum(cols @ self.p[f"conv{k}"] + self.p[f"bias{k}"], 0)
            ends = (0, BEFORE, BEFORE + VALUE - k + 1, m)
            at = [a + act[:, a:b].argmax(1) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            pooled += [np.take_along_axis(act, i[:, None], 1)[:, 0] for i in at]
            pooled.append(np.einsum("nm,nmf->nf", share[:, :VALUE - k + 1], act[:, BEFORE:BEFORE + VALUE - k + 1]))
            saved[k] = cols, act, at
        flat = np.concatenate(pooled, 1)
        hidden = np.maximum(flat @ self.p["hidden"] + self.p["hidden_bias"], 0)
        saved |= {"flat": flat, "hidden": hidden}
        return (hidden @ self.p["out"] + self.p["out_bias"])[:, 0], saved

    def backward(self, saved: dict, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, given those of the logits."""
        g, e = {}, error[:, None].astype(np.float32)
        g["out"], g["out_bias"] = saved["hidden"].T @ e, e.sum(0)
        dh = (e @ self.p["out"].T) * (saved["hidden"] > 0)
        g["hidden"], g["hidden_bias"] = saved["flat"].T @ dh, dh.sum(0)
        dflat = dh @ self.p["hidden"].T
        n, depth = len(error), self.EMBED + 3
        dinp = np.zeros((n, _WIDTH, depth), np.float32)
        parts = np.split(dflat, 4 * len(self.WIDTHS), 1)
        for w, k in enumerate(self.WIDTHS):
            cols, act, at = saved[k]
            d = np.zeros_like(act)
            for i, part in zip(at, parts[4 * w:], strict=False):
                np.put_along_axis(d, i[:, None], np.take_along_axis(d, i[:, None], 1) + part[:, None], 1)
            d[:, BEFORE:BEFORE + VALUE - k + 1] += saved["share"][:, :VALUE - k + 1, None] * parts[4 * w + 3][:, None]
            d *= act > 0
            g[f"conv{k}"] = cols.reshape(-1, k * depth).T @ d.reshape(-1, self.FILTERS)
            g[f"bias{k}"] = d.sum((0, 1))
            back = (d @ self.p[f"conv{k}"].T).reshape(n, d.shape[1], k, depth)
            for o in range(k):
                dinp[:, o:o + d.shape[1]] += back[:, :, o]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], saved["x"], dinp[:, :, :self.EMBED])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128) -> None:
        """Adam on the logistic loss, both classes weighted alike."""
        rng = np.random.default_rng(1)
        state = Moments.of(self)
        for _ in range(max(epochs, -(-200 * batch // len(x)))):
            self.epoch(state, x, y, y.mean(), rng, batch)

    def epoch(self, state: Moments, x: np.ndarray, y: np.ndarray, share: float, rng: np.random.Generator, batch: int = 128,
              rate: float = 2e-3, l2: float = 1e-4) -> None:
        """One pass over the rows; ``share`` is that of the secrets among all rows."""
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            i = order[a:a + batch]
            z, saved = self.forward(x[i])
            g = self.backward(saved, weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(i))
            state.step += 1
            for k, w in self.p.items():
                d = g[k] + l2 * w
                m = state.m[k] = 0.9 * state.m[k] + 0.1 * d
                v = state.v[k] = 0.999 * state.v[k] + 0.001 * d * d
                w -= rate * (m / (1 - 0.9 ** state.step)) / (np.sqrt(v / (1 - 0.999 ** state.step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[a:a + 512])[0] for a in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)


@dataclass
class Moments:
    """Adam's moments by parameter, and its steps so far."""

    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    step: int

    @classmethod
    def of(cls, network: Network) -> Moments:
        return cls({k: np.zeros_like(w) for k, w in network.p.items()}, {k: np.zeros_like(w) for k, w in network.p.items()}, 0)


def packed(network: Network, state: Moments) -> np.ndarray:
    """Parameters, moments and steps as one vector."""
    return np.concatenate([*(d[k].ravel() for d in (network.p, state.m, state.v) for k in network.p), [state.step]]).astype(np.float64)


def unpacked(vector: np.ndarray) -> tuple[Network, Moments]:
    network = Network()
    state, a = Moments.of(network), 0
    for d in (network.p, state.m, state.v):
        for k, w in network.p.items():
            d[k] = vector[a:a + w.size].reshape(w.shape).astype(np.float32)
            a += w.size
    state.step = round(vector[a])
    return network, state


def platt_sums(z: np.ndarray, y: np.ndarray, n1: float, n0: float, a: float, b: float) -> np.ndarray:
    """What rows add to the gradient and second derivatives of Platt's loss at a, b,
    for ``n1`` secrets and ``n0`` others in all."""
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    w = p * (1 - p) + 1e-9
    return np.array([((p - t) * z).sum(), (p - t).sum(), (w * z * z).sum(), (w * z).sum(), w.sum()])


def platt(sums: Callable[[float, float], np.ndarray]) -> tuple[float, float]:
    """slope, intercept of the logistic fit of the labels to the logits, with
    Platt's smoothed targets, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        s = sums(a, b)
        grad = np.array([s[0] + 1e-3 * (a - 1), s[1]])
        hess = np.array([[s[2] + 1e-3, s[3]], [s[3], s[4] + 1e-9]])
        step = np.linalg.solve(hess, grad)
        size = max(1.0, np.abs(step).max())
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def shape(value: str) -> int:
    """0: hexadecimal, 1: capitals and digits, 2: others."""
    return 0 if re.fullmatch(r"[0-9a-f]+", value) else 1 if re.fullmatch(r"[A-Z0-9]+", value) else 2


@dataclass
class Scanner:
    network: Network
    slope: float
    intercept: float
    thresholds: tuple[float, float, float]

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.intercept, -30, 30)))

    def scores(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        """Probability of every (before, value, after): that of its highest window."""
        out = np.empty(len(rows))
        for a in range(0, len(rows), 256):
            coded = [encode(*r) for r in rows[a:a + 256]]
            z = self.network.logits(np.concatenate(coded))
            head = np.cumsum([0] + [len(c) for c in coded[:-1]])
            out[a:a + 256] = self.probability(np.maximum.reduceat(z, head))
        return out


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def _drawn(rng: np.random.Generator) -> str:
    """A random key of a random alphabet and length; hexadecimal ones with a
    letter at least, for digits alone are no key."""
    letters = np.array(list(_ALPHABETS[rng.integers(len(_ALPHABETS))]))
    while True:
        value = "".join(rng.choice(letters, rng.integers(LONG, 65)))
        if not value.isdigit():
            return value


def copies(n_secrets: int) -> int:
    """How often a secret is drawn anew."""
    return max(2, 512 // n_secrets)


def redrawn(rows: list[tuple[str, str, str, int]], times: int, rng: np.random.Generator) -> list[tuple[str, str, str, int]]:
    """``times`` rows more of every secret."""
    more = []
    for before, value, after, _ in (r for r in rows if r[3] == 1):
        for _ in range(times):
            other = rows[rng.integers(len(rows))]
            around = (before, after) if rng.random() < 0.4 else (other[0], other[2])
            more.append((around[0], _drawn(rng) if rng.random() < 0.8 else value, around[1], 1))
    return more


def set_aside(rows: list[tuple[str, str, str, int]]) -> np.ndarray:
    return np.array([zlib.crc32(r[1].encode("utf-8", "surrogatepass")) % 5 == 1 for r in rows], bool)


def learn(rows: list[tuple[str, str, str, int]], recall: float = RECALL, seed: int = 0) -> Scanner | None:
    """The scanner of labelled rows, the same for any order of them."""
    rows = sorted(set(rows))
    if min(sum(r[3] == c for r in rows) for c in (0, 1)) < LEAST:
        return None
    rows = rows + redrawn(rows, copies(sum(r[3] == 1 for r in rows)), np.random.default_rng(seed))
    aside = set_aside(rows)
    y = np.array([r[3] for r in rows], float)
    if min((aside & (y == c)).sum() for c in (0, 1)) == 0:
        aside[:] = False
    train, check = np.flatnonzero(~aside), np.flatnonzero(aside if aside.any() else ~aside)
    network = Network(seed)
    coded = [encode(*r[:3]) for r in rows]
    # the windows of a long secret are all secret
    x = np.concatenate([coded[i] for i in train])
    network.train(x, np.repeat(y[train], [len(coded[i]) for i in train]))
    z = np.array([network.logits(coded[i]).max() for i in check], float)
    n1, n0 = y[check].sum(), (1 - y[check]).sum()
    slope, intercept = platt(lambda a, b: platt_sums(z, y[check], n1, n0, a, b))
    scanner = Scanner(network, slope, intercept, (0.5,) * 3)
    p = scanner.scores([rows[i][:3] for i in check])
    kinds = np.array([shape(rows[i][1]) for i in check])
    limits = []
    for k in range(3):
        mine = p[(y[check] == 1) & (kinds == k)]
        mine = np.sort(mine if len(mine) >= LEAST else p[y[check] == 1])
        limits.append(float(mine[int(np.floor((1 - recall) * len(mine)))]))
    scanner.thresholds = tuple(limits)
    return scanner


# --- over tables -----------------------------------------------------------------

def findings(spans: DataFrame) -> DataFrame:
    """(before, value, after, label) from the candidates of ``extract``: one row a
    distinct value of the rows outside the held-out fold, all of them."""
    seen = (spans.where(~held_out(F.col("doc_id"))).select(F.explode("spans").alias("s"))
            .select((F.col("s.kind") < 3).cast("int").alias("label"), "s.value", F.struct("s.before", "s.after").alias("around"))
            # a value in use as a secret anywhere is one
            .groupBy("value").agg(F.max("label").alias("label"), F.max_by("around", F.struct("label", "around")).alias("around")))
    return seen.select("around.before", "value", "around.after", "label")


def fit(rows: DataFrame, recall: float = RECALL, chunk: int = CHUNK) -> Scanner | None:
    """The scanner of a table of findings, learned from all of them: in one task
    up to ``chunk`` windows, beyond that chunk by chunk."""
    rows = written(rows.select("before", "value", "after", "label").distinct(), "secret-findings")
    windows = F.ceil(F.greatest(F.length("value") - (VALUE - STEP), F.lit(1)) / STEP)
    aside = F.crc32(F.col("value").cast("binary")) % 5 == 1
    size = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(windows).alias("windows"),
                                                             F.count_if(aside).alias("aside")).collect()}
    if min(size[c]["n"] if c in size else 0 for c in (0, 1)) < LEAST:
        return None
    times = copies(size[1]["n"])
    n = math.ceil((size[0]["windows"] + (1 + times) * size[1]["windows"]) / chunk)
    # of the secrets, drawn ones are set aside at any rate
    return _fit_chunks(rows, n, times, size[0]["aside"] > 0, recall) if n > 1 else _fit_one(rows, recall)


def _fit_one(rows: DataFrame, recall: float) -> Scanner | None:
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(got, recall))], pa.binary())], names=["model"])

    out = arrow_map(rows.repartition(1), run, "model binary").first()
    return pickle.loads(out["model"]) if out else None


_CODED = "chunk int, checked boolean, n long, n_secrets long, x binary, heads binary, y binary, shapes binary"


def _coder(times: int, split: bool, seed: int):
    """Of a chunk's findings two rows, those to train on and those to check with:
    windows one after another, and of every finding its first window, label and shape."""
    def run(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("before", "value", "after", "label")), strict=True))
        rows += redrawn(rows, times, np.random.default_rng((seed, chunk)))
        aside = set_aside(rows) if split else np.zeros(len(rows), bool)
        out = []
        for checked, pick in ((False, ~aside), (True, aside if split else ~aside)):
            some = [rows[i] for i in np.flatnonzero(pick)]
            coded = [encode(*r[:3]) for r in some]
            y = np.array([r[3] for r in some], np.uint8)
            out.append({"chunk": chunk, "checked": checked, "n": sum(map(len, coded)),
                        "n_secrets": sum(len(c) for c, label in zip(coded, y, strict=True) if label == 1),
                        "x": b"".join(c.tobytes() for c in coded), "heads": np.cumsum([0, *map(len, coded)], dtype=np.int64)[:-1].tobytes(),
                        "y": y.tobytes(), "shapes": np.array([shape(r[1]) for r in some], np.uint8).tobytes()})
        kinds = pa.schema([("chunk", pa.int32()), ("checked", pa.bool_()), ("n", pa.int64()), ("n_secrets", pa.int64()), ("x", pa.binary()),
                           ("heads", pa.binary()), ("y", pa.binary()), ("shapes", pa.binary())])
        return pa.Table.from_pylist([r for r in out if r["n"]], kinds)
    return run


def _per_chunk(chunks: DataFrame, fn: Callable[[dict], bytes]) -> DataFrame:
    """(chunk, n, out): ``fn`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([r["chunk"]], pa.int32()), "n": pa.array([r["n"]], pa.int64()),
                                                  "out": pa.array([fn(r)], pa.binary())})

    return arrow_map(chunks, run, "chunk int, n long, out binary")


def _mean(outs: DataFrame, n: int) -> np.ndarray:
    """Mean of the vectors ``out`` by rows, added up in groups of chunks and always
    in the same order."""
    def add(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
        total = sum(np.frombuffer(r["out"], np.float64) * r["n"] for r in rows)
        return pa.table({"chunk": pa.array([rows[0]["chunk"]], pa.int32()), "n": pa.array([sum(r["n"] for r in rows)], pa.int64()),
                         "out": pa.array([total.tobytes()], pa.binary())})

    groups = math.isqrt(n)
    parts = sorted(outs.groupBy(F.col("chunk") % groups).applyInArrow(add, "chunk int, n long, out binary").collect())
    return sum(np.frombuffer(r["out"], np.float64) for r in parts) / sum(r["n"] for r in parts)


def _fit_chunks(rows: DataFrame, n: int, times: int, split: bool, recall: float, seed: int = 0) -> Scanner:
    context = rows.sparkSession.sparkContext
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("before", "value", "after"), F.lit(n)).cast("int"))
    coded = written(dealt.groupBy("chunk").applyInArrow(_coder(times, split, seed), _CODED), "secret-chunks")
    train = coded.where(~F.col("checked")).select("chunk", "n", "x", "heads", "y").repartition(n).persist()
    count = coded.where(~F.col("checked")).agg(F.sum("n").alias("n"), F.sum("n_secrets").alias("n_secrets")).first()
    share = count["n_secrets"] / count["n"]

    def round_of(e: int, start):
        def run(r: dict) -> bytes:
            network, state = unpacked(start.value)
            heads = np.frombuffer(r["heads"], np.int64)
            # the windows of a long secret are all secret
            y = np.repeat(np.frombuffer(r["y"], np.uint8).astype(float), np.diff(heads, append=r["n"]))
            network.epoch(state, np.frombuffer(r["x"], np.uint8).reshape(-1, _WIDTH), y, share, np.random.default_rng((1, e, r["chunk"])))
            return packed(network, state).tobytes()
        return run

    first = Network(seed)
    vector = packed(first, Moments.of(first))
    for e in range(EPOCHS):
        start = context.broadcast(vector)  # some 30,000 numbers
        vector = _mean(_per_chunk(train, round_of(e, start)), n)
        start.unpersist()
    train.unpersist()
    network = unpacked(vector)[0]
    shared = context.broadcast(network)

    def highest(r: dict) -> bytes:
        z = shared.value.logits(np.frombuffer(r["x"], np.uint8).reshape(-1, _WIDTH))
        return np.maximum.reduceat(z, np.frombuffer(r["heads"], np.int64)).astype(np.float32).tobytes()

    checks = coded.where("checked")
    logits = written(_per_chunk(checks.select("chunk", "n", "x", "heads").repartition(n), highest).select("chunk", F.col("out").alias("z"))
                     .join(checks.select("chunk", "n", "y", "shapes"), "chunk"), "secret-logits")
    return calibrated(network, logits, recall)


def calibrated(network: Network, logits: DataFrame, recall: float) -> Scanner:
    """The scanner of a network and the checked findings, a row a chunk: chunk, n,
    z (float32), y and shapes (uint8)."""
    z_of = lambda r: np.frombuffer(r["z"], np.float32)
    y_of = lambda r: np.frombuffer(r["y"], np.uint8)

    def total(fn: Callable[[dict], np.ndarray]) -> np.ndarray:
        """Sum of a few numbers a chunk, always in the same order."""
        rows = sorted(_per_chunk(logits, lambda r: fn(r).astype(np.float64).tobytes()).select("chunk", "out").collect())
        return sum(np.frombuffer(r["out"], np.float64) for r in rows)

    def sizes(r: dict) -> np.ndarray:
        secret = np.bincount(np.frombuffer(r["shapes"], np.uint8)[y_of(r) == 1], minlength=3)
        return np.array([*secret, (y_of(r) == 0).sum()])

    *secrets, n0 = total(sizes)
    n1 = sum(secrets)
    slope, intercept = platt(lambda a, b: total(lambda r: platt_sums(z_of(r).astype(float), y_of(r), n1, n0, a, b)))
    scanner = Scanner(network, slope, intercept, (0.5,) * 3)
    kinds = [k if secrets[k] >= LEAST else 3 for k in range(3)]  # 3: secrets of all shapes
    ranks = {k: int(np.floor((1 - recall) * (n1 if k == 3 else secrets[k]))) for k in set(kinds)}
    found = ranked(logits, ranks)
    scanner.thresholds = tuple(float(scanner.probability(found[k:k + 1])[0]) for k in kinds)
    return scanner


def ordered(z: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the float32 numbers."""
    bits = z.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint32)


def ranked(logits: DataFrame, ranks: dict[int, int]) -> np.ndarray:
    """The secrets' logits at the given ranks (from 0), by shape (3: of all), exactly:
    11, 11 and 10 leading bits are settled one after another by counts."""
    lead = {k: 0 for k in ranks}
    left = dict(ranks)
    for before, width in ((0, 11), (11, 11), (22, 10)):
        rest = 32 - before - width

        def run(batches: Iterator[pa.RecordBatch], before=before, width=width, rest=rest, lead=dict(lead)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    mine = np.frombuffer(r["y"], np.uint8) == 1
                    key = ordered(np.frombuffer(r["z"], np.float32)).astype(np.int64)
                    shapes = np.frombuffer(r["shapes"], np.uint8)
                    for k, top in lead.items():
                        some = key[mine & ((shapes == k) | (k == 3)) & (key >> (32 - before) == top)]
                        count = np.bincount((some >> rest) & ((1 << width) - 1), minlength=1)
                        at = np.flatnonzero(count)
                        yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k), pa.int32()), "at": pa.array(at, pa.int32()),
                                                          "n": pa.array(count[at], pa.int64())})

        counts = arrow_map(logits.select("z", "y", "shapes"), run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
        settled = set()
        for k, at, count in sorted(counts.collect()):  # at most 2,048 rows a shape
            if k in settled:
                continue
            if left[k] < count:
                lead[k] = (lead[k] << width) + at
                settled.add(k)
            else:
                left[k] -= count
    out = np.zeros(4, np.float32)
    for k, v in lead.items():
        v = np.uint32(v)
        out[k] = np.array([v & np.uint32((1 << 31) - 1) if v >> 31 else ~v], np.uint32).view(np.float32)[0]
    return out


def scan(spans: DataFrame, scanner: Scanner | None) -> DataFrame:
    """(doc_id, spans) per row of ``extract``: the reported spans (kind, start,
    end, score), by start, then kind as in ``KINDS``."""
    shared = spans.sparkSession.sparkContext.broadcast(scanner)  # some 20,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            rows = b.column("spans").to_pylist()
            flat = [x for r in rows for x in r]
            p = s.scores([(x["before"], x["value"], x["after"]) for x in flat]).tolist() if s and flat else [None] * len(flat)
            told = iter(p)
            out = []
            for r in rows:
                scored = [(x, next(told)) for x in r]
                out.append([{"kind": KINDS[x["kind"]], "start": x["start"], "end": x["end"], "score": q} for x, q in scored
                            if x["kind"] < 3 or (q is not None and q >= s.thresholds[shape(x["value"])])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return arrow_map(spans, run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def secret_spans(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 recall: float = RECALL) -> DataFrame:
    """(doc_id, spans) per row of ``docs``; ``labelled`` (before, value, after,
    label) replaces the findings taken from the table itself."""
    spans = extract(docs, id_col, text_col)
    return scan(spans, fit(findings(spans) if labelled is None else labelled, recall))

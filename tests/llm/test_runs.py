"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cinestat.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute(w, least=6, power=4):
    found = {}
    for q in range(1, len(w) // power + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        i = 0
        while i < len(same):
            if same[i]:
                j = same.index(False, i)
                if j - i + q >= max(least, power * q):
                    found.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rng):
    k, w = rng.choice([1, 2, 3, 50]), []
    while len(w) < rng.choice([0, 5, 30, 120]):
        part = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
        w += (part * rng.randint(1, 9))[:rng.randint(1, 60)]
    return w


@pytest.mark.parametrize("least,power", [(6, 4), (1, 2), (6, 3), (12, 5)])
def test_all_runs_are_found(least, power):
    rng = random.Random(least)
    for _ in range(400):
        docs = [some_words(rng) for _ in range(rng.randint(1, 4))]
        flat = np.array(sum(docs, []), np.int64)
        base = np.cumsum([0] + [len(d) for d in docs])
        got = periodic_runs.find_runs(flat, np.repeat(np.arange(len(docs)), [len(d) for d in docs]), least, power) if len(flat) else []
        assert got == sorted((s + int(base[i]), n, q) for i, d in enumerate(docs) for s, n, q in brute(d, least, power))


@pytest.mark.parametrize("words", [np.zeros(60_000), np.arange(60_000) % 7, np.arange(60_000) // 2 % 2])
def test_long_runs_take_no_quadratic_time(words):
    got = periodic_runs.find_runs(words.astype(np.int64), np.zeros(len(words), np.int64))
    assert len(got) == 1 and got[0][:2] == (0, 60_000)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    # the brute force is quadratic: its texts stay short, and the query takes them all
    short = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 12_000}
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    assert {i: got[i] for i in short} == short
    assert sum(r[1] > 0 for r in short.values()) > 5


def test_odd_rows(spark, odd, empty):
    got = sorted((r["doc_id"] or 0, r["n_words"], len(r["runs"]), r["collapsed"]) for r in periodic_runs.periodic_runs(odd).collect())
    assert len(got) == odd.count() and got[0] == (0, 0, 0, "") and (8, 1, 0, "solo") in got
    long = next(r for r in got if r[0] == 6)
    assert long == (6, 90_000, 1, "word alpha beta.")
    assert periodic_runs.periodic_runs(empty).count() == 0
    tailed = {(r["doc_id"], r["text"]) for r in queries.looped_tails(odd).collect()}
    assert (3, None) in tailed and (None, "solo") in tailed and (4, "") in tailed
    spaces = spark.createDataFrame([(1, "a b\x1ca b\x85 c\x0bd\x0ce\r\nf")], "doc_id long, text string")
    assert periodic_runs.periodic_runs(spaces).first()["n_words"] == 5

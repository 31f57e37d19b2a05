"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cinestat.llm import collocations

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, cover=50, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        cand = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cand.items():
            if len(p) == 3:
                covered |= {q for q in (p[:2], p[1:]) if 100 * a >= cover * cand[q]}
        found = []
        for p, a in cand.items():
            if p in covered:
                continue
            s, _, left, right = min((10**6 * a * a // (g[p[:k]] * g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
            found.append((s, a, " ".join(p), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


def corpus(rng, docs):
    words = ["the", "The", "of", "Ärger", "a.b", "x", "é", "\x1cq", "new york", "go!", "z z", "ok\tno", "end\r", "-"]
    return [(" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, "und", "a b"])) for _ in range(docs)]


@pytest.mark.parametrize("chunk,slice_,block", [(1 << 21, 8 << 20, 1 << 15), (50, 40, 7)])
def test_equals_brute_force(spark, monkeypatch, chunk, slice_, block):
    # small limits cannot reach the Python workers: with them the two task functions run here
    rows = corpus(random.Random(5), 300) + [(None, "en"), ("", None), ("hot word " * 3000, "en")]
    df = spark.createDataFrame([(i, t, g, "s") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string")
    if chunk < 1000:
        return check_small_chunks(rows, monkeypatch, chunk, slice_, block)
    got = sorted(map(tuple, collocations.collocations(df.repartition(5), min_count=3, top=40).collect()))
    assert got == brute(rows, 3, top=40)


def check_small_chunks(rows, monkeypatch, chunk, slice_, block):
    import pyarrow as pa
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "SLICE", slice_)
    monkeypatch.setattr(collocations, "BLOCK_ENTRIES", block)
    batch = pa.RecordBatch.from_pydict({"lang": [g or "und" for _, g in rows], "text": [(t or "").encode() for t, _ in rows]})
    parts = defaultdict(list)
    for b in collocations._stripes(3)(iter([batch])):
        parts[b.column("part")[0].as_py()].append(b)
    got = []
    for blocks in parts.values():
        (out,) = list(collocations._merged(3)(iter(blocks)))
        got += [tuple(r.values()) for r in out.to_pylist()]
    triples = {(r[0], r[2], r[3], r[4]): r[5] for r in got if r[1] == 3}
    want = Counter()
    total = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = [x.encode() for x in re.findall(r"[^\x20\x09]+", piece)]
            total[lang or "und"] += len(w)
            want.update((lang or "und", *w[i:i + 3]) for i in range(len(w) - 2))
    assert triples == {k: v for k, v in want.items() if v >= 3}
    sums = Counter()
    for r in got:
        if r[1] == 0:
            sums[r[0]] += r[5]
    assert sums == +total


def test_odd_rows(spark, odd, empty):
    got = sorted(map(tuple, collocations.collocations(odd, min_count=2).collect()))
    assert got == brute([(r["text"], r["lang"]) for r in odd.collect()], 2)
    assert got
    assert collocations.collocations(empty).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    big = [(3_000_000_000_000, 3_000_000_000_001, 3_000_000_000_007), (7, 7, 7), (10**14, 10**14 + 1, 10**14)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = [r[0] for r in df.select(collocations._score(F.col("a"), F.col("l"), F.col("r")).cast("long")).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in big]

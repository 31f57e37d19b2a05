"""Secret scans: patterns against a plain reading, the network on held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cinestat.llm import queries, secret_scan

SF = "/root/testdata/sf0.1"


def plain(text):
    """The three patterns as they are stated: match, then drop what is too short."""
    t = text or ""
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def test_patterns_equal_a_plain_reading():
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIA" + "Z" * 16,
            "abcdef0123456789", "ABCDEF", "é", "ſecret", "toKen", "-", ".", "\n", "x", "ffff", "0" * 24, "q" * 40, "short"]
    for _ in range(6000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        got = secret_scan.candidates(t)
        assert [(s, k, e) for s, k, e, _, _ in got if k < 3] == plain(t), t
        base = [(s, e) for s, k, e, _, _ in got if k < 3]
        others = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t) if len(m.group()) >= 16
                  and re.search("[A-Za-z0-9]", m.group()) and all(e <= m.start() or m.end() <= s for s, e in base)]
        assert [(s, e) for s, k, e, _, _ in got if k == 3] == others, t


def test_gradients():
    rng = np.random.default_rng(3)
    net = secret_scan.Network(4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.concatenate([secret_scan.encode("the key: ", "Ab1" * n, " and") for n in (6, 9, 30)])
    y = rng.integers(0, 2, len(x)).astype(float)

    def loss():
        z = net.forward(x)[0]
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    z, saved = net.forward(x)
    g = net.backward(saved, 1 / (1 + np.exp(-z)) - y)
    for name, w in net.p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in w.shape)
            if name == "embed":
                i = (int(rng.choice(x.ravel())), i[1])
            old = w[i]
            w[i] = old + 1e-5
            up = loss()
            w[i] = old - 1e-5
            down = loss()
            w[i] = old
            assert abs((up - down) / 2e-5 - g[name][i]) < 1e-3 + 1e-2 * abs(g[name][i]), name


def test_long_values_are_read_whole():
    value = "".join(chr(33 + i % 90) for i in range(500))
    seen = secret_scan.encode("before", value, "after")
    assert {int(c) for w in seen for c in w[24:72]} >= {ord(c) - 31 for c in value}
    assert len(secret_scan.encode("", "x" * 48, "")) == 1 and len(secret_scan.encode("", "x" * 49, "")) == 2


def test_query_against_a_plain_reading_and_held_out_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op12_secret_scan(spark, SF).collect()}
    assert set(got) == set(docs)
    extra = []
    for i, t in docs.items():
        base = plain(t)
        listed = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        told = r["spans"].split(",") if r["spans"] else []
        assert set(listed.split(",")) - {""} <= set(told)
        extra += [x for x in told if x.startswith("network")]
    assert len(extra) <= len(docs) // 1000  # clean documents stay clean


def test_scanner_finds_unseen_formats_and_meets_its_recall(spark):
    spans = secret_scan.extract(spark.read.parquet(f"{SF}/documents.parquet"))
    scanner = secret_scan.fit(secret_scan.findings(spans))
    seen = {x["value"]: (x["before"], x["value"], x["after"], x["kind"] < 3) for r in spans.collect() for x in r["spans"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    flagged = lambda rows: [p >= scanner.thresholds[secret_scan.shape(r[1])] for r, p in zip(rows, scanner.scores([r[:3] for r in rows]), strict=True)]
    secrets, others = ([r for r in seen.values() if r[3] is bool(c)] for c in (1, 0))
    assert np.mean(flagged(secrets)) >= 0.95 and np.mean(flagged(others)) <= 0.01
    rng = random.Random(8)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = [("use ", p + pick(alnum, 30), " to log in") for p in ("ghp_", "sk_live_", "xoxb-", "") for _ in range(25)]
    assert np.mean(flagged(planted)) >= 0.9
    clean = [("see ", x, " for more") for x in ("internationalization", "4876179267539117", "www.example.com/a/b/c.html", "mail6.example.com",
                                                "src/main/java/com/example")]
    assert not any(flagged(clean))


def test_odd_rows(spark, odd, empty):
    got = secret_scan.secret_spans(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] == [] for r in got)
    assert secret_scan.secret_spans(empty).count() == 0
    few = spark.createDataFrame([(1, "Password: hunter2x; é " + "k" * 70_000), (1, "Password: hunter2x"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, [tuple(s) for s in r["spans"]]) for r in secret_scan.secret_spans(few).collect())
    assert got == [(0, []), (1, [("assign", 0, 18, None)]), (1, [("assign", 0, 18, None)])]


def test_own_labels(spark):
    rng = random.Random(1)
    rows = [("pin ", f"{rng.randrange(10**19):020d}", " ok", 1) for _ in range(80)]
    rows += [("see ", "".join(rng.choices("abcdefgh", k=20)), " ok", 0) for _ in range(80)]
    labelled = spark.createDataFrame(rows, "before string, value string, after string, label int")
    docs = spark.createDataFrame([(1, "pin 48201748291740283611 ok, see abcdefghgfedcbabcdef ok")], "doc_id long, text string")
    assert [tuple(s)[:3] for s in secret_scan.secret_spans(docs, labelled).first()["spans"]] == [("network", 4, 24)]


@pytest.mark.parametrize("n", [0, 1, 7])
def test_too_few_findings_teach_nothing(n):
    assert secret_scan.learn([("", "x" * (i + 20), "", 1) for i in range(n)] + [("", "y" * (i + 20), "", 0) for i in range(30)]) is None


@pytest.fixture(scope="module")
def many(spark):
    """4,000 secrets and 4,500 others, a document each, outside the held-out fold."""
    rng = random.Random(5)
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 5)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    rows = [(next(ids), "token=" + pick("ABCDEFGHJKabcdefghijk0123456789", 30) + " .") for _ in range(4000)]
    rows += [(next(ids), "see www." + pick("aeiou", 3) + "example.com/" + pick("abcdefgh", 8) + ".html now") for _ in range(4500)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_all_findings_are_learned(spark, many):
    found = secret_scan.findings(secret_scan.extract(many))
    n = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    assert n == {1: 4000, 0: found.where("label = 0").select("value").distinct().count()} and n[0] > 4400


def test_chunks_learn_all_findings_alike_in_any_order(spark, many):
    found = secret_scan.findings(secret_scan.extract(many))
    rows = [tuple(r) for r in found.collect()]
    scanner, again = (secret_scan.fit(f, chunk=1 << 12) for f in (found, found.repartition(7)))
    assert all((scanner.network.p[k] == again.network.p[k]).all() for k in scanner.network.p)
    assert (scanner.slope, scanner.intercept, scanner.thresholds) == (again.slope, again.intercept, again.thresholds)
    p = scanner.scores([r[:3] for r in rows])
    told = np.array([q >= scanner.thresholds[secret_scan.shape(r[1])] for q, r in zip(p, rows, strict=True)])
    y = np.array([r[3] for r in rows])
    assert told[y == 1].mean() >= 0.97 and told[y == 0].mean() <= 0.01


@pytest.mark.parametrize("split", [True, False])
def test_every_finding_of_a_chunk_is_coded_once(split):
    rng = random.Random(3)
    rows = [("a ", "".join(rng.choices("abcdef0123456789", k=rng.choice((20, 60, 200)))), " z", i % 3 == 0) for i in range(300)]
    table = pa.table({"chunk": [4] * 300, **{c: list(v) for c, v in zip(("before", "value", "after", "label"), zip(*rows, strict=True), strict=True)}})
    got = {r["checked"]: r for r in secret_scan._coder(2, split, 0)(table.set_column(4, "label", table["label"].cast("int32"))).to_pylist()}
    assert sum(len(got[c]["y"]) for c in got) == (500 if split else 1000)
    for r in got.values():
        heads, x = np.frombuffer(r["heads"], np.int64), np.frombuffer(r["x"], np.uint8).reshape(r["n"], -1)
        y = np.frombuffer(r["y"], np.uint8)
        assert r["n_secrets"] == np.diff(heads, append=r["n"])[y == 1].sum()
        windows = [w.tobytes() for w in np.split(x, heads[1:])]
        own = [secret_scan.encode(*q[:3]).tobytes() for q in rows if not split or bool(secret_scan.set_aside([q])[0]) is r["checked"]]
        assert not {*own} - {*windows}


def test_calibration_over_chunks_equals_that_of_all_rows(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 900).astype(np.uint8)
    z = (rng.normal(size=900) + 2 * y - 1).astype(np.float32)
    z[::50] = np.repeat(z[:1], 18)  # ties
    shapes = np.where(rng.random(900) < 0.004, 1, rng.integers(0, 2, 900) * 2).astype(np.uint8)
    cut = [0, 100, 101, 600, 900]
    logits = spark.createDataFrame([(i, b - a, *(bytearray(v[a:b].tobytes()) for v in (z, y, shapes))) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))],
                                   "chunk int, n long, z binary, y binary, shapes binary").repartition(3)
    got = secret_scan.calibrated(secret_scan.Network(), logits, 0.9)
    n1, n0 = y.sum(), (1 - y.astype(int)).sum()
    assert np.allclose((got.slope, got.intercept), secret_scan.platt(lambda a, b: secret_scan.platt_sums(z.astype(float), y, n1, n0, a, b)), atol=1e-9)
    for k in range(3):
        mine = z[(y == 1) & (shapes == k)]
        mine = np.sort(mine if len(mine) >= secret_scan.LEAST else z[y == 1])
        assert got.thresholds[k] == got.probability(mine[int(np.floor((1 - 0.9) * len(mine)))][None])[0]

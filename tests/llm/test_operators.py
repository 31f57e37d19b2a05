"""Every operator against brute force on small tables, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cinestat.llm import (
    exact_dedup, lexicon, licenses, line_rules, packing, quality, queries, sharding, simhash, token_counts,
    toxicity,
)
from cinestat.llm.bytebpe import ByteBPE

from .conftest import LONG, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- exact dedup -------------------------------------------------------------

def brute_dedup(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    return {k: (max((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_groups_equal_brute_force(spark, odd, counters):
    data = [(r[0], r[1]) for r in ODD] + [(100 + i, "Hot" if i % 2 else "hot") for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = brute_dedup(data)
    got = rows(exact_dedup.exact_groups(df, counters=counters).withColumn("digest", F.lower(F.hex("digest"))))
    assert len(got) == len(data)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["digest"]]
    assert Counter(r["digest"] for r in got if r["kept"]) == dict.fromkeys(want, 1)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_misra_gries_never_loses_a_frequent_item():
    rng = random.Random(3)
    items = [rng.choice([b"a", b"b"]) if rng.random() < 0.5 else str(rng.random()).encode() for _ in range(4000)]
    whole, parts = exact_dedup.MisraGries(9), exact_dedup.MisraGries(9)
    for x in items:
        whole.add(x)
    for a in range(0, len(items), 500):
        one = exact_dedup.MisraGries(9)
        for x in items[a:a + 500]:
            one.add(x)
        parts.merge(one.counts)
    for mg in (whole, parts):
        assert len(mg.counts) <= 9
        for x, n in Counter(items).items():
            if n > len(items) / 10:
                assert n - len(items) / 10 <= mg.counts[x] <= n


def test_drop_exact_copies_keeps_all_columns(spark, odd, empty):
    got = exact_dedup.drop_exact_copies(odd)
    assert got.schema == odd.schema
    kept = Counter((r["text"] or "").translate(LOWER) for r in rows(got))
    assert set(kept.values()) == {1} and len(kept) == len(brute_dedup([(r[0], r[1]) for r in ODD]))
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0


# --- sharding ----------------------------------------------------------------

def test_sharding_balances_bytes_and_numbers_rows(spark, tmp_path):
    got = rows(queries.op4_sharding(spark, SF))
    src = {r["doc_id"]: r["text"] for r in rows(docs_of(spark))}
    load, slots = Counter(), defaultdict(list)
    for r in got:
        t = src[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(src) and set(load) <= set(range(40))
    assert max(load.values()) <= sum(load.values()) / 40 + max(r["size"] for r in got)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_the_stored_map_is_taken_up_and_edited(spark, tmp_path):
    path, body = f"{tmp_path}/map", "word " * 9
    docs = spark.createDataFrame([(i, body * (1 + i % 5)) for i in range(4000)], "doc_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(10_000 + i, body) for i in range(1500)], "doc_id long, text string"))
    steps = [(docs, 5), (docs, 6), (more, 6), (more, 4)]
    seen = []
    for k, (df, shards) in enumerate(steps):
        got = rows(sharding.shard_documents(df, shards, path, slots=512))
        assert sharding.newest_map(spark, path)[0] == k + 1
        load, places = Counter(), defaultdict(list)
        for r in got:
            load[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert set(load) == set(range(shards)) and max(load.values()) < 1.05 * sum(load.values()) / shards
        assert all(sorted(v) == list(range(len(v))) for v in places.values())
        # against the map recomputed from the sizes alone
        sizes = Counter()
        for r in got:
            sizes[r["virtual_slot"]] += r["size"]
        if k == 0:
            want = sharding.balanced_map([(v, b, 0) for v, b in sorted(sizes.items())], shards, 512)
        else:
            want = sharding.rebalanced_map(seen[-1][1], [(v, b, 0) for v, b in sorted(sizes.items())], shards)
        assert all(want[r["virtual_slot"]] == r["shard"] for r in got)
        seen.append(({r["doc_id"]: r["shard"] for r in got}, sharding.newest_map(spark, path)[1]))
    grown = [i for i, s in seen[0][0].items() if seen[1][0][i] != s]
    assert grown and all(seen[1][0][i] == 5 for i in grown) and len(grown) < 0.25 * 4000
    assert len([i for i, s in seen[1][0].items() if seen[2][0][i] != s]) < 0.1 * 4000
    assert all(seen[3][0][i] == s for i, s in seen[2][0].items() if s < 4 and seen[3][1] == seen[2][1])


def test_slot_map_versions_and_growth(spark, odd, empty, tmp_path):
    sizes = [(v, 100 + v % 7, 1) for v in range(0, 512)]
    one = sharding.balanced_map(sizes, 8, 512)
    two = sharding.rebalanced_map(one, sizes, 9)
    moved = [v for v in one if one[v] != two[v]]
    assert moved and all(two[v] == 8 for v in moved)  # only into the new shard
    load = Counter()
    for v, b, _ in sizes:
        load[two[v]] += b
    assert max(load.values()) - min(load.values()) < 0.15 * sum(load.values()) / 9
    fewer = sharding.rebalanced_map(one, sizes, 7)
    assert set(fewer.values()) == set(range(7))
    path = str(tmp_path / "map")
    sharding.save_map(sharding.map_table(spark, one, sizes, 1), path)
    sharding.save_map(sharding.map_table(spark, two, sizes, 2), path)
    read = lambda v: {r["virtual_slot"]: r["shard"] for r in rows(sharding.load_map(spark, path, v))}
    assert read(1) == one and read(2) == two and read(None) == two
    assert sharding.shard_documents(odd, 4, str(tmp_path / "odd")).count() == len(ODD)
    assert sharding.shard_documents(empty, 4, str(tmp_path / "empty")).count() == 0


# --- quality rules -----------------------------------------------------------

def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_measures_equal_brute_force(spark, odd, empty):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", "\n\n x \n x "]) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in rows(line_rules.judge(df)):
        want = brute_measures(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
    got = rows(line_rules.judge(odd))
    assert len(got) == len(ODD) and {r["n_words"] for r in got if r["doc_id"] == 3} == {0}
    assert next(r for r in got if r["doc_id"] == 6)["n_repeat_words"] == len(LONG.split())
    assert line_rules.judge(empty).count() == 0


def test_sql_of_the_quality_rules_and_of_exact_groups_on_odd_rows(spark, odd, tmp_path):
    import duckdb
    from cinestat.llm import queries
    rng = random.Random(9)
    lines = ["Home  About", "HOME about ", "a b c d", " \t", "terms | of use", "x " * 60]
    data = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))) + f"\nown {i % 30}", None, rng.choice(["p", "q", None]), 1)
            for i in range(90)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name, sql in queries.SQL.items():
        got = rows(queries.QUERIES[name](spark, str(tmp_path)))
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(cur.fetchall()), name


def test_packed_and_exact_window_repeats_agree(spark):
    df = spark.createDataFrame([("a b c d a b c x a b c",), ("p q r s t",), ("z " * 9,)], "t string")
    w = line_rules.words_of(F.col("t"))
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    h = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    out = rows(df.select(line_rules._repeats_packed(h).alias("p"), line_rules._repeats_exact(h).alias("e")))
    assert all(r["p"] == r["e"] for r in out)


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    nav = "Home About Contact  Terms"
    data = [(i, f"{nav}\n{body(i)}", "big") for i in range(30)]
    menu = [" ".join(f"m{k}n{j}" for j in range(6)) for k in range(12)]
    data += [(100, "\n".join([nav.upper(), *menu]), "big")]
    data += [(200 + i, "\n".join([*menu, f"end {i}"]), "big") for i in range(14)]
    data += [(300 + i, f"{nav}\n{body(900)}", "copies") for i in range(40)]  # one text, many copies: one document
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows(line_rules.judge(df))}
    assert all(got[i]["kept"] for i in range(30)) and got[0]["left_words"] == 64 and got[5]["left_words"] == 60
    assert [i for i in range(200, 214) if not got[i]["kept"]] == list(range(200, 214)) and got[100]["kept"]
    assert all(got[i]["kept"] and got[i]["left_words"] == 64 for i in range(300, 340))
    clean = {r["doc_id"]: r["text"] for r in rows(line_rules.keep_good(df, length_col=None))}
    assert clean[5] == body(5) and clean[0] == f"{nav}\n{body(0)}" and 200 not in clean


# --- SimHash -----------------------------------------------------------------

def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= radius).tolist():
            p, q = find(i), find(i + 1 + j)
            parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(a))]


def test_fingerprints_and_groups_equal_brute_force(spark, odd, empty):
    src = sorted((r["doc_id"], r["text"]) for r in rows(docs_of(spark)))
    fps = [brute_fingerprint(t) for _, t in src]
    roots = brute_components(fps)
    got = {r["doc_id"]: r for r in rows(queries.op7_simhash(spark, SF))}
    for k, (i, _) in enumerate(src):
        assert got[i]["fingerprint"] == f"{fps[k]:016x}" and got[i]["component_id"] == src[roots[k]][0]
    out = rows(simhash.near_groups(odd))
    assert len(out) == len(ODD)
    zero = {r["component"] for r in out if r["fp"] == 0}
    assert zero == {3}  # null, empty and blank texts, also without an id
    assert {r["component"] for r in out if r["doc_id"] == 8} == {8}
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
    left = simhash.drop_near_copies(odd)
    assert left.schema == odd.schema and left.count() == len({r["component"] for r in out}) + 1  # id 8 has two texts


def test_covering_masks_miss_no_pair_within_the_radius():
    masks = simhash.covering_masks(list(range(64)))
    rng = random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(not diff & m for m in masks)
    for level in simhash.mask_tree(3):
        for _ in range(100):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not diff & m for _, _, m in level)
    assert max(64 - m.bit_count() for _, _, m in simhash.mask_tree(3)[2]) == 8


def test_large_buckets_are_split_without_losing_links(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = set(base)
    while len(fps) < 1500:  # chains and clouds around few centres
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = simhash.near_links(df, limit=256)
    root = {r["node"]: r["root"] for r in rows(simhash.connected(links))}
    groups = [root.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    assert [groups.index(g) for g in groups] == brute_components(fps)


# --- packing -----------------------------------------------------------------

def test_pieces_hold_every_token_once_and_sequences_are_full(spark, odd, empty):
    path = queries.byte_bpe()
    tok = tokenizers.Tokenizer.from_file(path)
    for df in (docs_of(spark), odd):
        src = Counter()
        for r in rows(df.select("doc_id", "text")):
            src[r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0])] += 1
        got = rows(packing.pack(df, path))
        seqs, by = defaultdict(list), defaultdict(list)
        for r in got:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
            by[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
        assert sorted(seqs) == list(range(len(seqs)))
        used = []
        for v in seqs.values():
            v.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and v[0][0] == 0
            used.append(sum(n for _, n in v))
        assert all(u == 1024 or u & (u - 1) == 0 for u in used)
        assert sum(used) == sum(len(ids) * n for (_, ids), n in src.items())
        for (doc, n), pieces in by.items():
            ids = np.frombuffer(b"".join(p for _, p in sorted(pieces)), "<u4")
            copies = sum(k for (d, x), k in src.items() if d == doc and len(x) == n)
            if copies == 1:
                assert (doc, tuple(ids.tolist())) in src
            assert len(ids) == n * copies
    assert packing.pack(empty, path).count() == 0


def test_rotation_keeps_targets_and_carries_deficits():
    totals = {"a": 70_000, "b": 20_000, "c": 10_003}
    r = packing.Rotation(totals, {"a": 1, "b": 1, "c": 2}, window=1000, length=64)
    place = {}
    windows = defaultdict(Counter)
    for q, n in totals.items():
        at = 0
        while at < n:  # any cut of a queue gives the same stream
            end = min(n, at + 777)
            for x, y, p, w in r.runs(q, at, end):
                for t in range(x, y):
                    assert p + t - x not in place
                    place[p + t - x] = q
                windows[w][q] += y - x
            at = end
    assert sorted(place) == list(range(sum(totals.values())))
    for w in range(15):
        assert windows[w]["c"] == 500 and abs(windows[w]["a"] - 250) <= 1
    e = packing.Rotation({"a": 10, "b": 20, "c": 31}, window=10).epochs[0]
    assert all(0 <= d < 1 for w in range(6) for d in e.deficit(w))
    assert packing.Rotation({}, None).tokens == 0


def test_targets_hold_with_more_sources_than_queues(spark, empty):
    path = queries.byte_bpe()
    data = [(i, "one two three four five six seven " * 3, f"s{i % 40}") for i in range(400)]
    data += [(1000 + i, "many more words in one large source " * 20, "large") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = rows(packing.pack(df, path, targets={"s0": 1, "s1": 3}, length=16, window=64, max_queues=8))
    assert {"s0", "s1", "large"} <= {r["queue"] for r in got} and len({r["queue"] for r in got}) <= 8
    first = Counter()
    for r in got:
        if r["window"] < 3:
            first[r["queue"]] += r["length"]
    assert first == {"s0": 48, "s1": 144}
    source = {i: s for i, _, s in data}
    assert all(source[r["doc_id"]] == r["queue"] for r in got if not r["queue"].startswith(packing.SHARED))
    with pytest.raises(ValueError, match="targets without documents"):
        packing.pack(df, path, targets={"s0": 1, "elsewhere": 1}, max_queues=8)
    assert packing.pack(empty, path, targets={"s0": 1}).count() == 0


# --- BPE ---------------------------------------------------------------------

ALPHABET = ["a", "Z", " ", "  ", "\n", "\t", "é", "ß", "'s", "'LL", "1", "22", "!", "…", "　", " ", "\x85", "\x1c", "\x1f",
            "\x0b", "中", "😀", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "ΑΣ", "é", "ſ"]


def odd_texts(n=3000):
    rng = random.Random(11)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(n)] + ["a" * 5000, "é" * 300, "=-" * 2000, " " * 4000 + "x"]


def test_lexicon_encoder_equals_the_library():
    path = queries.word_bpe()
    tok, bpe = tokenizers.Tokenizer.from_file(path), lexicon.WordBPE(path)
    words = [w.encode() for w in ("hello", "hell", "shell", "a", "the", "there", "é")]
    lex = lexicon.Lexicon.mapped(lexicon.compile_lexicon(dict(zip(words, bpe.merge(words), strict=True))))
    assert sorted(lex.numbers(words).tolist()) == list(range(len(words)))
    assert lex.numbers([b"he", b"", b"theres", b"zzz"]).tolist() == [-1] * 4
    assert [lex.ids_of(int(n)).tolist() for n in lex.numbers(words)] == bpe.merge(words)
    for lx in (lex, lexicon.Lexicon(lexicon.compile_lexicon({}))):
        enc = lexicon.Encoder(bpe, lx, cache_limit=50)
        texts = odd_texts()
        for a in range(0, len(texts), 200):
            for t, ids in zip(texts[a:a + 200], enc.encode(texts[a:a + 200]), strict=True):
                want = tok.encode(t, add_special_tokens=False).ids
                assert ids.tolist() == want
                assert bpe.decode(want) == tok.decode(want, skip_special_tokens=False)


def test_suffixes_are_shared():
    states = lexicon.minimal_automaton(sorted(a + b"tion" for a in (b"na", b"sta", b"mo", b"ques")))
    assert len(states) < 16 and states[-1].words == 4


def test_op3_equals_the_library(spark, odd, empty):
    path = queries.word_bpe()
    tok = tokenizers.Tokenizer.from_file(path)
    src = {r["doc_id"]: r["text"] for r in rows(docs_of(spark))}
    for r in rows(queries.op3_bpe(spark, SF)):
        ids = tok.encode(src[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    block = lexicon.build_lexicon(odd, path)
    got = lexicon.encode_decode(odd, path, block)
    assert got.count() == len(ODD) and [r["ids"] for r in rows(got) if r["doc_id"] == 3] == [[]]
    again = lexicon.decode(got, path, out_col="again")
    assert all(r["again"] == r["decoded"] for r in rows(again))
    assert lexicon.encode_decode(empty, path, lexicon.build_lexicon(empty, path)).count() == 0


def test_byte_bpe_equals_the_library():
    path = queries.byte_bpe()
    tok, bpe = tokenizers.Tokenizer.from_file(path), ByteBPE(path)
    sizes = bpe.byte_lengths()
    for t in odd_texts():
        e = tok.encode(t, add_special_tokens=False)
        assert bpe.ids(t).tolist() == e.ids
        if t:
            start, end = token_counts.char_spans(t, sizes[bpe.ids(t)])
            assert list(zip(start.tolist(), end.tolist(), strict=True)) == [tuple(x) for x in e.offsets]


# --- token counts ------------------------------------------------------------

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_share_all_tokens(spark, odd, empty, rule):
    path = queries.byte_bpe()
    tok = tokenizers.Tokenizer.from_file(path)
    df = docs_of(spark).limit(40).unionByName(spark.createDataFrame([(-1, "a\n\n\n\nb\r\n\n  c", "en", "s", 1)], docs_of(spark).schema))
    src = {r["doc_id"]: r for r in rows(df)}
    by = defaultdict(list)
    for r in rows(token_counts.attribute_tokens(df, path, ["source", "lang", "text"], split={"text": "\n"}, rule=rule)):
        by[r["doc_id"]].append(r)
    for d, v in by.items():
        v.sort(key=lambda r: r["start"])
        whole = f"{src[d]['source']}\n{src[d]['lang']}\n{src[d]['text']}\n"
        e = tok.encode(whole, add_special_tokens=False)
        want = [0.0] * len(v)
        for a, b in e.offsets:
            part = [max(0, min(b, r["end"]) - max(a, r["start"])) for r in v]
            if rule == "start":
                want[next(i for i, r in enumerate(v) if r["start"] <= a < r["end"])] += 1
            elif rule == "most":
                want[part.index(max(part))] += 1
            else:
                want = [w + p / (b - a) for w, p in zip(want, part, strict=True)]
        assert [r["n_tokens"] for r in v] == pytest.approx(want) and v[-1]["end"] == len(whole)
    got = rows(token_counts.attribute_tokens(odd, path, ["source", "text"], split={"text": "\n"}, rule=rule))
    assert len({(r["doc_id"], r["field"]) for r in got}) == 2 * len({r[0] for r in ODD})
    assert token_counts.attribute_tokens(empty, path, ["text"], rule=rule).count() == 0


# --- classifiers -------------------------------------------------------------

def labelled(spark, sf):
    return docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_scores_on_the_held_out_fold(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = labelled(spark, sf)
    truth = {r["doc_id"]: r["quality"] for r in rows(labels)}
    got = rows(queries.op1_quality_classifier(spark, sf))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    test = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert quality.quality_scores(odd, labels).count() == len(ODD)
    none = labels.where("false")
    assert {r["score"] for r in rows(quality.quality_scores(odd, none))} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.keep_good(odd, none, 0.3).schema == odd.schema


def test_discriminant_uses_mahalanobis_distances():
    rng = np.random.default_rng(0)
    dim = 3
    x = [rng.normal(size=(500, dim)), rng.normal(size=(800, dim)) * 2 + 1]
    n = np.array([500.0, 800.0])
    m = quality.Discriminant.fit(n, np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.2, 0.1)
    p = rng.normal(size=(5, dim))
    want = []
    for c in (0, 1):
        s = m.factors[c] @ m.factors[c].T
        d = p - x[c].mean(0)
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    assert m.difference(p) == pytest.approx(want[1] - want[0])


def test_toxicity_learns_marked_words(spark, odd, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    data = [(i, " ".join([word() for _ in range(rng.randint(5, 60))] + (["zorkish"] if i % 4 == 0 else [])), i % 4 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.toxicity_scores(docs, labels))}
    held = [(got[i] >= 0.5, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert toxicity.toxicity_scores(odd, labels).count() == len(ODD)
    assert {r["score"] for r in rows(toxicity.toxicity_scores(odd, labels.where("false")))} == {0.5}
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Some text, long enough to be cut into blocks."
    whole = set(np.concatenate(list(toxicity.ngram_buckets(text))).tolist())
    monkeypatch.setattr(toxicity, "_CHUNK", 7)
    assert set(np.concatenate(list(toxicity.ngram_buckets(text))).tolist()) == whole


# --- licences ----------------------------------------------------------------

def test_license_scan_and_inheritance(spark, odd, empty):
    mit = licenses.TEMPLATES["MIT"]
    data = [
        (1, "Released under the MIT License.\nbody text here", "repo/a/x.txt"),
        (2, mit[2], "repo/LICENSE"),
        (3, "plain words only", "repo/b/c/y.txt"),
        (4, "Licensed under the Apache License, Version 2.0.", "repo/b/COPYING"),
        (5, "plain words only", "repo/b/d/z.txt"),
        (6, "you may free the public software source", "other/q.txt"),
        (7, None, None),
        (8, "Intro.\n" + "filler words. " * 50 + "This work is licensed under the GNU General Public License, version 3.\nmore", "other/r.txt"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, path string")
    got = {r["doc_id"]: r for r in rows(licenses.scan(df))}
    assert {i: (r["licence"], r["origin"]) for i, r in got.items()} == {
        1: ("MIT", "header"), 2: ("MIT", "header"), 3: ("Apache-2.0", "inherited"), 4: ("Apache-2.0", "header"),
        5: ("Apache-2.0", "inherited"), 6: (None, "none"), 7: (None, "none"), 8: ("GPL-3.0", "header")}
    assert got[3]["distance"] == 1 and data[7][1][got[8]["match_start"]:got[8]["match_end"]].startswith("This work is")
    with_path = odd.withColumn("path", F.col("source"))
    assert licenses.scan(with_path).count() == len(ODD)
    assert licenses.scan(empty.withColumn("path", F.col("source"))).count() == 0


def test_anchors_lose_no_run_above_the_threshold():
    freq = {"license": 900, "the": 990, "version": 40}
    m = licenses.Matcher(licenses.TEMPLATES, freq, 1000, 0.8)
    full = licenses.Matcher(licenses.TEMPLATES, freq, 1000, 0.8)
    full.by_anchor = {t: list(range(len(full.forms))) for t in full.idf}
    rng = random.Random(4)
    pool = [t for f in licenses.TEMPLATES.values() for x in f for t in licenses.terms(x)]
    for _ in range(3000):
        run = Counter(rng.choices(pool, k=rng.randint(1, 8)))
        want = full.run_score(run)
        if want[1] >= 0.8:
            assert m.run_score(run)[1] == pytest.approx(want[1])


def test_notices_in_long_lines_and_narrow_wraps_are_found():
    import textwrap
    m = licenses.Matcher(licenses.TEMPLATES, {"the": 990, "of": 980, "and": 970, "this": 700, "all": 600}, 1000, 0.8)
    gpl = licenses.TEMPLATES["GPL-3.0"][2]
    footer = "Imprint | Contact | About the people behind these pages | Released under the MIT License | Terms | Archive of older news"
    for text, want in (
            ("The parser and all of its bundled example data are Released under the MIT License.", "MIT"),
            ("Unless noted otherwise all pages of this site are Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
            (footer, "MIT"), *((textwrap.fill(gpl, n, initial_indent="# ", subsequent_indent="# "), "GPL-3.0") for n in (16, 30, 79))):
        name, score, a, b = m.header(text)
        assert name == want and score > 0.99, text
        assert text[a:b].split()[0] in ("Released", "Licensed", "This", "#")
    assert m.header("The release of the parser is described on all pages of this site.")[0] is None


def test_siblings_are_told_apart_and_licence_files_are_templates():
    m = licenses.Matcher(licenses.TEMPLATES, {"the": 990, "of": 980, "and": 970, "this": 700, "all": 600, "to": 900, "a": 900}, 1000, 0.8)
    std = licenses.TEMPLATES["GPL-3.0"][2]
    for text, want in (
            (std, "GPL-3.0"), (std.replace("version 3", "version 2"), "GPL-2.0"), (std.replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
            (std.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1"),
            ("Licensed under the GNU General Public License, version 2.", "GPL-2.0"),
            ("This work is licensed under the GNU General Public License.", "GPL-1.0-or-later"),
            ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
            ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
            ("Licensed under the Apache License, Version 1.1.", None)):
        assert m.header(text)[0] == want, text
    for name, forms in licenses.TEMPLATES.items():
        for form in forms:
            if len(form) < 2000:
                assert m.header(form)[0] == name, form[:80]
            if len(form) > 500:
                assert m.whole(f"Copyright (c) 2020 Someone Else\n\n{form}")[0] == name, form[:80]


def test_word_counts_are_complete_whatever_the_partitions(spark):
    """No word is lost where every task's counter is full."""
    words = ["common" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(words + [f"only{k}n{i}" for k in range(200)])) for i in range(12)], "doc_id long, text string")
    want = None
    for parts in (1, 4, 12):
        got = {r["word"]: r["n"] for r in rows(lexicon.frequent_words(df.repartition(parts), queries.word_bpe(), local_words=50))}
        assert sum(n == 12 for w, n in got.items() if w.startswith("common")) >= 290
        assert want is None or got == want
        want = got


def test_ratios_and_scores_equal_a_plain_classifier(spark):
    """NB log-count ratios and the fitted scores against numpy on the same rows,
    with an id that has two texts and one that has two labels."""
    rng = random.Random(2)
    make = lambda bad: " ".join(rng.choice(["nasty", "vile"] if bad and rng.random() < 0.3 else ["calm", "kind", "tree", "river"]) for _ in range(12))
    data = [(i, make(i % 2)) for i in range(120)] + [(3, "calm tree"), (5, "nasty vile")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(4, 1)], "doc_id long, toxic int")
    sample = {r["doc_id"]: (r["label"], r["text"]) for r in rows(toxicity.sample_rows(docs.repartition(7), labels))}
    again = {r["doc_id"]: (r["label"], r["text"]) for r in rows(toxicity.sample_rows(docs.repartition(2), labels.repartition(3)))}
    assert sample == again
    model = toxicity.fit(toxicity.sample_rows(docs, labels), features=400)
    grams = {i: set(np.concatenate(list(toxicity.ngram_buckets(t))).tolist()) for i, (_, t) in sample.items()}
    n = [sum(1 for lab, _ in sample.values() if lab == c) for c in (0, 1)]
    df = [Counter(g for i, (lab, _) in sample.items() if lab == c for g in grams[i]) for c in (0, 1)]
    ratio = {g: np.log((df[1][g] + 1) / (n[1] + 2)) - np.log((df[0][g] + 1) / (n[0] + 2)) for g in set(df[0]) | set(df[1])
             if df[0][g] + df[1][g] >= toxicity.MIN_DOCS}
    strong = sorted(ratio, key=lambda g: (-abs(ratio[g]) / np.sqrt(1 / (df[1][g] + 1) + 1 / (df[0][g] + 1)), g))[:400]
    assert set(np.flatnonzero(model.feature >= 0).tolist()) == set(strong)
    order = sorted(sample)
    at = {g: k for k, g in enumerate(np.flatnonzero(model.feature >= 0)[np.argsort(model.feature[model.feature >= 0])].tolist())}
    x = [np.array(sorted(at[g] for g in grams[i] if g in at)) for i in order]
    scale = np.array([ratio[g] for g in sorted(at, key=at.get)])
    w, b = toxicity.fit_logistic(x, np.array([sample[i][0] for i in order]), scale)
    for i, f in zip(order, x):
        assert model.score(sample[i][1]) == pytest.approx(1 / (1 + np.exp(-(w[f].sum() + b))), abs=1e-6)

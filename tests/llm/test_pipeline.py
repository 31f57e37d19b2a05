"""Every pipeline stage against brute force on its own input, on odd rows and
empty tables."""

from collections import Counter

import corpus_pipeline

from cinestat.llm import exact_dedup, line_rules, packing, quality, queries, simhash

from .conftest import ODD
from .test_operators import LOWER, SF, brute_components, brute_fingerprint, brute_measures, rows

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "exact_duplicates", "near_duplicates",
                                                      "pack_sequences"]


def test_each_stage_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    step = STAGES["quality_rules"](spark, docs, SF).cache()
    assert step.schema == docs.schema
    verdict = {r["doc_id"]: r["kept"] for r in rows(line_rules.judge(docs))}
    assert {r["doc_id"] for r in rows(step)} == {i for i, k in verdict.items() if k}
    for r in rows(docs):
        m = brute_measures(r["text"])
        if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]:
            assert not verdict[r["doc_id"]]
    good = STAGES["quality_classifier"](spark, step, SF).cache()
    score = {r["doc_id"]: r["score"] for r in rows(quality.quality_scores(step, labels))}
    assert good.schema == docs.schema and {r["doc_id"] for r in rows(good)} == {i for i, s in score.items() if s >= 0.3}
    once = STAGES["exact_duplicates"](spark, good, SF).cache()
    last = {}
    for r in rows(good):
        k = r["text"].translate(LOWER)
        last[k] = max(last.get(k, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(once)) == sorted(last.values())
    far = STAGES["near_duplicates"](spark, once, SF).cache()
    src = sorted((r["doc_id"], r["text"]) for r in rows(once))
    roots = brute_components([brute_fingerprint(t) for _, t in src])
    assert sorted(r["doc_id"] for r in rows(far)) == sorted({src[x][0] for x in roots})
    assert far.schema == docs.schema
    pieces = rows(STAGES["pack_sequences"](spark, far, SF))
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows(far)}
    run = rows(corpus_pipeline.run(spark, SF))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in run) == Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces)


def keys(df):
    return Counter((r["doc_id"], r["text"]) for r in rows(df))


def test_stages_on_odd_rows_and_empty_tables(spark, odd, empty):
    """What each stage keeps of the odd rows, by id and text."""
    all_odd = Counter((r[0], r[1]) for r in ODD)
    got = {n: STAGES[n](spark, odd, SF) for n in STAGES}
    for n, f in STAGES.items():
        assert f(spark, empty, SF).count() == 0
        if n != "pack_sequences":
            assert got[n].schema == odd.schema
    assert keys(got["quality_rules"]) == Counter()  # all are short, or repeat themselves
    # the labels know none of the odd ids well enough to learn from: all pass or fail by the share of good ones
    scores = {(r["doc_id"], r["score"]) for r in rows(quality.quality_scores(odd, spark.read.parquet(f"{SF}/labels.parquet")))}
    assert sum(keys(got["quality_classifier"]).values()) == sum(s >= 0.3 for r in rows(odd) for i, s in scores if i == r["doc_id"]) \
        or len({s for _, s in scores}) > 1
    # one row of every normalised text, the one with the largest id
    want = {}
    for i, t in all_odd:
        k = (t or "").translate(LOWER)
        want[k] = max(want.get(k, -1), -1 if i is None else i)
    once = keys(got["exact_duplicates"])
    assert Counter((t or "").translate(LOWER) for _, t in once.elements()) == dict.fromkeys(want, 1)
    assert {((t or "").translate(LOWER), -1 if i is None else i) for i, t in once} == set(want.items())
    # one row of every fingerprint's group; no text goes for another text's sake
    far = keys(got["near_duplicates"])
    texts = sorted({t or "" for _, t in all_odd})
    roots = brute_components([brute_fingerprint(t) for t in texts])
    group = dict(zip(texts, roots, strict=True))
    assert Counter(group[t or ""] for _, t in far.elements()) == dict.fromkeys(set(roots), 1)
    assert (8, "one id, another text of other words altogether") in far and any(t == "solo" for _, t in far)
    tokens = Counter()
    for r in rows(got["pack_sequences"]):
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == {i for i, _ in all_odd} and all(tokens.values())


def test_rows_of_one_id_are_decided_by_their_text(spark):
    good = " ".join(f"word{i % 61}x{i}" for i in range(80)) + "."
    docs = spark.createDataFrame([(1, good, "en", "s", 0), (1, "bad bad " * 5, "en", "s", 0), (1, good, "en", "s", 0),
                                  (2, good.replace("word0x0", "other"), "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r["doc_id"], r["text"]) for r in rows(line_rules.keep_good(docs))} == {(1, good), (2, good.replace("word0x0", "other"))}
    assert keys(exact_dedup.drop_exact_copies(docs)) == {(1, good): 1, (1, "bad bad " * 5): 1, (2, good.replace("word0x0", "other")): 1}
    far = keys(simhash.drop_near_copies(docs))
    assert far[(1, "bad bad " * 5)] == 1 and far[(1, good)] == 1


def test_a_line_has_one_verdict_at_every_host_size(spark):
    """Above the ceiling the share of the host does not matter; headings keep the share."""
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    note, head = "this sentence of many words stands in all of them", "All notes"
    big = [(i, f"{note}\n{head}\n{body(i)}" if i < 120 else body(i), "big") for i in range(2500)]
    small = [(9000 + i, f"{note}\n{head}\n{body(9000 + i)}", "small") for i in range(120)]
    df = spark.createDataFrame(big + small, "doc_id long, text string, source string")
    left = {r["doc_id"]: r["left_words"] for r in rows(line_rules.judge(df))}
    assert left[5] == 62 and left[9005] == 60  # 120 of 2,500 is no share for a heading
    assert {r["doc_id"]: r["text"] for r in rows(line_rules.keep_good(df, length_col=None))}[5] == f"{head}\n{body(5)}"

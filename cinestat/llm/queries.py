"""The registered queries of the document operators: thin, with production
parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinestat.llm import (
    collocations, exact_dedup, lexicon, licenses, line_rules, packing, periodic_runs, quality, secret_scan, sharding,
    simhash, token_counts, toxicity,
)
from cinestat.llm.common import held_out, read_table
from cinestat.session import scratch_path

SHARDS = 40
GOOD = 0.3
TOXIC = 0.5


def byte_bpe() -> str:
    """The byte-level vocabulary file; its place is given by its package."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe() -> str:
    """The word-level vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _scored(scores: DataFrame, limit: float) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= limit).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), GOOD)


def piece_rows(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "window")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_rows(packing.pack(read_table(spark, sf_dir, "documents"), byte_bpe()))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    done = lexicon.encode_decode(docs, word_bpe(), lexicon.build_lexicon(docs, word_bpe()))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = sharding.shard_documents(docs, SHARDS, scratch_path(spark, "slot-map"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                       "virtual_slot")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a source is a top directory, a language one in it,
    and a file's name is its id, so no file is named as a licence. A document whose
    whole text is a licence's full text (a notice is none) is the licence file of its
    directory, and the documents there without a header of their own inherit it."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), TOXIC)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's source, language and lines of text."""
    return token_counts.attribute_tokens(read_table(spark, sf_dir, "documents"), byte_bpe(), ["source", "lang", "text"],
                                         split={"text": "\n"}, rule="most")


def looped_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document by crc32(doc_id) a tail repeats
    with a fixed period; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, tail(i))), " "))

    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    # the words are computed once a row and bound to the lambda's name
    tailed = F.get(F.transform(F.array(words), looped), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), tailed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped_tails(read_table(spark, sf_dir, "documents")))
    # greatest length, then smallest start, then smallest period: the runs come by start and period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] > b["length"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(read_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.KINDS[:3]))
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_sharding": op4_sharding,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_collocations": op13_collocations,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD, _SPACES = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]+"

SQL: dict[str, str] = {
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UP}', '{_LOW}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    # words do not span lines, so what is left is what the removed lines do not hold
    "op9_quality_rules": f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text IS NULL AS no_text,
         coalesce(text, '') AS t, md5(text) AS doc, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws
  FROM documents),
w AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS pos FROM d),
w3 AS (SELECT rid, pos, a, lead(a, 1) OVER r AS b, lead(a, 2) OVER r AS c FROM w WINDOW r AS (PARTITION BY rid ORDER BY pos)),
again AS (SELECT rid, pos FROM w3 WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM again) GROUP BY rid),
x AS (SELECT rid, host, doc_id, doc, unnest(string_split(t, chr(10))) AS line FROM d WHERE NOT no_text),
l AS (SELECT rid, host, doc_id, doc, lower(trim(regexp_replace(line, '{_SPACES}', ' ', 'g'), ' ')) AS nl,
             len(regexp_extract_all(line, '{_WORD}')) AS n FROM x),
hosts AS (SELECT host, count(DISTINCT doc) AS host_docs FROM d WHERE NOT no_text GROUP BY host),
common AS (
  SELECT host, nl, min(id) AS first_id, count(*) AS n_docs FROM (
    SELECT host, nl, doc, min(doc_id) AS id, max(n) AS n FROM l WHERE nl <> '' GROUP BY host, nl, doc)
  JOIN hosts USING (host) GROUP BY host, nl, host_docs
  HAVING count(*) > CASE WHEN max(n) >= {line_rules.LONG_LINE}
    THEN least({line_rules.MAX_DOCS}::DOUBLE, greatest({line_rules.MIN_DOCS}::DOUBLE, {line_rules.DOC_SHARE}::DOUBLE * host_docs))
    ELSE greatest({line_rules.MIN_DOCS}::DOUBLE, {line_rules.DOC_SHARE}::DOUBLE * host_docs) END),
gone AS (SELECT l.rid, sum(l.n) AS n FROM l JOIN common c ON c.host = l.host AND c.nl = l.nl
         WHERE c.first_id IS DISTINCT FROM l.doc_id GROUP BY l.rid),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(t) - length(regexp_replace(t, '{_WORD}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '{_WORD}')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '{_WORD}')))) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(ws) - coalesce(gone.n, 0) AS left_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
v AS (SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PCT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       left_words::BIGINT AS left_words,
       NOT base_failed AND NOT (left_words < n_words AND (left_words < {line_rules.MIN_LEFT_WORDS}
                                                          OR left_words < {line_rules.MIN_LEFT_SHARE}::DOUBLE * n_words)) AS kept
FROM v""",
    "op13_collocations": f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
x AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
u AS (SELECT pid, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM x),
g AS (SELECT lang, w1, lead(w1, 1) OVER r AS w2, lead(w1, 2) OVER r AS w3 FROM u WINDOW r AS (PARTITION BY pid ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY lang, w1),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= {collocations.MIN_COUNT}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
       HAVING count(*) >= {collocations.MIN_COUNT}),
total AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
cover AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, w1, w2),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, p.f AS l, q.f AS r, 1 AS k
  FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.w1 = f2.w1 JOIN f1 q ON q.lang = f2.lang AND q.w1 = f2.w2
  LEFT JOIN cover c ON c.lang = f2.lang AND c.w1 = f2.w1 AND c.w2 = f2.w2
  WHERE 100 * coalesce(c.f, 0) < {collocations.COVER_PCT} * f2.f
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, p.f, q.f, 1
  FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.w1 = f3.w1 JOIN f2 q ON q.lang = f3.lang AND q.w1 = f3.w2 AND q.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, p.f, q.f, 2
  FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.w1 = f3.w1 AND p.w2 = f3.w2 JOIN f1 q ON q.lang = f3.lang AND q.w1 = f3.w3),
scored AS (SELECT *, {collocations.SCALE}::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {collocations.TOP}""",
}

"""Quality rules with cross-document line frequency, on DataFrame functions only.

Base rules look at one text: too few words, or too many words inside repeated
three-word windows. The method looks across documents: normalised lines are
hashed, and for each host the *distinct* documents (by text hash, so that copies
of one text count once) that hold a line are counted. A line in more documents
than its host's limit is boilerplate; it is removed from every document but the
one with the smallest id. A document left with too little is rejected.

The limit is ``share`` of the host's distinct documents, at least ``min_docs``;
for lines of ``LONG_LINE`` words or more it is at most ``MAX_DOCS``. A heading of
a word or two may well stand in a share of a large host's documents, but a
sentence that stands in more than a hundred was copied, however large the host:
without the ceiling the same sentence in the same documents would be common on a
small host and none on a large one.

Common lines are rows of (host, line), and the documents' lines meet them in a
join on both, so a host with many common lines is spread over the tasks; a line
that very many documents hold is split by the planner's skew join. A document
gets back only the list of its own removed lines.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; repeated rows count once; an empty table gives
an empty table; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinestat.llm.common import broadcast_if_small, fresh, named, prepare, written

# the white space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_DOCS = 10
DOC_SHARE = 0.08
MAX_DOCS = 100
LONG_LINE = 5
MIN_LEFT_WORDS = 25
MIN_LEFT_SHARE = 0.3
POSITION_BITS = 20


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")


def normalised_line(line: Column) -> Column:
    """Lower case, ends trimmed, inner white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(line, "[ \\x09-\\x0D]+", " ")))


def text_lines(text: Column) -> Column:
    """(line_hash, n_words) of every line, in order; hash and words are those of
    the normalised line."""
    return F.transform(F.transform(F.split(text, "\n"), normalised_line),
                       lambda x: F.struct(F.xxhash64(x).alias("line_hash"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("n_words")))


def _covered(starts: Column) -> Column:
    """Positions that three-word windows at the ascending ``starts`` cover."""
    return F.aggregate(
        starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.cast("int").alias("last"), (a["n"] + F.least(F.lit(3), x.cast("int") - a["last"])).alias("n")),
        lambda a: a["n"].cast("long"))


def _repeats_packed(h: Column) -> Column:
    """Window starts whose hash occurs twice or more, from one sort of longs:
    the upper 44 bits of the hash above the 20-bit position. Null if two
    different hashes share their upper bits (the exact form is used then)."""
    low = (1 << POSITION_BITS) - 1
    top = lambda x: F.shiftright(x, POSITION_BITS)

    def pick(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.coalesce(top(F.get(s, i - 1)) == top(x), F.lit(False)))
                        | (F.coalesce(top(F.get(s, i + 1)) == top(x), F.lit(False))))
        return let(same, lambda r: F.when(
            F.exists(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))),
                     lambda i: F.coalesce((top(F.get(r, i)) == top(F.get(r, i - 1)))
                                          & (F.get(h, F.get(r, i).bitwiseAND(low).cast("int"))
                                             != F.get(h, F.get(r, i - 1).bitwiseAND(low).cast("int"))), F.lit(False))),
            F.lit(None)).otherwise(F.sort_array(F.transform(r, lambda x: x.bitwiseAND(low)))))

    packed = F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long")))
    return let(F.sort_array(packed), pick)


def _repeats_exact(h: Column) -> Column:
    """The same from a sort of (hash, position) pairs, for any length."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
    return let(pairs, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def count(h: Column) -> Column:
        packed = F.when(n < (1 << POSITION_BITS), _repeats_packed(h))
        return let(packed, lambda p: _covered(F.when(p.isNotNull(), p).otherwise(_repeats_exact(h))))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(hashes, count))


def base_measures(text: Column) -> Column:
    """A struct of the base counts of one text."""
    t = F.coalesce(text, F.lit(""))
    removed = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    with_word = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    return let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        (F.length(t) - removed(SPACE)).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words")))


def _document(id_col: str, text_col: str, host_col: str) -> list[Column]:
    """What tells documents apart: host, id, and the text by its hash. Rows that
    agree in all three are the same document."""
    t = named(text_col)
    return [F.coalesce(named(host_col).cast("string"), F.lit("")).alias("host"), named(id_col).alias("id"),
            F.when(t.isNotNull(), F.xxhash64(t)).alias("doc")]


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """host, id, doc, pos, line_hash, n_words: the lines with words."""
    rows = docs.select(*_document(id_col, text_col, host_col), named(text_col).alias("text")).where(F.col("text").isNotNull())
    return (rows.select("host", "id", "doc", F.posexplode(text_lines(F.col("text"))).alias("pos", "l"))
            .select("host", "id", "doc", "pos", "l.line_hash", "l.n_words").where(F.col("n_words") > 0))


def common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 min_docs: int = MIN_DOCS, share: float = DOC_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line_hash, n_docs, first_id): the lines above their limit."""
    base = docs.select(*_document(id_col, text_col, host_col)).where(F.col("doc").isNotNull())
    hosts = base.groupBy("host").agg(F.countDistinct("doc").alias("host_docs"))
    # distinct documents first, then lines: no reducer sees all rows of a hot line
    counted = (_lines(docs, id_col, text_col, host_col)
               .groupBy("host", "line_hash", "doc").agg(F.min("id").alias("id"), F.max("n_words").alias("n_words"))
               .groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id"), F.max("n_words").alias("n_words"))
               .where(F.col("n_docs") > min_docs))
    limit = F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("host_docs"))
    limit = F.when(F.col("n_words") >= LONG_LINE, F.least(limit, F.lit(float(max_docs)))).otherwise(limit)
    return counted.join(hosts, "host").where(F.col("n_docs") > limit).select("host", "line_hash", "n_docs", "first_id")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_docs: int = MIN_DOCS, share: float = DOC_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, id, doc, lost, gone) of the documents that lose lines: their words
    and the lines' hashes. Written once."""
    prepare(docs.sparkSession)
    common = written(common_lines(docs, id_col, text_col, host_col, min_docs, share, max_docs), "common-lines")
    hit = (_lines(docs, id_col, text_col, host_col).join(common.select("host", "line_hash", "first_id"), ["host", "line_hash"])
           .where(~F.col("first_id").eqNullSafe(F.col("id"))))
    # a repeated row has the same lines at the same places
    once = hit.groupBy("host", "id", "doc", "pos").agg(F.max("line_hash").alias("line_hash"), F.max("n_words").alias("n_words"))
    return written(once.groupBy("host", "id", "doc").agg(F.sum("n_words").alias("lost"), F.collect_set("line_hash").alias("gone")),
                   "removed-lines")


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PCT)


def depleted(m: Column, left: Column, min_words: int = MIN_LEFT_WORDS, min_share: float = MIN_LEFT_SHARE) -> Column:
    """Too little is left of a document that has lost lines."""
    return (left < m["n_words"]) & ((left < min_words) | (left < m["n_words"] * F.lit(min_share)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, left_words, kept), one row per row of ``docs``."""
    return _judged(docs, removed_lines(docs, id_col, text_col, host_col), id_col, text_col, host_col).drop("host", "doc", "gone")


def _judged(docs: DataFrame, removed: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The verdicts, with host, doc and the lines to remove. Texts are only read
    here, once: their measures are written, and these are joined."""
    measured = written(docs.select(*_document(id_col, text_col, host_col), base_measures(named(text_col)).alias("m")), "line-measures")
    lost = removed.select(F.col("host").alias("_h"), F.col("id").alias("_i"), F.col("doc").alias("_d"), "lost", "gone")
    m = F.col("m")
    rows = measured.join(lost, _same(["host", "id", "doc"], ["_h", "_i", "_d"]), "left").withColumn(
        "left_words", m["n_words"] - F.coalesce("lost", F.lit(0)))
    failed = base_failed(m)
    return rows.select(F.col("id").alias("doc_id"), "m.*", failed.alias("base_failed"), "left_words",
                       (~failed & ~depleted(m, F.col("left_words"))).alias("kept"), "host", "doc", "gone")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
              length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without rejected documents; the others lose their host's common
    lines (``length_col`` follows the text), all else as it is."""
    removed = removed_lines(docs, id_col, text_col, host_col)
    judged = _judged(docs, removed, id_col, text_col, host_col)
    # most documents are kept and lose nothing: the texts meet only the lists of the others
    out_host, out_id, out_doc, host, i, doc, cut_host, cut_id, cut_doc, gone, lines = fresh(
        docs, "rejected_host", "rejected_id", "rejected_doc", "host", "id", "doc", "cut_host", "cut_id", "cut_doc", "gone", "lines")
    rejected = written(judged.where(~F.col("kept")).select(F.col("host").alias(out_host), F.col("doc_id").alias(out_id), F.col("doc").alias(out_doc))
                       .distinct(), "rejected-documents")
    cut = removed.select(F.col("host").alias(cut_host), F.col("id").alias(cut_id), F.col("doc").alias(cut_doc), F.col("gone").alias(gone))
    # a document to cut: its key and its common lines
    per_cut = 40 + 8 * (removed.agg(F.sum(F.size("gone"))).first()[0] or 0) // max(removed.count(), 1)
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_document(id_col, text_col, host_col), (host, i, doc), strict=True)))
    rows = (keyed.join(broadcast_if_small(rejected, 40), _same([host, i, doc], [out_host, out_id, out_doc]), "left_anti")
            .join(broadcast_if_small(cut, per_cut), _same([host, i, doc], [cut_host, cut_id, cut_doc]), "left"))
    clean = F.when(named(gone).isNull(), named(text_col)).otherwise(F.array_join(F.filter(
        F.split(named(text_col), "\n"), lambda x: ~F.array_contains(named(gone), F.xxhash64(normalised_line(x)))), "\n"))
    rows = rows.withColumn(lines, clean)
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(named(lines).alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            out.append(F.when(named(gone).isNotNull(), F.length(named(lines)).cast(kind)).otherwise(named(c)).alias(c))
        else:
            out.append(named(c))
    return rows.select(out)

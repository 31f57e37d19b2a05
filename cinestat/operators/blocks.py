"""Blocks of web pages, matched by nesting (H1-H3).

A page is cut once into its tags and the texts between them (its pieces); a
running depth over the tags of one name gives every open tag its level, and its
block ends at the next close tag of that name on the same level. So a block with
blocks of its own kind inside stays whole, and a tag of another name that is never
closed does not matter. A list item also ends where the next item of its list
begins or its list ends, as browsers read it. A block that is never closed ends
with the page.

All of this is done on a page's own row, on arrays of numbers: the tag's place
with its level, sorted by level, has a block's end behind its begin. No tag becomes
a row, no page meets another, and a block's markup is its slice of the pieces.
Pages are dealt out by id first (``dealt``), so a task holds few texts.
Comments, scripts and styles are taken out first, so tags quoted there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinestat.functions.casts import after_label, score_text

# Fixed patterns of markup.
HIDDEN_RE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG_RE = r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>"""
PIECE_RE = rf"{TAG_RE}|[^<]++|<"
LISTS = ("ul", "ol")
TASK_CHARS = 8 << 20


def dealt(pages: DataFrame) -> DataFrame:
    """``pages`` dealt out by id. The number of tasks grows with the texts, since
    their compressed form in a shuffle, the engine's own measure, is many times
    smaller. Never one: a single partition counts as no deal by id."""
    chars = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    return pages.repartition(2 + chars // TASK_CHARS, "page_id")


def _pieces(html: Column) -> Column:
    """The tags of a page and the texts between them, in order; joined they are the
    page without its hidden parts."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN_RE, ""), F.lit(PIECE_RE), F.lit(0))


def _is_tag(piece: Column) -> Column:
    return piece.startswith("<") & (piece != "<") & (piece.startswith("</") | ~piece.endswith("/>"))


def page_tags(pages: DataFrame) -> DataFrame:
    """(page_id, no, name, closing, attrs): every tag; ``no`` is its place among the pieces."""
    rows = pages.select("page_id", F.posexplode(_pieces(F.col("html"))).alias("no", "tag")).where(_is_tag(F.col("tag")))
    return rows.select("page_id", "no", F.lower(F.regexp_extract("tag", TAG_RE, 2)).alias("name"), F.startswith("tag", F.lit("</")).alias("closing"),
                       F.regexp_extract("tag", TAG_RE, 3).alias("attrs"))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute of a tag; NULL where it is missing or empty."""
    return F.nullif(F.regexp_extract(attrs, rf"""(?i)(?:^|\s){name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def has_class(css: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(css, r"\s+"), name), F.lit(False))


# A key: a number above, then a tag's place among the pieces, then whether it closes.

def _key(above: Column, low: Column) -> Column:
    return above * F.lit(1 << 32) + low


def _low(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << 32) - 1))


def _above(key: Column) -> Column:
    return F.shiftright(key, 32)


def _closes(key: Column) -> Column:
    return key.bitwiseAND(F.lit(1)) == 1


def _place(key: Column) -> Column:
    return F.shiftright(_low(key), 1).cast("int")


def _counted(names: list[str]) -> Column:
    """Keys of the tags ``names`` in order: how many of them stand before, and the tag."""
    named = rf"(?i)^</?(?:{'|'.join(names)})(?![a-zA-Z0-9])"
    low = F.filter(F.transform("pieces", lambda p, no: F.when(p.startswith("<") & p.rlike(named) & _is_tag(p),
                                                              no.cast("long") * 2 + p.startswith("</").cast("long"))), lambda x: x.isNotNull())
    return F.transform(low, lambda x, t: _key(t.cast("long"), x))


def _deep(counted: str, behind: bool = False) -> Column:
    """Keys of the same tags with their levels; a close tag has the level of the open
    tag it ends (or, if ``behind``, each the depth behind it). Of the t tags before
    one, with i open tags among them, t - i are close tags: no sum runs over the page."""
    def opened(v: Column, i: Column) -> Column:
        return _key(2 * i.cast("long") + 1 - _above(v), _low(v))

    def closed(v: Column, j: Column) -> Column:
        return _key(_above(v) - 2 * j.cast("long") - (1 if behind else 0), _low(v))
    return F.concat(F.transform(F.filter(counted, lambda v: ~_closes(v)), opened), F.transform(F.filter(counted, _closes), closed))


def _list_items(out: DataFrame, at: str) -> DataFrame:
    """``at``: keys of what begins or ends a list item (a tag of an item, the end of
    a list) with its depth in lists."""
    out = out.withColumn("_l", _counted(list(LISTS))).withColumn("_i", _counted(["li"])).withColumn("_b", F.transform("_i", _low))
    # the depth behind each list tag, in order: the tag's place above, the depth (moved to be no less than 0) below
    moved = 1 << 31
    out = out.withColumn("_d", F.sort_array(F.transform(_deep("_l", behind=True), lambda k: _key(_low(k), _above(k) + moved))))
    # of the tags of both kinds in order, as many are list tags before an item as are not items
    out = out.withColumn("_p", F.sort_array(F.concat(F.transform("_l", lambda k: _low(k) * 2), F.transform("_b", lambda b: b * 2 + 1))))
    out = out.withColumn("_p", F.filter(F.transform("_p", lambda x, t: F.when(x.bitwiseAND(F.lit(1)) == 1, t)), lambda t: t.isNotNull()))
    depth = lambda n: F.when(n > 0, _low(F.get(F.col("_d"), n - 1)) - moved).otherwise(0)
    items = F.transform("_b", lambda b, i: _key(depth(F.get(F.col("_p"), i) - i), b))
    ends = F.filter(_deep("_l"), _closes)
    return out.withColumn(at, F.concat(items, ends)).drop("_l", "_i", "_b", "_d", "_p")


def page_blocks(pages: DataFrame, names: list[str]) -> DataFrame:
    """``pages`` with ``pieces`` for their html, and ``blocks``, those of the tags
    ``names``, as structs (no, level, name, stop): the places of the open tag and of
    the piece that ends the block, NULL for the page's end. The level of a list item
    is its depth in lists, since items may go unclosed. A page without an id has none."""
    kept = [c for c in pages.columns if c != "html"]
    out = pages.select(*kept, _pieces(F.when(F.col("page_id").isNotNull(), F.col("html"))).alias("pieces"))
    for n, name in enumerate(names):
        at = f"_k{n}"
        out = _list_items(out, at) if name == "li" else out.withColumn(at, _counted([name])).withColumn(at, _deep(at))
        # the key behind an open tag's own is what ends its block, if it has the same level
        out = out.withColumn(at, F.sort_array(at))
        out = out.withColumn(at, F.filter(F.transform(at, _block(at, name)), lambda b: b.isNotNull()))
    kinds = [F.col(f"_k{n}") for n in range(len(names))]
    return out.select(*kept, "pieces", (F.concat(*kinds) if len(kinds) > 1 else kinds[0]).alias("blocks"))


def _block(keys: str, name: str):
    def block(k: Column, i: Column) -> Column:
        after = F.get(F.col(keys), i + 1)
        return F.when(~_closes(k), F.struct(_place(k).alias("no"), _above(k).cast("int").alias("level"), F.lit(name).alias("name"),
                                            F.when(_above(after) == _above(k), _place(after)).alias("stop")))
    return block


def css(block: Column) -> Column:
    """The classes of a block of the row's page."""
    return attribute(F.get(F.col("pieces"), block["no"]), "class")


def inner_text(markup: Column) -> Column:
    """Text without tags, blanks trimmed and joined; NULL where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(markup, TAG_RE, " "), r"\s+", " ")), F.lit(""))


def inner(block: Column) -> Column:
    """The markup of a block of the row's page."""
    pieces = F.col("pieces")
    stop = F.coalesce(block["stop"], F.size(pieces))
    return F.array_join(F.slice(pieces, block["no"] + 2, stop - block["no"] - 1), "")


def block_texts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for every one of the ``blocks`` that ``pages`` were found to have
    (page_id, its fields), with ``css``, its classes, and ``inner``, its markup."""
    texts = F.transform("blocks", lambda b: F.struct(b.alias("b"), css(b).alias("css"), inner(b).alias("inner")))
    return blocks.select("page_id", F.inline(texts)).select("page_id", "b.*", "css", "inner")


def children(blocks: DataFrame, css_name: str, name: str) -> DataFrame:
    """``blocks`` cut down to the ones ``name`` directly in a ``name`` block of class
    ``css_name``, in order, without the ones deeper inside; ``pos`` numbers them."""
    mine = blocks.withColumn("_mine", F.filter("blocks", lambda b: b["name"] == name))
    outer = mine.withColumn("_outer", F.filter("_mine", lambda b: F.contains(F.get(F.col("pieces"), b["no"]), F.lit(css_name)) & has_class(css(b), css_name)))
    inside = F.transform("_outer", lambda o: F.filter("_mine", lambda b: (b["level"] == o["level"] + 1) & (b["no"] > o["no"]) & (
        o["stop"].isNull() | (b["no"] < o["stop"]))))
    found = outer.withColumn("blocks", F.sort_array(F.flatten(inside)))
    numbered = F.transform("blocks", lambda b, i: F.struct(*[b[c].alias(c) for c in ("no", "level", "name", "stop")], (i + 1).alias("pos")))
    return found.withColumn("blocks", numbered).drop("_mine", "_outer")


def review_rows(pages: DataFrame) -> DataFrame:
    """page_id, pos, user_name, rating, date: the reviews of film pages.
    The rating is NULL where the review gives none."""
    pages = dealt(pages)
    reviews = children(page_blocks(pages, ["div"]), "reviews", "div")
    # a review's own fields: its first of each class, before what it quotes
    own = F.regexp_replace("inner", r"""(?s)<div class=["'](?:[^"']*\s)?(?:quote|review)(?:\s[^"']*)?["']>.*""", "")
    found = block_texts(pages, reviews).select("page_id", "pos", own.alias("own"))
    field = lambda tag, css: inner_text(F.regexp_extract(
        "own", rf"""(?s)<{tag} class=["'](?:[^"']*\s)?{css}(?:\s[^"']*)?["']>(.*?)</{tag}>""", 1))
    texts = found.select("page_id", "pos", field("div", "user").alias("user_name"), field("span", "points").alias("points"), field("div", "date").alias("day"))
    return texts.select("page_id", "pos", "user_name", score_text("points").alias("rating"),
                        F.when(F.col("day").rlike(r"^\d{4}-\d\d-\d\d$"), F.col("day")).try_cast("date").alias("date"))


def film_fields(pages: DataFrame) -> DataFrame:
    """page_id, name, genres, year, country, own_score, other_score of film pages
    (H2, F22, F23): labelled list items, and scores told apart by their mark."""
    name = F.nullif(F.trim(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)), F.lit(""))
    both = page_blocks(dealt(pages).withColumn("h1", name), ["li", "div"])
    # the text of an item without the lists inside it
    item = F.transform(F.filter("blocks", lambda b: (b["name"] == "li") & (b["level"] == 1)),
                       lambda b: inner_text(F.regexp_replace(inner(b), r"(?is)<ul\b.*", "")))
    found = children(both.withColumn("items", item), "scores", "div").withColumn("scores", F.transform("blocks", inner))
    value = lambda label: F.array_max(F.transform("items", lambda x: after_label(x, label)))
    own = lambda x: x.rlike(r"(?is)^\s*<img\b")
    score = lambda mine: F.array_max(F.transform(F.filter("scores", mine), lambda x: score_text(inner_text(x))))
    return found.select("page_id", F.col("h1").alias("name"), value("Genre: ").alias("genres"), value("Year: ").try_cast("int").alias("year"),
                        value("Country: ").alias("country"), score(own).alias("own_score"), score(lambda x: ~own(x)).alias("other_score"))

"""Blocks of pages with nested, unclosed and hidden tags."""

import html.parser
import random
import re

from pyspark.sql import functions as F

from cinestat.operators import blocks

PAGES = [
    (1, "<div class='a'>x<div>y</div>z<p>never closed<div class=\"b\" data-t='<div>'>q</div></div><div>last"),
    (2, "<ul><li>one<li>two<ul><li>two a<li>two b</ul></li><li class='k'>three</ul><ol><li>four</ol>"),
    (3, "<!-- <li> --><script>'<li>x</li>'</script><ul><LI>é <b>bold</b></LI></ul><br/>"),
    (4, ""), (5, None), (6, "no tags < here"), (7, "</div></div><div>after stray ends</div>"),
]


def inner(spark, names):
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    got = blocks.block_texts(pages, blocks.page_blocks(pages, names)).orderBy("page_id", "no").collect()
    return [(r["page_id"], r["name"], r["css"], r["level"], r["inner"]) for r in got]


def test_blocks_hold_what_they_hold(spark):
    assert inner(spark, ["div"]) == [
        (1, "div", "a", 1, "x<div>y</div>z<p>never closed<div class=\"b\" data-t='<div>'>q</div>"), (1, "div", None, 2, "y"), (1, "div", "b", 2, "q"),
        (1, "div", None, 1, "last"), (7, "div", None, -1, "after stray ends")]


def test_list_items_end_where_browsers_end_them(spark):
    assert inner(spark, ["li"]) == [
        (2, "li", None, 1, "one"), (2, "li", None, 1, "two<ul><li>two a<li>two b</ul>"), (2, "li", None, 2, "two a"), (2, "li", None, 2, "two b"),
        (2, "li", "k", 1, "three"), (2, "li", None, 1, "four"), (3, "li", None, 1, "é <b>bold</b>")]


def test_children_and_fields(spark):
    page = ("<h1> N </h1><div class='x reviews'><div class=\"review\"><div class=\"user\">A &amp; b</div><div class=\"date\">2020-02-30</div>"
            "<div class='quote'><span class='points'>1/10</span></div></div><div><div class='user'>B</div><div class='date'>2021-01-02</div>"
            "<span class='points'> 7.5/10 </span></div></div><div class='review'><div class='user'>out</div></div>")
    pages = spark.createDataFrame([(1, page), (2, "<div class='reviews'></div>"), (3, None)], "page_id long, html string")
    got = [tuple(r) for r in blocks.review_rows(pages).orderBy("pos").withColumn("date", F.col("date").cast("string")).collect()]
    assert got == [(1, 1, "A &amp; b", None, None), (1, 2, "B", 7.5, "2021-01-02")]
    fields = {r["page_id"]: (r["name"], r["genres"], r["own_score"]) for r in blocks.film_fields(pages).collect()}
    assert fields == {1: ("N", None, None), 2: (None, None, None), 3: (None, None, None)}


def test_tags_equal_a_parser(spark):
    """Over the stored pages: every tag the standard parser sees, in its order."""
    class Tags(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.seen = []

        def handle_starttag(self, tag, attrs):
            self.seen.append((tag, False))

        def handle_endtag(self, tag):
            self.seen.append((tag, True))

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        p = Tags()
        p.feed(r["html"])
        want[r["page_id"]] = [t for t in p.seen if t[0] not in ("script", "style")]
    got = {}
    for r in blocks.page_tags(pages).orderBy("page_id", "no").collect():
        got.setdefault(r["page_id"], []).append((r["name"], r["closing"]))
    assert got == {k: v for k, v in want.items() if v}


def test_no_python_and_no_loops(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for df in (blocks.review_rows(pages), blocks.film_fields(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "NestedLoop", "Cartesian"))


def test_only_pages_are_shuffled(spark):
    """Neither tags nor blocks move: every window and join finds a page's rows in one task."""
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [f(pages)._jdf.queryExecution().executedPlan().toString() for f in (blocks.review_rows, blocks.film_fields)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for plan in plans:
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def by_hand(html, names):
    """(no of order, name, level, inner) of the blocks ``names`` by one walk over the page."""
    html = re.sub(blocks.HIDDEN_RE, "", html)
    tags = [(m.start(), m.end(), m[2].lower(), m[1] == "/") for m in re.finditer(blocks.TAG_RE, html) if m[1] or not m[3].endswith("/")]
    out = []
    for name in names:
        depth, events = 0, []  # of the tags that make levels; (level, begins a block, ends one, start, stop)
        for start, stop, tag, closing in tags:
            if tag in (blocks.LISTS if name == "li" else (name,)):
                depth += -1 if closing else 1
                if name != "li" or closing:
                    events.append((depth + closing, not closing, start, stop))
            elif tag == name:
                events.append((depth, not closing, start, stop))
        for i, (level, begins, _, stop) in enumerate(events):
            if begins:
                ends = [e[2] for e in events[i + 1:] if e[0] == level]
                out.append((stop, name, level, html[stop:ends[0] if ends else len(html)]))
    return [x[1:] for x in sorted(out)]


def test_blocks_equal_a_walk(spark):
    rng = random.Random(5)
    parts = ["<div>", "<div class='k'>", "</div>", "</DIV>", "<ul>", "</ul>", "<OL>", "</ol>", "<li>", "<li a='<li>'>", "</li>", "<li/>", "<div/>", "x", "é <", " > ", "<p>",
             "<!-- <div> -->", "<script>'<li>'</script>"]
    pages = [(n, "".join(rng.choices(parts, k=rng.randrange(1, 60)))) for n in range(120)] + [(500, "".join(rng.choices(parts, k=6000)))]
    df = spark.createDataFrame(pages, "page_id long, html string")
    for names in (["div"], ["li"], ["li", "div", "ul"]):
        got = {}
        for r in blocks.block_texts(df, blocks.page_blocks(df, names)).orderBy("page_id", "no").collect():
            got.setdefault(r["page_id"], []).append((r["name"], r["level"], r["inner"]))
        assert got == {n: x for n, html in pages if (x := by_hand(html, names))}


def test_tags_are_no_rows(spark):
    """A page stays one row until its blocks are found: nothing is sorted, joined or numbered across rows."""
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    for f in (blocks.review_rows, blocks.film_fields):
        plan = f(pages)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Window", "Sort ", "Join", "Aggregate")) and plan.count("Exchange") == 1


def test_a_page_that_comes_twice_is_read_twice(spark):
    page = "<h1>N</h1><ul><li>Year: 1999</ul><div class='reviews'><div class='review'><div class='user'>A</div><span class='points'>7/10</span></div></div>"
    pages = spark.createDataFrame([(1, page), (1, page), (2, page), (None, page)], "page_id long, html string")
    assert sorted((r["page_id"], r["pos"], r["user_name"], r["rating"]) for r in blocks.review_rows(pages).collect()) == [
        (1, 1, "A", 7.0), (1, 1, "A", 7.0), (2, 1, "A", 7.0)]
    assert sorted((r["page_id"] or 0, r["name"], r["year"] or 0) for r in blocks.film_fields(pages).collect()) == [
        (0, "N", 0), (1, "N", 1999), (1, "N", 1999), (2, "N", 1999)]

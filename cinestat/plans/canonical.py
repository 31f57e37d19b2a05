"""Canonical rating / catalogue tables derived from the driver tables.

The library's operators work on a movie-rating data model (raw movie text,
credits text, links, ratings, rating events, recommendation lists). The
driver ships TPC-H-like tables, so this module derives that model from them
with DataFrame expressions only; every table grows with its source tables.
``cinestat.plans.sql`` holds the same definitions as DuckDB CTEs for the
oracle check.

The ``key % m`` rules below only decide which rows carry a defect (a zero
budget, a missing link, a broken list text, ...). They never drop rows to
make a table smaller: every adapter reads its source tables whole.

Id spaces: ``tmdb_id`` = ``p_partkey``; rating-side ``movie_id`` = ``p_partkey
* 10 + 1`` (a second id ``p_partkey * 10 + 2`` exists for some parts, so two
rating ids can map to one catalogue id); ``user_id`` = ``o_custkey``. The slot
digit keeps ids of different parts apart at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinestat.sources.tables import Tables, folder_state

# Fixed values of the fixture design (not taken from any source). Rating-side
# and imdb ids are p_partkey * ID_STRIDE + a slot digit.
ID_STRIDE = 10
MOVIE_SLOT = 1        # the part's rating id
ALT_MOVIE_SLOT = 2    # a second rating id for some parts
STALE_MOVIE_SLOT = 3  # a link to a retired rating id: the part's ratings are orphans
IMDB_SLOT = 5
ALT_IMDB_SLOT = 6
BUDGET_FACTOR = 400
CREW_PER_MOVIE = 4
CAST_PER_MOVIE = 6


def _pk() -> Column:
    return F.col("p_partkey")


def rating_id(key: Column, slot) -> Column:
    """The rating-side id of part ``key`` in id slot ``slot``."""
    return key * ID_STRIDE + slot


def ratings(t: Tables) -> DataFrame:
    """ratings(user_id, movie_id, rating, ts, order_key, line_no).

    One rating per line item: the order's customer rates the part with
    ``ceil(quantity / 5)`` (1..10) at the order date.
    """
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    alt = (F.col("l_partkey") % 40 == 1) & (F.col("l_linenumber") % 2 == 0)
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("user_id"),
                    rating_id(F.col("l_partkey"), F.when(alt, ALT_MOVIE_SLOT)
                              .otherwise(MOVIE_SLOT)).alias("movie_id"),
                    F.ceil(F.col("l_quantity") / 5).cast("double").alias("rating"),
                    F.col("o_orderdate").alias("ts"),
                    F.col("l_orderkey").alias("order_key"),
                    F.col("l_linenumber").alias("line_no")))


def part_stats(t: Tables) -> DataFrame:
    """Per-part line aggregates (partial aggregation before the shuffle)."""
    # Integer / decimal arithmetic keeps the derived text exact, so any engine
    # that re-derives it gets the same digits.
    q = F.sum(F.col("l_quantity").cast("long"))
    n = F.count(F.lit(1))
    return (t.lineitem.groupBy("l_partkey")
            .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("sum_price"),
                 F.expr("sum(cast(l_quantity as bigint)) * 20 div count(1)").alias("avg_x100"),
                 n.alias("n_lines"),
                 q.alias("sum_qty")))


def _genre_text() -> Column:
    tokens = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    items = F.transform(tokens, lambda tok, i: F.format_string("{'id': %d, 'name': '%s'}", i + 1, tok))
    close = F.when(_pk() % 101 == 0, F.lit("")).otherwise(F.lit("]"))
    text = F.concat(F.lit("["), F.array_join(items, ", "), close)
    return F.when(_pk() % 107 == 9, F.lit(None)).when(_pk() % 103 == 9, F.lit("")).otherwise(text)


def _list_json(key_name: str, code: Column, name: Column) -> Column:
    return F.format_string('[{"%s": "%s", "name": "%s"}]', F.lit(key_name), code, name)


def movies_raw(t: Tables) -> DataFrame:
    """The raw movie table: every column text, with the defects cleaning must
    handle (zero and non-numeric budgets, '1,234' numbers, bad dates, years out
    of range, unknown booleans, unterminated, empty or missing list text, NULL titles)."""
    pk = _pk()
    b = F.round(F.col("p_retailprice") * BUDGET_FACTOR).cast("long")
    budget = (F.when(pk % 7 == 0, F.lit("0"))
               .when(pk % 13 == 4, F.lit("abc"))
               .when(pk % 11 == 2, F.concat((b / 1000).cast("long").cast("string"), F.lit(","),
                                            F.lpad((b % 1000).cast("string"), 3, "0")))
               .when(pk % 29 == 3, F.lit(""))
               .otherwise(b.cast("string")))
    rv = F.round(F.col("sum_price"), 0).cast("long")
    revenue = F.when(rv.isNull(), F.lit(None).cast("string")).when(pk % 17 == 0, F.lit("0")).otherwise(rv.cast("string"))
    year = (F.when(pk % 71 == 0, F.lit(1890)).when(pk % 73 == 0, F.lit(2030))
             .otherwise(F.lit(1970) + F.col("p_size")))
    date = F.make_date(year, (F.lit(1) + pk % 12).cast("int"), (F.lit(1) + pk % 28).cast("int"))
    release = (F.when(pk % 89 == 0, F.lit("1")).when(pk % 83 == 0, F.lit(None).cast("string"))
                .otherwise(date.cast("string")))
    n1 = t.nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("country"),
                         F.col("n_regionkey").alias("rk"))
    reg = t.region.select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("language"))
    n_nations = t.nation.agg(F.count(F.lit(1))).scalar()
    p = (t.part.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
         .join(part_stats(t), F.col("l_partkey") == _pk(), "left")
         .withColumn("k1", (_pk() % n_nations).cast("int"))
         .join(n1, "k1", "left").join(reg, "rk", "left"))
    return p.select(
        F.when(pk % 211 == 5, F.concat(F.lit("tt"), pk.cast("string"))).otherwise(pk.cast("string")).alias("id"),
        F.when(pk % 307 == 11, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("title"),
        F.when(pk % 3 == 0, "True").when(pk % 3 == 1, "False").otherwise("unknown").alias("adult"),
        F.when(pk % 5 == 0, "True").otherwise("False").alias("video"),
        budget.alias("budget"),
        revenue.alias("revenue"),
        F.when(F.col("p_size") % 10 == 0, F.lit("0"))
         .otherwise((F.lit(60) + 3 * F.col("p_size")).cast("string")).alias("runtime"),
        release.alias("release_date"),
        (F.col("avg_x100") / 100.0).cast("string").alias("vote_average"),
        F.col("n_lines").cast("string").alias("vote_count"),
        (F.col("sum_qty") / 10.0).cast("string").alias("popularity"),
        _genre_text().alias("genres"),
        _list_json("iso_3166_1", F.concat(F.lit("N"), F.col("k1").cast("string")), F.col("country"))
        .alias("production_countries"),
        _list_json("iso_639_1", F.concat(F.lit("R"), F.col("rk").cast("string")), F.col("language"))
        .alias("spoken_languages"),
    )


def _py(v: Column, quote: bool = True) -> Column:
    """Python repr of a scalar inside list text: None for NULL."""
    if not quote:
        return F.coalesce(v.cast("string"), F.lit("None"))
    s = v.cast("string")
    q = F.when(F.instr(s, "'") > 0, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit("'"), s, F.lit("'")))
    return F.coalesce(q, F.lit("None"))


def credit_rows(t: Tables) -> DataFrame:
    """Crew and cast credits, one row each, before they are written as text.

    Each movie gets a fixed number of crew and cast entries chosen by a
    formula over the supplier and customer tables, so no movie's list grows
    with the data. The planner takes the exploded keys for as small as their
    table and would send them whole to every executor: the joins merge.
    """
    pk = _pk()
    n_sup = t.supplier.agg(F.count(F.lit(1))).scalar()
    n_cus = t.customer.agg(F.count(F.lit(1))).scalar()
    parts = t.part.select("p_partkey")
    crew = (parts.select(pk, F.explode(F.sequence(F.lit(0), F.lit(CREW_PER_MOVIE - 1))).alias("i"))
            .withColumn("dup", (F.col("i") == 3) & (pk % 17 == 0))
            .withColumn("slot", F.when(F.col("dup"), F.lit(0)).otherwise(F.col("i")))
            .withColumn("s_suppkey", (pk * 3 + F.col("slot") * 7) % n_sup)
            .join(t.supplier.select("s_suppkey", "s_name").hint("merge"), "s_suppkey")
            .select(pk.alias("tmdb_id"), F.col("i").alias("pos"), F.lit("crew").alias("kind"),
                    F.col("s_name").alias("name"), F.col("s_suppkey").alias("person_id"),
                    F.when(F.col("slot") == 0, F.lit("Director"))
                     .when(F.col("slot") == 1, F.when(pk % 3 == 0, "Co-Director")
                           .when(pk % 3 == 1, "Assistant Director").otherwise("Director of Photography"))
                     .when(F.col("slot") == 2, F.lit("Producer")).alias("job"),
                    F.when((F.col("slot") == 0) & (pk % 9 == 4), F.lit("Writing"))
                     .when(F.col("slot") == 0, F.lit("Directing"))
                     .when(F.col("slot") == 1, F.when(pk % 3 == 2, "Camera").otherwise("Directing"))
                     .when(F.col("slot") == 2, F.lit("Production")).otherwise(F.lit("Crew")).alias("department"),
                    F.lit(None).cast("int").alias("order")))
    cast = (parts.select(pk, F.explode(F.sequence(F.lit(0), F.lit(CAST_PER_MOVIE - 1))).alias("i"))
            .withColumn("c_custkey", (pk * 5 + F.col("i") * 11) % n_cus)
            .join(t.customer.select("c_custkey", "c_name").hint("merge"), "c_custkey")
            .select(pk.alias("tmdb_id"), F.col("i").alias("pos"), F.lit("cast").alias("kind"),
                    F.when((pk % 23 == 0) & (F.col("i") == 5), F.concat("c_name", F.lit("'s double")))
                     .otherwise(F.col("c_name")).alias("name"),
                    F.col("c_custkey").alias("person_id"),
                    F.lit(None).cast("string").alias("job"), F.lit(None).cast("string").alias("department"),
                    F.when((pk % 19 == 0) & (F.col("i") == 2), F.lit(None).cast("int"))
                     .otherwise(F.col("i")).alias("order")))
    return crew.unionByName(cast)


def credits_raw(t: Tables) -> DataFrame:
    """credits(id, cast, crew) with Python-literal list text per movie."""
    r = credit_rows(t)
    gender = F.when((F.col("tmdb_id") + F.col("pos")) % 4 == 0, F.lit(None)).otherwise(
        F.lit(1) + (F.col("tmdb_id") + F.col("pos")) % 2)
    crew_item = F.format_string(
        "{'credit_id': %s, 'department': %s, 'gender': %s, 'id': %s, 'job': %s, 'name': %s, 'profile_path': None}",
        _py(F.concat(F.lit("c"), F.col("tmdb_id").cast("string"), F.lit("-"), F.col("pos").cast("string"))),
        _py(F.col("department")), _py(gender, quote=False), _py(F.col("person_id"), quote=False),
        _py(F.col("job")), _py(F.col("name")))
    cast_item = F.format_string(
        "{'cast_id': %s, 'character': %s, 'credit_id': %s, 'gender': %s, 'id': %s, 'name': %s, 'order': %s, "
        "'profile_path': None}",
        _py(F.col("pos") + 1, quote=False), _py(F.concat(F.lit("Role "), F.col("pos").cast("string"))),
        _py(F.concat(F.lit("k"), F.col("tmdb_id").cast("string"), F.lit("-"), F.col("pos").cast("string"))),
        _py(gender, quote=False), _py(F.col("person_id"), quote=False), _py(F.col("name")),
        _py(F.col("order"), quote=False))
    item = F.when(F.col("kind") == "crew", crew_item).otherwise(cast_item)
    grouped = (r.groupBy("tmdb_id")
               .agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "crew", F.struct("pos", item.alias("t")))))
                    .alias("crew_items"),
                    F.sort_array(F.collect_list(F.when(F.col("kind") == "cast", F.struct("pos", item.alias("t")))))
                    .alias("cast_items")))

    def text(items: str, broken: Column) -> Column:
        body = F.array_join(F.transform(F.col(items), lambda x: x["t"]), ", ")
        return F.concat(F.lit("["), body, F.when(broken, F.lit("")).otherwise(F.lit("]")))

    return grouped.select(F.col("tmdb_id").cast("string").alias("id"),
                          text("cast_items", F.lit(False)).alias("cast"),
                          text("crew_items", F.col("tmdb_id") % 101 == 0).alias("crew"))


def keywords_raw(t: Tables) -> DataFrame:
    """keywords(id, keywords): list text of the part type's words; some
    unterminated, some missing."""
    words = F.split("p_type", " ")
    items = F.transform(words, lambda w, i: F.concat(F.lit("{'id': "), (i + 1).cast("string"), F.lit(", 'name': "), _py(w), F.lit("}")))
    text = F.concat(F.lit("["), F.array_join(items, ", "), F.when(_pk() % 61 == 7, F.lit("")).otherwise(F.lit("]")))
    return t.part.select(_pk().cast("string").alias("id"),
                         F.when(_pk() % 67 == 5, F.lit(None)).otherwise(text).alias("keywords"))


def links_text(t: Tables) -> DataFrame:
    """``links`` as text cells: ids with a fraction ('862.0'), some unreadable."""
    imdb = F.when(F.col("imdbId") % 31 == 0, F.lit("n/a")).otherwise(F.col("imdbId").cast("string"))
    return links(t).select(F.col("movieId").cast("string").alias("movieId"), imdb.alias("imdbId"),
                           F.concat(F.col("tmdbId").cast("string"), F.lit(".0")).alias("tmdbId"))


def ratings_text(t: Tables, rated: DataFrame | None = None) -> DataFrame:
    """``ratings`` as text cells, some scores unreadable."""
    r = ratings(t) if rated is None else rated
    score = F.when(F.col("order_key") % 41 == 0, F.lit("good")).otherwise(F.col("rating").cast("string"))
    return r.select(F.col("user_id").cast("string").alias("userId"), F.col("movie_id").cast("string").alias("movieId"),
                    score.alias("rating"), F.unix_timestamp("ts").cast("string").alias("timestamp"))


def crawled_lines(t: Tables) -> DataFrame:
    """Labelled text lines of a film page: ``Genre: ...``, ``Year: ...`` and a
    score out of ten; some lines carry another label, some scores no number."""
    label = F.when(_pk() % 37 == 3, F.lit("Kind: ")).otherwise(F.lit("Genre: "))
    score = F.when(_pk() % 43 == 2, F.lit("n/a")).otherwise(F.concat((F.col("p_size") % 11).cast("string"), F.lit("/10")))
    return t.part.select(F.col("p_partkey").cast("long").alias("film_id"), F.concat(label, "p_type").alias("genre_line"),
                         F.concat(F.lit("Year: "), (F.col("p_size") + 1970).cast("string")).alias("year_line"),
                         score.alias("score_line"))


PAGE_ORDERS = 1 << 18  # a film's reviews of so many consecutive orders share a page


def film_pages(t: Tables, rated: DataFrame | None = None) -> DataFrame:
    """(page_id, html): pages of a film with its scores, facts and reviews, a page
    for every ``PAGE_ORDERS`` order numbers, so that no page grows with the data.

    Some reviews give no points, some quote another review; list items go
    unclosed, lists and reviews hold lists and reviews of their own, a script
    quotes a tag, and a review stands outside the list of reviews."""
    r = ratings(t) if rated is None else rated
    rows = (r.withColumn("_pk", F.expr(f"movie_id div {ID_STRIDE}"))
            .join(t.customer.select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id"))
    points = F.when(F.col("order_key") % 37 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<span class='big points'>"), F.col("rating").cast("int").cast("string"), F.lit("/10</span>")))
    quote = F.when(F.col("line_no") % 3 == 0, F.lit(
        '<div class="quote"><div class="review"><div class="user">someone</div><span class="points">1/10</span></div></div>')).otherwise(F.lit(""))
    review = F.concat(F.lit('<div class="review"><div class="user">'), F.col("c_name"), F.lit('</div><div class="text-xs date">'),
                      F.date_format("ts", "yyyy-MM-dd"), F.lit("</div><p>seen it<br>"), points, quote, F.lit("</div>"))
    page = F.col("_pk") * (1 << 20) + F.expr(f"order_key div {PAGE_ORDERS}")
    lists = rows.groupBy("_pk", page.alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("order_key", "line_no", review.alias("h")))).alias("_r"))
    n_nations = t.nation.agg(F.count(F.lit(1))).scalar()
    nations = t.nation.select(F.col("n_nationkey").alias("_nk"), "n_name")
    film = (t.part.select(F.col("p_partkey").alias("_pk"), "p_name", "p_type", "p_size").withColumn("_n", n_nations)
            .withColumn("_nk", (F.col("_pk") % F.col("_n")).cast("int")).join(nations, "_nk", "left"))
    own = F.when(F.col("_pk") % 43 == 2, F.lit("n/a")).otherwise(F.concat((F.col("p_size") % 11).cast("string"), F.lit("/10")))
    country = F.when(F.col("_pk") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("<li>Country: "), F.col("n_name")))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), F.col("p_name"),
        F.lit('</title><script>var t = "<div class=\'reviews\'>";</script></head><body><!-- <div> --><h1>'), F.col("p_name"),
        F.lit('</h1><div class="mt-1 scores"><div><img src="a>b.png"><span>'), own,
        F.lit('</span></div><div><svg class="h-auto"></svg><b>'), ((F.col("p_size") + 3) % 11).cast("string"),
        F.lit('/10</b></div></div><div class="info"><ul><li>Genre: '), F.col("p_type"),
        F.lit("<ul><li>Genre: none</li><li>Year: 1</ul></li><li>Year: "), (F.col("p_size") + 1970).cast("string"), country,
        F.lit("</ul></div><p>all reviews<div class='grid reviews'>"), F.array_join(F.transform("_r", lambda x: x["h"]), "\n"),
        F.lit('</div><div class="side"><div class="review"><div class="user">ad</div><span class="points">9/10</span></div></div></body></html>'))
    return lists.join(film, "_pk").select("page_id", html.alias("html"))


def damaged_pages(t: Tables) -> DataFrame:
    """``pages`` with some titles and headings lost."""
    lost = F.when(F.col("page_id") % 50 == 7, F.regexp_replace("html", r"(?s)<title>.*?</title>", "")) \
        .when(F.col("page_id") % 50 == 8, F.regexp_replace("html", r"(?s)<h1>.*?</h1>", "")).otherwise(F.col("html"))
    return t.pages.select("page_id", "url", lost.alias("html"))


def links(t: Tables) -> DataFrame:
    """links(movieId, imdbId, tmdbId): rating id -> catalogue id.

    Every part has a link. Some lack a tmdbId, some point at a retired rating
    id (so the part's ratings have no link), and some parts have a second
    rating id, which adds a second row."""
    pk = _pk()

    def link(movie_slot, imdb_slot: int, tmdb: Column) -> Column:
        return F.struct(rating_id(pk, movie_slot).cast("int").alias("movieId"),
                        rating_id(pk, imdb_slot).cast("int").alias("imdbId"),
                        tmdb.cast("int").alias("tmdbId"))

    main = link(F.when(pk % 97 == 3, STALE_MOVIE_SLOT).otherwise(MOVIE_SLOT), IMDB_SLOT,
                F.when(pk % 50 == 0, F.lit(None)).otherwise(pk))
    alt = link(ALT_MOVIE_SLOT, ALT_IMDB_SLOT, pk)
    rows = F.when(pk % 40 == 1, F.array(main, alt)).otherwise(F.array(main))
    return t.part.select(F.inline(rows))


def rating_events(t: Tables) -> DataFrame:
    """rating_events(event_id, user_id, movie_id, rating, ts) from ``events``.

    ``ts`` is cast from timestamp_ntz to timestamp: watermarks and session
    windows in streams need the zoned type (the session runs in UTC).
    """
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", "user_id",
                           rating_id(k, MOVIE_SLOT).alias("movie_id"),
                           (F.lit(1) + F.col("event_id") % 10).cast("double").alias("rating"),
                           F.col("ts").cast("timestamp").alias("ts"),
                           "event_type")


def event_lines(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """Rating events as JSON lines, the way producers send them.

    Even ids use ``user_id`` + ``timestamp``, odd ids ``userId`` + ``date``.
    Error events are malformed: no user, no movie, or not JSON at all.
    Purchases with id % 5 == 0 are sent twice.
    """
    e = rating_events(t) if events is None else events
    even = F.col("event_id") % 2 == 0
    err = F.col("event_type") == "error"
    no_user = err & (F.col("event_id") % 3 == 0)
    no_movie = err & (F.col("event_id") % 3 == 1)
    garbage = err & (F.col("event_id") % 3 == 2)
    user = F.when(no_user, F.lit(None)).otherwise(F.col("user_id"))
    body = F.to_json(F.named_struct(
        F.lit("event_id"), F.col("event_id"),
        F.lit("user_id"), F.when(even, user),
        F.lit("userId"), F.when(~even, user),
        F.lit("movieId"), F.when(no_movie, F.lit(None)).otherwise(F.col("movie_id")),
        F.lit("rating"), F.col("rating"),
        F.lit("timestamp"), F.when(even, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.lit("date"), F.when(~even, F.date_format("ts", "yyyy-MM-dd"))))
    line = F.when(garbage, F.concat(F.lit("not json: "), F.col("event_id").cast("string"))).otherwise(body)
    copies = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    return e.select(line.alias("value"), F.explode(copies).alias("copy")).drop("copy")


def recommendations(t: Tables, k: int = 10, rated: DataFrame | None = None) -> DataFrame:
    """recs(user_id, movie_id, score): a deterministic stand-in for the factor
    model's top-k lists, so the serving queries can be oracle-checked.

    score = 0.7 * the user's mean rating of the movie + 0.3 * the movie's mean
    rating, cut to 4 places (floor of x * 10^4, plain IEEE arithmetic so any
    engine gets the same value); top ``k`` per user, ties by movie_id.
    """
    from cinestat.operators.topk import top_k_per_group
    r = ratings(t) if rated is None else rated
    pair = r.groupBy("user_id", "movie_id").agg(F.avg("rating").alias("pair_mean"))
    movie = r.groupBy("movie_id").agg(F.avg("rating").alias("movie_mean"))
    scored = (pair.join(movie, "movie_id")
              .select("user_id", "movie_id",
                      (F.floor((F.col("pair_mean") * 0.7 + F.col("movie_mean") * 0.3) * 10000) / 10000.0)
                      .alias("score")))
    return top_k_per_group(scored, ["user_id"], [F.desc("score"), F.asc("movie_id")], k)


def recommendation_lists(t: Tables, k: int = 10, recs: DataFrame | None = None) -> DataFrame:
    """The same lists in the model's stored shape:
    user_id int, recommendations array<struct<movie_id:int, rating:float>>."""
    recs = recommendations(t, k) if recs is None else recs
    lst = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("movie_id").alias("m"))))
    return (recs.groupBy("user_id").agg(lst.alias("l"))
            .select(F.col("user_id").cast("int").alias("user_id"),
                    F.transform("l", lambda x: F.struct(x["m"].cast("int").alias("movie_id"),
                                                        (-x["o"]).cast("float").alias("rating")))
                    .alias("recommendations")))


def catalogue(t: Tables) -> DataFrame:
    """Recommendation-side metadata: id (text), title, genres (crawled layout)."""
    return t.part.select(rating_id(_pk(), MOVIE_SLOT).cast("string").alias("id"),
                         F.col("p_name").alias("title"), F.col("p_type").alias("genres"))


# Tables written once per session and driver folder (the silver layer): many
# analyses read them, and rebuilding them inside every query would repeat the
# line-item aggregations and their shuffles.
MATERIALIZED = ("movies_raw", "credits_raw", "ratings", "links", "rating_events", "recommendations")
# Derived canonical tables and the stored table each one reads (as a keyword
# argument) when materializing: the upstream join or aggregation -- e.g. the
# line-item x order join behind ``ratings`` -- then runs once per session.
UPSTREAM = {"recommendations": ("rated", "ratings"), "recommendation_lists": ("recs", "recommendations"),
            "event_lines": ("events", "rating_events"), "ratings_text": ("rated", "ratings"), "film_pages": ("rated", "ratings")}
_STORE: dict[tuple, str] = {}


class Canonical:
    """Canonical tables for one driver folder.

    With ``materialize=True`` the tables in ``MATERIALIZED`` are written as
    Parquet under the session's shared checkpoint folder the first time they
    are asked for, and read back from there afterwards (rebuilt if the files
    are gone). Otherwise every call returns the lazy derivation."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = False):
        self.t = Tables(spark, sf_dir)
        self.materialize = materialize
        # changed input is another input: what was stored from the old one is not served
        self.state = folder_state(spark, sf_dir) if materialize else ""

    def _stored(self, name: str, fn):
        return self.stored(name, lambda: fn(self.t))

    def stored(self, name: str, build) -> DataFrame:
        """``build()`` written once per session, folder and name (when
        materializing), else the lazy ``build()``."""
        if not self.materialize:
            return build()
        from cinestat.session import ensure_checkpoint_dir, scratch_path
        spark = self.t.spark
        key = (ensure_checkpoint_dir(spark), self.t.sf_dir, self.state, name)
        path = _STORE.get(key)
        if path is not None:
            try:
                return spark.read.parquet(path)
            except Exception:  # noqa: BLE001 -- files removed: rebuild below
                _STORE.pop(key, None)
        path = scratch_path(spark, f"silver-{name}")
        build().write.mode("overwrite").parquet(path)
        _STORE[key] = path
        return spark.read.parquet(path)

    def kept(self, name: str, write) -> str:
        """The path of something that is no plain table, e.g. a model, or the name
        that ``write(path)`` returns; it is called once per session, folder and name."""
        from cinestat.session import ensure_checkpoint_dir, scratch_path
        spark = self.t.spark
        key = (ensure_checkpoint_dir(spark), self.t.sf_dir, self.state, name)
        if key not in _STORE:
            path = scratch_path(spark, name)
            _STORE[key] = write(path) or path
        return _STORE[key]

    def __getattr__(self, name):
        fn = globals().get(name)
        if callable(fn) and name not in ("Canonical",):
            if self.materialize and name in UPSTREAM:
                # only the default form reads the stored upstream (which was
                # built with default arguments too)
                arg, up = UPSTREAM[name]
                base = fn
                fn = lambda t, *a, **kw: (base(t, **{arg: getattr(self, up)()}) if not (a or kw)
                                          else base(t, *a, **kw))
            if self.materialize and name in MATERIALIZED:
                return lambda *a, **kw: (self._stored(name, fn) if not (a or kw) else fn(self.t, *a, **kw))
            return lambda *a, **kw: fn(self.t, *a, **kw)
        raise AttributeError(name)

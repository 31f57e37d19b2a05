"""Field extraction from stored web pages (H1-H4) and the per-key prefix
cut-off of the crawler (W4).

Pages are processed whole: regular expressions run in the JVM over the full
HTML text of each row; nothing is truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinestat.operators.topk import top_k_per_group

# Fixed patterns for the stored page layout.
HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)"
SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//"
SCHEME_HOST_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/:?#]+)"
TITLE_RE = r"(?s)<title>(.*?)</title>"
H1_RE = r"(?s)<h1>(.*?)</h1>"
LANG_RE = r"<html lang=\"([^\"]*)\""
AD_RE = r"(?s)<div class=\"ad\">(.*?)</div>"
FOOTER_RE = r"(?s)<footer>(.*?)</footer>"
HREF_RE = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']([^\"']*)[\"']"
LI_RE = r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"
TAG_RE = r"<[^>]*>"


def _field(html: Column, pattern: str) -> Column:
    """First capture group, NULL when absent or empty (H2)."""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, host, lang, title, heading, ad, footer, n_links, status (H2, H4)."""
    h = F.col("html")
    out = pages.select(
        "page_id",
        F.regexp_extract("url", HOST_RE, 1).alias("host"),
        _field(h, LANG_RE).alias("lang"),
        _field(h, TITLE_RE).alias("title"),
        _field(h, H1_RE).alias("heading"),
        F.trim(F.regexp_replace(_field(h, AD_RE), TAG_RE, "")).alias("ad"),
        F.trim(F.regexp_replace(_field(h, FOOTER_RE), TAG_RE, "")).alias("footer"),
        F.size(F.regexp_extract_all(h, F.lit(HREF_RE), F.lit(1))).alias("n_links"))
    status = (F.when(F.col("title").isNull(), F.lit("missing_title"))
               .when(F.col("heading").isNull(), F.lit("missing_heading")).otherwise(F.lit("ok")))
    return out.withColumn("status", status)


def page_rejects(pages: DataFrame) -> DataFrame:
    """Pages that fail extraction, with the reason (H4): a reject table rather
    than a list kept on the driver."""
    return page_fields(pages).filter(F.col("status") != "ok").select("page_id", "status")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, url: every link of every page in order (H1).
    Links from the root are resolved against the page's scheme and host, links
    that name a host alone (``//host/x``) against its scheme."""
    base = F.regexp_extract("url", SCHEME_HOST_RE, 1)
    exploded = pages.select("page_id", base.alias("_base"), F.regexp_extract("url", SCHEME_RE, 1).alias("_scheme"),
                            F.posexplode(F.regexp_extract_all("html", F.lit(HREF_RE), F.lit(1))).alias("pos", "href"))
    absolute = F.when(F.col("href").startswith("//"), F.concat("_scheme", "href")).when(F.col("href").startswith("/"), F.concat("_base", "href")).otherwise(F.col("href"))
    return exploded.select("page_id", (F.col("pos") + 1).alias("pos"), "href", absolute.alias("url"))


def canonical_url(col: Column) -> Column:
    """URL without query and fragment, and without a trailing slash."""
    return F.regexp_replace(F.regexp_replace(col, r"[?#].*$", ""), r"/$", "")


def distinct_urls(pages: DataFrame) -> DataFrame:
    """url, n_sources: union-distinct of two listings -- the page URLs
    themselves and the links found on the pages (D2s)."""
    own = pages.select(canonical_url(F.col("url")).alias("url"), F.lit("page").alias("src"))
    linked = page_links(pages).select(canonical_url(F.col("url")).alias("url"), F.lit("link").alias("src"))
    return (own.unionByName(linked).groupBy("url")
            .agg(F.count_distinct("src").alias("n_sources")))


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, pos, item_text, href: repeated list blocks with their position (H3)."""
    items = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LI_RE), F.lit(1)))
                         .alias("pos", "item"))
    return items.select("page_id", (F.col("pos") + 1).alias("pos"),
                        F.trim(F.regexp_replace("item", TAG_RE, "")).alias("item_text"),
                        _field(F.col("item"), HREF_RE).alias("href"))


def prefix_cutoff(df: DataFrame, key: str, order_cols: list[str], missing: Column, limit: int) -> DataFrame:
    """Rows of each key, in order, while at most ``limit`` earlier rows were
    missing (W4, D21).

    The row after which reading stops is the (limit+1)-th missing row of the
    key. It is found with a per-key top-(limit+1) -- limited on the map side
    before the shuffle -- so a key with a huge number of rows is never sorted
    whole in one task. Rows up to and including that row are kept.
    """
    miss = df.filter(missing).select(key, *order_cols)
    firsts = top_k_per_group(miss, [key], [F.asc(c) for c in order_cols], limit + 1, rank_col="_r")
    cut = (firsts.filter(F.col("_r") == limit + 1)
           .select(F.col(key).alias("_key"), F.struct(*order_cols).alias("_cut")))
    # null-safe: the rows without a key are one key's rows
    j = df.join(cut, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return j.filter(F.col("_cut").isNull() | (F.struct(*order_cols) <= F.col("_cut"))).drop("_cut")

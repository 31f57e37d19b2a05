"""DuckDB definitions of the canonical tables, for the oracle SQL.

They state the same tables as ``cinestat.plans.canonical`` but directly from
the driver columns: where Spark parses text (list cells, numbers, dates),
the SQL computes the intended value from the source columns, so the oracle
checks the parsing path rather than repeating it.
"""

from __future__ import annotations

import re

TS_FMT_SQL = "%Y-%m-%d %H:%M:%S.%f"

CTES: dict[str, str] = {}

CTES["ratings"] = """
SELECT o.o_custkey AS user_id,
       l.l_partkey * 10 + CASE WHEN l.l_partkey % 40 = 1 AND l.l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS movie_id,
       CAST(ceil(l.l_quantity / 5) AS DOUBLE) AS rating,
       o.o_orderdate AS ts, l.l_orderkey AS order_key, l.l_linenumber AS line_no
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

CTES["part_stats"] = """
SELECT l_partkey,
       CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS BIGINT) AS rv,
       sum(CAST(l_quantity AS BIGINT)) * 20 // count(*) AS avg_x100,
       count(*) AS n_lines,
       sum(CAST(l_quantity AS BIGINT)) AS sum_qty
FROM lineitem GROUP BY l_partkey"""

CTES["movies_raw"] = """
SELECT
  CASE WHEN p.p_partkey % 211 = 5 THEN 'tt' || CAST(p.p_partkey AS VARCHAR) ELSE CAST(p.p_partkey AS VARCHAR) END AS id,
  CASE WHEN p.p_partkey % 307 = 11 THEN NULL ELSE p.p_name END AS title,
  CASE WHEN p.p_partkey % 3 = 0 THEN 'True' WHEN p.p_partkey % 3 = 1 THEN 'False' ELSE 'unknown' END AS adult,
  CASE WHEN p.p_partkey % 5 = 0 THEN 'True' ELSE 'False' END AS video,
  CASE WHEN p.p_partkey % 7 = 0 THEN '0' WHEN p.p_partkey % 13 = 4 THEN 'abc'
       WHEN p.p_partkey % 11 = 2 THEN CAST(p.b // 1000 AS VARCHAR) || ',' || lpad(CAST(p.b % 1000 AS VARCHAR), 3, '0')
       WHEN p.p_partkey % 29 = 3 THEN '' ELSE CAST(p.b AS VARCHAR) END AS budget,
  CASE WHEN s.rv IS NULL THEN NULL WHEN p.p_partkey % 17 = 0 THEN '0' ELSE CAST(s.rv AS VARCHAR) END AS revenue,
  CASE WHEN p.p_size % 10 = 0 THEN '0' ELSE CAST(60 + 3 * p.p_size AS VARCHAR) END AS runtime,
  CASE WHEN p.p_partkey % 89 = 0 THEN '1' WHEN p.p_partkey % 83 = 0 THEN NULL
       ELSE CAST(make_date(CASE WHEN p.p_partkey % 71 = 0 THEN 1890 WHEN p.p_partkey % 73 = 0 THEN 2030
                                ELSE 1970 + p.p_size END,
                           1 + p.p_partkey % 12, 1 + p.p_partkey % 28) AS VARCHAR) END AS release_date,
  s.avg_x100 / CAST(100 AS DOUBLE) AS vote_average_num,
  CAST(s.n_lines AS VARCHAR) AS vote_count,
  s.sum_qty / CAST(10 AS DOUBLE) AS popularity_num,
  CASE WHEN p.p_partkey % 101 = 0 OR p.p_partkey % 103 = 9 OR p.p_partkey % 107 = 9 THEN NULL ELSE string_split(p.p_name || ' ' || p.p_type, ' ') END AS genre_names,
  p.p_partkey % (SELECT count(*) FROM nation) AS nation_k,
  p.p_partkey
FROM (SELECT *, CAST(round(p_retailprice * 400) AS BIGINT) AS b FROM part) p
LEFT JOIN part_stats s ON s.l_partkey = p.p_partkey"""

CTES["movies"] = """
SELECT TRY_CAST(id AS INTEGER) AS tmdb_id, title,
       TRY_CAST(release_date AS DATE) AS release_date,
       CAST(year(TRY_CAST(release_date AS DATE)) AS INTEGER) AS release_year,
       nullif(TRY_CAST(budget AS DOUBLE), 0) AS budget,
       nullif(TRY_CAST(revenue AS DOUBLE), 0) AS revenue,
       nullif(TRY_CAST(runtime AS DOUBLE), 0) AS runtime,
       vote_average_num AS vote_average,
       TRY_CAST(vote_count AS INTEGER) AS vote_count,
       popularity_num AS popularity,
       CASE adult WHEN 'True' THEN true WHEN 'False' THEN false END AS adult,
       CASE video WHEN 'True' THEN true WHEN 'False' THEN false END AS video,
       genre_names, nation_k, p_partkey
FROM movies_raw"""

CTES["movies_dedup"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY title, release_year
                               ORDER BY vote_count DESC NULLS LAST, tmdb_id ASC NULLS LAST) AS rn
  FROM movies WHERE title IS NOT NULL) WHERE rn = 1
UNION ALL SELECT * FROM movies WHERE title IS NULL"""

CTES["movies_final"] = """
SELECT * FROM movies_dedup
WHERE budget <= (SELECT quantile_disc(budget, 0.99) FROM movies_dedup)
  AND revenue <= (SELECT quantile_disc(revenue, 0.99) FROM movies_dedup)"""

CTES["links"] = """
SELECT unnest(CASE WHEN p_partkey % 40 = 1 THEN [main, alt] ELSE [main] END, recursive := true)
FROM (SELECT p_partkey,
             {'movieId': CAST(p_partkey * 10 + CASE WHEN p_partkey % 97 = 3 THEN 3 ELSE 1 END AS INTEGER),
              'imdbId': CAST(p_partkey * 10 + 5 AS INTEGER),
              'tmdbId': CAST(CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey END AS INTEGER)} AS main,
             {'movieId': CAST(p_partkey * 10 + 2 AS INTEGER), 'imdbId': CAST(p_partkey * 10 + 6 AS INTEGER),
              'tmdbId': CAST(p_partkey AS INTEGER)} AS alt
      FROM part)"""

CTES["crew"] = """
SELECT c.p_partkey AS tmdb_id, c.i AS pos, s.s_name AS name,
  CASE WHEN c.slot = 0 THEN 'Director'
       WHEN c.slot = 1 THEN (CASE WHEN c.p_partkey % 3 = 0 THEN 'Co-Director'
                                  WHEN c.p_partkey % 3 = 1 THEN 'Assistant Director'
                                  ELSE 'Director of Photography' END)
       WHEN c.slot = 2 THEN 'Producer' END AS job,
  CASE WHEN c.slot = 0 AND c.p_partkey % 9 = 4 THEN 'Writing' WHEN c.slot = 0 THEN 'Directing'
       WHEN c.slot = 1 THEN (CASE WHEN c.p_partkey % 3 = 2 THEN 'Camera' ELSE 'Directing' END)
       WHEN c.slot = 2 THEN 'Production' ELSE 'Crew' END AS department
FROM (SELECT p_partkey, i, CASE WHEN i = 3 AND p_partkey % 17 = 0 THEN 0 ELSE i END AS slot
      FROM (SELECT p_partkey, unnest(range(0, 4)) AS i FROM part)) c
JOIN supplier s ON s.s_suppkey = (c.p_partkey * 3 + c.slot * 7) % (SELECT count(*) FROM supplier)
WHERE c.p_partkey % 101 <> 0"""

CTES["cast_rows"] = """
SELECT c.p_partkey AS tmdb_id, c.i AS pos,
  CASE WHEN c.p_partkey % 23 = 0 AND c.i = 5 THEN cu.c_name || '''s double' ELSE cu.c_name END AS name,
  CASE WHEN c.p_partkey % 19 = 0 AND c.i = 2 THEN NULL ELSE c.i END AS ord
FROM (SELECT p_partkey, unnest(range(0, 6)) AS i FROM part) c
JOIN customer cu ON cu.c_custkey = (c.p_partkey * 5 + c.i * 11) % (SELECT count(*) FROM customer)"""

CTES["dir_strict"] = """
SELECT tmdb_id, name FROM crew
WHERE department = 'Directing' AND lower(job) IN ('director', 'co-director')"""

CTES["dir_loose"] = """SELECT tmdb_id, name FROM crew WHERE job LIKE '%Director%'"""

CTES["main_cast"] = """SELECT tmdb_id, name FROM cast_rows WHERE ord <= 3"""

CTES["rating_stats"] = """
SELECT movie_id, count(*) AS rating_count, avg(rating) AS rating_mean, stddev_samp(rating) AS rating_std
FROM ratings GROUP BY movie_id"""

CTES["stats_tmdb"] = """
SELECT l.tmdbId AS tmdb_id, count(*) AS rating_count, avg(r.rating) AS rating_mean
FROM ratings r JOIN links l ON l.movieId = r.movie_id WHERE l.tmdbId IS NOT NULL GROUP BY l.tmdbId"""

CTES["backup"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT tmdb_id, title, vote_average, vote_count, release_year,
         row_number() OVER (PARTITION BY tmdb_id ORDER BY coalesce(vote_count, -1) DESC) AS rn
  FROM movies WHERE tmdb_id IS NOT NULL) WHERE rn = 1"""

CTES["enriched"] = """
SELECT rs.movie_id, ln.tmdbId AS tmdb_id, coalesce(mv.title, bk.title) AS title,
       rs.rating_count, rs.rating_mean, rs.rating_std,
       coalesce(mv.vote_average, bk.vote_average) AS vote_average,
       coalesce(mv.vote_count, bk.vote_count) AS vote_count,
       coalesce(mv.release_year, bk.release_year) AS release_year,
       coalesce(mv.vote_average, bk.vote_average) / 2.0 AS tmdb_rating_5
FROM rating_stats rs
LEFT JOIN (SELECT * FROM links WHERE tmdbId IS NOT NULL) ln ON ln.movieId = rs.movie_id
LEFT JOIN movies_final mv ON mv.tmdb_id = ln.tmdbId
LEFT JOIN backup bk ON bk.tmdb_id = ln.tmdbId"""

CTES["rating_events"] = """
SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + 1 AS movie_id,
       CAST(1 + event_id % 10 AS DOUBLE) AS rating, ts, event_type
FROM events"""

CTES["recs"] = """
SELECT user_id, movie_id, score FROM (
  SELECT p.user_id, p.movie_id, floor((p.pair_mean * 0.7 + m.movie_mean * 0.3) * 10000) / CAST(10000 AS DOUBLE) AS score,
         row_number() OVER (PARTITION BY p.user_id
                            ORDER BY floor((p.pair_mean * 0.7 + m.movie_mean * 0.3) * 10000) / CAST(10000 AS DOUBLE) DESC, p.movie_id) AS rn
  FROM (SELECT user_id, movie_id, avg(rating) AS pair_mean FROM ratings GROUP BY 1, 2) p
  JOIN (SELECT movie_id, avg(rating) AS movie_mean FROM ratings GROUP BY 1) m USING (movie_id))
WHERE rn <= 10"""

CTES["catalogue"] = """
SELECT CAST(p_partkey * 10 + 1 AS VARCHAR) AS id, p_name AS title, p_type AS genres FROM part"""

CTES["movie_roi"] = """
SELECT tmdb_id, genre_names,
       CASE WHEN budget > 0 AND revenue > 0 THEN revenue / budget END AS roi
FROM movies_final"""

CTES["movie_genre"] = """
SELECT unnest(m.genre_names) AS genre, m.roi, r.rating_mean, r.rating_count
FROM movie_roi m LEFT JOIN stats_tmdb r USING (tmdb_id)"""

_WORD = re.compile(r"\b([a-z_]+)\b")


def _deps(body: str) -> list[str]:
    return [w for w in dict.fromkeys(_WORD.findall(body)) if w in CTES]


def with_ctes(query: str) -> str:
    """Prefix ``query`` with the canonical CTEs it (transitively) uses, in
    dependency order."""
    order: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in order or name in stack:
            return
        for d in _deps(CTES[name]):
            if d != name:
                visit(d, stack + (name,))
        order.append(name)

    for d in _deps(query):
        visit(d)
    if not order:
        return query
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    q = query.lstrip()
    if q[:4].upper() == "WITH":
        return "WITH " + head + ",\n" + q[4:].lstrip()
    return "WITH " + head + "\n" + query

"""Fixed schemas. Nothing in the library infers a schema: inference costs an
extra pass over the input and is not stable across files."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
D = T.DoubleType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Raw movie table: every column text, as a header CSV reads it.
MOVIES_RAW = _struct(*[(c, S) for c in (
    "id", "title", "adult", "video", "budget", "revenue", "runtime", "release_date",
    "vote_average", "vote_count", "popularity", "genres", "production_countries",
    "spoken_languages")])

CREDITS_RAW = _struct(("id", S), ("cast", S), ("crew", S))
KEYWORDS_RAW = _struct(("id", I), ("keywords", S))
LINKS = _struct(("movieId", I), ("imdbId", I), ("tmdbId", I))
RATINGS = _struct(("userId", I), ("movieId", I), ("rating", D), ("timestamp", L))

# Nested lists inside the text columns.
ID_NAME_LIST = T.ArrayType(_struct(("id", I), ("name", S)))
COUNTRY_LIST = T.ArrayType(_struct(("iso_3166_1", S), ("name", S)))
LANGUAGE_LIST = T.ArrayType(_struct(("iso_639_1", S), ("name", S)))
CAST_LIST = T.ArrayType(_struct(
    ("cast_id", I), ("character", S), ("credit_id", S), ("gender", I), ("id", I),
    ("name", S), ("order", I), ("profile_path", S)))
CREW_LIST = T.ArrayType(_struct(
    ("credit_id", S), ("department", S), ("gender", I), ("id", I), ("job", S),
    ("name", S), ("profile_path", S)))

# Rating events as JSON text. Producers disagree on spelling (user_id/userId,
# date/timestamp), so the schema holds both and readers coalesce them.
RATING_EVENT = _struct(
    ("user_id", L), ("userId", L), ("movieId", L), ("rating", D),
    ("timestamp", S), ("date", S))

# Per-user recommendation list, as the factor model writes it.
REC_ITEM = _struct(("movie_id", I), ("rating", T.FloatType()))
RECOMMENDATIONS = _struct(("user_id", I), ("recommendations", T.ArrayType(REC_ITEM)))

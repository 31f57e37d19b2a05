"""Higher-order array functions over parsed credit lists.

They run per row inside the JVM on a movie's own (bounded) credit list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_director_loose(x: Column) -> Column:
    """Every job containing 'Director' (assistant and photography included)."""
    return x["job"].like("%Director%")


def is_director_strict(x: Column) -> Column:
    """Department Directing and job exactly director or co-director.

    Equality already decides, so exclusions such as 'assistant director' need
    no separate test.
    """
    job = F.lower(x["job"])
    return (x["department"] == "Directing") & job.isin("director", "co-director")


def director_names(crew, rule: str = "strict") -> Column:
    """Names of the directors in a crew list."""
    pred = is_director_strict if rule == "strict" else is_director_loose
    return F.transform(F.filter(_c(crew), pred), lambda x: x["name"])


def main_cast_names(cast, max_order: int = 3) -> Column:
    """Names of billed actors with 0-based order <= max_order; NULL order drops."""
    return F.transform(F.filter(_c(cast), lambda x: x["order"] <= max_order), lambda x: x["name"])


def names(arr) -> Column:
    """array<struct<..., name>> -> array<name>."""
    return F.transform(_c(arr), lambda x: x["name"])

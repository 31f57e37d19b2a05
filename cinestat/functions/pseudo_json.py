"""Python-literal list text -> typed arrays.

Raw credit and genre cells hold Python ``repr`` output, e.g.
``[{'id': 1, 'name': "O'Brien", 'gender': None}]``. Spark's JSON reader
already accepts single-quoted strings, so the only repair needed is turning
the Python constants ``None``/``True``/``False`` into JSON -- and only where
they stand as the value of a key. A word inside a quoted name ("None Left")
is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bare constant that directly follows a quoted key and its colon and is
# followed by the end of the value.
_VALUE_CONST = r"(?<=['\"]: ){word}(?=\s*[,}}\]])"


def repair(col) -> Column:
    """Rewrite Python constants that are values into JSON literals."""
    c = F.col(col) if isinstance(col, str) else col
    for word, lit in (("None", "null"), ("True", "true"), ("False", "false")):
        c = F.regexp_replace(c, _VALUE_CONST.format(word=word), lit)
    return c


def parse(col, schema, repair_text: bool = True) -> Column:
    """Parse list text into ``schema``; NULL when the text is not a list."""
    c = F.col(col) if isinstance(col, str) else col
    if repair_text:
        c = repair(c)
    return F.from_json(c, schema, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def schema_of(sample_text: str) -> Column:
    """DDL schema of a sample JSON text (F8)."""
    return F.schema_of_json(F.lit(sample_text))


def as_variant(col) -> Column:
    """List text as a VARIANT with the types of its values; NULL where it cannot
    be read (F7, F9)."""
    return F.from_json(repair(col), "variant", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def schema_of_all(df, col) -> DataFrame:
    """(schema, n): the one schema that covers every readable row of a column of
    list text, not that of a sample (F8). An aggregate with a partial phase."""
    v = as_variant(col)
    return df.agg(F.schema_of_variant_agg(v).alias("schema"), F.count(v).alias("n"))

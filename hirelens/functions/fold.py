"""Keys for looking names up, whatever their accents. Spark has no Unicode normal forms, so that one step is an Arrow
function; operators use it over distinct texts only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_marks: dict = {}


def _without_marks(values: pd.Series) -> pd.Series:
    if not _marks:
        _marks.update({i: None for i in range(0x110000) if unicodedata.combining(chr(i))})
    return values.str.normalize("NFKD").str.translate(_marks)


def unaccented(c: Column) -> Column:
    """Compatibility-decomposed text without combining marks."""
    return F.pandas_udf(_without_marks, "string")(c)


def composed(c: Column) -> Column:
    """Compatibility-composed text."""
    return F.pandas_udf(lambda values: values.str.normalize("NFKC"), "string")(c)


def lookup_key(c: Column) -> Column:
    """Words of a-z and 0-9, with `and` for `&`; null: empty."""
    t = F.replace(F.lower(unaccented(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def compact(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit(""))

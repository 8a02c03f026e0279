"""HTML to plain text by column expressions; only texts with character references pass through Python, in Arrow batches."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: For the SQL only: the references of the given pages, as patterns; `&` is last, so that one pass undoes one level.
ENTITIES = {"&lt;?": "<", "&gt;?": ">", "&quot;?": '"', "&copy;?": "©", "&middot;?": "·", "&amp;?": "&"}
SPACE = r"[ \t\n\r\f\x0B\x{A0}]"
#: In this order: what is no text, what ends a line, all other tags.
TAGS = {
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>": " ",
    r"(?i)<br\b[^>]*>|</(?:p|div|li|h[1-6]|tr)\s*>": " \n ",
    r"</?[A-Za-z!][^>]*>": " ",
}
LAYOUT = {r"[ \t]+": " ", rf"\n{SPACE}*\n{SPACE}*\n+": "\n\n", rf"^{SPACE}+|{SPACE}+$": ""}
STEPS = (ENTITIES, TAGS, ENTITIES, LAYOUT)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescaped(c: Column) -> Column:
    """`c` with one level of character references undone, named and numeric ones, as HTML 5 reads them."""
    return F.coalesce(_unescape(F.when(c.rlike("&[#A-Za-z]"), c)), c)


def html_text(c: Column) -> Column:
    """Plain text of an HTML column, whose own entities may be escaped once more; null and empty give an empty text.

    Lines end at the end of a block and at `br`; more than one blank line becomes one. A block without an end
    tag does not end a line.
    """
    out = F.coalesce(c, F.lit(""))
    for step in STEPS:
        if step is ENTITIES:
            out = unescaped(out)
            continue
        for pattern, to in step.items():
            out = F.regexp_replace(out, pattern, to)
    return out


def html_text_sql(c: str) -> str:
    out = f"coalesce({c}, '')"
    for step in STEPS:
        for pattern, to in step.items():
            quoted = [x.replace("'", "''") for x in (pattern, to)]
            out = f"regexp_replace({out}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return out


def hydrated(plain: Column, html: Column) -> Column:
    """`plain`, or the text of `html` where `plain` is blank and `html` isn't."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(plain) & ~blank(html), html_text(html)).otherwise(plain)

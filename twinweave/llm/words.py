"""What a word is, in SQL and in Python: a run of anything but space and \\x09-\\x0D."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | Column) -> Column:
    """Array of words; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores at its end as it takes to clash with no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def bind(value: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once: a lambda variable isn't inlined into inner lambdas."""
    return F.transform(F.array(value), body)[0]

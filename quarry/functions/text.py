"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of every kind from both ends (SQL ``trim`` removes spaces only)."""
    return F.trim(_column(c), F.lit(WHITESPACE))


def combined_text(
    summary: Column | str, text: Column | str, sep: str = "\n\n", mode: str = "clean"
) -> Column:
    """Summary and text in one string; a NULL part counts as empty.

    ``mode="compat"`` trims spaces only, so that two empty parts leave the separator behind;
    ``mode="clean"`` strips all white space.
    """
    joined = F.concat(
        F.coalesce(_column(summary), F.lit("")), F.lit(sep), F.coalesce(_column(text), F.lit(""))
    )
    if mode == "compat":
        return F.trim(joined)
    if mode == "clean":
        return strip(joined)
    raise ValueError(f"unknown mode {mode!r}; use 'clean' or 'compat'")


def not_blank(c: Column | str) -> Column:
    return strip(F.coalesce(_column(c), F.lit(""))) != ""


def tokens(c: Column | str) -> Column:
    """Lower-case words, split at white space; NULL has none."""
    lowered = F.lower(F.coalesce(_column(c), F.lit("")))
    # Splitting at one plain character is cheaper than at a pattern.
    spaced = F.translate(lowered, WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(spaced, " "), "")


def preview(c: Column | str, width: int) -> Column:
    """The first ``width`` characters, with an ellipsis if there are more."""
    c = _column(c)
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)


def safe_name(c: Column | str) -> Column:
    """A model name as one path segment."""
    return F.regexp_replace(_column(c), "/", "_")

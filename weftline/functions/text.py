"""Column expressions on text that several operators share; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, the no-break space included.
OUTER_BLANKS = r"^[\s ]+|[\s ]+$"


def strip_blanks(column: Column) -> Column:
    """column without white space at its ends; null stays null."""
    return F.regexp_replace(column, OUTER_BLANKS, "")


def name_key(column: Column) -> Column:
    """The key of a name that ignores letter case and outer blanks; null stays null."""
    return F.lower(strip_blanks(column))


def alnum_key(column: Column) -> Column:
    """column with only its letters and digits, in lower case; null becomes the empty text."""
    return F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def blank_to_null(column: Column) -> Column:
    """null for empty and blank texts, else the column as it is."""
    return F.when(F.length(strip_blanks(column)) > 0, column)

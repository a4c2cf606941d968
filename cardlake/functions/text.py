"""Column expressions for identifiers and blank texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, control and format characters (zero-width space, byte-order mark, soft hyphen ...).
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}]+"


def squeezed(c: Column) -> Column:
    """Text without any invisible character; '' when nothing is left, null stays null."""
    return F.when(c.rlike("^[!-~]*$"), c).otherwise(F.regexp_replace(c, INVISIBLE, ""))  # most values need no replacing


def is_blank(c: Column) -> Column:
    """True for null, empty and only invisible characters. Never null."""
    return F.coalesce(squeezed(c) == "", F.lit(True))


def canonical_id(c: Column) -> Column:
    """One spelling per identifier: invisible characters, letter case, a ``urn:uuid:`` prefix, braces and the
    hyphens of a UUID do not matter. Blank identifiers become null."""
    x = F.lower(F.regexp_replace(c, INVISIBLE, ""))
    x = F.regexp_replace(x, r"^(urn:)?uuid:", "")
    x = F.regexp_replace(x, r"^\{(.*)\}$", "$1")
    x = F.regexp_replace(x, r"^([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})$", "$1$2$3$4$5")
    return F.when(c.rlike("^[0-9a-f]{32}$"), c).otherwise(F.nullif(x, F.lit("")))

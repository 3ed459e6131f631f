"""Scalar expressions with the semantics that the checks need: UTF-16 lengths, wide white space, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, beyond what regular expressions here call \s.
#: Visible ASCII is ruled out first, in one comparison.
SPACE = r"[[^!-~]&&[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def units(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def words(s: Column) -> Column:
    return F.filter(F.split(s, f"{SPACE}+"), lambda w: w != "")


def rounded(x: Column, places: int = 0) -> Column:
    """Half towards positive infinity."""
    return F.floor(x * 10**places + F.lit(0.5)) / 10**places

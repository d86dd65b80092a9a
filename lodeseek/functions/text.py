"""Column functions on text. Regular expressions treat letters as Unicode does."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() and str.split() take for white space, as far as texts hold it.
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def words(text: Column) -> Column:
    """Lower-case words between white space, as an array without empty strings."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def clip(text: Column, most: int = 120, keep: int = 117, tail: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit(tail))).otherwise(text)


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether any of the parts is a substring."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def count_of(text: Column, parts: list[str]) -> Column:
    """How many of the parts are substrings."""
    return sum((F.contains(text, F.lit(p)).cast("int") for p in parts), F.lit(0))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

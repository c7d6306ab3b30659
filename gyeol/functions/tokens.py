"""White-space tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that Python's str.split() splits on.
SPACES = r"[\s\u001c-\u001f\u0085   -     　]"

#: The same characters, one by one.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def split_words(c: Column | str) -> Column:
    """Tokens between white space, without empty ones; null for null."""
    return F.filter(F.split(F.col(c) if isinstance(c, str) else c, SPACES + "+"), lambda t: t != "")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))

"""String expressions for multi-valued catalogue columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def split_values(c: Column, sep: str, trim: bool = False) -> Column:
    """Split on a literal separator (``F.split`` takes a pattern)."""
    parts = F.split(c, re.escape(sep))
    return F.transform(parts, strip) if trim else parts

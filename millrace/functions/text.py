"""Text helpers shared by records and JSON decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode counts as white space, and the four separators U+001C to U+001F: a character class of its own.
SPACES = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind; trim() takes the space character only."""
    return F.regexp_replace(text, rf"^{SPACES}+|{SPACES}+$", "")

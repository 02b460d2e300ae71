"""Small text helpers whose idea of white space is Python's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separators Python also strips.
SPACE = r"[\s\x1c-\x1f]"
# A Python regex word character: letters and numbers, no combining marks.
WORD = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def unix_newlines(text: Column) -> Column:
    """What reading a file in text mode does to line ends."""
    crlf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(crlf, F.lit("\r"), F.lit("\n"))

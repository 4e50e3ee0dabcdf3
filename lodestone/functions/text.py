"""Text functions as columns, equal to Python's on any Unicode text.

Java's \\s and \\w are ASCII and its `.` and `$` stop at more characters than
the expected ones, so classes are spelled out and `(?d)` keeps lines to \\n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.isspace and the regex \\s of Python see it.
W = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Words of letters, digits and underscores, joined by hyphens.
TOKEN = r"[\p{L}\p{N}_]+(?:-+[\p{L}\p{N}_]+)*"
REFERENCE = r"\[(\d+)\]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(c), rf"\A{W}+|{W}+\z", "")


def normalize(c: Column | str) -> Column:
    """Line ends as \\n, without white space at both ends."""
    return strip(F.regexp_replace(_col(c), "\r\n?", "\n"))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends, lower case."""
    return F.lower(F.regexp_replace(strip(c), rf"{W}+", " "))


def tokens(c: Column | str) -> Column:
    """The lower-case words of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0))


def references(c: Column | str) -> Column:
    """Numbers cited as [n], each once, in order of first mention. Numbers too large for an int are null-safe dropped."""
    found = F.transform(F.regexp_extract_all(_col(c), F.lit(REFERENCE), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def answer_text(c: Column | str) -> Column:
    """Text for fact matching: without [n] and backticks, lower case, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), r"\[\d+\]", ""), "`", "")
    return collapse(bare)


def sentences(c: Column | str) -> Column:
    """Non-empty sentences, split after . ! or ? and white space."""
    return F.filter(F.transform(F.split(_col(c), rf"(?<=[.!?]){W}+"), strip), lambda s: s != "")


def path(c: Column | str) -> Column:
    """A path for comparison: / as separator, lower case, no leading ./ ."""
    return F.regexp_replace(F.lower(strip(F.replace(_col(c), F.lit("\\"), F.lit("/")))), r"\A(\./)+", "")

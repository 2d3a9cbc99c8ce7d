"""Column expressions for document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CHARS = 200
MAX_CHARS = 200_000

# The code points that count as whitespace, and NUL, as a Java
# regex class.  Java's own \s leaves 24 of them out.  The ones below 256 are
# listed singly, which the regex engine keeps in a bit set, and the rest stand
# behind one range test, so that ordinary letters are told apart quickly.
BLANK_RUN = (
    r"[ \x00\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x85\xA0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]+"
)


def normalize_text(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """First ``max_chars`` characters with every run of blanks as one space, trimmed.

    Line breaks of all kinds and NUL are blanks, so the result is one line.
    """
    return F.trim(F.regexp_replace(F.substring(text, 1, max_chars), BLANK_RUN, " "))


def human_time(seconds: Column) -> Column:
    """Duration as ``1d 2h 3m``, ``2h 3m`` or ``3m 4s``; ``N/A`` when negative."""
    whole = seconds.cast("long")
    days = F.floor(whole / 86400)
    hours = F.floor(F.pmod(whole, F.lit(86400)) / 3600)
    minutes = F.floor(F.pmod(whole, F.lit(3600)) / 60)
    secs = F.pmod(whole, F.lit(60))
    return (
        F.when(seconds < 0, "N/A")
        .when(days > 0, F.format_string("%dd %dh %dm", days, hours, minutes))
        .when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .otherwise(F.format_string("%dm %ds", minutes, secs))
    )

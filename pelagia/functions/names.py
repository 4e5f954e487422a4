"""Text helpers: times in file names and read from pictures, identifiers, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(identifier: Column) -> Column:
    """Trimmed, with runs of white space as one space; empty becomes NULL."""
    text = F.trim(F.regexp_replace(identifier, r"\s+", " "))
    return F.when(text != "", text)


def filename_time(name: Column) -> Column:
    """The time in a file name (``yyyyMMdd-HHmmss`` or ``yyMMdd-HHmmss``, `-` or `_`), NULL outside 2000-2100."""
    long = F.regexp_extract(name, r"(?:^|\D)((?:19|20|21)\d{6})[-_](\d{6})(?:\D|$)", 1)
    clock = F.regexp_extract(name, r"(?:^|\D)((?:19|20|21)\d{6})[-_](\d{6})(?:\D|$)", 2)
    short = F.regexp_extract(name, r"(?:^|\D)(\d{6})[-_](\d{6})(?:\D|$)", 1)
    short_clock = F.regexp_extract(name, r"(?:^|\D)(\d{6})[-_](\d{6})(?:\D|$)", 2)
    at = F.coalesce(
        F.when(long != "", F.try_to_timestamp(F.concat(long, clock), F.lit("yyyyMMddHHmmss"))),
        F.when(short != "", F.try_to_timestamp(F.concat(F.lit("20"), short, short_clock), F.lit("yyyyMMddHHmmss"))),
    )
    return F.when((F.year(at) >= 2000) & (F.year(at) <= 2100), at)


# Characters that reading a picture confuses with digits.
CONFUSED = {"O": "0", "o": "0", "Q": "0", "D": "0", "I": "1", "l": "1", "i": "1", "|": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "G": "6"}
# Months as a camera writes them.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def digits(text: Column) -> Column:
    """Confusable characters as digits, all else but digits removed."""
    return F.regexp_replace(F.translate(text, "".join(CONFUSED), "".join(CONFUSED.values())), r"\D", "")


def picture_time(text: Column) -> Column:
    """A time read from a picture, ``dd MON yyyy hh:mm:ss``, with confused characters mended and hours over 23,
    minutes and seconds over 59 cut to the largest they can be; NULL if no date is found."""
    form = r"(?i)^\s*(\S{1,2})[\s/-]+(\S{3})[\s/-]+(\S{4})\s+(\S{1,2})[:;.](\S{1,2})[:;.](\S{1,2})\s*$"
    part = [F.regexp_extract(text, form, n) for n in range(1, 7)]
    word = F.upper(F.translate(part[1], "0158", "OISB"))
    agree = [sum(((F.substring(word, k + 1, 1) == name[k]).cast("int") for k in range(3)), F.lit(0)) for name in MONTHS]
    month = F.coalesce(*[F.when(a == least, n) for least in (3, 2) for n, a in enumerate(agree, 1)])
    number = [F.when(digits(p) != "", digits(p).try_cast("int")) for p in part]
    cut = [F.least(number[3], F.lit(23)), F.least(number[4], F.lit(59)), F.least(number[5], F.lit(59))]
    return F.try_make_timestamp(number[2], month, number[0], cut[0], cut[1], cut[2].cast("decimal(16,6)"), F.lit("UTC"))


def short_duration(seconds: Column) -> Column:
    """``2h 05m``, ``3m 07s`` or ``12s``; never a negative zero."""
    s = F.round(F.abs(seconds)).cast("bigint")
    text = F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
    return F.when((seconds < 0) & (s > 0), F.concat(F.lit("-"), text)).otherwise(text)

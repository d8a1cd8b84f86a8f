"""Small Column helpers that the text rules and the jobs share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a plain trim strips (fixed values).
BLANKS = " \t\n\r\0\x0b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, even where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(c: Column, chars: str = BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def fold(c: Column, ascii_only: bool = False) -> Column:
    """The match key of a title. ascii_only leaves accented capitals as they are."""
    if ascii_only:
        return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.lower(trim(c))


def natural_key(c: Column) -> Column:
    """Sorts numbers in a text by value: runs of digits are padded to twelve places. Case-insensitive."""
    padded = F.regexp_replace(F.lower(c), r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0+(\d{12})", "$1")


#: Compares without regard to case and accents.
COLLATION = "UNICODE_CI_AI"


def natural_order(c: Column) -> Column:
    """``natural_key`` to sort by: ``É`` stands with ``e``, whatever the case."""
    return F.collate(natural_key(c), COLLATION)


def alike(c: Column) -> Column:
    """A text to join or group by without regard to case, accents and blanks around it."""
    return F.collate(trim(c), COLLATION)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./]*)$", 1))


def stem(c: Column) -> Column:
    """A file name without its extension; a dot at the front starts no extension."""
    return F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def under(path: Column, root: Column) -> Column:
    """Whether a path lies at or below a root, segment by segment."""
    return F.concat(path, F.lit("/")).startswith(F.concat(root, F.lit("/")))


def plain_file_name(c: Column) -> Column:
    return ~c.rlike(r"[/\\\x00]") & ~c.isin("", ".", "..")

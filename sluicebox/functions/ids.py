"""Identifiers and instants as they stand in dirty feeds, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space around an id: blanks, tabs, line ends.
ID_SPACE = " \t\n\r"


def clean_id(c: Column) -> Column:
    """Lower case, without surrounding white space. Null stays null."""
    return F.lower(F.btrim(c, F.lit(ID_SPACE)))


def clean_name(c: Column) -> Column:
    """A cleaned id, with blank ones as null."""
    return F.nullif(clean_id(c), F.lit(""))


def pack_id(c: Column) -> Column:
    """A cleaned id as bytes, hexadecimal ones at half their length (random hex digits don't compress in a shuffle).

    One leading byte tells the forms apart, so equal bytes mean equal ids. Null stays null.
    """
    raw = F.unhex(c)
    even = F.length(c) % 2 == 0
    return F.when(raw.isNotNull() & even, F.concat(F.unhex(F.lit("01")), raw)).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def unpack_id(c: Column) -> Column:
    """The inverse of pack_id."""
    body = F.substring(c, 2, 2_147_483_647)
    return F.when(F.substring(c, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(body))).otherwise(F.decode(body, "UTF-8"))


#: An ISO 8601 instant: date, time, and a zone that must be there.
ISO_INSTANT = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|z|[+-]\d{2}(:?\d{2})?)\s*$"


def iso_instant(c: Column) -> Column:
    """The instant of an ISO 8601 string with a zone; null for zone-less, damaged or null ones.

    Spark alone would read a zone-less string in the session's zone, hence the pattern.
    """
    zoned = F.regexp_replace(F.upper(F.trim(c)), r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    zoned = F.regexp_replace(zoned, r"(:\d{2}\S*[+-]\d{2})$", "$1:00")
    return F.when(c.rlike(ISO_INSTANT), zoned.try_cast("timestamp"))

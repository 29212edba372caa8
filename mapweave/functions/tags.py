"""Reading numbers, flags and colours from free-form tag text.

All functions take string columns; a missing tag is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import lookup, record, rgba
from .fixed_values import NAMED_COLOURS

_INTEGER = r"^\s*([+-]?[0-9]+)"
_DECIMAL = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_HEX = r"^\s*([+-]?)0[xX]([0-9a-fA-F]+)"
_FLOAT_LIMIT = 3.4028234663852886e38


def tag(name: str) -> Column:
    return F.col("tags").getItem(name)


def leading_int(text: Column) -> Column:
    """Integer at the start of the text; NULL when there is none or it does not fit 32 bits."""
    return F.regexp_extract(text, _INTEGER, 1).try_cast("int")


def leading_float(text: Column) -> Column:
    """Decimal or whole hexadecimal number at the start of the text; NULL when there is none or it exceeds float32."""
    digits = F.conv(F.regexp_extract(text, _HEX, 2), 16, 10).try_cast("double")
    hexadecimal = F.when(F.regexp_extract(text, _HEX, 1) == "-", -digits).otherwise(digits)
    decimal = F.regexp_extract(text, _DECIMAL, 1).try_cast("double")
    value = F.when(text.rlike(_HEX), hexadecimal).otherwise(decimal)
    return F.when(F.abs(value) <= F.lit(_FLOAT_LIMIT), value)


def without_metre_sign(text: Column) -> Column:
    """The text without one closing m or M."""
    return F.regexp_replace(text, r"[mM]\z", "")


def height_text(text: Column) -> Column:
    """The part of a height that is read: closing m dropped, cut at the first blank."""
    return F.substring_index(without_metre_sign(text), " ", 1)


def speed_limit(maxspeed: Column) -> Column:
    """Leading number of the limit; units are not converted."""
    return leading_float(maxspeed)


def is_oneway(oneway: Column) -> Column:
    return F.coalesce(oneway.isin("yes", "1"), F.lit(False))


def is_marked(flag: Column) -> Column:
    """Present and not ``no``: the rule for bridges and tunnels."""
    return F.coalesce(flag != "no", F.lit(False))


def name_or_empty(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))


def hex_colour(text: Column) -> Column:
    """#RGB or #RRGGBB, the # optional; NULL for anything else."""
    digits = F.regexp_replace(text, "^#", "")
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    part = lambda at: F.conv(F.substring(full, at, 2), 16, 10).cast("double") / F.lit(255.0)
    return F.when(
        full.rlike("^[0-9A-Fa-f]{6}$"),
        record(r=part(1), g=part(3), b=part(5), a=F.lit(1.0)),
    )


def parse_colour(text: Column, fallback: Column) -> Column:
    """Named colour in any case, else hex colour, else the fallback."""
    named = lookup(F.lower(text), NAMED_COLOURS, F.lit(None), rgba)
    return F.coalesce(named, hex_colour(text), fallback)

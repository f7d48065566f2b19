"""Hex colours as column expressions (six upper-case digits, no #)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import CSS_COLOUR, HEX_COLOUR
from .columns import clamp, half_up

def strip_hex(value: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(value), "^#", ""))


def pick(*values: Column) -> Column:
    """First usable hex value."""
    return F.coalesce(*[F.when(F.trim(v).rlike(HEX_COLOUR), strip_hex(v)) for v in values])


def channels(hex_: Column) -> list[Column]:
    return [F.conv(F.substring(hex_, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]


def to_hex(parts: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.hex(clamp(half_up(p), 0, 255)), 2, "0") for p in parts])


def mix(a: Column, b: Column, t) -> Column:
    t = t if isinstance(t, Column) else F.lit(t)
    return to_hex([x + (y - x) * t for x, y in zip(channels(a), channels(b))])


def lighten(h: Column, t) -> Column:
    return mix(h, F.lit("FFFFFF"), t)


def darken(h: Column, t) -> Column:
    return mix(h, F.lit("000000"), t)


def solid_over(fill: Column, background: Column) -> Column:
    """A fill (hex or rgb/rgba) laid over a solid background; null if unreadable."""
    css = [F.regexp_extract(fill, CSS_COLOUR, i) for i in range(1, 5)]
    is_css = fill.rlike(CSS_COLOUR)
    base = F.when(is_css, to_hex([v.try_cast("double") for v in css[:3]])).otherwise(pick(fill))
    alpha = F.when(is_css & (css[3] != ""), css[3].try_cast("double")).otherwise(1.0)
    return F.when(alpha >= 0.999, base).otherwise(mix(background, base, alpha))



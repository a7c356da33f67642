"""Colours as numbers and hexadecimal text."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of parts 0..255, clipped."""
    def part(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(c).cast("int")))
    return F.format_string("#%02x%02x%02x", part(r), part(g), part(b))


def hex_part(color: Column, i: int) -> Column:
    """The i-th part (0 red, 1 green, 2 blue) as 0..255."""
    return F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("int")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """(h, s, v) of parts 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0.0))
    h = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    turned = h - F.floor(h)
    return F.struct(F.coalesce(turned, F.lit(0.0)).alias("h"), F.coalesce((top - low) / F.nullif(top, F.lit(0.0)), F.lit(0.0)).alias("s"), top.alias("v"))


def rgb(h: Column, s: Column, v: Column) -> Column:
    """(r, g, b) of hue, saturation and value 0..1."""
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    cases = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))
    def channel(c: int) -> Column:
        out = F.when(i % 6 == 0, cases[0][c])
        for k in range(1, 6):
            out = out.when(i % 6 == k, cases[k][c])
        return out
    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def saturated(color: Column, factor: float = 1.7) -> Column:
    """The colour with its saturation multiplied, at most 1."""
    parts = [hex_part(color, i) / 255.0 for i in range(3)]
    c = hsv(*parts)
    out = rgb(c.h, F.least(F.lit(1.0), c.s * factor), c.v)
    return rgb_to_hex(out.r * 255, out.g * 255, out.b * 255)


def between(a: Column, b: Column, share: Column) -> Column:
    """The colour at `share` of the way from a to b."""
    return rgb_to_hex(*(hex_part(a, i) * (1 - share) + hex_part(b, i) * share for i in range(3)))


def distinct_colors(n: int) -> list[str]:
    """n colours with hues spread evenly."""
    return ["#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hsv_to_rgb(i / n, 0.75, 0.9)) for i in range(n)]

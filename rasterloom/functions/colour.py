"""Colour mathematics as Column expressions: all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the published OKLab matrices (linear sRGB to cone response, cone response to OKLab, and their inverses)
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def _product(matrix, x: Column, y: Column, z: Column) -> list[Column]:
    return [F.lit(a) * x + F.lit(b) * y + F.lit(c) * z for a, b, c in matrix]


def linear(channel: Column) -> Column:
    """sRGB 0..255 to linear 0..1."""
    c = channel / F.lit(255.0)
    return F.when(c >= 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def channel(c: Column) -> Column:
    """Linear light to sRGB 0..255, clamped and rounded half away from zero."""
    inner = F.when(c >= 0.0031308, F.lit(1.055) * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(c * 12.92)
    return F.when(c <= 0, 0).when(c >= 1, 255).otherwise(F.round(inner * 255)).cast("int")


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lms = [F.cbrt(x) for x in _product(TO_LMS, linear(r), linear(g), linear(b))]
    return tuple(_product(TO_LAB, *lms))


def linear_rgb(light: Column, a: Column, b: Column) -> list[Column]:
    return _product(FROM_LMS, *[F.pow(x, F.lit(3)) for x in _product(FROM_LAB, light, a, b)])


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """Degrees from 0; compare hues by circular_distance only."""
    h = F.degrees(F.atan2(b, a))
    return F.when(h < 0, h + 360).otherwise(h)


def in_gamut(light: Column, a: Column, b: Column) -> Column:
    out = F.lit(True)
    for x in linear_rgb(light, a, b):
        out = out & x.between(-1e-4, 1.0001)
    return out


def distance2(p: tuple, q: tuple) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(p[1:], q[1:])), (p[0] - q[0]) * (p[0] - q[0]))


def circular_distance(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def lerp_hue(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc."""
    return F.pmod(a + (F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0) * t, F.lit(360.0))


def smoothstep(t: Column) -> Column:
    return t * t * (3 - 2 * t)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clamp_channel(x: Column) -> Column:
    return F.round(clamp(x, 0, 255)).cast("int")


def gamut_chroma(light: Column, c: Column, h: Column, steps: int = 24) -> Column:
    """The greatest chroma up to c inside sRGB at this lightness and hue, by bisection."""
    cos, sin = F.cos(F.radians(h)), F.sin(F.radians(h))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) * 0.5
        inside = in_gamut(light, middle * cos, middle * sin)
        return F.struct(F.when(inside, middle).otherwise(state["lo"]).alias("lo"), F.when(inside, state["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), c.cast("double").alias("hi")), halve, lambda s: s["lo"])
    return F.when(c <= 0, 0.0).when(in_gamut(light, c * cos, c * sin), c).otherwise(found)


#: OKLab of columns r, g, b in DuckDB's SQL, for {p} before the column names.
OKLAB_SQL = """(
  select {cols}, 0.2104542553 * lp + 0.7936177850 * mp - 0.0040720468 * sp as lab_l,
         1.9779984951 * lp - 2.4285922050 * mp + 0.4505937099 * sp as lab_a, 0.0259040371 * lp + 0.7827717662 * mp - 0.8086757660 * sp as lab_b
  from (select *, cbrt(0.4122214708 * rl + 0.5363325363 * gl + 0.0514459929 * bl) as lp, cbrt(0.2119034982 * rl + 0.6806995451 * gl + 0.1073969566 * bl) as mp,
               cbrt(0.0883024619 * rl + 0.2817188376 * gl + 0.6299787005 * bl) as sp
        from (select *, case when r / 255.0 >= 0.04045 then pow((r / 255.0 + 0.055) / 1.055, 2.4) else r / 255.0 / 12.92 end as rl,
                     case when g / 255.0 >= 0.04045 then pow((g / 255.0 + 0.055) / 1.055, 2.4) else g / 255.0 / 12.92 end as gl,
                     case when b / 255.0 >= 0.04045 then pow((b / 255.0 + 0.055) / 1.055, 2.4) else b / 255.0 / 12.92 end as bl from {source})))"""

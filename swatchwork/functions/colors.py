"""Colour functions as column expressions: text to channels, colour spaces, distances and contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swatchwork.functions.csstext import bound

#: Named colours.
NAMED = {"black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "gray": "#808080", "grey": "#808080", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080"}
_RGB = r"^rgba?\(\s*(\d+)[\s,]+(\d+)[\s,]+(\d+)(?:\s*[,/]\s*([\d.]+))?\s*\)$"
_HEX6 = r"^#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})?$"
_HEX3 = r"^#([0-9a-f])([0-9a-f])([0-9a-f])([0-9a-f])?$"


def parse_color(text: Column) -> Column:
    """A struct of r, g, b (int) and a (double) from rgb(), rgba(), hex and some names; null for anything else."""
    named = F.create_map(*(F.lit(x) for pair in {**NAMED, "transparent": "rgba(0, 0, 0, 0)"}.items() for x in pair))

    def read(t: Column) -> Column:
        number = lambda s: F.conv(s, 16, 10).cast("int")
        part = lambda pattern, k: F.regexp_extract(t, pattern, k)
        alpha = F.when(part(_RGB, 4) == "", 1.0).otherwise(part(_RGB, 4).try_cast("double"))
        rgb = F.struct(*(part(_RGB, k).try_cast("int").alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))), alpha.alias("a"))
        six = F.struct(*(number(part(_HEX6, k)).alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))), F.when(part(_HEX6, 4) == "", 1.0).otherwise(number(part(_HEX6, 4)) / 255.0).alias("a"))
        twice = lambda k: F.concat(part(_HEX3, k), part(_HEX3, k))
        three = F.struct(*(number(twice(k)).alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))), F.when(part(_HEX3, 4) == "", 1.0).otherwise(number(twice(4)) / 255.0).alias("a"))
        return F.when(t.rlike(_RGB), rgb).when(t.rlike(_HEX6), six).when(t.rlike(_HEX3), three)

    plain = lambda t: F.coalesce(F.try_element_at(named, t), t)
    return bound(bound(F.lower(F.trim(text)), plain), read)


def to_hex(c: Column) -> Column:
    byte = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    return F.concat(F.lit("#"), byte(c["r"]), byte(c["g"]), byte(c["b"]))


def _linear(x: Column, knee: float) -> Column:
    v = x / 255.0
    return F.when(v <= knee, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(c: Column) -> Column:
    """Relative luminance, with the threshold 0.03928."""
    return 0.2126 * _linear(c["r"], 0.03928) + 0.7152 * _linear(c["g"], 0.03928) + 0.0722 * _linear(c["b"], 0.03928)


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def contrast_level(ratio: Column, large: Column) -> Column:
    """AAA, AA or FAIL; large text needs 4.5 and 3, other text 7 and 4.5."""
    return F.when(ratio >= F.when(large, 4.5).otherwise(7.0), "AAA").when(ratio >= F.when(large, 3.0).otherwise(4.5), "AA").otherwise("FAIL")


def rgb_distance(a: Column, b: Column) -> Column:
    square = lambda k: (a[k] - b[k]) * (a[k] - b[k])
    return F.sqrt((square("r") + square("g") + square("b")).cast("double"))


def to_hsl(c: Column) -> Column:
    """A struct of h (0-359), s and l (0-100), rounded half up."""
    r, g, b = (c[k] / 255.0 for k in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    sat = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - top - low)).otherwise(d / (top + low))
    hue = F.when(d == 0, 0.0).when(top == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    whole = lambda x: F.floor(x + 0.5).cast("int")
    return F.struct(whole(hue * 60).alias("h"), whole(sat * 100).alias("s"), whole(light * 100).alias("l"))


def to_oklab(c: Column) -> Column:
    """The published matrices of OKLab."""
    r, g, b = (_linear(c[k], 0.04045) for k in "rgb")
    l_ = F.cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b)
    m_ = F.cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b)
    s_ = F.cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b)
    return F.struct(
        (0.2104542553 * l_ + 0.7936177850 * m_ - 0.0040720468 * s_).alias("l"),
        (1.9779984951 * l_ - 2.4285922050 * m_ + 0.4505937099 * s_).alias("a"),
        (0.0259040371 * l_ + 0.7827717662 * m_ - 0.8086757660 * s_).alias("b"),
    )


#: sRGB to XYZ with four decimals, and with seven.
XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
FINE_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def to_lab(c: Column, matrix: tuple = XYZ) -> Column:
    r, g, b = (_linear(c[k], 0.04045) for k in "rgb")
    x, y, z = (p * r + q * g + s * b for p, q, s in matrix)
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    fx, fy, fz = f(x / 0.95047), f(y), f(z / 1.08883)
    return F.struct((116 * fy - 16).alias("l"), (500 * (fx - fy)).alias("a"), (200 * (fy - fz)).alias("b"))


def to_fine_lab(c: Column) -> Column:
    """CIELAB with the finer matrix; null for a null colour."""
    return F.when(c.isNotNull(), to_lab(c, FINE_XYZ))


def to_oklch(c: Column) -> Column:
    """A struct of lightness l, chroma c and hue h in degrees from 0."""

    def turned(x: Column) -> Column:
        h = F.degrees(F.atan2(x["b"], x["a"]))
        return F.struct(x["l"].alias("l"), F.sqrt(x["a"] * x["a"] + x["b"] * x["b"]).alias("c"), F.when(h < 0, h + 360).otherwise(h).alias("h"))

    return bound(to_oklab(c), turned)


def from_oklch(c: Column) -> Column:
    """A struct of r, g, b of a struct of l, c, h; channels outside sRGB are cut to it, halves round up."""

    def encoded(x: Column) -> Column:
        x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        v = F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)
        return F.floor(v * 255 + 0.5).cast("int")

    def rgb(x: Column) -> Column:
        l_, m_, s_ = (F.pow(x[k], F.lit(3.0)) for k in "lms")
        return F.struct(
            encoded(4.0767416621 * l_ - 3.3077115913 * m_ + 0.2309699292 * s_).alias("r"),
            encoded(-1.2684380046 * l_ + 2.6097574011 * m_ - 0.3413193965 * s_).alias("g"),
            encoded(-0.0041960863 * l_ - 0.7034186147 * m_ + 1.7076147010 * s_).alias("b"),
        )

    light, a, b = c["l"], c["c"] * F.cos(F.radians(c["h"])), c["c"] * F.sin(F.radians(c["h"]))
    cones = F.struct(
        (light + 0.3963377774 * a + 0.2158037573 * b).alias("l"),
        (light - 0.1055613458 * a - 0.0638541728 * b).alias("m"),
        (light - 0.0894841775 * a - 1.2914855480 * b).alias("s"),
    )
    return bound(cones, rgb)


def space_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two structs of l, a, b: the OKLab distance, or delta E (CIE76)."""
    square = lambda k: (a[k] - b[k]) * (a[k] - b[k])
    return F.sqrt(square("l") + square("a") + square("b"))

"""CSS text as column expressions: lengths, times, easings, layers, names and URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """The numeric prefix of a text such as 16px; null without one."""
    return F.regexp_extract(F.trim(text), r"^[-+]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")


def milliseconds(text: Column) -> Column:
    """A CSS time in milliseconds; null for anything else."""
    t = F.lower(F.trim(text))
    value = F.regexp_extract(t, r"^([-+]?[\d.]+)(ms|s)$", 1).try_cast("double")
    return value * F.when(F.regexp_extract(t, r"^([-+]?[\d.]+)(ms|s)$", 2) == "s", 1000.0).otherwise(1.0)


def layers(text: Column) -> Column:
    """The parts of a comma-separated list; commas inside brackets do not part."""
    return F.transform(F.split(text, r",(?![^(]*\))"), lambda x: F.trim(x))


def duration_band(ms: Column) -> Column:
    """Names of durations up to 80, 150, 250, 400, 700 and 1200 ms, and above."""
    out = F.when(ms <= 80, "instant")
    for most, name in ((150, "xs"), (250, "sm"), (400, "md"), (700, "lg"), (1200, "xl")):
        out = out.when(ms <= most, name)
    return F.when(ms.isNotNull(), out.otherwise("xxl"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def arguments(text: Column, function: str) -> Column:
    """The numbers between the brackets of a CSS function; null where there is none or one is no number."""
    found = F.transform(F.split(F.nullif(F.regexp_extract(text, rf"{function}\(([^()]*)\)", 1), F.lit("")), ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(~F.exists(found, lambda x: x.isNull()), found)


#: Families of easing words.
EASING_WORDS = {"": "linear", "linear": "linear", "ease": "ease-in-out", "ease-in-out": "ease-in-out", "ease-in": "ease-in", "ease-out": "ease-out"}


def easing_family(text: Column) -> Column:
    """linear, ease-in, ease-out, ease-in-out, spring, steps or custom; no text is linear.

    A curve with a control point above 1 or below 0 is a spring. One that starts within a fifth and ends within a fifth of
    the line's ends is ease-in-out; otherwise a flat start is ease-out, a steep end ease-in, and what is left goes by the
    side of the diagonal on which both control points lie.
    """
    word = F.create_map(*(F.lit(x) for pair in EASING_WORDS.items() for x in pair))

    def curve(p: Column) -> Column:
        x1, y1, x2, y2 = (F.get(p, F.lit(k)) for k in range(4))
        return (
            F.when(F.coalesce(F.size(p), F.lit(0)) != 4, None)
            .when(~(y1.between(0, 1) & y2.between(0, 1)), "spring")
            .when((x1 < 0.2) & (x2 > 0.8), "ease-in-out")
            .when(((x1 < 0.2) & (y1 < 0.2)), "ease-out")
            .when(((x2 > 0.8) & (y2 > 0.8)) | ((y1 < x1) & (y2 < x2)), "ease-in")
            .when((y1 > x1) & (y2 > x2), "ease-out")
        )

    def family(t: Column) -> Column:
        steps = F.when(t.contains("steps") & ~t.contains("cubic-bezier"), "steps")
        return F.coalesce(F.try_element_at(word, t), bound(arguments(t, "cubic-bezier"), curve), steps, F.lit("custom"))

    return bound(F.coalesce(F.lower(F.trim(text)), F.lit("")), family)


def class_tokens(text: Column) -> Column:
    """Lower-case words of class names, cut at capitals and at what is not a letter or digit."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+"), "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path of a URL, / if it has none."""
    p = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def normalized_url(url: Column) -> Column:
    """Scheme, host, path without a last slash, and query, in lower case; the fragment goes."""
    bare = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "/+$", "")
    return F.lower(F.concat(bare, F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def half_up(x: Column) -> Column:
    """Rounded with halves up, also below zero."""
    return F.floor(x + 0.5)

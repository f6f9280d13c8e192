"""Identifiers, dates, costs and scores as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.patterns import DISPLAY_POINTS, METHOD_POINTS, TIERS
from folioscope.functions.text import let


def document_id(content: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHmmSS, or a start of it, as an ISO date; empty where the year is missing or no number."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), "^D:", "")
    part = lambda at, default: F.when(F.length(text) >= at + 1, F.substring(text, at, 2)).otherwise(default)
    year = F.substring(text, 1, 4)
    iso = F.concat(year, F.lit("-"), part(5, "01"), F.lit("-"), part(7, "01"), F.lit("T"), part(9, "00"), F.lit(":"), part(11, "00"), F.lit(":"), part(13, "00"))
    return F.when((F.length(text) >= 4) & year.rlike(r"^\d{4}$"), iso).otherwise("")


def tier_of(label: Column) -> Column:
    """The model tier of a label; free for any other."""
    out = F.lit("free")
    for tier, name, _, _ in TIERS[1:]:
        out = F.when(label == name, tier).otherwise(out)
    return out


def _rate(label: Column, column: int) -> Column:
    out = F.lit(0.0)
    for row in TIERS:
        out = F.when(label == row[1], row[column]).otherwise(out)
    return out


def fixed(value: Column, places: int) -> Column:
    """A double with at most 4 places as printf writes it: its exact binary value rounded, halves to the even digit.

    format_string rounds the shortest decimal form half up instead, and writes 0.015, whose exact value is less, as 0.02.
    """
    scale = 10**places

    def digits(x: Column) -> Column:
        # Exactly, x * scale is product + rest: each half of x has bits enough to spare for the scale.
        far = x * 134217729.0
        high = far - (far - x)
        product = x * float(scale)
        rest = (high * float(scale) - product) + (x - high) * float(scale)
        below = F.floor(product)
        # A product off the middle lies on the same side of it as the exact value.
        n = F.when(product - below != 0.5, F.rint(product)).when(rest > 0, below + 1).when(rest < 0, below).otherwise(F.rint(product)).cast("long")
        return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))

    # Of larger numbers the product has few or no bits after the point.
    near = F.abs(value) < 1e11
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(near, F.concat(sign, let(F.abs(value), digits))).otherwise(F.format_string(f"%.{places}f", value))


def cost_by_pages(label: Column, pages: Column) -> Column:
    """The estimate shown for a number of pages, by the rate per 1000 pages."""
    cost = pages / 1000 * _rate(label, 2)
    return F.concat(F.lit("**Estimated Cost:** "), F.when(cost == 0, "FREE").when(cost < 0.01, "< $0.01").otherwise(F.concat(F.lit("$"), fixed(cost, 2))))


def cost_by_tokens(label: Column, pages: Column) -> Column:
    """The estimate shown for a number of pages, by 1000 tokens a page and the rate per million."""
    cost = pages * 1000 / 1000000 * _rate(label, 3)
    few = fixed(cost, 4)
    many = fixed(cost, 2)
    unit = F.when(pages > 1, " pages)").otherwise(" page)")
    return F.when(cost == 0, "**Estimated Cost:** FREE").otherwise(F.concat(F.lit("**Estimated Cost:** ~$"), F.when(cost < 0.01, few).otherwise(many), F.lit(" ("), pages.cast("string"), unit))


def method_points(method: Column) -> Column:
    out = F.lit(10)
    for name, points in reversed(METHOD_POINTS):
        out = F.when(F.contains(method, F.lit(name)), points).otherwise(out)
    return out


def display_score(md: Column, method: Column) -> Column:
    """The 0 to 100 score that is shown beside a result."""
    bonus = F.lit(0)
    for name, points in reversed(DISPLAY_POINTS):
        bonus = F.when(F.contains(method, F.lit(name)), points).otherwise(bonus)
    has = lambda x: F.when(F.contains(md, F.lit(x)), 10).otherwise(0)
    return F.least(F.lit(100), F.lit(50) + bonus + has("##") + has("|") + F.when(F.length(md) > 1000, 10).otherwise(0))


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.6, "acceptable").when(score >= 0.4, "poor").otherwise("unacceptable")


def page_quality(average: Column) -> Column:
    return F.when(average >= 0.9, "excellent").when(average >= 0.8, "good").when(average >= 0.7, "acceptable").when(average >= 0.5, "poor").otherwise("very_poor")

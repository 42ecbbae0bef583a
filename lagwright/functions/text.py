"""Texts about alignments: clocks, amounts, summaries, and what is read back from notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def product_error(a: Column, b: Column) -> Column:
    """What the product of two doubles loses by rounding, exactly (Dekker); of sizes below 1e290."""

    def halves(x: Column) -> tuple[Column, Column]:
        c = x * 134217729.0
        high = c - (c - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    return al * bl - (((a * b - ah * bh) - al * bh) - ah * bl)


def decimals(x: Column, digits: int, sign: str = "") -> Column:
    """x with ``digits`` decimals, rounded by its binary value, half to even, as printf() does; null for null. Spark's
    format_string() rounds the shortest decimal text of x instead, half up, and writes null as a word."""
    scale = F.lit(10.0**digits)
    p, lost = x * scale, product_error(x, scale)
    half = p - F.floor(p) == 0.5
    n = F.when(half & (lost > 0), F.ceil(p).cast("double")).when(half & (lost < 0), F.floor(p).cast("double")).otherwise(F.rint(p))
    return F.when(x.isNotNull(), F.format_string(f"%{sign}.{digits}f", F.when(F.abs(p) < 2.0**52, n / scale).otherwise(x)))


def whole(seconds: Column) -> Column:
    return F.bround(F.greatest(seconds, F.lit(0.0))).cast("bigint")


def long_clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on, rounded half to even."""
    s = whole(seconds)
    hours = F.floor(s / 3600)
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def cut_clock(seconds: Column) -> Column:
    """m:ss, cut to whole seconds."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)))
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def ms_clock(seconds: Column) -> Column:
    """m:ss.mmm, or h:mm:ss.mmm from an hour on."""
    ms = whole(seconds * 1000)
    s = F.floor(ms / 1000)
    hours = F.floor(s / 3600)
    tail = F.format_string("%02d.%03d", s % 60, ms % 1000)
    return F.when(hours > 0, F.concat(F.format_string("%d:%02d:", hours, F.floor(s / 60) % 60), tail)).otherwise(F.concat(F.format_string("%d:", F.floor(s / 60)), tail))


def eta(seconds: Column) -> Column:
    """Time left: seconds, minutes and seconds, or hours and minutes; a dash where it is not known."""
    s = whole(seconds)
    text = F.when(s < 60, F.format_string("ETA %ds", s)).when(s < 3600, F.format_string("ETA %dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("ETA %dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "ETA —").otherwise(text)


def signed_ms(ms: Column, railed: Column) -> Column:
    """+12ms; past the search's edge by sign only."""
    return F.when(railed, F.concat(F.lit("past "), F.when(ms >= 0, "+").otherwise("-"), F.lit("40ms"))).otherwise(F.format_string("%+dms", F.bround(ms).cast("bigint")))


def pad_text(seconds: Column) -> Column:
    """+0.125, or n/a where none was measured."""
    return F.when(seconds.isNull(), "n/a").otherwise(decimals(seconds, 3, "+"))


def tagged(bare: Column, verdict: Column) -> Column:
    """The folder's name with its verdict, null where that is neither pass nor fail."""
    return F.when(verdict.isin("pass", "fail"), F.concat(bare, F.lit("_["), verdict, F.lit("]")))


def block(notes: Column, key: str) -> Column:
    """What stands behind ``key=`` up to the next semicolon, null without it."""
    found = F.regexp_extract(notes, rf"(?:^|;\s*){key}=([^;]*)", 1)
    return F.when(found != "", F.trim(found))


def checkpoints(notes: Column) -> Column:
    """The points ``seconds:+lag`` of the note ``points=`` as an array of strings."""
    return F.regexp_extract_all(F.coalesce(block(notes, "points"), F.lit("")), F.lit(r"(\d+:[+-]\d+)"), F.lit(1))


def summary(profile: Column, offset: Column, drift: Column, p95: Column, jumps: Column, confidence: Column, codes: Column) -> Column:
    """One line about a report; offsets in seconds, drift in ms a minute, p95 in ms. Null if any of them is."""
    return F.concat(F.lit("profile="), profile, F.lit("; offset="), decimals(offset, 3, "+"), F.lit("s; drift="), decimals(drift, 1, "+"), F.lit("ms/min; p95="), F.bround(p95).cast("bigint"), F.lit("ms; jumps="), jumps, F.lit("; conf="), decimals(confidence, 2), F.lit("; codes="), F.when(codes == "", "none").otherwise(codes))

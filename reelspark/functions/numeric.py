"""Numeric and time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def scaled(c: Column, low: Column, high: Column) -> Column:
    """c between low and high as 0 to 1; 1 where they meet."""
    return F.when(high <= low, F.lit(1.0)).otherwise(clamp((c - low) / (high - low)))


def clipped_power(c: Column, p: float) -> Column:
    return F.pow(F.greatest(c, F.lit(0.0)), F.lit(p))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The shared length over the shorter one's; 0 where either is empty."""
    shared, short = F.least(a1, b1) - F.greatest(a0, b0), F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, F.greatest(shared, F.lit(0)) / short).otherwise(0.0)


def confidence(c: Column) -> Column:
    """low, medium, high or a number as 0 to 1; anything else 0.5."""
    word = F.lower(F.trim(c))
    number = c.try_cast("double")
    return F.when(word == "low", 0.25).when(word == "medium", 0.6).when(word == "high", 0.9).when(number.isNotNull(), clamp(number)).otherwise(0.5)


def pts_to_ms(pts: Column, base_num: int, base_den: int) -> Column:
    """A presentation time in rational seconds as milliseconds, halves to even."""
    return F.bround(pts * F.lit(base_num) * 1000 / F.lit(base_den)).cast("long")


def ms_to_frame(ms: Column, fps: Column) -> Column:
    """The frame at a time; 25 frames a second where the rate is unknown or not positive."""
    rate = F.when(fps > 0, fps).otherwise(25.0)
    return F.bround(ms * rate / 1000.0).cast("long")


def relevance(no: Column, yes: Column) -> Column:
    """The second class's share of a softmax over two logits."""
    return 1.0 / (1.0 + F.exp(no - yes))

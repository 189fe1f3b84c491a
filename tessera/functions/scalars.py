"""Scalar expressions: text edits, numbers in text, paths, and the arithmetic of a paced loop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in nanoseconds: the shortest and longest step, and the most steps in one go.
MIN_STEP, MAX_STEP, MAX_STEPS = 2_000_000, 10_000_000, 10


def leading_int(text: Column) -> Column:
    """The decimal number that a text starts with, after white space; 0 if there is none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def path_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def edited(text: Column, key: Column) -> Column:
    """Text after a key: '\\b' removes the last character, any other key is appended."""
    shorter = F.substring(text, F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(0)))
    return F.when(key == "\b", shorter).otherwise(F.concat(text, key))


def _div(a: Column, b: Column) -> Column:
    """Quotient of longs that are not negative."""
    return ((a - a % b) / b).cast("long")


def step(prediction: Column, delta: Column, longest: int = MAX_STEP, shortest: int = MIN_STEP, most: int = MAX_STEPS) -> Column:
    """The next step in nanoseconds: as short as lets the loop catch up with `delta` while each step costs `prediction`.

    Where a step of the longest kind is needed, or more than `most` steps, it is the longest.
    """
    top = F.lit(longest).cast("long")
    n = _div(delta, F.greatest(top - prediction, F.lit(1).cast("long"))) + 1
    ideal = F.when(prediction >= top, top).when(n > most, top).otherwise(_div(delta + prediction * n, n))
    return F.greatest(F.lit(shortest).cast("long"), F.least(top, ideal))


def bounded_lag(game_time: Column, now: Column, longest: int = MAX_STEP) -> Column:
    """Lag beyond the longest step is dropped."""
    return F.greatest(game_time, now - longest)


def half_excess(prediction: Column, actual: Column) -> Column:
    """Half of what a prediction exceeds the actual duration by, in whole units; 0 if it does not."""
    return F.greatest(_div(F.abs(prediction - actual), F.lit(2).cast("long")), F.lit(0).cast("long")) * (prediction > actual).cast("long")


def seconds(nanoseconds: Column) -> Column:
    """Whole nanoseconds as seconds."""
    return nanoseconds.cast("double") / F.lit(1e9)


def nanoseconds(seconds_: Column) -> Column:
    """Seconds as whole nanoseconds, halves away from zero."""
    scaled = seconds_.cast("double") * F.lit(1e9)
    return (F.signum(scaled) * F.floor(F.abs(scaled) + F.lit(0.5))).cast("long")

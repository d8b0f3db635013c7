"""Rates, intervals, agreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: normal quantile of the intervals.
Z = 1.96


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def wilson_bound(k: Column, n: Column, sign: int, z: float = Z) -> Column:
    """A bound of Wilson's interval for k of n, in [0, 1]; 0 for n = 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = (middle + sign * half) / (1 + z * z / n)
    return F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)))


def rate_columns(k: Column, n: Column, places: int = 5) -> list[Column]:
    """n, a, rate, lo, hi of a rate series."""
    rounded = lambda c: F.round(c, places)
    return [
        n.cast("long").alias("n"),
        k.cast("long").alias("a"),
        rounded(F.coalesce(ratio(k, n), F.lit(0.0))).alias("rate"),
        rounded(wilson_bound(k, n, -1)).alias("lo"),
        rounded(wilson_bound(k, n, 1)).alias("hi"),
    ]


def kappa(agree: Column, expected: Column) -> Column:
    """Cohen's kappa from observed and expected agreement; NaN if nothing was rated or chance agrees fully."""
    return F.when(agree.isNull() | (expected >= 1), F.lit(float("nan"))).otherwise((agree - expected) / (1 - expected))


def worst_rate(rates: Column) -> Column:
    """The highest rate per million of any class of input tokens; null without any."""
    return F.array_max(F.map_values(F.map_filter(rates, lambda k, _: k != "output")))


def reservation(prompt: Column, rates: Column, overhead: int, most_output: int) -> Column:
    """What one request may cost at most: no token has less than a byte, input counts at its worst rate, output in full."""
    given = F.octet_length(prompt) + F.lit(overhead)
    return (given * worst_rate(rates) + most_output * F.element_at(rates, F.lit("output"))) / 1e6


def settlement(status: Column, reserved: Column, actual: Column) -> Column:
    """What a request counts for in the end: nothing if it was refused unprocessed (429), its price if that is known, else all that was reserved."""
    return F.when(status == 429, F.lit(0.0)).otherwise(F.coalesce(actual, reserved))


def cost(tokens: Column, rates: Column) -> Column:
    """Sum over token classes of tokens x rate per million, from two maps; a class without a rate is an error."""
    classes = F.map_keys(tokens)
    missing = F.raise_error(F.lit("a token class has no rate")).cast("double")
    each = F.transform(classes, lambda k: F.element_at(tokens, k).cast("double") * F.coalesce(F.try_element_at(rates, k).cast("double"), missing))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 1e6

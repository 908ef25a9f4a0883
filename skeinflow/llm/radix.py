"""Percentiles of very large numeric columns by radix selection.

A double becomes the 64-bit integer of its sign, exponent and mantissa, which keeps
its order. The integer is read in digits from the top; the first digit takes the
exponent and ``MANTISSA_BITS`` bits of mantissa. The histogram of first digits is
the *state*: states add up, so days and partitions combine by summing counts, and a
percentile read from a state is off by at most 2^-(MANTISSA_BITS + 1) of its value.
Where the exact value is wanted, further passes follow only the digit that holds
each target rank.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANTISSA_BITS = 9
#: Low bits not yet looked at after each digit: the first digit, two more, none left.
SHIFTS = (52 - MANTISSA_BITS, 21, 0)
RELATIVE_ERROR = 2.0 ** -(MANTISSA_BITS + 1)


def ordered_bits(x: Column) -> Column:
    """The order-preserving integer of a finite double (both zeros give 0), by exact arithmetic in the JVM."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    scale = F.pow(F.lit(2.0), guess)
    exponent = F.when(a / scale >= 2.0, guess + 1).when(a / scale < 1.0, guess - 1).otherwise(guess)
    mantissa = a / F.pow(F.lit(2.0), exponent)
    normal = (exponent + 1023) * F.lit(1 << 52) + ((mantissa - 1.0) * F.lit(float(1 << 52))).cast("long")
    tiny = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def from_bits(k: Column) -> Column:
    """The double of an order-preserving integer."""
    a = F.abs(k)
    exponent = F.shiftright(a, 52)
    fraction = a.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))
    value = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).otherwise((1.0 + fraction) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(k < 0, -value).otherwise(value)


def state(values: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """The mergeable state: groups, digit, n. Null values are left out; NaN and infinities must be null already.

    Counts are combined map-side, so a group holding a third of all rows sends at
    most one row per digit and map task.
    """
    digit = F.shiftright(ordered_bits(F.col(value)), SHIFTS[0]).alias("digit")
    return values.where(F.col(value).isNotNull()).groupBy(*groups, digit).agg(F.count(F.lit(1)).alias("n"))


def merge(states: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Combine states over whatever is not among ``groups`` (days, partitions, earlier runs)."""
    return states.groupBy(*groups, "digit").agg(F.sum("n").alias("n"))


def locate(histogram: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """For each group and probability the digit that holds the nearest rank ceil(p * n), and the rank within it."""
    order = W.partitionBy(*groups).orderBy("digit")
    total = F.sum("n").over(W.partitionBy(*groups))
    h = histogram.withColumn("__upto", F.sum("n").over(order)).withColumn("n_values", total)
    targets = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n_values"))).cast("long").alias("rank")) for p in probs])
    inside = F.filter(targets, lambda t: (t["rank"] <= F.col("__upto")) & (t["rank"] > F.col("__upto") - F.col("n")))
    hit = h.withColumn("__t", F.explode(inside))
    return hit.select(*groups, "n_values", F.col("__t.prob").alias("prob"), "digit", (F.col("__t.rank") - F.col("__upto") + F.col("n")).alias("rank"))


def read(states: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles of merged states: groups, n_values, prob, value, max_relative_error. The value is the middle of the digit's range."""
    middle = from_bits(F.col("digit") * F.lit(1 << SHIFTS[0]) + F.lit(1 << (SHIFTS[0] - 1)))
    zero = F.col("digit").isin(0, -1)
    at = locate(states, groups, probs)
    return at.select(*groups, "n_values", "prob", F.when(zero, F.lit(0.0)).otherwise(middle).alias("value"), F.lit(RELATIVE_ERROR).alias("max_relative_error"))


def select(
    values: DataFrame, groups: Sequence[str], probs: Sequence[float], value: str = "value", first: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d
) -> DataFrame:
    """Exact percentiles (nearest rank): groups, n_values, prob, value, max_relative_error = 0.

    ``first`` is the merged state of the same values, if there is one; it saves the first pass.
    Every further pass reads the values again and counts only those under a digit
    that holds a target rank; ``keep`` may write the few targets down between
    passes. Null groups are groups; empty input gives no rows.
    """
    group = F.xxhash64(*groups)
    known = values.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("__v"), group.alias("__g"))
    targets = keep(locate(first if first is not None else state(values, groups, value), groups, probs))
    for before, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        low = F.col("digit") * F.lit(1 << before)
        ends = [from_bits(low).alias("__lo"), from_bits(low + F.lit((1 << before) - 1)).alias("__hi")]
        follow = targets.select(*[F.col(g).alias(f"__grp_{g}") for g in groups], group.alias("__h"), F.col("digit").alias("__path"), *ends).distinct()
        same = [F.col(g).eqNullSafe(F.col(f"__grp_{g}")) for g in groups]
        # The digit's range is compared as doubles, so only the few values inside are taken apart into bits.
        met = known.join(follow, [F.col("__g") == F.col("__h"), F.col("__v") >= F.col("__lo"), F.col("__v") <= F.col("__hi"), *same])
        counted = met.groupBy(*groups, "__path", F.shiftright(ordered_bits(F.col("__v")), shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        order = W.partitionBy(*groups, "__path").orderBy("digit")
        counted = counted.withColumn("__upto", F.sum("n").over(order))
        t = targets.select(*[F.col(g).alias(f"__grp_{g}") for g in groups], F.col("digit").alias("__at"), "n_values", "prob", "rank")
        pair = counted.join(t, [F.col("__path") == F.col("__at"), *same])
        pair = pair.where((F.col("rank") <= F.col("__upto")) & (F.col("rank") > F.col("__upto") - F.col("n")))
        targets = keep(pair.select(*groups, "n_values", "prob", "digit", (F.col("rank") - F.col("__upto") + F.col("n")).alias("rank")))
    return targets.select(*groups, "n_values", "prob", from_bits(F.col("digit")).alias("value"), F.lit(0.0).alias("max_relative_error"))

"""Exact quantiles of groups of any size, by distributed selection.

Values are counted first. A group of up to 65,536 different values is summed up
in order; the values of a larger one never come together in one task: four
histograms, each over 16 bits of the order-preserving 64-bit form of a double,
narrow every wanted rank down to its value. A histogram has at most 65,536 rows
a group and rank, and only values that share the bits found so far are counted
again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.plans.scratch import Scratch

_DIGIT = 16
_ALL = np.int64(0x7FFF_FFFF_FFFF_FFFF)


def _ordered(values: pa.Array) -> pa.Array:
    """Doubles as whole numbers in the same order; the two zeros are one, and NaN is the greatest."""
    x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ _ALL, bits))


def _double(numbers: pa.Array) -> pa.Array:
    bits = numbers.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(np.where(bits < 0, bits ^ _ALL, bits).view(np.float64))


def _column(function, kind: str):
    def apply(values: pa.Array) -> pa.Array:
        return function(values)

    return F.arrow_udf(apply, kind)


def _prefix(number: str | Column, digits: int) -> Column:
    """The first ``digits`` digits of a number, in order from 0 on: its sign bit is flipped."""
    flipped = (F.col(number) if isinstance(number, str) else number).bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(flipped, 64 - _DIGIT * digits) if digits else F.lit(0).cast("long")


def _selected(ranks: DataFrame, bars: DataFrame, within: list[str], place: str) -> DataFrame:
    """Each rank with the bar that it falls in: the bars of a group are summed up in order of ``place``."""
    upto = F.sum("n").over(Window.partitionBy(*within).orderBy(place))
    bars = bars.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    return ranks.join(bars, within).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float] = (0.5,), few: int = 1 << _DIGIT) -> DataFrame:
    """(keys, probability, value): quantiles with linear interpolation between the two values beside a place.

    Null values don't count, and a group without any has no row; null keys are a
    group. NaN is greater than all numbers. Ties and copies are counted, never
    listed, so a hot group or a hot value is a few rows.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    number = _column(_ordered, "bigint")(F.col(value).cast("double"))
    counted = df.filter(F.col(value).isNotNull()).select(group.alias("g"), number.alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    counted = scratch.stash(counted, "values")
    totals = scratch.stash(counted.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different")), "totals")
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    place = F.col("probability") * (F.col("total") - 1)
    wanted = totals.select("g", "total", "different", asked).select("g", "probability", "different", place.alias("place"), F.floor(place).alias("low"), F.ceil(place).alias("high"))
    ranks = wanted.select("g", "different", F.explode(F.array("low", "high")).alias("rank")).distinct().withColumn("asked", F.col("rank"))
    small, large = ranks.filter(F.col("different") <= few).drop("different"), ranks.filter(F.col("different") > few).drop("different")
    small_groups = small.select("g").distinct()
    found = _selected(small, counted.join(small_groups, "g", "left_semi"), ["g"], "x").select("g", "asked", "x")
    if not large.isEmpty():
        # rank counts from the values that share the prefix
        left = scratch.stash(large.withColumn("prefix", F.lit(0).cast("long")), "ranks")
        for digits in range(1, 64 // _DIGIT + 1):
            near = counted.withColumn("prefix", _prefix("x", digits - 1)).join(left.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
            histogram = near.groupBy("g", "prefix", _prefix("x", digits).alias("next")).agg(F.sum("n").alias("n"))
            hit = _selected(left, histogram, ["g", "prefix"], "next")
            nxt = scratch.stash(hit.select("g", "asked", (F.col("rank") - F.col("before")).alias("rank"), F.col("next").alias("prefix")), "ranks")
            scratch.drop(left)
            left = nxt
        found = found.unionByName(left.select("g", "asked", F.col("prefix").bitwiseXOR(F.lit(-(1 << 63))).alias("x")))
    values = found.select("g", "asked", _column(_double, "double")("x").alias("v"))
    side = lambda name: values.select(F.col("g"), F.col("asked").alias(name), F.col("v").alias(f"{name}_value"))
    both = wanted.join(side("low"), ["g", "low"]).join(side("high"), ["g", "high"])
    share = F.col("place") - F.col("low")
    between = F.col("low_value") * (1 - share) + F.col("high_value") * share
    result = F.when(F.col("low") == F.col("high"), F.col("low_value")).otherwise(between)
    return both.select(*[F.col(f"g.{k}").alias(k) for k in keys], "probability", result.alias("value"))

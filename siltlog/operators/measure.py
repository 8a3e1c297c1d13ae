"""Summaries of measurements: percentiles of a group, medians and their bootstrap intervals."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """The value at the place ceil(share * n) of each group's values in order, as p<share in hundredths>: counted by value, so that no group is put in one list."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*group).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(s) * F.col("all")), F.col(value))).alias(f"p{round(100 * s)}") for s in shares]
    return ranked.groupBy(*group).agg(*at)


def median_interval(values: list[float], rounds: int = 10_000, share: float = 0.95, seed: int = 1) -> tuple[float, float]:
    """Bootstrap interval of the median of a few measurements."""
    generator = random.Random(seed)
    found = sorted(statistics.median(generator.choices(values, k=len(values))) for _ in range(rounds))
    cut = int(rounds * (1 - share) / 2)
    return found[max(0, cut - 1)], found[rounds - cut - 1]

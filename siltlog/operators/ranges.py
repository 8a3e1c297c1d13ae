"""Joins of keys with key ranges and of ranges with each other, as joins on equal nodes of a binary tree over the key space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places where the key space is cut, at most; they are sent with the plan.
SPLITS = 1024
#: Ranges that may be broadcast, each as up to two rows a level of the tree; more are joined by a shuffle.
BROADCAST = 1 << 16
#: Ranges of a node that keys meet in one task of that shuffle.
NODE = 1 << 14


def splits(bounds: list, most: int | None = None) -> list:
    """Cuts of the key space: some of the bounds of ranges, evenly spread over the different ones."""
    found = sorted({b for b in bounds if b is not None})
    step = -(-len(found) // (most or SPLITS)) or 1
    return found[::step]


def bucketed(frame: DataFrame, key: str, cuts: list, name: str) -> DataFrame:
    """The frame with a column of how many cuts are at or below the key, found by halves: a projection each, as generated code has no other loop over an array."""
    frame, array = frame.withColumn(name, F.lit(0)), F.array(*map(F.lit, cuts))
    for h in reversed(range(len(cuts).bit_length())):
        after = F.col(name) + (1 << h)
        frame = frame.withColumn(name, F.when((after <= len(cuts)) & (F.get(array, after - 1) <= F.col(key)), after).otherwise(F.col(name)))
    return frame


def _at_keys(keys: DataFrame, key: str, cuts: list) -> DataFrame:
    """A row for each node above a key: its leaf and all up to the root.

    The tree has a leaf a bucket and is numbered as a heap: the root 1, the leaf of bucket b 2^levels + b.
    """
    levels = len(cuts).bit_length()
    leaf = (F.col("_bucket") + (1 << levels)).cast("long")
    return bucketed(keys, key, cuts, "_bucket").withColumn("_node", F.explode(F.array(*[F.shiftright(leaf, h) for h in range(levels + 1)]))).drop("_bucket")


def _at_ranges(ranges: DataFrame, low: str, high: str, cuts: list) -> DataFrame:
    """A row for each of the fewest nodes whose leaves are just the range's buckets: two a level at most, and one of them above each of these leaves."""
    levels = len(cuts).bit_length()
    ends = bucketed(bucketed(ranges, low, cuts, "_first"), high, cuts, "_last")
    first, after, nodes = (F.col("_first") + (1 << levels)).cast("long"), (F.col("_last") + (1 << levels) + 1).cast("long"), []
    for h in range(levels + 1):
        a, b = F.shiftright(first + ((1 << h) - 1), h), F.shiftright(after, h)  # what is left on this level: from a to below b
        nodes += [F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)]
    return ends.withColumn("_node", F.explode(F.array_compact(F.array(*nodes)))).drop("_first", "_last")


def containing(keys: DataFrame, key: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Each key with each range (low to high, both included) that it is in.

    The buckets that a range meets are dealt to the fewest nodes of a tree, and a
    key to the nodes above its bucket, so that rows meet by one equal node only: what is compared in vain
    are keys and ranges that end in one bucket. Up to BROADCAST ranges are sent to the keys, which are dealt anew if there
    are many results of each. Columns of both have different names.
    """
    spark = keys.sparkSession
    found = ranges.select(low, high).limit(BROADCAST + 1).collect()
    cuts = splits([b for r in found for b in r])
    dealt = _at_ranges(ranges, low, high, cuts)
    on = ["_node"]
    if len(found) > SPLITS:
        keys = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = _at_keys(keys, key, cuts)
    if len(found) <= BROADCAST:
        dealt = F.broadcast(dealt)
    else:  # ranges of a node in blocks, by all they have
        blocks = dealt.groupBy("_node").agg(F.ceil(F.count(F.lit(1)) / NODE).alias("_blocks"))
        dealt = dealt.join(F.broadcast(blocks), "_node").withColumn("_block", F.pmod(F.xxhash64(*ranges.columns), F.col("_blocks"))).drop("_blocks")
        placed = placed.join(F.broadcast(blocks), "_node").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
        on.append("_block")
    return placed.join(dealt, on).filter(F.col(key).between(F.col(low), F.col(high))).drop(*on)


def overlapping(ranges: DataFrame, number: str, low: str, high: str) -> DataFrame:
    """Pairs (number_a < number_b) of ranges that overlap: the lower bound of one of them is in the other, which has the lesser bound or, of equal ones, number."""
    points = ranges.select(F.col(low).alias("_low"), F.col(high).alias("_high"), F.col(number).alias("_number"))
    met = containing(points, "_low", ranges.select(number, low, high), low, high)
    met = met.filter(F.expr(f"({low} < _low or {low} = _low and {number} < _number) and {low} <= _high and {number} <> _number"))
    return met.select(F.least(number, "_number").alias(f"{number}_a"), F.greatest(number, "_number").alias(f"{number}_b"))

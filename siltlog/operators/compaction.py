"""Maintenance: which versions a compaction keeps, and checks that views don't change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .view import newest, visible


def retain(versions: DataFrame, last_level: bool, oldest_snapshot: int | Column = 0, key: str = "k", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """What a compaction writes.

    Without a snapshot (0) the newest version of each key, and no deleted ones at the
    last level. With one, all versions above it and the newest up to it, deleted
    ones too, at every level.
    """
    if isinstance(oldest_snapshot, int) and not oldest_snapshot:
        kept = newest(versions, key=key, seq=seq)
        return kept.filter(~F.col(deleted)) if last_level else kept
    later = versions.filter(F.col(seq) > oldest_snapshot)  # stay where they are
    return later.unionByName(newest(versions, oldest_snapshot, key, seq))


def run_metadata(ops: DataFrame) -> DataFrame:
    """Rows, key range, sequence range, distinct keys and tombstones of each run."""
    return ops.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("k").alias("lo"),
        F.max("k").alias("hi"),
        F.min("seq").alias("smin"),
        F.max("seq").alias("smax"),
        F.count_distinct("k").alias("n_keys"),
        F.sum(F.col("deleted").cast("long")).alias("n_deleted"),
    )


def space_amplification(ops: DataFrame) -> DataFrame:
    """Versions of each run and how many of them are live."""
    live = visible(ops).groupBy("run").agg(F.count(F.lit(1)).alias("live"))
    return ops.groupBy("run").agg(F.count(F.lit(1)).alias("versions")).join(live, "run", "left").select("run", "versions", F.coalesce("live", F.lit(0)).alias("live"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows either view has that the other lacks, in one row."""
    lost, gained = before.exceptAll(after).agg(F.count(F.lit(1)).alias("lost")), after.exceptAll(before).agg(F.count(F.lit(1)).alias("gained"))
    return lost.select("lost", F.lit(0).alias("one")).join(gained.select("gained", F.lit(0).alias("one")), "one").drop("one")

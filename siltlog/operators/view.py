"""Reads: the latest visible version of each key, point lookups, ranges and as-of probes.

An op table has the columns key, seq, deleted and value (others are carried). seq
is unique for each key. All views choose the newest version first and drop deleted
ones afterwards: the other way round would bring old values back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(ops: DataFrame, snapshot: int | Column | None = None, key: str = "k", seq: str = "seq") -> DataFrame:
    """The newest version of each key up to the snapshot, deleted or not.

    Rank 1 of a window: Spark keeps one row a key before the shuffle (WindowGroupLimit),
    so a hot key is cut down in every task.
    """
    seen = ops if snapshot is None else ops.filter(F.col(seq) <= snapshot)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))
    return seen.withColumn("rn", rank).filter("rn = 1").drop("rn")


def visible(ops: DataFrame, snapshot: int | Column | None = None, key: str = "k", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The live view as of a snapshot."""
    return newest(ops, snapshot, key, seq).filter(~F.col(deleted))


def get(ops: DataFrame, wanted, snapshot: int | Column | None = None, key: str = "k") -> DataFrame:
    """The visible version of one key: no row if it isn't found or was deleted. The filter reaches the scan."""
    return visible(ops.filter(F.col(key) == F.lit(wanted)), snapshot, key)


def seek(ops: DataFrame, target=None, limit: int | None = None, end=None, snapshot: int | Column | None = None, key: str = "k") -> DataFrame:
    """The view in order of key from target on (all of it without one), before `end`, `limit` rows at most.

    Keys outside of the range are dropped below the window.
    """
    if target is not None:
        ops = ops.filter(F.col(key) >= F.lit(target))
    if end is not None:
        ops = ops.filter(F.col(key) < F.lit(end))
    found = visible(ops, snapshot, key).orderBy(key)
    return found if limit is None else found.limit(limit)


#: Sequences of a block: what of a key has its versions and probes in order in one task.
BLOCK = 1 << 20


def as_of(probes: DataFrame, ops: DataFrame, probe: str = "probe_id", key: str = "k", at: str = "s", block: int = BLOCK) -> DataFrame:
    """For each probe (probe id, key, at) the newest version with seq <= at, and its status: ok, deleted or missing.

    Probes and versions of a key are put in one order, block by block of their sequences, and each probe takes the
    last version before it: linear in both, where a join would pair every
    probe with every version of its key. A probe with no version before it in its block takes the last one of the
    blocks before, of which a key has one row each; so no key's versions are all in one task.
    """
    version = F.struct(F.col("seq"), F.col("deleted"), F.col("v")).alias("version")
    left = ops.select(key, F.col("seq").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast(probes.schema[probe].dataType).alias(probe), version)
    right = probes.select(key, F.col(at).alias("place"), F.lit(1).alias("kind"), probe, F.lit(None).cast(left.schema["version"].dataType).alias("version"))
    both = left.unionByName(right).withColumn("block", F.floor(F.col("place") / block))
    inside = Window.partitionBy(key, "block").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("own", F.last("version", ignorenulls=True).over(inside)).filter("kind = 1")
    ends = both.groupBy(key, "block").agg(F.max("version").alias("end"))  # by seq, which comes first in it
    ahead = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col(key).alias("_key"), F.col("block").alias("_block"), F.last("end", ignorenulls=True).over(ahead).alias("before"))
    met = near[key].eqNullSafe(before["_key"]) & near["block"].eqNullSafe(before["_block"])
    found = near.join(before, met, "left").withColumn("got", F.coalesce("own", "before"))
    status = F.when(F.col("got").isNull(), "missing").when(F.col("got.deleted"), "deleted").otherwise("ok")
    return found.select(probe, key, F.col("place").alias(at), F.col("got.seq").alias("seq"), status.alias("status"), F.when(status == "ok", F.col("got.v")).alias("v"))


def history(ops: DataFrame, wanted, key: str = "k", seq: str = "seq") -> DataFrame:
    """All versions of a key, newest first, with their rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))
    return ops.filter(F.col(key) == F.lit(wanted)).withColumn("rn", rank)


def diff(ops: DataFrame, old: int | Column, new: int | Column | None = None, key: str = "k", seq: str = "seq") -> DataFrame:
    """Keys whose visible version differs between two snapshots: added, removed or changed."""
    a = visible(ops, old, key, seq).select(key, F.col(seq).alias("old_seq"))
    b = visible(ops, new, key, seq).select(key, F.col(seq).alias("new_seq"))
    change = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").when(F.col("old_seq") != F.col("new_seq"), "changed")
    return a.join(b, key, "full_outer").withColumn("change", change).filter(F.col("change").isNotNull())

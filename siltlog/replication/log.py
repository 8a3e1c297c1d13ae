"""Analytics over a replicated log of (node, idx, term, batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Range partitions of an export whose order is checked.
PARTS = 64


def majority_commit(acks: DataFrame, nodes: int = 3) -> DataFrame:
    """For each term the highest index that a majority of nodes has: of (term, node, m) the m at the place nodes // 2 + 1 from above.

    A term has a row a node, so its list is as short as the cluster. A term with fewer nodes than a majority commits nothing.
    """
    held = acks.groupBy("term").agg(F.sort_array(F.collect_list("m"), asc=False).alias("m"))
    return held.filter(F.size("m") > nodes // 2).select("term", F.col("m")[nodes // 2].alias("commit_index"))


def first_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first index of log a whose term log b lacks, and how many there are."""
    other = b.select("idx", F.col("term").alias("other"))
    differs = ~F.col("term").eqNullSafe(F.col("other"))
    joined = a.join(other, "idx", "left")
    return joined.agg(F.min(F.when(differs, F.col("idx"))).alias("first_difference"), F.count_if(differs).alias("n_different"))


def append_entries(log: DataFrame, entries: DataFrame, previous_index: int, previous_term: int, commit: int) -> DataFrame | None:
    """log after a leader's entries (idx, term, ...) were appended; None if it doesn't hold (previous_index, previous_term).

    From the first entry whose term differs on, the log is cut and the new entries
    follow; entries that match stay. A conflict at or below `commit` is an error: what is committed is never cut.
    """
    if previous_index and log.filter((F.col("idx") == previous_index) & (F.col("term") == previous_term)).isEmpty():
        return None
    own = log.select("idx", F.col("term").alias("own"))
    conflict = entries.join(own, "idx").filter("own != term").agg(F.min("idx")).first()[0]
    if conflict is not None and conflict <= commit:
        raise ValueError(f"entry {conflict} is committed and can't be replaced")
    kept = log if conflict is None else log.filter(F.col("idx") < conflict)
    return kept.unionByName(entries.join(kept.select("idx"), "idx", "left_anti"))


def commit_after(leader_commit: int, matched: int) -> int:
    """What a follower may commit: no more than it has matched with its leader."""
    return min(leader_commit, matched)


def may_vote(log: DataFrame, last_term: int, last_index: int) -> bool:
    """Whether a candidate's log, by its last entry, is as complete as this one."""
    own = log.agg(F.max(F.struct("term", "idx")).alias("last")).first()["last"]
    return own is None or (last_term, last_index) >= (own["term"], own["idx"])


def terms_monotonic(log: DataFrame) -> DataFrame:
    """For each node how many entries have a lower term than the one before."""
    order = Window.partitionBy("node").orderBy("idx")
    return log.withColumn("down", F.col("term") < F.lag("term").over(order)).groupBy("node").agg(F.count_if("down").alias("n_down"))


def committed_ops(log: DataFrame, commit: int) -> DataFrame:
    """Operations of the committed entries (idx, batch array of struct(op, k, v)) in order, with sequences by entry and position."""
    return (
        log.filter(F.col("idx") <= commit)
        .select("idx", F.posexplode("batch").alias("position", "o"))
        .select("idx", "position", F.col("o.k").alias("k"), (F.col("o.op") == "delete").alias("deleted"), F.coalesce("o.v", F.lit("")).alias("v"))
    )


def rebuild(snapshot: DataFrame, log: DataFrame, snapshot_index: int, commit: int) -> DataFrame:
    """Live (k, v) from an export at snapshot_index and the committed entries after it."""
    base = snapshot.select("k", F.lit(snapshot_index).cast("long").alias("idx"), F.lit(-1).alias("position"), F.lit(False).alias("deleted"), "v")
    later = committed_ops(log.filter(F.col("idx") > snapshot_index), commit).withColumn("idx", F.col("idx").cast("long"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.col("idx").desc(), F.col("position").desc()))
    return base.unionByName(later).withColumn("rn", rank).filter("rn = 1 and not deleted").select("k", "v")


def export_state(live: DataFrame, path: str, partitions: int = PARTS) -> None:
    """Writes the live (k, v) in order of key: a range of keys in each file."""
    live.select("k", "v").repartitionByRange(partitions, "k").sortWithinPartitions("k").write.mode("error").parquet(path)


def check_order(exported: DataFrame) -> DataFrame:
    """Rows of an export, and how many keys aren't above the one before in its order.

    Each range of keys is checked in a task of its own; ranges don't overlap, so repeated keys share a range.
    """
    dealt = exported.repartitionByRange(PARTS, "k").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("part").orderBy("k")
    return dealt.withColumn("up", F.coalesce(F.lag("k").over(order) < F.col("k"), F.lit(True))).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("up")).alias("out_of_order"))


def needs_snapshot(log: DataFrame, max_bytes: int = 8 << 20, max_entries: int = 1024) -> bool:
    """Whether the retained log (with column bytes) has reached a limit after which an export is due."""
    row = log.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    return row["n"] >= max_entries or row["b"] >= max_bytes

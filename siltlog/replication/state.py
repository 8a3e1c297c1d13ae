"""The state of a node that replicates a log: terms, votes, snapshots and truncation, as rows and small checked files."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from ..sources.store import Store, StoreError
from .log import committed_ops

#: Bytes and entries of a log after which a snapshot is due, and bytes that a state may have.
SNAPSHOT_BYTES, SNAPSHOT_ENTRIES, STATE_BYTES = 8 << 20, 1024, 64 << 20


@dataclass(frozen=True)
class NodeState:
    """What a node must not forget. Entries up to snapshot_index are in the snapshot; 0 means that there is none."""

    identity: str
    term: int = 0
    voted_for: int = 0
    commit: int = 0
    snapshot_index: int = 0
    snapshot_term: int = 0
    snapshot_bytes: int = 0

    def observe(self, term: int) -> NodeState:
        """After a message of a term: a higher one is taken over, and the vote was for the old one."""
        return replace(self, term=term, voted_for=0) if term > self.term else self

    def vote(self, candidate: int, term: int, complete: bool) -> tuple[NodeState, bool]:
        """The state after a request for a vote, and whether it is given: once a term, to a candidate whose log is as complete."""
        new = self.observe(term)
        given = term == new.term and complete and new.voted_for in (0, candidate)
        return (replace(new, voted_for=candidate) if given else new), given

    def check(self, last_index: int) -> str | None:
        """What can't be in a state whose log ends at last_index, or None."""
        has = [self.snapshot_index > 0, self.snapshot_term > 0, self.snapshot_bytes > 0]
        if any(has) != all(has):
            return "a snapshot lacks its index, term or size"
        if not self.snapshot_index <= self.commit <= last_index:
            return "the commit is outside of the log"
        if self.snapshot_term > self.term:
            return "the snapshot is of a later term"
        return None


class StateFile:
    """A state in a file that is whole or not there; the first error stays, as with a node that stops when it can't write."""

    def __init__(self, spark: SparkSession, folder: str, identity: str):
        self.files, self.identity, self.error = Files(spark, folder), identity, None

    def save(self, state: NodeState) -> None:
        if self.error:
            raise self.error
        body = json.dumps(asdict(state), sort_keys=True)
        if len(body) > STATE_BYTES:
            raise StoreError("IOError", "the state is too large")
        try:
            self.files.folder()
            self.files.replace("state.json", json.dumps({"crc": zlib.crc32(body.encode()), "size": len(body), "body": body}))
        except Exception as e:
            self.error = StoreError("IOError", f"state: {e}")
            raise self.error from e

    def load(self, last_index: int) -> NodeState:
        """The state, or a new one for an empty folder; Corruption if it is damaged, another node's or can't be."""
        if not self.files.exists("state.json"):
            if self.files.names(""):
                raise StoreError("Corruption", "there are files, but no state")
            return NodeState(self.identity)
        try:
            outer = json.loads(self.files.read("state.json"))
            body = outer["body"]
            if len(body) != outer["size"] or zlib.crc32(body.encode()) != outer["crc"]:
                raise ValueError("checksum")
            state = NodeState(**json.loads(body))
        except (ValueError, TypeError, KeyError) as e:
            raise StoreError("Corruption", f"state: {e}") from e
        problem = "it is another node's" if state.identity != self.identity else state.check(last_index)
        if problem:
            raise StoreError("Corruption", f"state: {problem}")
        return state


def term_at(log: DataFrame, state: NodeState, index: int) -> int | None:
    """The term of an entry of the log or of the snapshot's last one; None if there is no such entry."""
    if index == state.snapshot_index:
        return state.snapshot_term
    row = log.filter(F.col("idx") == index).select("term").first()
    return None if row is None else row["term"]


def bad_terms(log: DataFrame, state: NodeState) -> DataFrame:
    """(idx, term) of entries whose term is 0, below the entry's before or above the node's."""
    before = log.select((F.col("idx") + 1).alias("idx"), F.col("term").alias("before"))
    joined = log.select("idx", "term").join(before, "idx", "left")
    low = F.coalesce("before", F.when(F.col("idx") == state.snapshot_index + 1, F.lit(state.snapshot_term)), F.lit(0))
    return joined.filter((F.col("term") == 0) | (F.col("term") < low) | (F.col("term") > state.term)).select("idx", "term")


def vote_counts(votes: DataFrame, nodes: int = 3) -> DataFrame:
    """(term, candidate, votes, won) of votes (term, candidate, node, granted): each node counts once."""
    given = votes.filter("granted").groupBy("term", "candidate").agg(F.count_distinct("node").alias("votes"))
    return given.withColumn("won", F.col("votes") >= nodes // 2 + 1)


def truncated(log: DataFrame, state: NodeState, index: int, size: int) -> tuple[DataFrame, NodeState]:
    """The log and state after a snapshot up to `index`, which is committed, was made durable: its entries go, later ones stay."""
    if index <= state.snapshot_index:
        return log, state
    term = term_at(log, state, index)
    if index > state.commit or term is None:
        raise ValueError(f"entry {index} isn't committed")
    return log.filter(F.col("idx") > index), replace(state, snapshot_index=index, snapshot_term=term, snapshot_bytes=size)


def installed(log: DataFrame, state: NodeState, index: int, term: int, size: int) -> tuple[DataFrame, NodeState]:
    """The log and state after a leader's snapshot was received whole.

    What is committed is never taken back: an old snapshot changes nothing. Entries after it stay if
    the log has its last entry with the same term, and go otherwise.
    """
    if index <= state.commit:
        return log, state
    rest = log.filter(F.col("idx") > index) if term_at(log, state, index) == term else log.limit(0)
    return rest, replace(state, snapshot_index=index, snapshot_term=term, snapshot_bytes=size, commit=index)


def apply_committed(store: Store, log: DataFrame, applied: int, commit: int, before: Callable[[int], None] = lambda index: None) -> int:
    """Loads the operations of entries after `applied` up to `commit` in order as one commit of the table; the index that is applied then."""
    if commit <= applied:
        return applied
    before(commit)
    ops = committed_ops(log.filter(F.col("idx") > applied), commit)
    if not ops.isEmpty():
        store.load(ops, ["idx", "position"])
    return commit


def node_info(spark: SparkSession, node: int, leader: int, log: DataFrame, state: NodeState, applied: int, error: str | None = None) -> DataFrame:
    """One row that says what a node knows of itself."""
    last = log.agg(F.coalesce(F.max("idx"), F.lit(state.snapshot_index)).alias("last_index"))
    fields = {"id": node, "leader": leader, "is_leader": error is None and leader == node, "term": state.term, "commit": state.commit, "snapshot_index": state.snapshot_index, "applied_index": applied, "error": error}
    return last.select(*[F.lit(v).cast("string" if k == "error" else "boolean" if k == "is_leader" else "long").alias(k) for k, v in fields.items()], F.col("last_index").cast("long"))

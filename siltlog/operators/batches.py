"""Writes: validation, atomic batches, sequence assignment and grouping."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import OPERATION_OVERHEAD, key_valid, operation_bytes

#: Highest sequence: LONG is signed, so half of the domain that an unsigned one has.
MAX_SEQUENCE = (1 << 63) - 1

# Type codes of encoded operations.
PUT, DELETE = 1, 2
#: What a 32-bit length can say.
MAX_LENGTH = (1 << 32) - 1


@dataclass(frozen=True)
class Limits:
    """Most operations of a batch, bytes of a key, of a value, and of all keys and values, with `overhead` bytes an operation. Without arguments: what the encoding can hold."""

    operations: int = MAX_LENGTH
    key: int = MAX_LENGTH
    value: int = MAX_LENGTH
    total: int = MAX_LENGTH
    overhead: int = OPERATION_OVERHEAD


#: What a remote client may send at once.
REMOTE = Limits(operations=4096, key=1536 << 10, value=1 << 20, total=1536 << 10, overhead=0)
_TOO_MUCH = {"operations": "too many operations", "key": "a key is too large", "value": "a value is too large", "total": "the batch is too large"}


def encoded_problem(rows: list[tuple[bytes, bytes]], limits: Limits) -> str | None:
    """What is wrong with a batch of (key, value) by its sizes, or None."""
    sizes = {
        "operations": len(rows),
        "key": max((len(k) for k, _ in rows), default=0),
        "value": max((len(v) for _, v in rows), default=0),
        "total": sum(limits.overhead + len(k) + len(v) for k, v in rows),
    }
    return next((text for name, text in _TOO_MUCH.items() if sizes[name] > getattr(limits, name)), None)


def batch_problems(ops: DataFrame, limits: Limits) -> DataFrame:
    """(batch_id, n, total, problem) of each batch of (batch_id, k, deleted, v): an invalid key, a delete with a value or the first limit that is exceeded; null if it may be written."""
    key, value = F.octet_length("k"), F.coalesce(F.octet_length("v"), F.lit(0))
    sums = ops.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(key).alias("key"),
        F.max(value).alias("value"),
        F.sum((F.lit(limits.overhead) + key + value).cast("long")).alias("total"),
        F.bool_or(~key_valid(F.col("k"))).alias("bad_key"),
        F.bool_or(F.col("deleted") & (value > 0)).alias("bad_delete"),
    )
    problem = F.when(F.col("bad_key"), F.lit("a key is empty or has TAB, NL or NUL")).when(F.col("bad_delete"), F.lit("a delete carries a value"))
    for name, text in _TOO_MUCH.items():
        problem = problem.when(F.col("n" if name == "operations" else name) > getattr(limits, name), F.lit(text))
    return sums.select("batch_id", "n", "total", problem.alias("problem"))


class Batch:
    """Operations that are to be written together: (op, key, value) in order, as Store.write() takes them."""

    def __init__(self, operations: Iterable[tuple[str, bytes, bytes]] = ()):
        self.operations = list(operations)

    def put(self, key: bytes, value: bytes) -> Batch:
        self.operations.append(("put", key, value))
        return self

    def delete(self, key: bytes) -> Batch:
        self.operations.append(("delete", key, b""))
        return self

    def append(self, other: Batch) -> Batch:
        """Adds the operations of another batch, or of this one once more."""
        self.operations += list(other.operations)
        return self

    def clear(self) -> None:
        self.operations = []

    def __len__(self) -> int:
        return len(self.operations)

    def __iter__(self) -> Iterator[tuple]:
        return iter((op, key) if op == "delete" else (op, key, value) for op, key, value in self.operations)

    def encode(self) -> bytes:
        """Each operation as a type byte, two lengths as little-endian 32 bits, the key and the value."""
        return b"".join(struct.pack("<BII", PUT if op == "put" else DELETE, len(k), len(v)) + k + v for op, k, v in self.operations)

    @staticmethod
    def decode(data: bytes) -> Batch:
        """The batch of its encoding; ValueError if that is cut off, has another type or a delete with a value."""
        out, at = Batch(), 0
        while at < len(data):
            if len(data) - at < OPERATION_OVERHEAD:
                raise ValueError("the head of an operation is cut off")
            kind, key_size, value_size = struct.unpack_from("<BII", data, at)
            at += OPERATION_OVERHEAD
            if kind not in (PUT, DELETE) or (kind == DELETE and value_size):
                raise ValueError("no such operation")
            if len(data) - at < key_size + value_size:
                raise ValueError("an operation is cut off")
            key, value = data[at : at + key_size], data[at + key_size : at + key_size + value_size]
            at += key_size + value_size
            out.operations.append(("put" if kind == PUT else "delete", key, value))
        return out


def batch_prefix(ops: DataFrame, last_batch: int | Column) -> DataFrame:
    """Operations of the batches up to a boundary, as recovery sees them."""
    return ops.filter(F.col("batch_id") <= last_batch)


def batch_sizes(ops: DataFrame) -> DataFrame:
    """Operations and encoded bytes of each batch."""
    return ops.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(operation_bytes(F.col("k"), F.col("v")).cast("long")).alias("bytes"))


def assign_sequences(batches: DataFrame, base: int = 0) -> DataFrame:
    """seq for rows of (batch_id, position): base + 1 for the first and so on, without gaps.

    Batches are counted first and their starts summed over the small table of
    batches; within a batch the position gives the rest, so that no row but one a batch is put in one order.
    """
    counts = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.withColumn("block", F.floor(F.col("batch_id") / 65536))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block_start = blocks.groupBy("block").agg(F.sum("n").alias("m")).withColumn("block_start", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    inside = Window.partitionBy("block").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(block_start.select("block", "block_start"), "block")
    starts = starts.select("batch_id", (F.col("block_start") + F.col("inside")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy("position"))
    return batches.withColumn("rank", rank).join(starts, "batch_id").withColumn("seq", F.lit(base) + F.col("start") + F.col("rank")).drop("rank", "start")


def invalid_keys(rows: DataFrame, key: str) -> DataFrame:
    """rows whose key may not be written; a batch with any of them is rejected whole."""
    return rows.filter(~key_valid(F.col(key)))


def monotonic(batches: DataFrame) -> DataFrame:
    """Whether each batch's (batch_id, f, l) first sequence is above the last one of the batch before.

    Batches are put in order block by block of their ids; only a row a block is put in one order for all.
    """
    blocks = batches.withColumn("block", F.floor(F.col("batch_id") / 65536))
    inside = F.lag("l").over(Window.partitionBy("block").orderBy("batch_id"))
    ends = blocks.groupBy("block").agg(F.max_by("l", "batch_id").alias("end"))
    before = ends.select("block", F.lag("end").over(Window.orderBy("block")).alias("before"))
    joined = blocks.withColumn("inside", inside).join(before, "block")
    return joined.select("batch_id", "f", "l", F.coalesce(F.col("f") > F.coalesce("inside", "before"), F.lit(True)).alias("ok"))


def group_batches(sizes: Iterable[int], limit: int = 1 << 20) -> Iterator[list[int]]:
    """Commit groups of queued batches (by index), first come first served: whole batches while their bytes fit in `limit`; an oversize or an empty one is alone."""
    group, held = [], 0
    for i, size in enumerate(sizes):
        if group and (size == 0 or held + size > limit):
            yield group
            group, held = [], 0
        group.append(i)
        held += size
        if size == 0 or held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group

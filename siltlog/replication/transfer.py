"""Export of a table's live rows as checked records, their validation and import, and their transfer in chunks."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.batches import DELETE, REMOTE, Batch
from ..sources.files import Files
from ..sources.store import Store, StoreError

# Bytes and operations of a record, and bytes of a chunk.
RECORD_BYTES, RECORD_OPERATIONS, CHUNK = 256 << 10, 4096, 256 << 10
_SCHEMA = "part int, place long, n long, low binary, high binary, crc long, payload binary"


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (part, k, v) in order as records: whole operations while they fit."""
    held, size, place, part = Batch(), 0, 0, None

    def record() -> pa.RecordBatch:
        nonlocal held, size, place
        payload, keys = held.encode(), [k for _, k, _ in held.operations]
        row = [part, place, len(held), keys[0], keys[-1], zlib.crc32(payload), payload]
        held, size, place = Batch(), 0, place + 1
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in _SCHEMA.split(", ")])

    for batch in batches:
        for number, key, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            part = number
            more = 9 + len(key) + len(value)
            if len(held) and (size + more > RECORD_BYTES or len(held) == RECORD_OPERATIONS):
                yield record()
            held.put(key, value)
            size += more
    if len(held):
        yield record()


def export(live: DataFrame, path: str, index: int, term: int, partitions: int = 64) -> dict:
    """Writes the live (k, v) as records in order of key, ranges of keys side by side, and then a header with their number; the header.

    A record has RECORD_BYTES and RECORD_OPERATIONS at most, unless one operation has more. An export without a
    header was never ended.
    """
    spark = live.sparkSession
    rows = live.select(F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"))
    dealt = rows.repartitionByRange(partitions, "k").sortWithinPartitions("k").select(F.spark_partition_id().alias("part"), "k", "v")
    dealt.mapInArrow(_records, _SCHEMA).write.mode("error").parquet(f"{path}/records")
    n = spark.read.parquet(f"{path}/records").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes")).first()
    header = {"index": index, "term": term, "records": n["records"], "rows": n["rows"], "bytes": n["bytes"]}
    body = json.dumps(header, sort_keys=True)
    Files(spark, path).replace("header.json", json.dumps({"crc": zlib.crc32(body.encode()), "body": body}))
    return header


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The operations of records, and what is wrong with each record."""
    for batch in batches:
        for r in batch.to_pylist():
            rows, wrong = [], None
            try:
                if zlib.crc32(r["payload"]) != r["crc"]:
                    raise ValueError("checksum")
                rows = Batch.decode(r["payload"]).operations
                keys = [k for _, k, _ in rows]
                if len(rows) != r["n"] or not rows or len(rows) > RECORD_OPERATIONS:
                    raise ValueError("number of operations")
                if any(op != "put" for op, _, _ in rows):
                    raise ValueError(f"operation {DELETE}")
                if any(not k or any(x in k for x in (b"\t", b"\n", b"\x00")) or len(v) > REMOTE.value for _, k, v in rows):
                    raise ValueError("key or value")
                if any(b <= a for a, b in zip(keys, keys[1:], strict=False)) or (keys[0], keys[-1]) != (r["low"], r["high"]):
                    raise ValueError("order of keys")
            except ValueError as e:
                rows, wrong = [], str(e)
            n = max(1, len(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * n, pa.int32()), pa.array([r["place"]] * n, pa.int64()), pa.array([x[1] for x in rows] or [None], pa.binary()), pa.array([x[2] for x in rows] or [None], pa.binary()), pa.array([wrong] * n, pa.string())],
                ["part", "place", "k", "v", "wrong"],
            )


def validate(spark: SparkSession, path: str) -> DataFrame:
    """The exported (k, v); StoreError Corruption if the header, a record or their order is wrong.

    Within a range of keys records follow each other by place, without gaps and with rising keys; the first and last keys
    of ranges, a row each, show that ranges follow each other too.
    """
    files = Files(spark, path)
    if not files.exists("header.json"):
        raise StoreError("Corruption", "the export has no end")
    outer = json.loads(files.read("header.json"))
    if zlib.crc32(outer["body"].encode()) != outer["crc"]:
        raise StoreError("Corruption", "header")
    header = json.loads(outer["body"])
    records = spark.read.schema(_SCHEMA).parquet(f"{path}/records")
    order = Window.partitionBy("part").orderBy("place")
    before, number = F.lag("high").over(order), F.row_number().over(order) - 1
    steps = records.select("part", "n", "low", "high", "payload", F.coalesce(before < F.col("low"), F.lit(True)).alias("up"), (number == F.col("place")).alias("next"))
    parts = steps.groupBy("part").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("rows"), F.sum(F.octet_length("payload")).alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and(F.col("up") & F.col("next")).alias("ok"))
    ranges = parts.withColumn("up", F.coalesce(F.lag("high").over(Window.orderBy("part")) < F.col("low"), F.lit(True)))  # a row a range
    sums = ranges.agg(F.sum("records").alias("records"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.bool_and(F.col("ok") & F.col("up")).alias("ok")).first()
    if any((sums[c] or 0) != header[c] for c in ("records", "rows", "bytes")) or sums["ok"] is False:
        raise StoreError("Corruption", "records are missing or out of order")
    opened = records.mapInArrow(_opened, "part int, place long, k binary, v binary, wrong string")
    bad = opened.filter("wrong is not null").select("wrong").first()
    if bad is not None:
        raise StoreError("Corruption", f"a record: {bad['wrong']}")
    return opened.select("k", "v")


def restore(spark: SparkSession, path: str, store: Store) -> None:
    """Loads a validated export into a table as one commit."""
    rows = validate(spark, path)
    if not rows.isEmpty():
        store.load(rows.select("k", F.lit(False).alias("deleted"), "v"), ["k"])


def chunk_plan(sizes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(name, offset, length) of each chunk of files (name, size)."""
    starts = sizes.filter("size > 0").select("name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("offset"))
    return starts.select("name", "offset", F.least(F.lit(chunk).cast("long"), F.col("size") - F.col("offset")).alias("length"))


def received(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(name, next_offset, complete): how far each file has come without a gap, from chunks (name, offset, length) that may be repeated but not torn."""
    order = Window.partitionBy("name").orderBy("offset")
    linked = chunks.distinct().withColumn("at", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order), F.lit(0)) == F.col("offset"))
    broken = linked.groupBy("name").agg(F.min(F.when(~F.col("at"), F.col("offset"))).alias("gap"))
    reach = linked.join(broken, "name").filter(F.col("gap").isNull() | (F.col("offset") < F.col("gap"))).groupBy("name").agg(F.max(F.col("offset") + F.col("length")).alias("next_offset"))
    out = sizes.join(reach, "name", "left").select("name", F.coalesce("next_offset", F.lit(0).cast("long")).alias("next_offset"), "size")
    return out.select("name", "next_offset", (F.col("next_offset") == F.col("size")).alias("complete"))


def remove_obsolete(spark: SparkSession, folder: str, active: str) -> list[str]:
    """Deletes all exports of a folder but the one that the state names."""
    files = Files(spark, folder)
    gone = [n for n in files.names("") if n.endswith(".snapshot") and n != active]
    for name in gone:
        files.delete(name)
    return gone

"""A persistent multi-version table: a commit log and immutable sorted runs that a manifest names.

A commit is one JSON file of a whole batch, written under another name first, so it is there whole
or not at all. A manifest version is one file too, and CURRENT names the one that
counts. What CURRENT's manifest doesn't name is no part of the table: left-over
runs are ignored until vacuum() removes them.
"""

from __future__ import annotations

import base64
import json
import logging
import math
import os
import socket
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import key_valid
from ..operators import compaction, view
from ..operators.batches import MAX_SEQUENCE, Limits, encoded_problem, group_batches
from ..plans.policy import PASSES, Policy, Run, choose, due
from .files import Files

SCHEMA = "k binary, seq long, deleted boolean, v binary"
_FORBIDDEN = (b"\t", b"\n", b"\x00")
log = logging.getLogger(__name__)


class StoreError(Exception):
    """code is one of IOError, Corruption, InvalidArgument."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


BLOOM_BYTES = 8 << 20


@dataclass(frozen=True)
class Options:
    """Limits of the tail and levels, and what an open expects. bloom_bits: bits a key of a run's filter, 1 to 64; Parquet rounds a filter to a power of two of at most BLOOM_BYTES a row group."""

    policy: Policy = field(default_factory=Policy)
    bloom_bits: int = 10
    create_if_missing: bool = True
    error_if_exists: bool = False
    event_log: bool = False
    #: Bytes of a run's file, about; a run has as many files, written by as many tasks, as that makes.
    file_bytes: int = 32 << 20
    #: Bytes of the batches that are committed as one group, unless a batch alone has more.
    group_bytes: int = 1 << 20
    limits: Limits = field(default_factory=Limits)
    #: Seconds after which the lock of a holder that no longer renews it may be broken.
    lease: float = 60.0
    #: Whether a thread flushes and compacts, so that writes don't wait for it.
    background: bool = False
    #: Called with the name of a step before it is taken; raising there is a fault of that step.
    before: Callable[[str], None] = lambda step: None

    def check(self) -> None:
        if self.policy.tail_limit < 1 or self.policy.level0_limit < 1 or self.policy.level1_bytes < 1 or not 1 <= self.bloom_bits <= 64 or self.file_bytes < 1 or self.group_bytes < 1 or self.lease <= 0:
            raise StoreError("InvalidArgument", "an option is out of range")


@dataclass(frozen=True)
class RunFile(Run):
    """A run in the manifest; bounds are hexadecimal, so their order is that of the bytes."""

    path: str = ""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_number: int = 1
    #: Commits up to this sequence are in runs.
    flushed: int = 0
    last_sequence: int = 0
    runs: tuple[RunFile, ...] = ()

    def text(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})

    @staticmethod
    def parse(text: str) -> Manifest:
        try:
            outer = json.loads(text)
            if zlib.crc32(outer["body"].encode()) != outer["crc"]:
                raise ValueError("checksum")
            body = json.loads(outer["body"])
            return Manifest(**{**body, "runs": tuple(RunFile(**r) for r in body["runs"])})
        except (ValueError, TypeError, KeyError) as e:
            raise StoreError("Corruption", f"manifest: {e}") from e


@dataclass(eq=False)
class Snapshot:
    """A pinned sequence. Reads at it give the same rows until it is released."""

    store: Store
    sequence: int
    active: bool = True


class Lease:
    """The lock of a table: a file with its holder, host and time of expiry, which a thread renews.

    A holder that was killed renews no more, so its lock is broken once it has expired. Hosts' clocks are taken to differ by much less than a
    lease. held() tells the holder itself, ahead of each step that counts, that it has not lost it.
    """

    def __init__(self, files: Files, name: str, seconds: float):
        self.files, self.name, self.seconds = files, name, seconds
        self.owner = f"{socket.gethostname()}:{os.getpid()}:{uuid.uuid4().hex}"
        self.until = 0.0
        self._end = threading.Event()
        self._turn = threading.Lock()

    def take(self) -> bool:
        if not self.files.create(self.name, self._text()):
            found = self._read()
            if found is not None and found["until"] > time.time():
                return False
            self.files.replace(self.name, self._text())
            time.sleep(min(0.2, self.seconds / 10))  # another that breaks it just now
            if (self._read() or {}).get("owner") != self.owner:
                return False
        threading.Thread(target=self._renew, daemon=True).start()
        return True

    def _text(self) -> str:
        self.until = time.time() + self.seconds
        return json.dumps({"owner": self.owner, "until": self.until})

    def _read(self) -> dict | None:
        try:
            return json.loads(self.files.read(self.name))
        except ValueError:
            return None  # the holder was killed while it wrote it
        except Exception:
            if self.files.exists(self.name):
                raise
            return None

    def _renew(self) -> None:
        while not self._end.wait(self.seconds / 3):
            with self._turn:
                if self._end.is_set():
                    return
                try:
                    if not self.held() or (self._read() or {}).get("owner") != self.owner:
                        self.until = 0.0
                        return
                    self.files.replace(self.name, self._text())
                except Exception as e:  # until it expires the next turn may do
                    log.warning("lock of %s: %s", self.files.root, e)

    def held(self) -> bool:
        return time.time() < self.until

    def release(self) -> None:
        self._end.set()
        with self._turn:
            if (self._read() or {}).get("owner") == self.owner:
                self.files.delete(self.name)


class Cursor:
    """Walks over the live rows of a snapshot in order of key, for a reader on the driver: rows come partition by partition.

    valid tells whether it is at a row; key and value are that row's. An error of a read ends the walk and stays in `error`.
    """

    def __init__(self, store: Store, snapshot: Snapshot, target: bytes | str = b""):
        self.store, self.snapshot = store, snapshot
        self.seek(target)

    def seek(self, target: bytes | str = b"") -> None:
        """Goes to the first key from target on; without one to the first of all."""
        self.error: Exception | None = None
        self._rows = iter(self.store.seek(target, snapshot=self.snapshot).toLocalIterator())
        self.next()

    def next(self) -> None:
        try:
            row = next(self._rows, None)
        except Exception as e:
            self.error, row = e, None
        self.valid = row is not None
        self.key, self.value = (bytes(row["k"]), bytes(row["v"])) if row is not None else (None, None)


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class Store:
    """store = Store(spark, path); store.write([...]); store.view().show(); store.close()."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.files = Files(spark, self.path)
        self.snapshots: list[Snapshot] = []
        self.error: StoreError | None = None
        self.is_open = False
        self.counters = dict.fromkeys(("flush_count", "compaction_count", "commit_count", "committed_operations", "max_batch_operations", "committed_bytes", "runs_read", "runs_skipped"), 0)
        self._mutex = threading.RLock()  # the manifest and the list of commits
        self._one = threading.RLock()  # one flush, load or compaction at a time; taken before the other
        self._wake: threading.Event | None = None
        self._worker: threading.Thread | None = None
        self.open()

    # open and close

    def open(self) -> None:
        """Takes the lock, reads the manifest and replays commits after it. A failed open releases what it took."""
        self.options.check()
        if self.is_open:
            raise StoreError("InvalidArgument", "already open")
        there = self.files.exists()
        if there and self.options.error_if_exists:
            raise StoreError("InvalidArgument", f"{self.path} exists")
        if not there and not self.options.create_if_missing:
            raise StoreError("InvalidArgument", f"{self.path} is missing")
        self.files.folder()
        self.lock = Lease(self.files, "LOCK", self.options.lease)
        if not self.lock.take():
            raise StoreError("IOError", f"{self.path} is locked")
        try:
            self.manifest = self._load()
            self.commits = self._replay()
        except BaseException:
            self.lock.release()
            raise
        self.error, self.is_open = None, True
        if self.options.background:
            self._wake = threading.Event()
            self._worker = threading.Thread(target=self._work, daemon=True)
            self._worker.start()
        self._event("open")

    def _work(self) -> None:
        """Flushes and compacts whenever a write asks for it, until the table is closed."""
        while True:
            self._wake.wait()
            self._wake.clear()
            if not self.is_open:
                return
            try:
                if self._tail_count() >= self.options.policy.tail_limit:
                    self.flush()
                self.maintain()
            except Exception as e:
                self.error = self.error or StoreError("IOError", f"maintenance: {e}")
                return

    def drain(self) -> None:
        """Returns when a background flush or compaction that is under way has ended; the tail may have writes."""
        with self._one:
            pass

    def close(self) -> None:
        """Flushes the tail and releases the lock; snapshots end. Closing again is no error."""
        if not self.is_open:
            return
        try:
            if not self.error and self.commits:
                self.flush()
        finally:
            self.is_open = False
            if self._worker is not None:
                self._wake.set()
                self._worker.join()
                self._worker = None
            for s in self.snapshots:
                s.active = False
            self.snapshots = []
            self.lock.release()
            self._event("close")
        if self.error:
            raise self.error

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _load(self) -> Manifest:
        if self.files.exists("CURRENT"):
            name = self._text("CURRENT").strip()
            if not self.files.exists(f"manifest/{name}"):
                raise StoreError("IOError", f"{name} is missing")
            return Manifest.parse(self._text(f"manifest/{name}"))
        if self.files.names("manifest"):
            raise StoreError("Corruption", "there are manifests, but no CURRENT")
        return self._recover()

    def _text(self, name: str) -> str:
        try:
            return self.files.read(name)
        except Exception as e:
            raise StoreError("Corruption" if "ChecksumException" in str(e) else "IOError", f"{name} can't be read") from e

    def _recover(self) -> Manifest:
        """Without any manifest all runs that are there count, at level 0, with what a scan of them gives."""
        names = [n for n in self.files.names("runs") if n.startswith("run_")]
        if not names:
            return Manifest()
        runs = []
        for name in names:
            number = int(name.removeprefix("run_"))
            runs.append(self._describe(number, 0, f"runs/{name}")[0])
        top = max(self._scan(r).agg(F.max("seq")).first()[0] or 0 for r in runs)
        return Manifest(next_number=max(r.number for r in runs) + 1, flushed=top, last_sequence=top, runs=tuple(runs))

    def _replay(self) -> list[tuple[int, int, str]]:
        """(first, last sequence, name) of commits after the manifest; overlapping ranges are corrupt."""
        out, last = [], self.manifest.flushed
        for name in self.files.names("log"):
            if not name.endswith(".json"):
                continue  # never became a commit
            first, end = (int(x) for x in name.removesuffix(".json").split("_")[1:])
            if end <= self.manifest.flushed:
                continue
            if first <= last:
                raise StoreError("Corruption", f"{name} overlaps the commits before it")
            out.append((first, end, f"log/{name}"))
            last = end
        self.manifest = replace(self.manifest, last_sequence=max(last, self.manifest.last_sequence))
        return out

    def _save(self, manifest: Manifest) -> None:
        """Makes a manifest count. If that fails it may count nevertheless: the handle takes no more writes, and a new open decides."""
        if not self.lock.held():
            self.error = StoreError("IOError", f"the lock of {self.path} was lost")
            raise self.error
        manifest = replace(manifest, version=self.manifest.version + 1)
        name = f"{manifest.version:06d}.json"
        try:
            self.options.before("manifest")
            self.files.replace(f"manifest/{name}", manifest.text())
            self.files.replace("CURRENT", name)
        except Exception as e:
            self.error = StoreError("IOError", f"manifest: {e}")
            raise self.error from e
        self.manifest = manifest

    def _event(self, what: str) -> None:
        if self.options.event_log:
            log.info("%s: %s", self.path, what)

    def _check(self) -> None:
        if not self.is_open:
            raise StoreError("IOError", "closed")
        if self.error:
            raise self.error
        if not self.lock.held():
            raise StoreError("IOError", f"the lock of {self.path} was lost")

    # writes

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self.write([("put", key, value)])

    def delete(self, key: bytes | str) -> None:
        self.write([("delete", key, b"")])

    def write(self, batch: Iterable[tuple]) -> None:
        """Commits (put, key, value) and (delete, key) rows together or, if any is invalid, none."""
        self.write_all([batch])

    def write_all(self, batches: Iterable[Iterable[tuple]]) -> None:
        """Commits batches that were queued together, in order: groups of whole batches as group_batches() makes them, each in one file. If any is invalid, none is committed."""
        self._check()
        queued = []
        for batch in batches:
            rows = []
            for op, key, *value in batch:
                key, value = _bytes(key), _bytes(value[0]) if value else b""
                if not key or any(x in key for x in _FORBIDDEN):
                    raise StoreError("InvalidArgument", "a key is empty or has TAB, NL or NUL")
                if op not in ("put", "delete") or (op == "delete" and value):
                    raise StoreError("InvalidArgument", f"no such operation: {op}")
                rows.append((op == "delete", key, value))
            if problem := encoded_problem([(k, v) for _, k, v in rows], self.options.limits):
                raise StoreError("InvalidArgument", problem)
            if rows:
                queued.append(rows)
        sizes = [sum(9 + len(k) + len(v) for _, k, v in rows) for rows in queued]
        with self._mutex:
            for group in group_batches(sizes, self.options.group_bytes):
                self._commit([queued[i] for i in group], sum(sizes[i] for i in group))
        if self._tail_count() >= self.options.policy.tail_limit:
            if self._wake is not None:
                self._wake.set()
            else:
                self.flush()
                self.maintain()

    def _tail_count(self) -> int:
        return sum(b - a + 1 for a, b, _ in self.commits)

    def _commit(self, group: list[list[tuple[bool, bytes, bytes]]], size: int) -> None:
        rows = [row for batch in group for row in batch]
        first = self.manifest.last_sequence + 1
        last = first + len(rows) - 1
        if last > MAX_SEQUENCE:
            raise StoreError("InvalidArgument", "sequences are exhausted")
        name = f"log/commit_{first:019d}_{last:019d}.json"
        text = "".join(
            json.dumps({"seq": first + i, "deleted": d, "k": base64.b64encode(k).decode(), "v": base64.b64encode(v).decode(), "crc": zlib.crc32(k + v)}) + "\n"
            for i, (d, k, v) in enumerate(rows)
        )
        try:
            self.options.before("commit")
            self.files.replace(name, text)
        except Exception as e:
            self.error = StoreError("IOError", f"commit: {e}")
            raise self.error from e
        self.commits.append((first, last, name))
        self.manifest = replace(self.manifest, last_sequence=last)
        self.counters["commit_count"] += 1
        self.counters["committed_operations"] += len(rows)
        self.counters["committed_bytes"] += size
        self.counters["max_batch_operations"] = max([self.counters["max_batch_operations"], *map(len, group)])

    def load(self, ops: DataFrame, positions: list[str]) -> None:
        """Commits a large table of (k, deleted, v) as one run of level 0, with sequences in the order of `positions` columns, which are unique together.

        Rows are numbered range by range of the order: no task sees all of them.
        """
        self._check()
        with self._one:
            self.flush()
            with self._mutex:
                self._load_rows(ops, positions)
        self.maintain()

    def _load_rows(self, ops: DataFrame, positions: list[str]) -> None:
        if not ops.filter(~key_valid(F.col("k"))).isEmpty():
            raise StoreError("InvalidArgument", "a key is empty or has TAB, NL or NUL")
        dealt = ops.repartitionByRange(*positions).sortWithinPartitions(*positions).withColumn("place", F.monotonically_increasing_id())
        staging = f"{self.path}/staging"
        dealt.withColumn("part", F.shiftright("place", 33)).write.mode("overwrite").parquet(staging)
        dealt = self.spark.read.parquet(staging)
        starts, total = {}, self.manifest.last_sequence
        for part, n in sorted(map(tuple, dealt.groupBy("part").count().collect())):  # a row a partition
            starts[part], total = total, total + n
        if total == self.manifest.last_sequence:
            return
        start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("part")]
        inside = F.col("place").bitwiseAND((1 << 33) - 1)
        rows = dealt.select(F.col("k").cast("binary"), (start + inside + 1).cast("long").alias("seq"), "deleted", F.coalesce(F.col("v").cast("binary"), F.lit(b"")).alias("v"))
        self._publish(rows, 0, [], self.files.size("staging"), flushed=total)
        self.files.delete("staging")

    # reads

    def _scan(self, run: RunFile) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{run.path}")

    def _tail(self, commits: list[tuple[int, int, str]] | None = None) -> DataFrame:
        kept = [f"{self.path}/{name}" for _, _, name in (self.commits if commits is None else commits)]
        if not kept:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema("seq long, deleted boolean, k string, v string, crc long").option("mode", "FAILFAST").json(kept)
        decoded = rows.select(F.unbase64("k").alias("k"), "seq", "deleted", F.unbase64("v").alias("v"), "crc")
        sound = F.crc32(F.concat("k", "v")) == F.col("crc")
        return decoded.select("k", F.when(sound, F.col("seq")).otherwise(F.raise_error(F.lit("Corruption: checksum of a commit")).cast("long")).alias("seq"), "deleted", "v")

    def versions(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions of keys from low to high (both included): the runs whose range the manifest has there, and the tail."""
        if not self.is_open:
            raise StoreError("IOError", "closed")
        out = self._tail()
        for run in self.manifest.runs:
            met = (run.low is None) or ((high is None or run.low <= high.hex()) and (low is None or run.high >= low.hex()))
            self.counters["runs_read" if met else "runs_skipped"] += 1
            if met:
                out = out.unionByName(self._scan(run))
        if low is not None:
            out = out.filter(F.col("k") >= F.lit(low))
        return out if high is None else out.filter(F.col("k") <= F.lit(high))

    def _at(self, snapshot: Snapshot | None) -> int:
        if snapshot is None:
            return self.manifest.last_sequence
        if snapshot.store is not self or not snapshot.active:
            raise StoreError("InvalidArgument", "the snapshot isn't one of this open table")
        return snapshot.sequence

    def view(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The live (k, seq, v) as of a snapshot, or now."""
        return view.visible(self.versions(), self._at(snapshot)).select("k", "seq", "v")

    def get(self, key: bytes | str, snapshot: Snapshot | None = None) -> bytes | None:
        key = _bytes(key)
        if not key or any(x in key for x in _FORBIDDEN):
            raise StoreError("InvalidArgument", "a key is empty or has TAB, NL or NUL")
        row = view.get(self.versions(key, key), key, self._at(snapshot)).first()
        return None if row is None else bytes(row["v"])

    def seek(self, target: bytes | str = b"", limit: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """(k, seq, v) in order from target on."""
        low = _bytes(target) or None
        return view.seek(self.versions(low), limit=limit, snapshot=self._at(snapshot)).select("k", "seq", "v")

    def cursor(self, target: bytes | str = b"", snapshot: Snapshot | None = None) -> Cursor:
        """A place in the live rows in order of key, at the first key from target on."""
        return Cursor(self, snapshot or self.snapshot(), target)

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """keys (k) with the value of each, or null."""
        return keys.join(self.view(snapshot), "k", "left")

    def snapshot(self) -> Snapshot | None:
        """A pin at the last sequence; None when closed."""
        if not self.is_open:
            return None
        self.snapshots.append(Snapshot(self, self.manifest.last_sequence))
        return self.snapshots[-1]

    def release(self, snapshot: Snapshot | None) -> None:
        """Ends a pin; None, foreign and released ones are ignored."""
        if snapshot in self.snapshots:
            self.snapshots.remove(snapshot)
            snapshot.active = False

    # maintenance

    def _describe(self, number: int, level: int, path: str) -> tuple[RunFile, int]:
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{path}")
        logical = F.sum(F.octet_length("k") + F.octet_length("v") + F.lit(21))
        r = rows.agg(F.hex(F.min("k")).alias("lo"), F.hex(F.max("k")).alias("hi"), F.count(F.lit(1)).alias("n"), logical.alias("size")).first()
        low, high = (None if x is None else x.lower() for x in (r["lo"], r["hi"]))
        return RunFile(number, level, r["size"] or 0, r["n"], low, high, path), r["n"]

    def _publish(self, rows: DataFrame, level: int, inputs: list[RunFile], size: int, flushed: int | None = None) -> None:
        """Writes a run of about `size` bytes sorted by key and falling sequence, ranges of keys side by side, and has the manifest name it in place of its inputs."""
        with self._mutex:
            number = self.manifest.next_number
            self.manifest = replace(self.manifest, next_number=number + 1)
        path = f"runs/run_{number:06d}"
        self.files.delete(path)
        # what a split-block filter with so many bits a key errs at; Parquet derives sizes from it
        wrong = (1 - math.exp(-8 / self.options.bloom_bits)) ** 8
        n_files = max(1, -(-size // self.options.file_bytes))
        writer = (
            rows.select("k", "seq", "deleted", "v")
            .repartitionByRange(n_files, "k")
            .sortWithinPartitions("k", F.col("seq").desc())
            .write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#k", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("parquet.bloom.filter.fpp#k", repr(wrong))
            .option("parquet.bloom.filter.candidates.number#k", "15")
            .option("parquet.bloom.filter.max.bytes", str(BLOOM_BYTES))
        )
        writer.parquet(f"{self.path}/{path}")
        run, _ = self._describe(number, level, path)
        self.options.before("publish")
        with self._mutex:
            live, gone = {r.number for r in self.manifest.runs}, {r.number for r in inputs}
            if not gone <= live:
                return  # another publish was first: the output is left for vacuum()
            runs = tuple(r for r in self.manifest.runs if r.number not in gone) + (run,)
            moved = {} if flushed is None else {"flushed": flushed, "last_sequence": max(flushed, self.manifest.last_sequence)}
            self._save(replace(self.manifest, runs=runs, **moved))

    def flush(self) -> None:
        """Moves the tail to a run of level 0, with all of its versions."""
        self._check()
        with self._one:
            with self._mutex:
                taken = list(self.commits)
            if not taken:
                return
            self.options.before("flush")
            self._publish(self._tail(taken), 0, [], sum(self.files.size(name) for _, _, name in taken), flushed=taken[-1][1])
            with self._mutex:
                self.commits = self.commits[len(taken) :]
            for _, _, name in taken:
                self.files.delete(name)
            self.counters["flush_count"] += 1
        self._event("flush")

    def compact(self) -> bool:
        """One pass over the runs; the tail isn't flushed. False if there is nothing to do."""
        self._check()
        with self._one:
            chosen = choose(list(self.manifest.runs))
            if chosen is None:
                return False
            inputs, level = chosen
            rows = self._scan(inputs[0])
            for run in inputs[1:]:
                rows = rows.unionByName(self._scan(run))
            oldest = min((s.sequence for s in self.snapshots), default=0)
            self._publish(compaction.retain(rows, last_level=level == 2, oldest_snapshot=oldest), level, inputs, sum(r.size for r in inputs))
            self.counters["compaction_count"] += 1
            self._event(f"compaction to level {level}")
            return True

    def maintain(self) -> None:
        """Compacts while the policy asks for it, a few passes at most."""
        for _ in range(PASSES):
            if not due(list(self.manifest.runs), self.options.policy) or not self.compact():
                break

    def vacuum(self) -> list[str]:
        """Removes runs, manifests and commits that the table no longer names. Readers of an older manifest must be done."""
        self._check()
        live = {r.path for r in self.manifest.runs}
        gone = [f"runs/{n}" for n in self.files.names("runs") if f"runs/{n}" not in live]
        gone += [f"manifest/{n}" for n in self.files.names("manifest") if n != f"{self.manifest.version:06d}.json"]
        named = {name for _, _, name in self.commits}
        gone += [f"log/{n}" for n in self.files.names("log") if f"log/{n}" not in named]
        for name in gone:
            self.files.delete(name)
        return gone

    def stats(self) -> dict[str, int]:
        """Counts of this handle, and sizes of the table: runs, versions and bytes by level, and what the tail holds."""
        runs = self.manifest.runs
        levels = {f"level{k}_{what}": sum(of(r) for r in runs if r.level == k) for k in range(3) for what, of in (("run_count", lambda _: 1), ("versions", lambda r: r.versions), ("bytes", lambda r: r.size))}
        tail = {"tail_operations": self._tail_count(), "tail_commits": len(self.commits)}
        return {"run_count": len(runs), **levels, **tail, "last_sequence": self.manifest.last_sequence, **self.counters}

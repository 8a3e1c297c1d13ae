import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from siltlog.operators.batches import Batch, Limits
from siltlog.plans.policy import Policy
from siltlog.sources import Options, Store, StoreError
from siltlog.streaming import ingest


def small(**more):
    return Options(policy=Policy(tail_limit=8, level0_limit=2, level1_bytes=2000), **more)


def rows(frame):
    return {bytes(r["k"]): bytes(r["v"]) for r in frame.collect()}


def test_put_delete_and_reopen(spark, tmp_path):
    with Store(spark, str(tmp_path / "t")) as store:
        store.put("k1", "v1")
        store.put("k2", b"\t\n\x00binary")
        store.delete("k3")
        assert store.get("k2") == b"\t\n\x00binary"
        store.delete("k2")
        assert store.get("k2") is None and store.get("k1") == b"v1"
    with Store(spark, str(tmp_path / "t")) as store:
        assert rows(store.view()) == {b"k1": b"v1"}
        assert store.stats()["last_sequence"] == 4


def test_rejected_batch_changes_nothing(spark, tmp_path):
    with Store(spark, str(tmp_path / "t")) as store:
        for bad in ([("put", "a", "1"), ("put", "", "2")], [("put", "a\tb", "1")], [("add", "a", "1")]):
            with pytest.raises(StoreError, match="InvalidArgument"):
                store.write(bad)
        assert store.view().count() == 0 and store.manifest.last_sequence == 0


def test_lock_and_double_open(spark, tmp_path):
    with Store(spark, str(tmp_path / "t")) as store:
        with pytest.raises(StoreError, match="locked"):
            Store(spark, str(tmp_path / "t"))
        with pytest.raises(StoreError, match="already open"):
            store.open()
    store.close()
    with pytest.raises(StoreError, match="closed"):
        store.view()


def test_snapshot_is_stable_over_flush_and_compaction(spark, tmp_path):
    with Store(spark, str(tmp_path / "t"), small()) as store:
        store.write([("put", "a", "old"), ("put", "b", "old")])
        pin = store.snapshot()
        store.write([("put", "a", "new"), ("delete", "b"), ("put", "c", "new")])
        store.flush()
        store.compact()
        assert rows(store.view(pin)) == {b"a": b"old", b"b": b"old"}
        assert rows(store.view()) == {b"a": b"new", b"c": b"new"}
        assert [bytes(r["k"]) for r in store.seek("b").collect()] == [b"c"]
        store.release(pin)
        with pytest.raises(StoreError, match="snapshot"):
            store.view(pin)


def test_failed_manifest_poisons_and_reopen_decides(spark, tmp_path):
    def before(step):
        if step == "manifest":
            raise OSError("no space")

    store = Store(spark, str(tmp_path / "t"), Options(before=before))
    store.put("a", "1")
    with pytest.raises(StoreError, match="no space"):
        store.flush()
    with pytest.raises(StoreError, match="no space"):
        store.put("b", "2")
    with pytest.raises(StoreError):
        store.close()
    with Store(spark, str(tmp_path / "t")) as store:
        assert rows(store.view()) == {b"a": b"1"}
        store.flush()
        store.vacuum()
        assert rows(store.view()) == {b"a": b"1"}


def test_bulk_load_and_streaming_ingest(spark, tmp_path):
    source = tmp_path / "in"
    data = spark.range(200).select(F.concat(F.lit("k"), F.col("id") % 20).alias("k"), (F.col("id") % 7 == 0).alias("deleted"), F.col("id").cast("string").alias("v"), "id")
    data.repartition(3).write.parquet(str(source))
    expected = {f"k{i % 20}".encode(): str(i).encode() for i in range(180, 200) if i % 7}
    with Store(spark, str(tmp_path / "t")) as store:
        store.load(data, ["id"])
        assert rows(store.view()) == expected and store.manifest.last_sequence == 200
    with Store(spark, str(tmp_path / "s")) as store:
        for _ in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema(data.schema).parquet(str(source))
            ingest(stream, store, str(tmp_path / "check"), ["id"]).awaitTermination()
        assert rows(store.view()) == expected and store.manifest.last_sequence == 200


def test_bloom_bits_set_the_size_of_filters(spark, tmp_path):
    frame = spark.range(0, 4000, 1, 1).select(F.col("id").alias("event_id"), F.md5(F.col("id").cast("string")).alias("k"), F.lit(False).alias("deleted"), F.lit("v").alias("v"))
    sizes = []
    for bits in (4, 32):
        with Store(spark, str(tmp_path / str(bits)), Options(bloom_bits=bits)) as store:
            store.load(frame, ["event_id"])
            assert store.get("cfcd208495d565ef66e7dff9f98764da") == b"v"
        sizes.append(sum(p.stat().st_size for p in (tmp_path / str(bits)).rglob("*.parquet")))
    assert 12_000 < sizes[1] - sizes[0] < 20_000  # 2 kB and 16 kB


def test_random_operations_against_a_dictionary(spark, tmp_path):
    rng = random.Random(20)
    model, path, pins = {}, str(tmp_path / "t"), []
    store = Store(spark, path, small())
    for step in range(12):
        batch = []
        for _ in range(rng.randint(1, 6)):
            key = f"k{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                batch.append(("delete", key))
                model.pop(key.encode(), None)
            else:
                batch.append(("put", key, f"v{step}-{len(batch)}"))
                model[key.encode()] = batch[-1][2].encode()
        store.write(batch)
        action = rng.choice(["flush", "compact", "reopen", "pin", "none"])
        if action == "reopen":
            store.close()
            store, pins = Store(spark, path, small()), []
        elif action == "pin":
            pins.append((store.snapshot(), dict(model)))
        elif action != "none":
            getattr(store, action)()
    assert rows(store.view()) == model
    for pin, seen in pins:
        assert rows(store.view(pin)) == seen
    store.close()


def test_command_line(spark, tmp_path, capfdbinary):
    from siltlog.__main__ import parse_batch, run

    with Store(spark, str(tmp_path / "t")) as store:
        assert run(store, "write", ["put", "a", "1", "delete", "b", "put", "c", "3"]) == 0
        assert run(store, "get", ["a"]) == 0 and run(store, "get", ["b"]) == 1
        assert run(store, "scan", ["b"]) == 0
        with pytest.raises(StoreError, match="InvalidArgument"):
            run(store, "put", ["a"])
    assert capfdbinary.readouterr().out.endswith(b"c\t3\n")
    assert parse_batch(["put", "k", "v"]) == [("put", "k", "v")]


def test_lock_of_a_killed_holder_expires(spark, tmp_path):
    path = str(tmp_path / "t")
    store = Store(spark, path, Options(lease=1.5))
    store.put("a", "1")
    time.sleep(2)
    with pytest.raises(StoreError, match="locked"):  # it was renewed
        Store(spark, path)
    store.lock._end.set()  # as if the process had been killed
    time.sleep(2)
    with Store(spark, path) as other:
        assert rows(other.view()) == {b"a": b"1"}
        with pytest.raises(StoreError, match="lock"):
            store.put("b", "2")
        other.put("c", "3")
    with pytest.raises(StoreError, match="lock"):
        store.close()


def test_background_maintenance(spark, tmp_path):
    with Store(spark, str(tmp_path / "t"), small(background=True)) as store:
        for i in range(30):
            store.put(f"k{i % 9}", str(i))
        want = {f"k{i % 9}".encode(): str(i).encode() for i in range(30)}
        assert rows(store.view()) == want
        for _ in range(100):
            if store.stats()["flush_count"]:
                break
            time.sleep(0.1)
        assert store.stats()["flush_count"] >= 1
        store.drain()
    with Store(spark, str(tmp_path / "t")) as store:
        assert rows(store.view()) == want and store.stats()["tail_operations"] == 0


def test_large_loads_are_written_by_many_tasks(spark, tmp_path):
    frame = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.lit(False).alias("deleted"), F.sha2(F.col("id").cast("string"), 256).alias("v"), "id")
    with Store(spark, str(tmp_path / "t"), Options(file_bytes=200_000)) as store:
        store.load(frame, ["id"])
        run = store.manifest.runs[0]
        assert len(list((tmp_path / "t" / run.path).glob("*.parquet"))) > 4
        assert store.view().count() == 20_000
        store.get("0")
        store.get("ffffffffffffffffffffffffffffffffffff")
        assert store.stats()["runs_skipped"] == 2


def test_groups_and_limits(spark, tmp_path):
    with Store(spark, str(tmp_path / "t"), Options(group_bytes=54, limits=Limits(operations=3, value=10))) as store:
        store.write_all([[("put", "x", "A"), ("put", "p", "1"), ("put", "q", "2")], [("delete", "x"), ("put", "x", "B")], [("put", "x", "C"), ("delete", "m")]])
        assert store.stats()["commit_count"] == 2 and store.stats()["committed_operations"] == 7 and store.get("x") == b"C"
        for bad, why in (([("put", "a", "1")] * 4, "operations"), ([("put", "a", "x" * 11)], "value")):
            with pytest.raises(StoreError, match=why):
                store.write(bad)
        batch = Batch().put(b"a", b"1").delete(b"b")
        store.write(batch)
        assert store.get("a") == b"1"


def test_batch_encoding():
    batch = Batch().put(b"k", b"\x00v").delete(b"d").put(b"e", b"")
    assert Batch.decode(batch.encode()).operations == batch.operations and len(Batch.decode(b"")) == 0
    for bad in (batch.encode()[:-1], b"\x03" + bytes(8), b"\x02\x01\x00\x00\x00\x01\x00\x00\x00kv", b"\x01\x00"):
        with pytest.raises(ValueError):
            Batch.decode(bad)
    batch.append(batch)
    assert len(batch) == 6
    batch.clear()
    assert len(batch) == 0


def test_cursor(spark, tmp_path):
    with Store(spark, str(tmp_path / "t")) as store:
        store.write([("put", "a", "1"), ("put", "b", "2"), ("put", "c", "3"), ("delete", "b")])
        cursor = store.cursor()
        store.write([("put", "d", "4"), ("delete", "a")])
        seen = []
        while cursor.valid:
            seen.append((cursor.key, cursor.value))
            cursor.next()
        assert seen == [(b"a", b"1"), (b"c", b"3")] and cursor.error is None
        cursor.seek("b")
        assert (cursor.valid, cursor.key) == (True, b"c")
        latest = store.cursor("d")
        assert latest.key == b"d"
        latest.next()
        assert not latest.valid and latest.key is None


def test_command_line_exit_codes(spark, tmp_path, capfdbinary):
    from siltlog.__main__ import main

    path = str(tmp_path / "t")
    assert main([path, "put", "a", "1"]) == 0 and main([path, "get", "a"]) == 0 and main([path, "get", "b"]) == 1
    assert main([path]) == 2 and main([path, "nothing"]) == 2 and main([path, "put", "", "1"]) == 2
    assert main([path, "compact"]) == 0 and main([path, "status"]) == 0
    (tmp_path / "t" / "CURRENT").write_text("000099.json")
    assert main([path, "get", "a"]) == 3
    assert b"1\n" in capfdbinary.readouterr().out


def test_damaged_commits_are_found(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    store.put("a", "1")
    (file,) = (tmp_path / "t" / "log").glob("commit_*.json")
    file.write_text(file.read_text().replace(base64.b64encode(b"1").decode(), base64.b64encode(b"2").decode()))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="checksum of a commit"):
        store.view().collect()
    store.commits = []
    store.close()
    torn = '{"seq": 1, "deleted": false, "k": "YQ=='
    file.write_text(torn)
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    store = Store(spark, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)malformed"):
        store.view().collect()
    store.commits = []
    store.close()
    (file.parent / "commit_0000000000000000001_0000000000000000002.json").write_text("")
    with pytest.raises(StoreError, match="overlaps"):
        Store(spark, str(tmp_path / "t"))

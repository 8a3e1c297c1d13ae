import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltlog import vectors
from siltlog.functions import codecs
from siltlog.operators import bloom, measure, ranges
from siltlog.replication import state, transfer
from siltlog.replication.state import NodeState, StateFile
from siltlog.sources import Store, StoreError
from siltlog.sources.files import Files


def column(spark, values, kind, *exprs):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(*exprs).collect()]


def test_fixed_numbers(spark):
    numbers = [0, 1, 255, 256, (1 << 32) - 1, 1 << 32, (1 << 63) - 1, None, -1]
    x = F.col("x")
    got = column(spark, numbers, "long", codecs.encode_fixed(x, 4), codecs.encode_fixed(x, 8))
    for n, (a, b) in zip(numbers, got, strict=True):
        assert (a and bytes(a)) == (None if n is None or not 0 <= n < 1 << 32 else n.to_bytes(4, "little"))
        assert (b and bytes(b)) == (None if n is None or n < 0 else n.to_bytes(8, "little"))
    data = [n.to_bytes(8, "little") for n in numbers[:7]] + [b"\xff" * 8, b"abc", None]
    assert [r[0] for r in column(spark, data, "binary", codecs.decode_fixed(x, 8))] == [*numbers[:7], None, None, None]


def test_internal_keys_sort_by_key_and_falling_sequence(spark):
    pairs = [(k, s) for k in ("a", "ab", "b", "é") for s in (0, 1, 255, 256, (1 << 63) - 1)]
    rows = spark.createDataFrame(pairs, "k string, s long").withColumn("d", codecs.internal_key(F.col("k"), F.col("s")))
    back = rows.select("k", "s", "d", codecs.user_key(F.col("d")).cast("string").alias("k2"), codecs.key_sequence(F.col("d")).alias("s2")).collect()
    assert all((r["k"], r["s"]) == (r["k2"], r["s2"]) for r in back)
    assert [(r["k"], r["s"]) for r in sorted(back, key=lambda r: bytes(r["d"]))] == sorted(pairs, key=lambda p: (p[0].encode(), -p[1]))
    assert column(spark, [b"short", b"x" * 20], "binary", codecs.user_key(F.col("x")), codecs.key_sequence(F.col("x"))) == [(None, None)] * 2


def test_strings_states_and_addresses(spark):
    x = F.col("x")
    texts = ["", "plain", 'a"b', "back\\slash", '\\"', "line\nbreak"]
    assert [r[0] for r in column(spark, texts, "string", codecs.unquoted(codecs.quoted(x)))] == texts
    assert [r[0] for r in column(spark, ['a"', '"a', "a"], "string", codecs.unquoted(x))] == [None] * 3
    names = ["OK", "NotFound", "InvalidArgument", "IOError", "Corruption", "?"]
    assert [r[0] for r in column(spark, names, "string", codecs.reply_code(x))] == [1, 2, 3, 4, 5, 4]
    assert [r[0] for r in column(spark, [1, 2, 3, 4, 5, 0], "int", codecs.reply_state(x))] == [*names[:5], "Corruption"]
    good = ["127.0.0.1:80", "255.0.10.1:65535"]
    bad = ["127.0.0.1:0", "127.0.0.1:65536", "256.0.0.1:1", "1.2.3:4", "host:1", "1.2.3.4:", "1.2.3.4:5x", "01.2.3.4:5", None]
    got = [r[0] for r in column(spark, good + bad, "string", codecs.endpoint(x))]
    assert [tuple(r) for r in got[:2]] == [("127.0.0.1", 80), ("255.0.10.1", 65535)] and got[2:] == [None] * len(bad)
    frame = spark.createDataFrame([("c", 2, ["a:1", "b:2"], ["a:3", "b:4"])], "n string, i int, c array<string>, p array<string>")
    assert frame.select(codecs.cluster_identity(F.col("n"), F.col("i"), F.col("c"), F.col("p"))).first()[0] == "c\n2\na:1 a:3\nb:2 b:4"
    assert [r[0] for r in column(spark, [3, 4, 6], "long", codecs.log_offset(x, F.lit(3)))] == [None, 0, 2]


def test_key_filters(spark):
    ops = spark.range(40_000).select((F.col("id") % 3).alias("run"), F.concat(F.lit("k"), "id").alias("k"))
    filters = bloom.build_filters(ops, bits_per_key=10)
    assert filters.select("run", "part").distinct().count() == filters.count() > 3
    assert bloom.sound(filters).filter("not ok").count() == 0
    inside = bloom.may_contain(ops.sample(0.1, seed=1), filters)
    assert inside.filter("not maybe").count() == 0
    outside = spark.range(10_000).select((F.col("id") % 3).alias("run"), F.concat(F.lit("other"), "id").alias("k"))
    assert 20 < bloom.may_contain(outside, filters).filter("maybe").count() < 300  # about 1 %
    assert bloom.may_contain(outside.withColumn("run", F.lit(9).cast("long")).limit(5), filters).filter("maybe").count() == 5
    broken = filters.limit(2).withColumn("hashes", F.lit(31))
    assert bloom.sound(broken).filter("ok").count() == 0
    assert [bloom.filter_hashes(b) for b in (1, 10, 64)] == [1, 6, 30]


def test_range_joins(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SPLITS", 3)
    rng = random.Random(5)
    bounds = [tuple(sorted((f"{rng.randint(0, 99):02d}", f"{rng.randint(0, 99):02d}"))) for _ in range(30)]
    runs = spark.createDataFrame([(i, *b) for i, b in enumerate(bounds)], "run int, lo string, hi string")
    keys = spark.createDataFrame([(f"{i:02d}",) for i in range(100)], "k string")
    got = sorted(map(tuple, ranges.containing(keys, "k", runs, "lo", "hi").select("k", "run").collect()))
    assert got == sorted((f"{i:02d}", j) for i in range(100) for j, (a, b) in enumerate(bounds) if a <= f"{i:02d}" <= b)
    pairs = sorted(map(tuple, ranges.overlapping(runs, "run", "lo", "hi").collect()))
    assert pairs == sorted((i, j) for i in range(30) for j in range(i + 1, 30) if bounds[i][0] <= bounds[j][1] and bounds[j][0] <= bounds[i][1])
    assert ranges.containing(keys, "k", runs.limit(0), "lo", "hi").count() == 0


@pytest.fixture
def joined(monkeypatch, spark):
    """What each join gets: its sides and columns."""
    frame, seen = type(spark.range(0)), []
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, on=None, how=None: (seen.append((self, other, on)), join(self, other, on, how))[1])
    return seen


def wide(spark, n):
    """Ranges of different bounds that all overlap."""
    return spark.createDataFrame([(i, f"{i:04d}", f"{n + i:04d}") for i in range(n)], "run int, lo string, hi string")


def test_wide_ranges_are_dealt_to_few_nodes(spark, joined):
    keys = spark.createDataFrame([(f"{i:04d}",) for i in (0, 150, 399)], "k string")
    assert len(ranges.containing(keys, "k", wide(spark, 400), "lo", "hi").select("k", "run").collect()) == 1 + 151 + 400
    _, dealt, on = joined[-1]
    assert dealt.groupBy(on).count().agg(F.sum("count")).first()[0] <= 400 * 2 * 11  # by buckets it would be 400 each


def test_overlaps_are_compared_once(spark, joined):
    assert ranges.overlapping(wide(spark, 300), "run", "lo", "hi").count() == 300 * 299 // 2
    a, b, on = joined[-1]
    met = a.groupBy(on).count().withColumnRenamed("count", "n").join(b.groupBy(on).count(), on)
    assert met.agg(F.sum(F.col("n") * F.col("count"))).first()[0] <= 3 * 300 * 299 // 2  # by buckets it would be all pairs in each


@pytest.mark.parametrize(("cuts", "most", "node"), [(3, 1 << 16, 9), (1, 1 << 16, 9), (7, 5, 3), (1024, 5, 1)])
def test_range_joins_by_nodes(spark, monkeypatch, cuts, most, node):
    for name, value in (("SPLITS", cuts), ("BROADCAST", most), ("NODE", node)):
        monkeypatch.setattr(ranges, name, value)
    rng = random.Random(cuts)
    bounds = [tuple(sorted((f"{rng.randint(0, 99):02d}", f"{rng.randint(0, 99):02d}"))) for _ in range(30)] + [("50", "40"), ("10", "10"), (None, "40"), ("10", None)]
    runs = spark.createDataFrame([(i, *b) for i, b in enumerate(bounds)], "run int, lo string, hi string")
    keys = spark.createDataFrame([(f"{i:02d}",) for i in range(100)] + [(None,)], "k string")

    def upto(a, b):
        return a is not None and b is not None and a <= b

    got = sorted(map(tuple, ranges.containing(keys, "k", runs, "lo", "hi").select("k", "run").collect()))
    assert got == sorted((f"{i:02d}", j) for i in range(100) for j, (a, b) in enumerate(bounds) if upto(a, f"{i:02d}") and upto(f"{i:02d}", b))
    pairs = sorted(map(tuple, ranges.overlapping(runs, "run", "lo", "hi").collect()))
    assert pairs == sorted((i, j) for i in range(34) for j in range(i + 1, 34) if upto(bounds[i][0], bounds[j][1]) and upto(bounds[j][0], bounds[i][1]))


def test_export_is_checked_and_restored(spark, tmp_path):
    rows = {f"key{i:05d}".encode(): (b"" if i % 9 == 0 else bytes([i % 256]) * (i % 2000)) for i in range(3000)}
    with Store(spark, str(tmp_path / "a")) as store, Store(spark, str(tmp_path / "b")) as other:
        frame = spark.createDataFrame([(k, False, v, i) for i, (k, v) in enumerate(rows.items())], "k binary, deleted boolean, v binary, i long")
        store.load(frame, ["i"])
        path = str(tmp_path / "x")
        header = transfer.export(store.view().select("k", "v"), path, 7, 2, partitions=4)
        assert header["rows"] == 3000 and header["records"] > 4
        records = spark.read.parquet(f"{path}/records")
        assert records.agg(F.max(F.octet_length("payload"))).first()[0] <= transfer.RECORD_BYTES
        transfer.restore(spark, path, other)
        assert {bytes(r["k"]): bytes(r["v"]) for r in other.view().collect()} == rows
    whole = [r.asDict() for r in records.collect()]
    flipped = bytearray(whole[0]["payload"])
    flipped[-1] ^= 1
    damages = [whole[1:], [*whole, whole[0]], [{**whole[0], "payload": flipped}, *whole[1:]], [{**whole[0], "place": 9}, *whole[1:]], [{**whole[0], "payload": whole[1]["payload"], "crc": zlib.crc32(whole[1]["payload"])}, *whole[1:]]]
    for i, damage in enumerate(damages):
        bad = str(tmp_path / f"bad{i}")
        spark.createDataFrame([tuple(r[c] for c in records.columns) for r in damage], records.schema).write.parquet(f"{bad}/records")
        Files(spark, bad).replace("header.json", Files(spark, path).read("header.json"))
        with pytest.raises(StoreError, match="Corruption"):
            transfer.validate(spark, bad)
    with pytest.raises(StoreError, match="no end"):
        transfer.validate(spark, str(tmp_path / "none"))
    for name in ("1.snapshot", "2.snapshot", "keep.txt"):
        (tmp_path / "x" / name).write_text("")
    assert transfer.remove_obsolete(spark, path, "2.snapshot") == ["1.snapshot"]


def test_chunks(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 300), ("c", 0)], "name string, size long")
    plan = transfer.chunk_plan(sizes, 256)
    assert sorted(map(tuple, plan.collect())) == [("a", 0, 256), ("a", 256, 256), ("a", 512, 256), ("a", 768, 232), ("b", 0, 256), ("b", 256, 44)]
    came = plan.filter("not (name = 'a' and offset = 512)").union(plan.limit(2))
    assert sorted(map(tuple, transfer.received(came, sizes).collect())) == [("a", 512, False), ("b", 300, True), ("c", 0, True)]
    assert sorted(map(tuple, transfer.received(plan.filter("offset > 0"), sizes).collect()))[0] == ("a", 0, False)


def entries(spark, terms, first=1):
    return spark.createDataFrame([(first + i, t, [("put", f"k{i % 2}", f"v{i}")]) for i, t in enumerate(terms)], "idx long, term long, batch array<struct<op:string,k:string,v:string>>")


def test_state_rules(spark, tmp_path):
    first = NodeState("n1", term=2, voted_for=3)
    assert first.observe(1) is first and first.observe(4) == NodeState("n1", term=4)
    assert first.vote(2, 2, True) == (first, False) and first.vote(2, 3, True) == (NodeState("n1", term=3, voted_for=2), True)
    assert first.vote(3, 2, True)[1] and not first.vote(2, 3, False)[1]
    log = entries(spark, [1, 1, 2, 2])
    held = NodeState("n1", term=2, commit=3)
    shorter, cut = state.truncated(log, held, 2, 100)
    assert [r["idx"] for r in shorter.orderBy("idx").collect()] == [3, 4] and (cut.snapshot_index, cut.snapshot_term) == (2, 1)
    assert state.term_at(shorter, cut, 2) == 1 and state.term_at(shorter, cut, 4) == 2 and state.term_at(shorter, cut, 9) is None
    with pytest.raises(ValueError, match="committed"):
        state.truncated(log, held, 4, 100)
    same, new = state.installed(log, held, 4, 2, 50)
    assert same.count() == 0 and new.commit == 4
    kept, new = state.installed(entries(spark, [1, 1, 2, 2, 2]), NodeState("n1", term=2, commit=1), 3, 2, 50)
    assert [r["idx"] for r in kept.orderBy("idx").collect()] == [4, 5] and new.commit == 3
    assert state.installed(log, NodeState("n1", term=2, commit=1), 3, 9, 50)[0].count() == 0
    assert state.installed(log, held, 2, 1, 50) == (log, held)
    assert [r["idx"] for r in state.bad_terms(entries(spark, [1, 2, 1, 0, 9]), held).orderBy("idx").collect()] == [3, 4, 5]
    file = StateFile(spark, str(tmp_path / "n"), "n1")
    assert file.load(0) == NodeState("n1")
    file.save(cut)
    assert file.load(4) == cut
    with pytest.raises(StoreError, match="outside"):
        file.load(2)
    with pytest.raises(StoreError, match="another"):
        StateFile(spark, str(tmp_path / "n"), "n2").load(4)
    text = file.files.read("state.json")
    file.files.replace("state.json", text.replace("snapshot_index", "snapshot_indey"))
    with pytest.raises(StoreError, match="checksum"):
        file.load(4)
    file.files.replace = lambda *_: (_ for _ in ()).throw(OSError("full"))
    for _ in range(2):  # the first error stays
        with pytest.raises(StoreError, match="full"):
            file.save(cut)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x").write_text("")
    with pytest.raises(StoreError, match="no state"):
        StateFile(spark, str(tmp_path / "odd"), "n1").load(0)


def test_apply_and_info(spark, tmp_path):
    log = entries(spark, [1, 1, 2, 2])
    with Store(spark, str(tmp_path / "t")) as store:
        assert state.apply_committed(store, log, 0, 3) == 3 and state.apply_committed(store, log, 3, 3) == 3
        assert {r["k"].decode(): r["v"].decode() for r in store.view().collect()} == {"k0": "v2", "k1": "v1"}
        assert state.apply_committed(store, log, 3, 4) == 4 and store.get("k1") == b"v3" and store.stats()["last_sequence"] == 4
    info = state.node_info(spark, 1, 1, log, NodeState("n", term=2, commit=4), 4).first()
    assert (info["is_leader"], info["last_index"], info["applied_index"], info["error"]) == (True, 4, 4, None)


def test_percentiles_and_intervals(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randint(0, 50)) for _ in range(400)]
    got = measure.percentiles(spark.createDataFrame(rows, "g string, x int"), ["g"], "x", [0.5, 0.99]).collect()
    for r in got:
        own = sorted(x for g, x in rows if g == r["g"])
        assert (r["p50"], r["p99"]) == tuple(own[-(-int(s * 100) * len(own) // 100) - 1] for s in (0.5, 0.99))
    low, high = measure.median_interval([1.0, 2.0, 3.0, 4.0, 100.0])
    assert 1.0 <= low <= 3.0 <= high <= 100.0 and measure.median_interval([5.0]) == (5.0, 5.0)


@pytest.mark.parametrize("metric", ["l2", "inner", "cosine"])
def test_batch_search_equals_single_searches(spark, metric):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [1.0]), (302, [0.5] * 8), (303, [0.5] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    wanted = frame.filter("vec_id in (5, 100, 302)")
    got = vectors.search_batch(frame, wanted, 4, metric, block=2).collect()
    for q in (5, 100, 302):
        single = vectors.top_k(frame.filter("size(embedding) = 8"), rows[q][1], 4, metric).collect()
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == [r["vec_id"] for r in single]
        assert [r["dist"] for r in mine] == pytest.approx([r["dist"] for r in single], abs=1e-9)


@pytest.mark.parametrize("metric", ["l2", "inner", "cosine"])
def test_batch_search_holds_few_numbers(metric):
    rng = np.random.default_rng(4)
    queries, own = rng.normal(size=(1000, 8)), np.round(rng.normal(size=(10_000, 8)), 1).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(list(own), pa.list_(pa.float32()))], ["id", "vector"])
    tracemalloc.start()
    got = next(vectors._nearest([batch], list(range(1000)), queries, 3, metric))
    assert tracemalloc.get_traced_memory()[1] < 60e6  # a distance for each pair would take 80 MB
    tracemalloc.stop()
    for q in (0, 500, 999):
        x = own.astype(float)
        dist = {"l2": np.sqrt(np.square(x - queries[q]).sum(axis=1)), "inner": -(x @ queries[q]), "cosine": 1 - x @ queries[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(queries[q])}[metric]
        assert [r["id"] for r in got.slice(q * 3, 3).to_pylist()] == np.lexsort((np.arange(10_000), dist))[:3].tolist()


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
def test_batch_search_of_equal_and_odd_vectors(monkeypatch, cells):
    monkeypatch.setattr(vectors, "CELLS", cells)
    nan, inf = float("nan"), float("inf")
    rows = [[1e8 + (i % 3) * 1e-7, 0.1] for i in range(20)] + [None, [1.0], [None, 1.0], [nan, 0.0], [inf, 0.0], [1e200, 0.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.float64()))], ["id", "vector"])
    queries = np.array([[1e8, 0.1], [0.0, 0.0]])

    def dist(v, q):
        return sum(((a - b) ** 2 if abs(a - b) < 1e150 else inf if a == a else nan) for a, b in zip(v, q, strict=True)) ** 0.5

    for k in (1, 4, 25):
        got = next(vectors._nearest([batch.slice(0, 9), batch.slice(9)], ["a", "b"], queries, k, "l2")).to_pylist()
        for name, q in zip("ab", queries.tolist(), strict=True):
            want = sorted((d != d, 0.0 if d != d else d, i) for i, v in enumerate(rows) if v is not None and len(v) == 2 and None not in v for d in [dist(v, q)])[:k]
            assert [r["id"] for r in got if r["query_id"] == name] == [i for _, _, i in want]


def test_vectors_as_values(spark):
    frame = spark.createDataFrame([("a", [1.0, 2.5], "m"), ("b", [3.0], None)], "k string, x array<float>, m string")
    coded = frame.select("k", vectors.encode_vector(F.col("x"), F.col("m")).alias("v")).union(spark.createDataFrame([("c", "plain")], "k string, v string"))
    got = {r["k"]: r["d"] for r in coded.select("k", vectors.decode_vector(F.col("v").cast("binary")).alias("d")).collect()}
    assert (list(got["a"]["vector"]), got["a"]["metadata"]) == ([1.0, 2.5], "m") and list(got["b"]["vector"]) == [3.0] and got["c"] is None


def test_vectors_in_a_table_are_searched_at_a_snapshot(spark, tmp_path):
    def found(store, pin=None):
        rows = store.view(pin).select(F.col("k").cast("string").alias("vec_id"), vectors.decode_vector(F.col("v")).alias("d")).filter("d is not null")
        frame = rows.select("vec_id", F.col("d.vector").cast("array<double>").alias("embedding"))
        return [r["id"] for r in vectors.search_batch(frame, frame.filter("vec_id = 'a'"), 2).orderBy("rank").collect()]

    with Store(spark, str(tmp_path / "t")) as store:
        store.write([("put", "a", '{"vector":[0.0,0.0]}'), ("put", "b", '{"vector":[1.0,0.0]}'), ("put", "note", "plain"), ("put", "c", '{"vector":[0.0,3.0],"metadata":"m"}')])
        pin = store.snapshot()
        store.write([("delete", "b"), ("put", "d", '{"vector":[0.0,1.0]}')])
        assert found(store) == ["a", "d"] and found(store, pin) == ["a", "b"]

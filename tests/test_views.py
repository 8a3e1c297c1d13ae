import random

import pytest
from pyspark.sql import functions as F

from siltlog import functions, vectors
from siltlog.operators import batches, compaction, view
from siltlog.plans.policy import Policy, Run, choose, simulate
from siltlog.replication import log

SCHEMA = "k string, seq long, deleted boolean, v string, batch_id long, run long"


def make(spark, n=300, keys=20, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        gone = rng.random() < 0.25
        rows.append((f"k{rng.randrange(keys):02d}", i + 1, gone, "" if gone else f"v{i}", i // 7, i // 64))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def model(rows, at):
    out = {}
    for k, seq, gone, v, *_ in rows:
        if seq <= at:
            out.pop(k, None)
            if not gone:
                out[k] = v
    return out


def as_dict(frame):
    return {r["k"]: r["v"] for r in frame.collect()}


@pytest.mark.parametrize("at", [0, 1, 77, 300])
def test_view_equals_model(spark, at):
    rows, ops = make(spark)
    assert as_dict(view.visible(ops, at)) == model(rows, at)


def test_old_values_do_not_come_back(spark):
    ops = spark.createDataFrame([("a", 1, False, "x", 0, 0), ("a", 2, True, "", 0, 0)], SCHEMA)
    assert view.visible(ops).count() == 0 and view.get(ops, "a", 1).first()["v"] == "x"


def test_seek_lands_on_next_live_key(spark):
    ops = spark.createDataFrame([("a", 1, False, "1", 0, 0), ("b", 2, False, "2", 0, 0), ("b", 3, True, "", 0, 0), ("c", 4, False, "4", 0, 0)], SCHEMA)
    assert [r["k"] for r in view.seek(ops, "b", limit=1).collect()] == ["c"]
    assert [r["k"] for r in view.seek(ops, end="c").collect()] == ["a"]


@pytest.mark.parametrize("block", [1, 10, view.BLOCK])
def test_as_of_equals_model(spark, block):
    rows, ops = make(spark)
    wanted = [(i, f"k{i % 22:02d}", (i * 37) % 301) for i in range(60)]
    got = {r["probe_id"]: (r["status"], r["v"]) for r in view.as_of(spark.createDataFrame(wanted, "probe_id long, k string, s long"), ops, block=block).collect()}
    for i, k, s in wanted:
        live, any_ = model(rows, s), any(r[0] == k and r[1] <= s for r in rows)
        assert got[i] == (("ok", live[k]) if k in live else ("deleted" if any_ else "missing", None))


@pytest.mark.parametrize("pin", [0, 100])
@pytest.mark.parametrize("last_level", [False, True])
def test_compaction_keeps_every_pinned_view(spark, pin, last_level):
    rows, ops = make(spark)
    kept = compaction.retain(ops, last_level, pin)
    for at in {pin, 300} - {0}:
        assert as_dict(view.visible(kept, at)) == model(rows, at)
    if not pin:
        assert kept.count() == (len(model(rows, 300)) if last_level else len({r[0] for r in rows}))
    else:
        assert kept.filter("seq > 100").count() == 200
    assert compaction.differences(view.visible(ops), view.visible(kept)).first() == (0, 0)


def test_sequences_have_no_gaps(spark):
    rows, ops = make(spark)
    given = batches.assign_sequences(ops.select("batch_id", F.col("seq").alias("position")), base=5).collect()
    assert sorted((r["position"], r["seq"]) for r in given) == [(i, i + 5) for i in range(1, 301)]


def test_key_rules(spark):
    keys = [("ok",), ("",), ("a\tb",), ("a\nb",), ("a\x00b",), (None,)]
    assert [r[0] for r in spark.createDataFrame(keys, "k string").filter(functions.key_valid(F.col("k"))).collect()] == ["ok"]


def test_names_and_prefixes(spark):
    row = spark.range(1).select(
        functions.run_name(F.lit(7)), functions.run_name(F.lit(12345678)), functions.file_number(F.lit("run_000012")), functions.file_number(F.lit("run_000000")),
        functions.file_number(F.lit("x_000012")), functions.shared_prefix(F.lit("abcd"), F.lit("abxd")), functions.status_text(F.lit("NotFound"), F.lit("k")), functions.status_text(F.lit("OK"), F.lit("")),
    ).first()
    assert tuple(row) == ("run_000007", "run_12345678", 12, None, None, 2, "NotFound: k", "OK")


def test_group_commit_packing():
    assert list(batches.group_batches([10, 20, 30, 100, 0, 5], 60)) == [[0, 1, 2], [3], [4], [5]]
    assert list(batches.group_batches([30, 30, 30], 54)) == [[0], [1], [2]]


@pytest.mark.parametrize(
    ("n", "batch", "tail", "level0", "level1", "size", "expected"),
    [(100_000, 1, 1024, 4, 64 << 20, 100, (98, 19)), (100_000, 32, 1024, 4, 64 << 20, 100, (98, 19)), (10_000, 32, 256, 4, 64 << 10, 128, (40, 16)), (4, 1, 2, 1, 64 << 20, 3093, (2, 1)), (4, 1, 2, 1, 1024, 3093, (2, 2))],
)
def test_policy_gives_the_known_counts(n, batch, tail, level0, level1, size, expected):
    state = simulate([min(batch, n - i) for i in range(0, n, batch)], Policy(tail, level0, level1), size)
    assert (state.flushes, state.compactions) == expected


def test_compaction_inputs():
    runs = [Run(1, 0, 1, 1, "b", "d"), Run(2, 1, 1, 1, "a", "c"), Run(3, 1, 1, 1, "x", "z"), Run(4, 1, 1, 1, None, None)]
    inputs, level = choose(runs)
    assert ([r.number for r in inputs], level) == ([1, 2, 4], 1)
    assert choose([Run(1, 2, 1)]) is None


def test_log_append(spark):
    schema = "idx long, term long"
    own = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], schema)
    new = spark.createDataFrame([(2, 1), (3, 2), (4, 2)], schema)
    assert sorted(map(tuple, log.append_entries(own, new, 1, 1, commit=2).collect())) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert log.append_entries(own, new, 3, 9, commit=0) is None
    with pytest.raises(ValueError, match="committed"):
        log.append_entries(own, new, 1, 1, commit=3)
    assert log.may_vote(own, 1, 3) and not log.may_vote(own, 1, 2) and log.may_vote(own, 2, 1)


def test_rebuild_from_export_and_log(spark):
    batch = "array<struct<op:string,k:string,v:string>>"
    entries = spark.createDataFrame([(1, [("put", "a", "1"), ("put", "b", "1")]), (2, [("delete", "a", None), ("put", "c", "2")]), (3, [("put", "a", "3")])], f"idx long, batch {batch}")
    export = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    assert as_dict(log.rebuild(export, entries, 1, 2)) == {"b": "1", "c": "2"}
    assert as_dict(log.rebuild(export, entries, 1, 3)) == {"a": "3", "b": "1", "c": "2"}


def test_export_order(spark, tmp_path):
    rows, ops = make(spark)
    log.export_state(view.visible(ops), str(tmp_path / "x"), 3)
    exported = spark.read.parquet(str(tmp_path / "x"))
    assert as_dict(exported) == model(rows, 300) and log.check_order(exported).first()["out_of_order"] == 0
    assert log.check_order(exported.union(exported.limit(1))).first()["out_of_order"] == 1


@pytest.mark.parametrize("metric", ["l2", "inner", "cosine"])
def test_top_k(spark, metric):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(50)]
    q = rows[3][1]

    def distance(v):
        dot = sum(a * b for a, b in zip(v, q, strict=True))
        if metric == "l2":
            return sum((a - b) ** 2 for a, b in zip(v, q, strict=True)) ** 0.5
        return -dot if metric == "inner" else 1 - dot / (sum(a * a for a in v) * sum(b * b for b in q)) ** 0.5

    found = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), q, 5, metric)
    assert [r["vec_id"] for r in found.collect()] == [i for i, _ in sorted(rows, key=lambda r: distance(r[1]))[:5]]
    assert vectors.recall(found, found) == 1.0

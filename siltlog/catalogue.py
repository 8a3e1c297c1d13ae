"""Queries over the op log derived from `events`, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs
from .operators import batches, bloom, compaction, measure, ranges, view
from .replication import log, state, transfer
from .sources import Options, Store
from .sources.places import shared_folder
from .streaming import ingest
from .vectors import search_batch, top_k

#: Operations of a batch and versions of a run in the derived op log; the first divides the second, so runs end with batches.
BATCH, RUN = 32, 1024


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op log of events: one key a user, sequence from the event id, a delete for each error."""
    deleted = F.col("event_type") == "error"
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"),
        (F.col("event_id") + 1).alias("seq"),
        deleted.alias("deleted"),
        F.when(deleted, F.lit("")).otherwise(F.col("props")).alias("v"),
        F.floor(F.col("event_id") / BATCH).cast("long").alias("batch_id"),
        F.floor(F.col("event_id") / RUN).cast("long").alias("run"),
    )


def last_sequence(spark: SparkSession, sf_dir: str) -> Column:
    """The log's last sequence, as a subquery of the plan that uses it."""
    return load(spark, sf_dir, "events").agg(F.coalesce(F.max("event_id") + 1, F.lit(0)).alias("top")).scalar()


def share(number: Column, times: int, over: int) -> Column:
    """number * times / over, rounded down."""
    product = number * times
    return ((product - F.pmod(product, F.lit(over))) / over).cast("long")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of probes of orders: a key and a sequence for each."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("probe_id"),
        F.concat(F.lit("user:"), F.lpad((F.col("o_custkey") % 200).cast("string"), 6, "0")).alias("k"),
        (F.col("o_orderkey") % 10000).alias("s"),
    )


def _live(frame: DataFrame) -> DataFrame:
    return frame.select("k", "seq", "v")


def get_latest(spark, sf_dir):
    """Latest live value of every key."""
    return _live(view.visible(ops(spark, sf_dir)))


def get_snapshot(spark, sf_dir):
    """The view as of the middle of the log."""
    return _live(view.visible(ops(spark, sf_dir), share(last_sequence(spark, sf_dir), 1, 2)))


def get_key(spark, sf_dir):
    return _live(view.get(ops(spark, sf_dir), "user:000042"))


def multi_get_asof(spark, sf_dir):
    return view.as_of(probes(spark, sf_dir), ops(spark, sf_dir))


def scan_first(spark, sf_dir):
    return _live(view.seek(ops(spark, sf_dir), limit=20))


def seek_limit(spark, sf_dir):
    return _live(view.seek(ops(spark, sf_dir), "user:000050", limit=10))


def range_between(spark, sf_dir):
    return _live(view.seek(ops(spark, sf_dir), "user:000020", end="user:000040"))


def tombstoned_keys(spark, sf_dir):
    return view.newest(ops(spark, sf_dir)).filter("deleted").select("k", "seq")


def version_history(spark, sf_dir):
    return view.history(ops(spark, sf_dir), "user:000042").select("k", "seq", "deleted", "v", F.col("rn").cast("long").alias("rn"))


def snapshot_diff(spark, sf_dir):
    return view.diff(ops(spark, sf_dir), share(last_sequence(spark, sf_dir), 3, 10))


def batch_prefix(spark, sf_dir):
    """The view after a crash in the middle of the log: whole batches only."""
    boundary = share(last_sequence(spark, sf_dir), 1, 3 * BATCH)
    return _live(view.visible(batches.batch_prefix(ops(spark, sf_dir), boundary)))


def batch_sizes(spark, sf_dir):
    return batches.batch_sizes(ops(spark, sf_dir))


def invalid_keys(spark, sf_dir):
    """Documents whose text may not be a key."""
    docs = load(spark, sf_dir, "documents")
    return batches.invalid_keys(docs, "text").select("doc_id")


def sequence_assign(spark, sf_dir):
    """How many operations get the sequence that the log has, when it is assigned from batches and positions."""
    log_ = ops(spark, sf_dir).select("batch_id", F.col("seq").alias("was"), F.col("seq").alias("position"))
    given = batches.assign_sequences(log_)
    return given.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seq") == F.col("was")).alias("same"))


def wal_monotonic(spark, sf_dir):
    ranges = ops(spark, sf_dir).groupBy("batch_id").agg(F.min("seq").alias("f"), F.max("seq").alias("l"))
    return batches.monotonic(ranges)


def run_metadata(spark, sf_dir):
    return compaction.run_metadata(ops(spark, sf_dir))


def _meta(spark, sf_dir):
    return ops(spark, sf_dir).groupBy("run").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))


def runs_for_key(spark, sf_dir):
    """Runs whose key range a probe's key is in: the files that a read may not skip."""
    return ranges.containing(probes(spark, sf_dir), "k", _meta(spark, sf_dir), "lo", "hi").select("probe_id", "k", "run")


def run_overlap(spark, sf_dir):
    return ranges.overlapping(_meta(spark, sf_dir), "run", "lo", "hi")


def _old_runs(spark, sf_dir):
    return ops(spark, sf_dir).filter(F.col("run") < share(last_sequence(spark, sf_dir), 1, 2 * RUN) + 1)


def compact_l1(spark, sf_dir):
    return compaction.retain(_old_runs(spark, sf_dir), last_level=False).select("k", "seq", "deleted", "v")


def compact_l2(spark, sf_dir):
    return compaction.retain(_old_runs(spark, sf_dir), last_level=True).select("k", "seq", "deleted", "v")


def compact_pinned(spark, sf_dir):
    pin = share(last_sequence(spark, sf_dir), 3, 10)
    return compaction.retain(_old_runs(spark, sf_dir), last_level=True, oldest_snapshot=pin).select("k", "seq", "deleted", "v")


def compaction_equiv(spark, sf_dir):
    """The view before and after the older half of the runs is compacted."""
    all_ops = ops(spark, sf_dir)
    cut = share(last_sequence(spark, sf_dir), 1, 2 * RUN) + 1
    merged = compaction.retain(all_ops.filter(F.col("run") < cut), last_level=False).unionByName(all_ops.filter(F.col("run") >= cut))
    return compaction.differences(_live(view.visible(all_ops)), _live(view.visible(merged)))


def space_amplification(spark, sf_dir):
    return compaction.space_amplification(ops(spark, sf_dir))


def state_export_order(spark, sf_dir):
    """Rows of the ordered export, and how many of its keys aren't above the one before."""
    return log.check_order(_live(view.visible(ops(spark, sf_dir))))


def majority_commit(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    term = (1 + F.floor(F.col("event_id") / 2000)).cast("long").alias("term")
    acks = events.groupBy(term, (F.col("user_id") % 3).alias("node")).agg((F.max("event_id") + 1).alias("m"))
    return log.majority_commit(acks, nodes=3)


def log_matching(spark, sf_dir):
    """Where the logs of two nodes differ first, and in how many entries."""
    events, last = load(spark, sf_dir, "events"), last_sequence(spark, sf_dir)
    term = (1 + F.floor(F.col("event_id") / 1000)).cast("long")
    a = events.filter(F.col("event_id") < share(last, 1, 2)).select((F.col("event_id") + 1).alias("idx"), term.alias("term"))
    b = events.filter(F.col("event_id") < share(last, 48, 100)).select((F.col("event_id") + 1).alias("idx"), (term + (F.col("event_id") >= share(last, 42, 100)).cast("int")).alias("term"))
    return log.first_difference(a, b)


def status_counts(spark, sf_dir):
    """How many probes found a value, a deleted key and nothing."""
    return multi_get_asof(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def crc_per_batch(spark, sf_dir):
    """CRC-32 of each operation, and their sum over a batch."""
    code = F.crc32(F.concat(F.col("k"), F.col("v")).cast("binary"))
    return ops(spark, sf_dir).groupBy("batch_id").agg(F.sum(code).alias("crc_sum"))


def level_stats(spark, sf_dir):
    """Runs and versions of each level that the maintenance policy leaves, from the sizes of batches."""
    from .plans.policy import Policy, simulate

    sizes = ops(spark, sf_dir).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).orderBy("batch_id")
    state = simulate((r["n"] for r in sizes.toLocalIterator()), Policy())
    return spark.createDataFrame(state.levels(), "level int, runs long, versions long")


def vector_topk(spark, sf_dir):
    """The ten vectors nearest to the first by Euclidean distance (a limit is the feature)."""
    vectors = load(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").select("embedding").first()
    return top_k(vectors, [float(x) for x in query[0]] if query else [], 10)


def _stored(spark, sf_dir, options: Options | None = None) -> Store:
    """A new table in the shared folder."""
    return Store(spark, shared_folder(spark, "store"), options)


def _read(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("k").cast("string").alias("k"), "seq", F.col("v").cast("string").alias("v"))


def _parts(spark, sf_dir, n: int) -> list[DataFrame]:
    """The operations of events in n parts by position."""
    rows = load(spark, sf_dir, "events").agg(F.max("event_id") + 1).first()[0] or 0
    events = ops(spark, sf_dir).select("k", "deleted", "v", "seq")
    return [events.filter(F.col("seq").between(rows * i // n + 1, rows * (i + 1) // n)) for i in range(n)]


def store_latest(spark, sf_dir):
    """Events loaded into a table in three parts, and its live rows."""
    with _stored(spark, sf_dir) as store:
        for part in _parts(spark, sf_dir, 3):
            store.load(part, ["seq"])
        return _read(store.view())


def store_snapshot(spark, sf_dir):
    """What a snapshot sees that was taken after the first half, when the rest was loaded and all was compacted."""
    with _stored(spark, sf_dir) as store:
        first, rest = _parts(spark, sf_dir, 2)
        store.load(first, ["seq"])
        pin = store.snapshot()
        store.load(rest, ["seq"])
        store.compact()
        return _read(store.view(pin))


def store_after_compaction(spark, sf_dir):
    """The live rows after compactions to the last level."""
    with _stored(spark, sf_dir) as store:
        for part in _parts(spark, sf_dir, 4):
            store.load(part, ["seq"])
        store.compact()
        store.compact()
        return _read(store.view())


def store_reopen(spark, sf_dir):
    """A table that was written, deleted from and closed, opened again: its live rows but for 50 keys that are deleted by a batch (limits are the feature)."""
    store = _stored(spark, sf_dir)
    with store:
        for part in _parts(spark, sf_dir, 2):
            store.load(part, ["seq"])
        store.write([("delete", f"user:{i:06d}") for i in range(50)])
    with Store(spark, store.path) as again:
        return _read(again.view())


def stream_ingest(spark, sf_dir):
    """Events read as a stream into a table, and its live rows."""
    schema = load(spark, sf_dir, "events").schema
    gone = F.col("event_type") == "error"
    with _stored(spark, sf_dir) as store:
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
        rows = stream.select(F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"), gone.alias("deleted"), F.when(gone, F.lit("")).otherwise(F.col("props")).alias("v"), "event_id")
        ingest(rows, store, f"{store.path}-stream", ["event_id"]).awaitTermination()
        return _read(store.view())


def state_round_trip(spark, sf_dir):
    """The live rows after an export as checked records, and an import into another table."""
    with _stored(spark, sf_dir) as store, _stored(spark, sf_dir) as other:
        store.load(_parts(spark, sf_dir, 1)[0], ["seq"])
        path = f"{store.path}-export"
        transfer.export(store.view().select("k", "v"), path, index=1, term=1, partitions=4)
        transfer.restore(spark, path, other)
        return _read(other.view()).select("k", "v")


def batch_limits(spark, sf_dir):
    """Batches with what is wrong with each, under small limits."""
    few = batches.Limits(operations=32, key=11, value=36, total=1100, overhead=0)
    return batches.batch_problems(ops(spark, sf_dir), few)


def vote_counts(spark, sf_dir):
    """Votes of events taken as requests: a term is 500 events, the candidate and the node follow from the user, errors are refusals."""
    events = load(spark, sf_dir, "events")
    votes = events.select((1 + F.floor(F.col("event_id") / 500)).cast("long").alias("term"), (F.col("user_id") % 2).alias("candidate"), (F.col("user_id") % 3).alias("node"), (F.col("event_type") != "error").alias("granted"))
    return state.vote_counts(votes, nodes=3)


def value_percentiles(spark, sf_dir):
    """Percentiles of the values of each type of event, by nearest rank."""
    return measure.percentiles(load(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])


def internal_keys(spark, sf_dir):
    """Encoded keys of all versions, and what they decode to."""
    coded = ops(spark, sf_dir).select("k", "seq", codecs.internal_key(F.col("k"), F.col("seq")).alias("data"))
    return coded.select(F.lower(F.hex("data")).alias("coded"), codecs.user_key(F.col("data")).cast("string").alias("k"), codecs.key_sequence(F.col("data")).alias("seq"))


def key_filters(spark, sf_dir):
    """Runs and keys of probes: how many keys of a run its filter rules out (none), and the size of the filter."""
    log_ = ops(spark, sf_dir)
    filters = bloom.build_filters(log_, bits_per_key=10)
    asked = bloom.may_contain(log_.select("run", "k").distinct(), filters)
    sizes = filters.select("run", "bits", F.col("hashes").cast("long").alias("hashes")).distinct()
    return asked.groupBy("run").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(~F.col("maybe")).alias("n_missed")).join(sizes, "run")


def term_order(spark, sf_dir):
    """Entries of a log with a term below that of the entry before: terms fall with every 700th event."""
    entries = load(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("idx"), (2 + F.floor(F.col("event_id") / 1000) - (F.col("event_id") % 700 == 699).cast("int")).cast("long").alias("term"))
    return state.bad_terms(entries, state.NodeState("q", term=1 << 40))


def chunk_transfer(spark, sf_dir):
    """How far files came of which some chunks were lost: a file is a user's events, a chunk 16 bytes of their props."""
    sizes = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("name")).agg(F.sum(F.octet_length("props")).cast("long").alias("size"))
    chunks = transfer.chunk_plan(sizes, 16).filter(F.pmod(F.col("name") * 31 + F.col("offset"), F.lit(41)) != 7)
    return transfer.received(chunks, sizes)


def vector_search(spark, sf_dir):
    """The five nearest vectors of all to each whose id 50 divides."""
    vectors = load(spark, sf_dir, "embeddings")
    return search_batch(vectors, vectors.filter("vec_id % 50 = 0"), 5).select("query_id", F.col("id").alias("vec_id"), F.round("dist", 6).alias("dist"), "rank")


def _number(queries: list[Callable]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"q{i:02d}_{f.__name__}": f for i, f in enumerate(queries, 1)}


QUERIES = _number(
    [
        get_latest, get_snapshot, get_key, multi_get_asof, scan_first, seek_limit, range_between, tombstoned_keys, version_history, snapshot_diff,
        batch_prefix, batch_sizes, invalid_keys, sequence_assign, wal_monotonic, run_metadata, runs_for_key, run_overlap, compact_l1, compact_l2,
        compact_pinned, compaction_equiv, space_amplification, state_export_order, majority_commit, log_matching, vector_topk, status_counts, crc_per_batch, level_stats,
        store_latest, store_snapshot, store_after_compaction, store_reopen, stream_ingest, state_round_trip, batch_limits, vote_counts, value_percentiles, internal_keys,
        key_filters, term_order, chunk_transfer, vector_search,
    ]
)

_OPS = f"""
ops as (select concat('user:', lpad(cast(user_id as varchar), 6, '0')) as k, event_id + 1 as seq, event_type = 'error' as deleted,
               case when event_type = 'error' then '' else props end as v,
               cast(floor(event_id / {BATCH}) as bigint) as batch_id, cast(floor(event_id / {RUN}) as bigint) as run
        from events),
tip as (select max(seq) as top from ops)"""
_LIVE = """
live as (select k, seq, v from (select *, row_number() over (partition by k order by seq desc) as rn from ops) where rn = 1 and not deleted)"""
_META = "meta as (select run, min(k) as lo, max(k) as hi from ops group by run)"
_PROBES = """
probes as (select o_orderkey as probe_id, concat('user:', lpad(cast(o_custkey % 200 as varchar), 6, '0')) as k, o_orderkey % 10000 as s
           from orders)"""
_ASOF = """
found as (select * from (select p.probe_id, p.k, p.s, o.seq, o.deleted, o.v, row_number() over (partition by p.probe_id order by o.seq desc nulls last) as rn
                         from probes p left join ops o on o.k = p.k and o.seq <= p.s) where rn = 1),
answer as (select probe_id, k, s, seq, case when seq is null then 'missing' when deleted then 'deleted' else 'ok' end as status,
                case when seq is not null and not deleted then v end as v from found)"""
_OLD = f"old as (select ops.* from ops, tip where run < top // {RUN} // 2 + 1)"


def _at(where: str) -> str:
    return f"select k, seq, v from (select ops.*, row_number() over (partition by k order by seq desc) as rn from ops, tip where {where}) where rn = 1 and not deleted"


_SQL = {
    "get_latest": f"with {_OPS}, {_LIVE} select * from live",
    "get_snapshot": f"with {_OPS} {_at('seq <= top // 2')}",
    "get_key": f"with {_OPS}, {_LIVE} select * from live where k = 'user:000042'",
    "multi_get_asof": f"with {_OPS}, {_PROBES}, {_ASOF} select * from answer",
    "scan_first": f"with {_OPS}, {_LIVE} select * from live order by k limit 20",
    "seek_limit": f"with {_OPS}, {_LIVE} select * from live where k >= 'user:000050' order by k limit 10",
    "range_between": f"with {_OPS}, {_LIVE} select * from live where k >= 'user:000020' and k < 'user:000040'",
    "tombstoned_keys": f"with {_OPS} select k, seq from (select *, row_number() over (partition by k order by seq desc) as rn from ops) where rn = 1 and deleted",
    "version_history": f"with {_OPS} select k, seq, deleted, v, row_number() over (order by seq desc) as rn from ops where k = 'user:000042'",
    "snapshot_diff": f"""with {_OPS}, {_LIVE}, past as ({_at('seq <= top * 3 // 10')})
        select * from (select coalesce(a.k, b.k) as k, a.seq as old_seq, b.seq as new_seq,
               case when a.seq is null then 'added' when b.seq is null then 'removed' when a.seq <> b.seq then 'changed' end as change
        from past a full outer join live b on a.k = b.k) where change is not null""",
    "batch_prefix": f"with {_OPS} {_at(f'batch_id <= top // {BATCH} // 3')}",
    "batch_sizes": f"with {_OPS} select batch_id, count(*) as n, cast(sum(9 + strlen(k) + strlen(v)) as bigint) as bytes from ops group by batch_id",
    "invalid_keys": "select doc_id from documents where text is null or length(text) = 0 or instr(text, chr(9)) > 0 or instr(text, chr(10)) > 0",
    "sequence_assign": f"with {_OPS}, given as (select seq, row_number() over (order by batch_id, seq) as g from ops) select count(*) as n, count(*) filter (g = seq) as same from given",
    "wal_monotonic": f"""with {_OPS}, b as (select batch_id, min(seq) as f, max(seq) as l from ops group by batch_id)
        select batch_id, f, l, coalesce(f > lag(l) over (order by batch_id), true) as ok from b""",
    "run_metadata": f"""with {_OPS} select run, count(*) as n, min(k) as lo, max(k) as hi, min(seq) as smin, max(seq) as smax,
        count(distinct k) as n_keys, count(*) filter (deleted) as n_deleted from ops group by run""",
    "runs_for_key": f"with {_OPS}, {_PROBES}, {_META} select probe_id, k, run from probes join meta on k between lo and hi",
    "run_overlap": f"with {_OPS}, {_META} select a.run as run_a, b.run as run_b from meta a join meta b on a.run < b.run and a.lo <= b.hi and b.lo <= a.hi",
    "compact_l1": f"with {_OPS}, {_OLD} select k, seq, deleted, v from (select *, row_number() over (partition by k order by seq desc) as rn from old) where rn = 1",
    "compact_l2": f"with {_OPS}, {_OLD} select k, seq, deleted, v from (select *, row_number() over (partition by k order by seq desc) as rn from old) where rn = 1 and not deleted",
    "compact_pinned": f"""with {_OPS}, {_OLD} select k, seq, deleted, v from (
        select old.*, seq > top * 3 // 10 as later, row_number() over (partition by k, seq > top * 3 // 10 order by seq desc) as rn from old, tip) where later or rn = 1""",
    "compaction_equiv": f"""with {_OPS}, {_LIVE}, {_OLD},
        merged as (select k, seq, deleted, v from (select *, row_number() over (partition by k order by seq desc) as rn from old) where rn = 1
                   union all select k, seq, deleted, v from ops, tip where run >= top // {RUN} // 2 + 1),
        after as (select k, seq, v from (select *, row_number() over (partition by k order by seq desc) as rn from merged) where rn = 1 and not deleted)
        select (select count(*) from (select * from live except all select * from after)) as lost,
               (select count(*) from (select * from after except all select * from live)) as gained""",
    "space_amplification": f"""with {_OPS}, l as (select run, count(*) as live from (select *, row_number() over (partition by k order by seq desc) as rn from ops) where rn = 1 and not deleted group by run)
        select run, count(*) as versions, coalesce(max(live), 0) as live from ops left join l using (run) group by run""",
    "state_export_order": f"with {_OPS}, {_LIVE} select count(*) as n, count(*) filter (not up) as out_of_order from (select coalesce(lag(k) over (order by k) < k, true) as up from live)",
    "majority_commit": """with acks as (select 1 + cast(floor(event_id / 2000) as bigint) as term, user_id % 3 as node, max(event_id + 1) as m from events group by 1, 2)
        select term, m as commit_index from (select term, m, row_number() over (partition by term order by m desc) as rn from acks) where rn = 2""",
    "log_matching": """with t as (select max(event_id) + 1 as top from events),
        la as (select event_id + 1 as idx, 1 + cast(floor(event_id / 1000) as bigint) as term from events, t where event_id < top // 2),
        lb as (select event_id + 1 as idx, 1 + cast(floor(event_id / 1000) as bigint) + case when event_id >= top * 42 // 100 then 1 else 0 end as term from events, t where event_id < top * 48 // 100)
        select min(la.idx) filter (la.term is distinct from lb.term) as first_difference, count(*) filter (la.term is distinct from lb.term) as n_different from la left join lb using (idx)""",
    "vector_topk": """with q as (select embedding as e from embeddings where vec_id = 0)
        select vec_id, sqrt(list_sum(list_transform(list_zip(embedding, e), lambda x: (cast(x[1] as double) - cast(x[2] as double)) * (cast(x[1] as double) - cast(x[2] as double))))) as dist
        from embeddings, q order by dist, vec_id limit 10""",
    "crc_per_batch": f"""with {_OPS}, rule as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: xor(c >> 1, (c & 1) * 3988292384))) as t),
        bytes as (select batch_id, list_transform(string_split(concat(k, v), ''), lambda x: cast(ord(x) as bigint)) as b from ops)
        select batch_id, cast(sum(xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)) as bigint) as crc_sum
        from bytes, rule group by batch_id""",
    "level_stats": f"""with recursive {_OPS},
        flushes as (select cast(floor(event_id / 1024) as bigint) as i, count(*) as n from events group by 1),
        s as (select cast(-1 as bigint) as i, 0::bigint as r0, 0::hugeint as v0, 0::bigint as r1, 0::hugeint as v1, 0::bigint as r2, 0::hugeint as v2
            union all
            select i, case when full0 then 0 else r0 end, case when full0 then 0 else v0 end,
                   case when full0 and not full1 then 1 when full0 then 0 else r1 end, case when full0 and not full1 then v0 + v1 when full0 then 0 else v1 end,
                   case when full0 and full1 then 1 else r2 end, case when full0 and full1 then v0 + v1 + v2 else v2 end
            from (select f.i, r0 + 1 as r0, v0 + f.n as v0, r1, v1, r2, v2, r0 + 1 > 4 as full0, (v0 + f.n + v1) * 100 > 67108864 as full1 from s join flushes f on f.i = s.i + 1)),
        done as (select * from s order by i desc limit 1)
        select 0 as level, cast(r0 as bigint) as runs, cast(v0 as bigint) as versions from done
        union all select 1, cast(r1 as bigint), cast(v1 as bigint) from done union all select 2, cast(r2 as bigint), cast(v2 as bigint) from done""",
    "store_latest": f"with {_OPS}, {_LIVE} select * from live",
    "store_snapshot": f"with {_OPS} {_at('seq <= top // 2')}",
    "store_after_compaction": f"with {_OPS}, {_LIVE} select * from live",
    "store_reopen": f"with {_OPS}, {_LIVE} select * from live where k >= 'user:000050'",
    "stream_ingest": f"with {_OPS}, {_LIVE} select * from live",
    "state_round_trip": f"with {_OPS}, {_LIVE} select k, v from live",
    "batch_limits": f"""with {_OPS}, b as (select batch_id, count(*) as n, max(strlen(k)) as key, max(strlen(v)) as value, cast(sum(strlen(k) + strlen(v)) as bigint) as total,
            bool_or(k = '' or instr(k, chr(9)) > 0 or instr(k, chr(10)) > 0) as bad_key, bool_or(deleted and v <> '') as bad_delete from ops group by batch_id)
        select batch_id, n, total, case when bad_key then 'a key is empty or has TAB, NL or NUL' when bad_delete then 'a delete carries a value' when n > 32 then 'too many operations'
            when key > 11 then 'a key is too large' when value > 36 then 'a value is too large' when total > 1100 then 'the batch is too large' end as problem from b""",
    "vote_counts": """select term, candidate, votes, votes >= 2 as won from (
            select 1 + cast(floor(event_id / 500) as bigint) as term, user_id % 2 as candidate, count(distinct user_id % 3) as votes from events where event_type <> 'error' group by 1, 2)""",
    "value_percentiles": """select event_type, min(value) filter (upto >= ceil(0.5 * n)) as p50, min(value) filter (upto >= ceil(0.95 * n)) as p95, min(value) filter (upto >= ceil(0.99 * n)) as p99
        from (select event_type, value, count(*) over (partition by event_type) as n, count(*) over (partition by event_type order by value) as upto from events) group by event_type""",
    "internal_keys": f"""with {_OPS} select lower(hex(k)) || '00' || lower(lpad(hex(18446744073709551615::ubigint - seq::ubigint), 16, '0')) as coded, k, seq from ops""",
    "key_filters": f"""with {_OPS} select run, count(distinct k) as n_keys, cast(0 as bigint) as n_missed, greatest(64, 10 * count(distinct k)) as bits, cast(6 as bigint) as hashes from ops group by run""",
    "term_order": """with e as (select event_id + 1 as idx, 2 + cast(floor(event_id / 1000) as bigint) - case when event_id % 700 = 699 then 1 else 0 end as term from events)
        select idx, term from (select idx, term, lag(term) over (order by idx) as before from e) where term < before""",
    "chunk_transfer": """with f as (select user_id as name, cast(sum(strlen(props)) as bigint) as size from events group by user_id),
        lost as (select name, min(o) as gap from (select name, unnest(range(0, size, 16)) as o from f) where (name * 31 + o) % 41 = 7 group by name)
        select name, coalesce(gap, size) as next_offset, gap is null as complete from f left join lost using (name)""",
    "vector_search": """with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 50 = 0),
        d as (select query_id, vec_id, sqrt(list_sum(list_transform(list_zip(embedding, e), lambda x: (cast(x[1] as double) - cast(x[2] as double)) * (cast(x[1] as double) - cast(x[2] as double))))) as dist from embeddings, q)
        select query_id, vec_id, round(dist, 6) as dist, rank from (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from d) where rank <= 5""",
    "status_counts": f"with {_OPS}, {_PROBES}, {_ASOF} select status, count(*) as n from answer group by status",
}
_NAMES = {name.split("_", 1)[1]: name for name in QUERIES}
ORACLE_SQL = {_NAMES[name]: sql for name, sql in _SQL.items()}

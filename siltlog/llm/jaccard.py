"""Exact similarity join on word shingles with filters in several global orders, and its connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import cut, digest, drop_rows, near, slices, table, tidy
from .textscan import NOT_SPACE, mix, text_bytes, words

SHINGLE = 5
#: Similarity in hundredths from which two documents link.
PERCENT = 80
SLICE = 4 << 20
#: Shingles of a group that one task sorts, about.
GROUP = 1 << 20
#: One in so many shingles is sampled to find those that too many texts have for one group.
SAMPLE = 4096
#: Common shingles that are broadcast, at most: those that this share of all shingles are.
COMMON_SHARE = 1_000_000
#: The document frequency of all of these: above every other.
COMMON = (1 << 32) - 1
#: Bits of a shingle's hash that are shuffled.
KEPT_BITS = 48
#: Longs of the bitmap of a set in which each shingle flips a bit, and of those in which each token of a prefix sets one.
ODD, MARKS = 8, 4
#: Entries of a token that one task tries, about.
BLOCK = 4096
#: Sets of each shingle that all others of it are tried with in a round.
PARTNERS = 6
#: Rounds with such partners, at most, before all remaining pairs are tried.
ROUNDS = 2
#: Remaining pairs for each entry of the index below which no further round is run.
PAIRS_AN_ENTRY = 1
#: Sets that a task holds by number, so as to tell which are connected.
HELD_SETS = 500_000
#: Keys of sets that a task remembers, so as not to send equal sets again.
HELD_KEYS = 200_000
#: Keys of sets of several texts, at most, that all tasks know the text to send of.
COPIED = 1_000_000
#: Sets of a slice whose shared shingles go to one group.
BLOCK_SETS = 256


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order of text and hash, and how many each text has.

    A text with fewer than k words, but not none, has its whole sequence of words as one.
    """
    data, offsets = text_bytes(column)
    found = words(data, offsets, NOT_SPACE)
    h, owner, count = found.hashes(), found.owner(), np.diff(found.first)
    factor = np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = out * factor + h[j : j + n]
    same = owner[:n] == owner[k - 1 :][:n]
    out, owner = mix(out[same]), owner[:n][same]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        x = count[short].astype(np.uint64)
        for j in range(k - 1):  # word j of those that have it
            has = count[short] > j
            x[has] = x[has] * factor + h[found.first[:-1][short][has] + j]
        out = np.concatenate([out, mix(x)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.bincount(owner[keep], minlength=len(column)).astype(np.int64)


def _keys(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, from two sums over its hashes."""
    edge = np.concatenate([[0], np.cumsum(n)])
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)), dtype=np.uint64)])
        sums.append(run[edge[1:]] - run[edge[:-1]])
    return mix(sums[0] ^ mix(sums[1] + n.astype(np.uint64))).view(np.int64)


def _signatures(rate: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The size and key of each text's set, and a sample of its shingles: about one in `rate`, which differ from text to text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets, n = shingle_sets(part.column(2))
                keys = _keys(sets, n)
                kept = sets >> np.uint64(64 - KEPT_BITS)
                drawn = mix(kept ^ np.repeat(keys.view(np.uint64), n)) < np.uint64((1 << 64) // rate - 1)
                count = np.bincount(np.repeat(np.arange(len(n)), n)[drawn], minlength=len(n))
                sample = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(kept[drawn].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(keys), sample], ["id", "digest", "n", "key", "sample"])

    return run


def _encode(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, each in as many bytes a value as its largest takes."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c, dtype="<u8")
        width = (int(c.max(initial=0)).bit_length() + 7) // 8
        parts += [len(c).to_bytes(4, "little"), bytes([width]), c.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
    return b"".join(parts)


def _decode(raw: bytes, at: int = 0) -> list[np.ndarray]:
    """The columns that _encode() put behind the first `at` bytes."""
    out = []
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 4], "little"), raw[at + 4]
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(raw, "u1", n * width, at + 5).reshape(n, width)
        out.append(wide.view("<u8").reshape(-1))
        at += 5 + n * width
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins and ends."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]]))
    return first, np.append(first, len(x))[1:]


def _slice(keys: np.ndarray, place: int) -> np.uint64:
    """A number for the sets of a slice in their order, and for its place in the table."""
    return mix(np.sum(mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64)), dtype=np.uint64, keepdims=True) ^ mix(np.asarray([place], dtype=np.uint64)))[0]


def _block(slice_: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A number for each block of BLOCK_SETS sets of a slice; its first bits tell the group that their shared shingles meet in."""
    return mix(slice_ + (own // np.uint64(BLOCK_SETS)) * np.uint64(0x9E3779B97F4A7C15))


def _home(block: np.ndarray, bits: int) -> np.ndarray:
    return (block >> np.uint64(64 - bits)).astype(np.int64)


def _blobs(parts: list[tuple[int, bytes]]) -> dict[str, pa.Array]:
    return {"part": pa.array([g for g, _ in parts], pa.int32()), "blob": pa.array([b for _, b in parts], pa.binary())}


def _spread(bits: int, common: np.ndarray, copied: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shingles of each set, dealt to ranges of their hashes, with the set's place in its slice; the keys and sizes of a slice's sets go to groups after the ranges, once, with the common shingles.

    So a shingle takes as many bytes whatever the number of ranges. Of equal sets, those of the ids in `copied` are
    sent, and others once by a task, as far as it remembers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets, n = shingle_sets(part.column(1))
                keys = _keys(sets, n)
                may = n > 0
                if len(copied[0]):
                    at = np.minimum(np.searchsorted(copied[0], keys), len(copied[0]) - 1)
                    may &= (copied[0][at] != keys) | (copied[1][at] == part.column(0).to_numpy(zero_copy_only=False))
                new = np.zeros(len(n), dtype=bool)
                found = np.flatnonzero(may)
                for i in found[np.unique(keys[found], return_index=True)[1]].tolist():
                    if int(keys[i]) not in seen:
                        new[i] = True
                        seen.add(int(keys[i]))
                if len(seen) > HELD_KEYS:
                    seen.clear()
                owner = np.repeat(np.arange(len(n)), n)
                sets, own = sets[new[owner]], (np.cumsum(new) - 1)[owner[new[owner]]].astype(np.uint64)
                keys, n = keys[new], n[new]
                slice_ = _slice(keys, place)
                place += 1
                kept = sets >> np.uint64(64 - KEPT_BITS)
                often = np.zeros(len(kept), dtype=bool)
                if len(common):
                    often = common[np.minimum(np.searchsorted(common, kept), len(common) - 1)] == kept
                out = []
                its, hashes = own[often], kept[often]  # in order of the sets
                for first in range(0, len(keys), BLOCK_SETS):
                    a, b = np.searchsorted(its, np.asarray([first, first + BLOCK_SETS], dtype=np.uint64))
                    block = _block(np.asarray([slice_]), np.asarray([first], dtype=np.uint64))
                    docs = slice(first, first + BLOCK_SETS)
                    out.append(((1 << bits) + int(_home(block, bits)[0]), b"\0" + _encode(block, keys[docs].view(np.uint64), n[docs], its[a:b] - np.uint64(first), hashes[a:b])))
                group = (sets[~often] >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                group, its, hashes = group[order], own[~often][order], kept[~often][order] & np.uint64((1 << KEPT_BITS - bits) - 1)
                for a, b in zip(*_runs(group), strict=True):
                    out.append((int(group[a]), _encode(np.asarray([slice_]), np.diff(its[a:b], prepend=np.uint64(0)), hashes[a:b])))
                yield pa.RecordBatch.from_pydict(_blobs(out))

    return run


def _shared(bits: int) -> Callable[[pa.Table], pa.Table]:
    """Of the shingles in a range those that more than one set has, with how many have them, dealt to the groups of their sets' blocks. What is in the groups after the ranges goes on as it is.

    Equal sets that were sent more than once count as several, in all sets alike.
    """

    def run(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        if part >> bits:
            return pa.table({"part": pa.array([part - (1 << bits)] * len(group), pa.int32()), "blob": group["blob"]})
        read = [_decode(blob.as_py()) for blob in group["blob"]]
        slice_ = np.repeat(np.concatenate([x[0] for x in read]), [len(x[1]) for x in read])
        own = np.concatenate([np.cumsum(x[1], dtype=np.uint64) for x in read])
        h = np.concatenate([x[2] for x in read])
        order = np.argsort(h, kind="stable")
        first, end = _runs(h[order])
        df = np.repeat(end - first, end - first)
        order, df = order[df > 1], df[df > 1]
        block, its, h = _block(slice_[order], own[order]), own[order] % np.uint64(BLOCK_SETS), h[order] | np.uint64(part << KEPT_BITS - bits)
        order = np.lexsort((its, block))  # so in order of the groups
        block, its, h, df = block[order], its[order], h[order], df[order]
        out, home = [], _home(block, bits)
        for a, b in zip(*_runs(home), strict=True):
            first, end = _runs(block[a:b])
            out.append((int(home[a]), b"\1" + _encode(block[a:b][first], end - first, its[a:b], h[a:b], df[a:b])))
        return pa.table(_blobs(out))

    return run


def _gathered(blobs: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Keys and sizes of the sets of a group's blocks, and of each shared shingle the set's place among them, hash and frequency."""
    tables, entries = [], []
    for blob in blobs:
        raw = blob.as_py()
        (entries if raw[0] else tables).append(_decode(raw, 1))
    block = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in tables)])
    order = np.argsort(block)
    start = np.cumsum([0, *(len(x[1]) for x in tables)])
    docs, hashes, dfs = [np.zeros(0, np.int64)], [], []
    for at, (_, _, _, its, h) in zip(start, tables, strict=False):
        docs.append(at + its.astype(np.int64))
        hashes.append(h)
        dfs.append(np.full(len(h), COMMON, dtype=np.int64))
    for its_block, count, its, h, df in entries:
        at = np.searchsorted(block[order], its_block)
        if not len(block) or (block[order][np.minimum(at, len(block) - 1)] != its_block).any():
            raise ValueError("the texts were not read in the same order again; write them to a table first")
        docs.append(np.repeat(start[order[at]], count.astype(np.int64)) + its.astype(np.int64))
        hashes.append(h)
        dfs.append(df.astype(np.int64))
    keys, sizes = (_joined([x[i] for x in tables]).view(np.int64) for i in (1, 2))
    return keys, sizes, np.concatenate(docs), _joined(hashes), np.concatenate([np.zeros(0, np.int64), *dfs])


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with any that it links with, at least."""
    return -(-percent * n // 100)


_ORDERS = (np.uint64(0xA4093822299F31D0), np.uint64(0x082EFA98EC4E6C89))


def _bitmap(hashes: np.ndarray, owner: np.ndarray, n: int, longs: int, flip: bool) -> np.ndarray:
    """For each of n sets a bitmap in which each of its hashes flips or sets a bit."""
    place = mix(hashes ^ np.uint64(0x452821E638D01377)) % np.uint64(64 * longs)
    out = np.zeros(n * longs, dtype=np.uint64)
    (np.bitwise_xor if flip else np.bitwise_or).at(out, owner * longs + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.reshape(n, longs).view(np.int64)


BITMAPS = [*(f"odd{i}" for i in range(ODD)), *(f"two{i}" for i in range(MARKS)), *(f"three{i}" for i in range(MARKS))]


def _prefixes(group: pa.Table) -> pa.Table:
    """What can link of each set: its shared shingles, its prefix in the first order, and bitmaps of its prefixes in the others and of all shared shingles.

    In every order shingles of a single set come first; then, in the first, those that fewer
    sets have, and in the others those whose hashes are lower under a salt. A set of
    n shares at least needed(n), so the first n - needed(n) + 1 of it, in
    any one order for all sets, have one that its partner's first have too. Sets whose first are all
    their own link with nothing.
    """
    keys, sizes, doc, h, df = _gathered(group["blob"])
    one_of = np.zeros(len(keys), dtype=bool)  # equal sets
    one_of[np.unique(keys, return_index=True)[1]] = True
    doc, h, df = doc[one_of[doc]], h[one_of[doc]], df[one_of[doc]]
    order = np.lexsort((h, doc))
    doc, h, df = doc[order], h[order], df[order]
    rows, prefixes = [], ([], [])
    for a, b in zip(*_runs(doc), strict=True):
        n = int(sizes[doc[a]])
        first = n - needed(n) + 1 - (n - int(b - a))
        if first <= 0:
            continue
        own = h[a:b]
        one = own[np.lexsort((own, df[a:b]))[:first]]
        for found, salt in zip(prefixes, _ORDERS, strict=True):
            found.append(own[np.argsort(mix(own ^ salt), kind="stable")[:first]])
        rows.append((int(keys[doc[a]]), n, n - len(own), own.tobytes(), one.astype(np.int64)))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    out = {k: pa.array(list(c), t) for k, c, t in zip(["key", "n", "own", "shared", "one"], columns, kinds, strict=True)}
    whole = [np.frombuffer(r[3], "<u8") for r in rows]
    maps = [_bitmap(_joined(x), np.repeat(np.arange(len(rows)), [len(y) for y in x]), len(rows), longs, flip) for x, longs, flip in ((whole, ODD, True), (prefixes[0], MARKS, False), (prefixes[1], MARKS, False))]
    out["part"] = pa.array([group["part"][0].as_py()] * len(rows), pa.int32())
    return pa.table(out | dict(zip(BITMAPS, map(pa.array, np.concatenate(maps, axis=1).T), strict=True)))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def _meet(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum()) if len(y) else 0


class _Forest:
    """Numbers that are connected; the smallest of a component stands for it."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)

    def batch(self, names: list[str]) -> pa.RecordBatch:
        """Each number's component and the number."""
        keys = list(self.root)
        return pa.RecordBatch.from_arrays([pa.array([self.find(x) for x in keys], pa.int64()), pa.array(keys, pa.int64())], names)


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what the pairs connect that are as similar as asked for: from the smallest set of each component that the task finds to the others. Pairs that are connected already aren't compared."""
    forest = _Forest()

    def stars() -> pa.RecordBatch:
        links = forest.batch(["u", "v"])
        return links.filter(pc.not_equal(links.column(0), links.column(1)))

    for batch in batches:
        for x in batch.to_pylist():
            if forest.find(x["u"]) == forest.find(x["v"]):
                continue
            both = _meet(x["shared"], x["v_shared"])
            if 100 * both >= PERCENT * (x["n"] + x["v_n"] - both):
                forest.join(x["u"], x["v"])
        if len(forest.root) > HELD_SETS:
            yield stars()
            forest = _Forest()
    yield stars()


def _connect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = _Forest()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            forest.join(u, v)
    yield forest.batch(["component", "key"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) among the pairs that connect what all links among them connect."""
    a = sets.select(F.col("key").alias("u"), "n", "shared")
    b = sets.select(F.col("key").alias("v"), F.col("n").alias("v_n"), F.col("shared").alias("v_shared"))
    return cut(pairs.join(a, "u").join(b, "v").mapInArrow(_verify, "u long, v long"))


def components(links: DataFrame) -> DataFrame:
    """(key, component) of every key in the links: the smallest key that links lead to.

    Each round gives a key the smallest label among its neighbours and then that label's
    own label, so that the rounds grow as the logarithm of the longest path. Labels are broadcast
    while they are few; the links of a hub are split by adaptive execution beyond.
    """
    both = cut(links.select("u", "v").union(links.select("v", "u")))
    labels = cut(both.groupBy(F.col("u").alias("key")).agg(F.least("key", F.min("v")).alias("component")))
    while True:
        at_hand = near(labels.withColumnRenamed("key", "v"))
        by_neighbour = both.join(at_hand, "v").select(F.col("u").alias("key"), "component", F.lit(None).cast("long").alias("was"))
        own = labels.select("key", "component", F.col("component").alias("was"))
        low = by_neighbour.union(own).groupBy("key").agg(F.min("component").alias("at"), F.max("was").alias("was"))
        up = near(labels.select(F.col("key").alias("at"), F.col("component").alias("up")))
        step = cut(low.join(up, "at", "left").select("key", F.least("at", "up").alias("component"), "was"))
        labels = step.select("key", "component")
        if step.filter("component < was").isEmpty():
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (key, component) after further links.

    Up to common.BROADCAST_IDS labels and links (16 bytes each), which are counted first, are connected in one task; beyond,
    links are followed between components only, in rounds of joins.
    """
    known = links if labels is None else links.union(labels.select("component", "key"))
    if known.count() <= common.BROADCAST_IDS:
        return cut(known.coalesce(1).mapInArrow(_connect, "component long, key long").select("key", "component"))
    if labels is None:
        return components(links)
    of_u = labels.select(F.col("key").alias("u"), F.col("component").alias("cu"))
    of_v = labels.select(F.col("key").alias("v"), F.col("component").alias("cv"))
    between = links.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    between = cut(between.filter("u != v").distinct())
    if between.isEmpty():
        return labels
    joined = components(between).select(F.col("key").alias("component"), F.col("component").alias("low"))
    single = between.select(F.col("u").alias("key")).union(between.select("v")).distinct().withColumn("component", F.col("key"))
    all_ = labels.union(single.join(labels.select("key"), "key", "left_anti"))
    return cut(all_.join(joined, "component", "left").select("key", F.coalesce("low", "component").alias("component")))


def overlap_needed(n: str, other: str) -> str:
    """SQL for the shingles that sets of these sizes share at least if they link."""
    return f"(({PERCENT} * ({n} + {other}) + {99 + PERCENT}) div {100 + PERCENT})"


def _index(sets: DataFrame) -> DataFrame:
    """(token, key, n, own, place, blocks): the shingles of each set's prefix in the first order with their places among all n.

    Sets of n and m shingles that link share overlap_needed(n, m), so they have a shingle in common whose place in
    each is at most the size less that. That bounds the partner's size, by `most`, and
    entries whose bound is below all sizes that the shingle has are left out. So are shingles of one set.
    A shingle's entries are dealt to `blocks` tasks.
    """
    entries = sets.select("key", "n", "own", F.posexplode("one").alias("rank", "token"))
    entries = entries.select("token", "key", "n", "own", (F.col("own") + F.col("rank")).alias("place"))
    entries = cut(entries.withColumn("most", F.expr(f"({100 + PERCENT} * (n - place)) div {PERCENT} - n")))
    met = entries.groupBy("token").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = cut(met.select("token", "least", F.ceil(F.col("k") / BLOCK).cast("long").alias("blocks")))
    return cut(entries.join(near(met), "token").filter("most >= least").select("token", "key", "n", "own", "place", "blocks"))


def _may_link() -> Column:
    """Whether an entry and a partner's (columns with p_) can be of sets that link: by sizes and places, then by bitmaps, none of which misses a link.

    Sets of n and m that link differ in at most n + m - 2 * overlap_needed(n, m) shingles. Those that no
    other set has are among them, and each bit in which the bitmaps of shared shingles differ
    comes of one more. In each of the other orders the prefixes of such sets have a token in common, hence a bit.
    """
    need = overlap_needed("n", "p_n")
    placed = f"place <= n - {need} and p_place <= p_n - {need}"
    odd = " + ".join(f"bit_count(odd{i} ^ p_odd{i})" for i in range(ODD))
    differ = f"own + p_own + {odd} <= n + p_n - 2 * {need}"
    orders = [" or ".join(f"({x}{i} & p_{x}{i}) != 0" for i in range(MARKS)) for x in ("two", "three")]
    return F.expr(f"component != p_component and {placed} and {differ} and ({orders[0]}) and ({orders[1]})")


def link_components(sets: DataFrame) -> DataFrame | None:
    """(key, component) of the sets that link with others; None if no sets share a shingle.

    Trying all pairs of a shingle's sets would be the square of a group of near copies, so
    partners are chosen first: PARTNERS sets of each shingle are tried with all others of it. Sets that now
    are of one component need not be tried with each other again. What remains is every pair of
    different components that shares a shingle: it is counted, and either tried in full or, while it
    is too much, cut down by another round with other partners. Pairs become rows only if _may_link() holds,
    and a shingle's entries are dealt to blocks, with the partners in each.
    """
    index = _index(sets)
    entries = index.count()
    tidy(sets.sparkSession)  # of the shuffles that made the sets
    bitmaps = sets.select("key", *BITMAPS)
    labels = None
    for round_ in range(ROUNDS + 1):
        if labels is None:
            own = index.withColumn("component", F.col("key"))
        else:
            own = index.join(near(labels), "key", "left").withColumn("component", F.coalesce("component", "key"))
        sizes = own.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
        main = cut(
            sizes.groupBy("token")
            .agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("parts"))
            .filter("parts > 1")
            .select("token", F.col("main.component").alias("main"), (F.col("all") - F.col("main.k")).alias("rest"), "all")
        )
        left = main.agg(F.sum(F.col("rest") * F.col("all"))).first()[0] or 0
        if not left:
            break
        last = left <= PAIRS_AN_ENTRY * entries or round_ == ROUNDS
        open_ = own.join(near(main.select("token", "main")), "token").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
        if last:
            side = open_.filter("component != main")
        else:
            chosen = open_.withColumn("order", F.xxhash64("key", F.lit(round_)))
            for group in (["token", "block"], ["token"]):
                rank = F.row_number().over(Window.partitionBy(*group).orderBy("order", "key"))
                chosen = chosen.withColumn("rank", rank).filter(F.col("rank") <= PARTNERS).drop("rank")
            side = chosen.drop("order")
        side = side.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "main")
        side = side.join(bitmaps, "key")
        side = side.select("token", "block", *(F.col(c).alias(f"p_{c}") for c in side.columns if c not in ("token", "block")))
        pairs = open_.join(bitmaps, "key").join(side.hint("merge"), ["token", "block"]).filter(_may_link())
        if last:
            pairs = pairs.filter("component = main or p_key < key")
        pairs = cut(pairs.select(F.least("key", "p_key").alias("u"), F.greatest("key", "p_key").alias("v")).distinct())
        labels = merged(labels, verified(pairs, sets))
        if last:
            break
        del own, sizes, open_, side, pairs
        tidy(sets.sparkSession)
    return labels


def _common(signed: DataFrame, total: int, rate: int, group: int) -> np.ndarray:
    """Hashes, sorted, of shingles that more texts have than one task should meet, as a sample tells.

    Only what is done with a shingle depends on it, not the result: these are not counted, and
    come last in the first order. They are COMMON_SHARE at most.
    """
    least = max(group, total // COMMON_SHARE)
    drawn = signed.filter("key is not null").select(F.explode("sample").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    found = drawn.filter(F.col("k") * rate >= least / 2).select("h").collect()
    return np.sort(np.asarray([r[0] for r in found], dtype=np.int64)).view(np.uint64)


def _copied(classes: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, of sets that several texts have, and the id of the one that is sent; `most` of them at most, those with more copies first.

    Only what is sent twice depends on it, not the result.
    """
    least, n = None, 0
    for copies, k in sorted(classes.filter("copies > 1").groupBy("copies").count().collect(), reverse=True):
        n += k
        if n > most:
            break
        least = copies
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = classes.filter(F.col("copies") >= least).select("key", "first").toArrow()
    keys, ids = (found[c].to_numpy() for c in ("key", "first"))
    order = np.argsort(keys)
    return keys[order], ids[order]


def _single(sets: DataFrame) -> DataFrame:
    """One row of each set: equal ones that were sent more than once are in groups (`part`) of their own."""
    again = cut(sets.groupBy("key").agg(F.min("part").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    if again.isEmpty():
        return sets
    return cut(sets.join(near(again), "key", "left").filter("least is null or least = part").drop("least"))


def _decided(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per row of docs: id, digest of the text, n_shingles, component_id; see similar_components()."""
    read = docs.select(docs[id_column].cast("long").alias("id"), digest(docs[text_column]).alias("digest"), docs[text_column].alias("text"))
    signed = cut(read.mapInArrow(_signatures(SAMPLE), "id long, digest long, n long, key long, sample array<long>").withColumn("key", F.when(F.expr("n > 0 and id is not null"), F.col("key"))))
    classes = cut(signed.filter("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(20, max(4, int(total // GROUP).bit_length()))
    send = _spread(bits, _common(signed, total, SAMPLE, GROUP), _copied(classes, COPIED))
    spread = read.filter("id is not null").select("id", "text").mapInArrow(send, "part int, blob binary")
    shared = spread.groupBy("part").applyInArrow(_shared(bits), "part int, blob binary")
    maps = ", ".join(f"{c} long" for c in BITMAPS)
    sets = _single(cut(shared.groupBy("part").applyInArrow(_prefixes, f"key long, n long, own long, shared binary, one array<long>, part int, {maps}"))).drop("part")
    first = classes.select("key", "first")
    labels = link_components(sets)
    found = classes.filter("copies > 1").select("key", F.col("first").alias("component_id"))
    if labels is not None:
        linked = cut(labels.join(first, "key"))
        low = near(cut(linked.groupBy("component").agg(F.min("first").alias("component_id"))))
        found = found.join(labels, "key", "left_anti").unionByName(linked.join(low, "component").select("key", "component_id"))
    out = signed.join(near(cut(found)), "key", "left")
    return out.select("id", "digest", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def similar_components(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id.

    A text's set is of its distinct runs of SHINGLE words (words are runs of characters other
    than white space, A-Z lower-cased). Two texts link if PERCENT hundredths of the shingles that either has
    are shared. component_id is the smallest id that links lead to, or the
    row's own. Components are exact, but links are not given, nor a row's number of them: pairs
    already in one component are not verified. Texts with equal sets are one class, known by a 64-bit key, and
    take part in the join once. Shingles are known by KEPT_BITS bits of a hash.

    A null text, or one without words, links with nothing. Ids
    are integers; a row with a null id has no component and links with nothing; rows that share an id are
    rows of their own, each in the component of its own text. An empty table gives no rows; other
    columns aren't read. A task that is run again has to meet its rows in the same order, as it does in files; else
    an error is raised.
    """
    return _decided(docs, id_column, text_column).drop("digest").withColumnRenamed("id", id_column)


def drop_similar(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """docs with the rows of each component that have its smallest id.

    Rows with a null id, and rows whose text is null or without words, stay. Of rows that
    share an id each goes or stays by the component of its own text; equal rows go or stay together. An empty table
    stays empty, and docs' columns may have any names.
    """
    gone = _decided(docs, id_column, text_column).filter("id != component_id")
    return drop_rows(docs, gone, id_column, text_column)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of near copies that each is in."""
    return similar_components(table(spark, sf_dir, "documents"), "doc_id", "text")


OP8_SQL = """
with recursive
docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents),
shingles as (
    select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
met as (select a.doc_id as u, b.doc_id as v, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from met join sizes a on a.doc_id = u join sizes b on b.doc_id = v where 100 * k >= 80 * (a.n + b.n - k)),
reach as (
    select u as doc_id, v as other from links
    union
    select r.doc_id, l.v from reach r join links l on r.other = l.u)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) as component_id
from docs d left join sizes s using (doc_id) left join (select doc_id, min(other) as low from reach group by doc_id) c using (doc_id)
"""

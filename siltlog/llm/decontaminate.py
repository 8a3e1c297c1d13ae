"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, drop_rows, slices, table
from .textscan import ALNUM, Words, text_bytes, words

WINDOW = 10
#: Words of a block, by which the shift table is read.
BLOCK = 2
#: Bits of a block's place in the shift table, at least and at most: there are 8 places or more for each pattern, within these bounds.
TABLE_BITS = 16, 24
#: Benchmark words that one pass holds in each task; a larger benchmark is read in several blocks of items.
PASS_WORDS = 1_000_000
#: Bytes of text that are scanned at a time.
SLICE = 4 << 20
#: Places in a slice that are searched side by side.
LANES = 4096


class Searcher:
    """Patterns of one length in words, found by Wu and Manber's method in a sequence of word hashes.

    A pattern is known by its words' hashes and its own words (bytes). The shift table
    has, for each block of BLOCK words (less for shorter patterns), how far
    the search may move on: as far as the block is from the end of any pattern.
    Where that is 0, the patterns in the suffix bucket are compared word by word.
    """

    def __init__(self, patterns: list[tuple[bytes, ...]], hashes: np.ndarray):
        self.length = hashes.shape[1]
        self.block = min(BLOCK, self.length)
        self.patterns = patterns
        self.bits = min(max((8 * len(patterns)).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
        most = self.length - self.block + 1
        self.shift = np.full(1 << self.bits, most, dtype=np.int16)
        for end in range(self.block, self.length + 1):
            np.minimum.at(self.shift, self.codes(hashes[:, end - self.block : end]), self.length - end)
        suffix, whole = self.codes(hashes[:, -self.block :]), _folded(hashes[:, j] for j in range(self.length))
        self.order = np.lexsort((whole, suffix))
        self.suffix, self.whole = suffix[self.order], whole[self.order]

    def codes(self, block: np.ndarray) -> np.ndarray:
        """Places in the shift table of blocks of word hashes, one in each row."""
        return (_folded(block[:, j] for j in range(block.shape[1])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray, found: Words, owner: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence within one text."""
        n, m, b = len(hashes), self.length, self.block
        if n < m:
            return
        code = hashes[b - 1 :].copy() if b == 1 else hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        jump = self.shift[(code >> np.uint64(64 - self.bits)).astype(np.int64)]  # by a block's first word
        ends = np.linspace(m - 1, n, min(LANES, n - m + 1) + 1).astype(np.int64)  # window ends, dealt to lanes
        at, stop = ends[:-1].copy(), ends[1:]
        hits = []
        while len(at):
            step = jump[at - b + 1].astype(np.int64)
            zero = step == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not hits:
            return
        end = np.concatenate(hits)
        end = end[owner[end] == owner[end - m + 1]]
        key = self.codes(np.stack([hashes[end - b + 1 + j] for j in range(b)], axis=1)) if len(end) else np.zeros(0, np.int64)
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        some = high > low
        end, low, high = end[some], low[some], high[some]
        whole = _folded(hashes[end - m + 1 + j] for j in range(m)) if len(end) else np.zeros(0, np.uint64)
        while len(end):  # the bucket's patterns are tried side by side, one of each in a step
            for i in np.flatnonzero(self.whole[low] == whole).tolist():
                pattern, first = int(self.order[low[i]]), int(end[i]) - m + 1
                if self.patterns[pattern] == tuple(found.data[found.begin[w] : found.end[w]].tobytes() for w in range(first, first + m)):
                    yield first, pattern
            low = low + 1
            live = (low < high) & (self.whole[np.minimum(low, len(self.whole) - 1)] <= whole)
            end, low, high, whole = end[live], low[live], high[live], whole[live]


def _folded(columns: Iterable[np.ndarray]) -> np.ndarray:
    """One hash of the word hashes in each row."""
    out = np.uint64(0)
    for column in columns:
        out = out * np.uint64(0x9E3779B97F4A7C15) + column
    return out


def _patterns(items: list[tuple], window: int) -> dict[int, dict[tuple[bytes, ...], set[int]]]:
    """By length in words: each distinct window with the places in `items` of the items that have it."""
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
    found = words(data, offsets, ALNUM)
    out: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for i in range(len(items)):
        own = [found.data[found.begin[w] : found.end[w]].tobytes() for w in range(found.first[i], found.first[i + 1])]
        n = min(window, len(own))
        for at in range(len(own) - n + 1 if n else 0):
            out[n][tuple(own[at : at + n])].add(i)
    return out


def _hash_words(patterns: list[tuple[bytes, ...]]) -> np.ndarray:
    data, offsets = text_bytes(pa.array([b" ".join(p).decode() for p in patterns], pa.large_string()))
    return words(data, offsets, ALNUM).hashes().reshape(len(patterns), -1)


_MADE: dict[str, list] = {}


def _pass(frame: DataFrame, items: list[tuple], window: int, last: bool) -> DataFrame:
    """Adds to `hits` (first and end of hit words) and `items` what these items give; counts at the last pass."""
    names = [str(k) for k, _ in items]
    shared = frame.sparkSession.sparkContext.broadcast([[(list(found), list(found.values())) for _, found in sorted(_patterns(items, window).items())], uuid.uuid4().hex])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, name = shared.value
        if name not in _MADE:  # a worker's next task has the same patterns
            _MADE.clear()
            _MADE[name] = [(Searcher(p, _hash_words(p)), of) for p, of in patterns]
        searchers = _MADE[name]
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield _scan(part, searchers, names, last)

    kept = [f.name for f in frame.schema if f.name not in ("text", "hits", "items")]
    types = ", ".join(f"`{n}` {frame.schema[n].dataType.simpleString()}" for n in kept)
    end = "n_words long, n_hit long, items array<string>" if last else "text string, hits binary, items array<string>"
    return frame.select(*kept, "text", "hits", "items").mapInArrow(run, f"{types}, {end}")


def _scan(part: pa.RecordBatch, searchers: list, names: list[str], last: bool) -> pa.RecordBatch:
    column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
    data, offsets = text_bytes(column["text"])
    found = words(data, offsets, ALNUM)
    owner, hashes = found.owner(), found.hashes()
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for searcher, of in searchers:
        for first, pattern in searcher.find(hashes, found, owner):
            doc = int(owner[first])
            spans[doc].append((first - int(found.first[doc]), first - int(found.first[doc]) + searcher.length))
            items[doc].update(names[i] for i in of[pattern])
    n, hits, had = part.num_rows, column["hits"], column["items"]
    all_hits = [hits[i].as_py() or b"" for i in range(n)]
    all_items = [had[i].as_py() or [] for i in range(n)]
    for doc, own in spans.items():
        all_hits[doc] += np.asarray(own, dtype="<i8").tobytes()
        all_items[doc] = sorted(items[doc].union(all_items[doc]))
    out = {k: v for k, v in column.items() if k not in ("text", "hits", "items")}
    if last:
        out["n_words"] = pa.array(np.diff(found.first), pa.int64())
        out["n_hit"] = pa.array([_covered(x) for x in all_hits], pa.int64())
    else:
        out["text"], out["hits"] = column["text"], pa.array(all_hits, pa.binary())
    out["items"] = pa.array(all_items, pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _covered(packed: bytes) -> int:
    """Words inside of any of the spans."""
    if not packed:
        return 0
    spans = np.frombuffer(packed, dtype="<i8").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    before = np.concatenate([[-1], reach[:-1]])
    return int(np.maximum(0, reach - np.maximum(spans[:, 0], before)).sum())


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, item_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: the id, n_words, n_hit, items (ids of found items as strings, sorted).

    Words are runs of letters and digits, A-Z lower-cased (all characters
    above U+007F count as letters). An item's windows are its runs of `window`
    words, or all of its words if it has fewer. A word of a text is hit if it is inside of an
    occurrence of any window; an item is found if any of its windows occurs.

    Items are read to the driver in blocks of at most PASS_WORDS words, and each block is
    searched for in a pass of its own over all rows, which stay in their
    partitions: nothing is shuffled. Null and empty texts have no words; rows with
    equal or null ids are treated like others, and a null item_id is the item "None"; items without words are
    never found. Without items nothing is hit. Other columns aren't read.
    """
    frame = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"), F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items"))
    blocks, size = [[]], 0
    for row in benchmark.select(item_column, item_text).toLocalIterator():
        n = len(row[1] or "") // 2 + 1
        if blocks[-1] and size + n > PASS_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], row[1]))
        size += n
        if len(blocks) > 1 and len(blocks[-1]) == 1:
            frame = _pass(frame, blocks[-2], window, last=False)
            blocks[-2] = []
    frame = _pass(frame, blocks[-1], window, last=True)
    return frame.withColumnRenamed("id", id_column)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs.

    Of rows that share an id each is judged by its own text; rows with a null id stay, and so do null and empty texts. An empty table
    stays empty, and docs' columns may have any names.
    """
    rows = docs.select(F.struct(docs[id_column].alias("id"), digest(docs[text_column]).alias("digest")).alias("row"), docs[text_column].alias("text"))
    hit = find_benchmark(rows, benchmark, "row", "text").filter("n_hit > 0")
    return drop_rows(docs, hit.select("row.id", "row.digest"), id_column, text_column)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with how many of their words are inside of passages of the benchmark."""
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = """
with
docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
    from documents),
items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
    from benchmark),
item_windows as (
    select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as words
    from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct n from item_windows),
doc_windows as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as words
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
found as (select doc_id, item_id, i, d.n from doc_windows d join item_windows b on d.n = b.n and d.words = b.words),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
named as (
    select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names
    from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)
"""

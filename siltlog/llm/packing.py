"""Packing of token streams into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Longest piece of what a text has beyond its full windows.
PIECE = 256
#: Windows that one run of the differencing method fills.
WINDOWS = 128
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The letters and numbers below U+0180.
_L, _N = r"A-Za-zªµºÀ-ÖØ-öø-ſ", r"0-9²³¹¼-¾"
#: _SPLIT for texts without apostrophes, white space next to white space and characters above: it needs no look-ahead.
_EASY_SPLIT = rf" ?(?:[{_L}]+|[{_N}]+|[^\s{_L}{_N}]+)|\s"
_ABOVE, _SPACES = re.compile(r"[^\x00-ſ]"), re.compile(r"\s\s")
#: White space as _SPLIT has it (Unicode's property White_Space), in runs too long for a look-ahead that steps back through them.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


class ByteTokenizer:
    """Ids of a byte-level BPE tokenizer.json as little-endian unsigned 32-bit integers.

    `encode` takes strings of added tokens for ordinary text; `encode_whole` gives them their
    ids, as the `tokenizers` library does with add_special_tokens=False.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        self._any, self._easy = (
            tiktoken.Encoding("vocabulary", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_SPLIT, _EASY_SPLIT)
        )
        self._path, self._library = path, None
        self._added = {content: np.asarray([i], dtype="<u4").tobytes() for content, i in added.items()}
        longest_first = map(re.escape, sorted(added, key=len, reverse=True))
        self._cuts = re.compile(f"({'|'.join(longest_first)})") if added else None
        #: Whether a token is its string and no more, so that a text may be cut at it.
        self._exact = not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])

    def encode_whole(self, text: str) -> bytes:
        if self._cuts is None or not self._cuts.search(text):
            return self.encode(text)
        if self._exact:
            return b"".join(self._added[x] if i % 2 else self.encode(x) for i, x in enumerate(self._cuts.split(text)))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return np.asarray(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ordinary text. Long runs of white space are cut out by _SPLIT's rule: all of a run at the end, else all but its last character, which goes with what follows."""
        out, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [self._split(text[at : run.start()]), self._piece(text[run.start() : end])]
            at = end
        return b"".join([*out, self._split(text[at:])])

    def _piece(self, text: str) -> bytes:
        return _bytes(self._any._core_bpe.encode_single_piece(text.encode()))

    def _split(self, text: str) -> bytes:
        easy = "'" not in text and not _SPACES.search(text) and (text.isascii() or not _ABOVE.search(text))
        return _bytes((self._easy if easy else self._any).encode_ordinary(text))


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of the items (by index) with near-equal sums.

    Every item begins as a partial partition with one group. Again and again
    the two partial partitions with the largest imbalances are merged, the
    fullest groups of one with the emptiest of the other, and only the
    differences to the emptiest group are kept. Empty groups are left out.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = k - len(b)  # groups of a that meet an empty group of b
        meet = len(a) - alone
        if meet <= 0:
            both = a + b
        else:
            both = a[:alone] + [(x + y, (s, t)) for (x, s), (y, t) in zip(a[alone:], reversed(b[-meet:]), strict=True)] + b[:-meet]
        both.sort(key=_fullness, reverse=True)
        if len(both) == k and both[-1][0]:
            least = both[-1][0]
            both = [(x - least, s) for x, s in both]
        made += 1
        heapq.heappush(heap, (-both[0][0], made, both))
    groups = [_flat(s) for _, _, both in heap for _, s in both]
    return groups + [[] for _ in range(k - len(groups))]


def _fullness(group: tuple) -> int:
    return group[0]


def _flat(joined) -> list[int]:
    out, todo = [], [joined]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        else:
            out.append(x)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups with sums of at most `capacity`, as few as differencing finds: their number rises whenever it is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return [g for g in groups if g]
        k += 1


class _Packer:
    """Packs the token streams of one task. Rows are (id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.rest: list[tuple] = []  # (id, start, ids, doc_tokens) of pieces without a sequence
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, key, ids: bytes) -> None:
        total, at, step = len(ids) // 4, 0, self.capacity
        while total - at >= step:
            self._put([(key, at, ids[4 * at : 4 * (at + step)], total)])
            at += step
        piece = min(PIECE, self.capacity)
        while at < total:
            n = min(piece, total - at)
            self.rest.append((key, at, ids[4 * at : 4 * (at + n)], total))
            self.held += n
            at += n
        if self.held >= (WINDOWS + 1) * self.capacity:
            self._fill()

    def _put(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, ids, total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def _cut(self, tokens: int) -> list[tuple]:
        """Takes that many tokens off the end of what is held."""
        out = []
        while tokens:
            key, start, ids, total = self.rest.pop()
            n = len(ids) // 4
            if n > tokens:
                self.rest.append((key, start, ids[: 4 * (n - tokens)], total))
                start, ids, n = start + n - tokens, ids[4 * (n - tokens) :], tokens
            out.append((key, start, ids, total))
            tokens -= n
            self.held -= n
        return out

    def _fill(self) -> None:
        """Packs all but what would not fill a window; a token a window is left free, as sums are only near-equal."""
        k = self.held // self.capacity
        later = self._cut(self.held - k * self.capacity + min(k, self.capacity // 8) if k else self.held)
        pieces, self.rest, self.held = self.rest, later[::-1], sum(len(x[2]) // 4 for x in later)
        if pieces:
            for group in windows([len(x[2]) // 4 for x in pieces], self.capacity):
                self._put([pieces[i] for i in group])

    def finish(self) -> None:
        """Packs what is left; less than a window goes to sequences whose lengths are powers of two, which need no padding."""
        if self.held >= self.capacity:
            self._fill()
        while self.held:
            whole = min(self.capacity, 1 << (self.held.bit_length() - 1))
            self._put(self._cut(whole)[::-1])


def pack(docs: DataFrame, id_column: str, text_column: str, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a text's token stream, with its sequence and its place there.

    A text's stream is the ids of its text, in which strings of the file's added tokens have their own ids, and then end_id; a null or empty
    text has end_id only. Streams fill windows of `capacity` tokens; what is left
    of each is cut into pieces of at most PIECE tokens, which differencing
    deals to near-equal windows, WINDOWS at a time. Each task packs the rows
    of its own partition, so nothing is shuffled, and a task that runs again packs
    the same rows into the same sequence ids. At most 11 sequences of a task
    are shorter than the rest, with lengths that are powers of two.

    Returned: the id, start (ids of the text's stream before the piece), length,
    ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    Rows with equal or null ids are packed like others. Other columns of
    docs are not read. An empty table gives no rows.
    """
    key_type = docs.schema[id_column].dataType.simpleString()
    key, text = docs[id_column].alias("key"), docs[text_column].alias("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        packer = _Packer(capacity, TaskContext.get().partitionId() << 33)
        kind = None

        def out() -> pa.RecordBatch:
            key, start, ids, total, sequence, offset = zip(*packer.rows, strict=True)
            packer.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(key, kind), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, sequence, offset))],
                ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            kind = batch.schema.field("key").type
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                packer.add(k, tokenizer.encode_whole(t.as_py() or "") + end)
                if len(packer.rows) >= 2000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    schema = f"key {key_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", id_column)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, with a checksum of each piece's ids."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

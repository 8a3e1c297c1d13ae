"""Token counts of a unigram tokenizer by count-only Viterbi search."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

SPACE = "▁"
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Places of a word that the search holds, about, so that a word may be as long as it likes.
SPAN = 1 << 15
#: Words whose counts a task keeps.
KEPT_WORDS = 300_000


def piece_scores(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces of a SentencePiece model in order of id with the scores of its file, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    """How many pieces the best segmentation of a word has.

    The best segmentation is that of the greatest sum of scores, added from left to right;
    of equal sums at a place the one whose last piece begins first. A
    character that is no piece of its own may stand as unknown. With byte fallback
    each of its bytes is a piece; without, unknown characters in a row are one.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        known = set()
        for piece, score in pieces:
            if piece and piece not in known:
                self.automaton.add_word(piece, (len(piece), score))
                known.add(piece)
        self.automaton.make_automaton()
        self.longest = max(map(len, known), default=0) + 1
        self.single = {p for p in known if len(p) == 1}
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_fallback = all(f"<0x{b:02X}>" in known for b in range(256))
        self.kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        size = min(n + 1, SPAN + 2 * self.longest)
        best = [-math.inf] * size
        begin = [-1] * size
        count = [0] * size
        unknown = [False] * size
        best[0] = 0.0
        ready = 0  # places that are settled
        base = 0  # the place that the lists begin with

        def move() -> None:
            """Forgets places that no piece reaches back to from where the search is."""
            nonlocal base
            gone = ready - base - self.longest
            for values, empty in ((best, -math.inf), (begin, -1), (count, 0), (unknown, False)):
                del values[:gone]
                values += [empty] * gone
            base += gone

        def settle(upto: int) -> None:
            nonlocal ready
            while ready < upto:
                if ready + 1 - base >= size:
                    move()
                character, at, to = word[ready], ready - base, ready + 1 - base
                if character not in self.single:
                    score = best[at] + self.unknown_score
                    if begin[to] < 0 or score > best[to]:
                        best[to], begin[to], unknown[to] = score, ready, True
                        if self.byte_fallback:
                            count[to] = count[at] + len(character.encode("utf-8", "surrogatepass"))
                        else:
                            count[to] = count[at] + (not unknown[at])
                ready += 1

        for last, (length, piece) in self.automaton.iter(word):
            settle(last)
            if last + 1 - base >= size:
                move()
            first = last + 1 - length
            at, end = first - base, last + 1 - base
            score = best[at] + piece
            if begin[end] < 0 or score > best[end] or (score == best[end] and first < begin[end]):
                best[end], begin[end], count[end], unknown[end] = score, first, count[at] + 1, False
        settle(n)
        return count[n - base]

    def text(self, text: str) -> int:
        """Pieces of a text: spaces are written as SPACE, with one ahead unless the text begins with one, and begin words."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        found = text.removeprefix(SPACE).split(SPACE)
        kept, total = self.kept, 0
        for w in found:
            n = kept.get(w)
            if n is None:
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                n = self.word(SPACE + w)
                if len(w) < 64:
                    kept[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, id_column: str, text_column: str, model_path: str) -> DataFrame:
    """One row per row of docs: the id and n_tokens, the number of pieces of the text.

    The tokenizer is a unigram model whose pieces and scores are those of the SentencePiece file.
    Each word's matches are enumerated by an Aho-Corasick automaton, and
    dynamic programming carries the best score and its number of pieces; no
    segmentation is built, and a long word is searched in a window of SPAN places. Texts are split at every space, and each word, with the space ahead of it, is searched alone:
    a piece with a space after its first character is never matched. In piece_bpe_32k.model these
    are the 14 runs of two or more spaces, so a run of n spaces counts as about n pieces. A null or empty text has none. Equal rows and rows with null ids
    are treated like others; other columns aren't read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(*piece_scores(model_path))
        for batch in batches:
            counts = [counter.text(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    frame = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return frame.mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_column)


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))

"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut, digest, drop_rows, lowest, near, slices, table
from .textscan import mix, text_bytes

#: Labelled rows that the text model is fitted on, at most: those with the smallest hashes of their ids.
TRAINING_ROWS = 4000
#: Places that byte trigrams are hashed to, as a power of two.
BITS = 15
SLICE = 1 << 20
#: Trigrams overlap, so their log chances are not those of independent events: n of them count as n * EVIDENCE / (n + EVIDENCE), in texts of any length.
EVIDENCE = 100
#: Chance that a declared language, or the language of an address suffix, is the text's.
DECLARED, SUFFIX = 0.9, 0.8
#: Rows of a domain that its prior counts for in a host's, and of all rows in a domain's.
SMOOTHING = 5.0
#: Least chance of the language found for a row to be accepted.
LEAST = 0.5
# Languages of address suffixes that are mostly of one language.
SUFFIXES = {"at": "de", "de": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pl": "pl", "pt": "pt", "br": "pt", "ru": "ru", "jp": "ja", "se": "sv"}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class TextModel:
    """Log chances of hashed byte trigrams in each language."""

    languages: list[str]
    weights: np.ndarray

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log chances for each text and language, and how many trigrams each text has."""
        places, owner = trigrams(column)
        n = np.bincount(owner, minlength=len(column))
        out = np.zeros((len(column), len(self.languages)))
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(owner, self.weights[j][places], len(column))
        return out, n


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around each letter of each text, with everything but letters as one mark, and the text that each is of."""
    data, offsets = text_bytes(column)
    letter = _LETTER[data]
    plain = np.where(letter, data, 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    before, after = np.full(len(data), 32, np.uint64), np.full(len(data), 32, np.uint64)
    if len(data) > 1:
        same = owner[1:] == owner[:-1]
        before[1:][same] = plain[:-1][same]
        after[:-1][same] = plain[1:][same]
    code = (before << np.uint64(16) | plain << np.uint64(8) | after)[letter]
    return (mix(code) >> np.uint64(64 - BITS)).astype(np.int64), owner[letter]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's trigrams and how often each is met."""
    return np.unique(trigrams(pa.array([text or ""], pa.large_string()))[0], return_counts=True)


def fit(rows: list[tuple[str, str]]) -> TextModel:
    """Text model of (text, language) rows, with add-one smoothing."""
    return fit_counted((language, *counted(text)) for text, language in rows)


def fit_counted(rows: Iterable[tuple[str, np.ndarray, np.ndarray]]) -> TextModel:
    """Text model of (language, places, counts) rows."""
    sums: dict[str, np.ndarray] = {}
    for language, places, counts in rows:
        sums.setdefault(language, np.ones(1 << BITS))[places] += counts
    languages = sorted(sums)
    weights = np.zeros((len(languages), 1 << BITS), dtype=np.float32)
    for j, language in enumerate(languages):
        weights[j] = np.log(sums[language] / sums[language].sum())
    return TextModel(languages, weights)


def train(labelled: DataFrame, id_column: str, text_column: str, language_column: str, most: int = TRAINING_ROWS) -> TextModel:
    """Text model from the whole texts of `most` labelled rows at most, those with the smallest hashes of their ids.

    Rows without a language are left out; a null text has no trigrams, and equal hashes are put in order by id, language and counts.

    Trigrams are counted where the texts are read. One task adds up the counts (10 bytes for each
    of a text's places) and sends back 4 << BITS bytes a language.
    """
    rows = labelled.filter(F.col(language_column).isNotNull()).select(
        F.col(id_column).cast("string").alias("id"), F.col(language_column).alias("language"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column).cast("string")).alias("hash")
    )
    last = lowest(rows, "hash", most)
    if last is None:
        return fit([])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = [counted(t.as_py()) for t in part.column("text")]
                grams = [(places.astype("<u2").tobytes(), counts.astype("<u8").tobytes()) for places, counts in found]
                columns = [pa.array([g[i] for g in grams], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("hash", "id", "language")), *columns], ["hash", "id", "language", "places", "counts"])

    sampled = rows.filter(F.col("hash") <= last).mapInArrow(count, "hash long, id string, language string, places binary, counts binary")
    chosen = sampled.orderBy("hash", "id", "language", "places", "counts").limit(most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_counted(
            (language.as_py(), np.frombuffer(places.as_py(), "<u2"), np.frombuffer(counts.as_py(), "<u8"))
            for b in batches
            for language, places, counts in zip(b.column("language"), b.column("places"), b.column("counts"), strict=True)
        )
        yield pa.RecordBatch.from_arrays([pa.array(model.languages, pa.string()), pa.array([w.astype("<f4").tobytes() for w in model.weights], pa.binary())], ["language", "weights"])

    found = sorted(chosen.select("language", "places", "counts").coalesce(1).mapInArrow(run, "language string, weights binary").collect())
    return TextModel([r[0] for r in found], np.asarray([np.frombuffer(r[1], "<f4") for r in found], dtype=np.float32).reshape(len(found), 1 << BITS))


def identify(rows: DataFrame, keys: list[str], model: TextModel) -> DataFrame:
    """One row per row of `rows` (keys, text, declared, suffix, host): the keys, language, confidence, accepted.

    A language's chance is the product, scaled to a sum of 1, of the text's likelihood,
    those of the declared language and the suffix, where they are known
    languages, and the host's prior. Priors come from grouped sums of the text's
    chances: a host's is smoothed with its domain's (its last two labels), and that with the
    prior of all rows. A row is accepted if its text has letters and the
    best language has a chance of LEAST or more.

    A null or empty text has no letters; its language and confidence are null. A null declared
    language, suffix or host gives no evidence (a null host has the prior of all rows). Equal rows and rows with null keys
    are treated like others. Keys with names of other columns here are an error. Without languages in the model nothing is accepted.
    """
    languages = model.languages
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                column = dict(zip(part.schema.names, part.columns, strict=True))
                likely, n = shared.value.score(column.pop("text"))
                likely *= (EVIDENCE / (n + EVIDENCE))[:, None]
                if likely.shape[1]:
                    likely -= likely.max(axis=1, keepdims=True)
                column["letters"] = pa.array(n, pa.int64())
                column["likely"] = pa.array(list(likely), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(list(column.values()), list(column))

    clash = {"text", "host", "suffix", "declared", "letters", "likely"} & {k.lower() for k in keys}
    if clash:
        raise ValueError(f"keys can't be called {sorted(clash)}")
    frame = rows.select(*keys, "declared", "suffix", "host", "text")
    scored = cut(frame.mapInArrow(run, f"{kinds}, declared string, suffix string, host string, letters long, likely array<double>"))
    if not languages:
        return scored.select(*keys, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("accepted"))

    def scaled(logs: list[Column]) -> list[Column]:
        total = sum((F.exp(x) for x in logs[1:]), F.exp(logs[0]))
        return [F.exp(x) / total for x in logs]

    count = range(len(languages))
    chance = scaled([F.col("likely")[j] for j in count])
    domain = F.substring_index("host", ".", -2)
    sums = [F.sum(chance[j]).alias(f"c{j}") for j in count]
    hosts = cut(scored.filter("letters > 0").groupBy("host").agg(*sums, F.count(F.lit(1)).alias("n")))
    again = [F.sum(f"c{j}").alias(f"d{j}") for j in count]
    domains = hosts.groupBy(domain.alias("domain")).agg(*again, F.sum("n").alias("m"))
    whole = hosts.agg(*[F.sum(f"c{j}") for j in count], F.sum("n")).first()
    overall = [((whole[j] or 0.0) + 1.0) / ((whole[len(languages)] or 0) + len(languages)) for j in count]
    of_domain = [(F.col(f"d{j}") + SMOOTHING * overall[j]) / (F.col("m") + SMOOTHING) for j in count]
    of_host = [((F.col(f"c{j}") + SMOOTHING * of_domain[j]) / (F.col("n") + SMOOTHING)).alias(f"p{j}") for j in count]
    priors = cut(hosts.withColumn("domain", domain).join(domains, "domain").select("host", *of_host))
    priors = near(priors, BROADCAST_IDS // 10)

    def evidence(value: Column, language: str, right: float) -> Column:
        wrong = (1 - right) / max(1, len(languages) - 1)
        return F.when(value.isin(languages), F.when(value == language, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log(wrong))))).otherwise(F.lit(0.0))

    tongue = F.col("suffix")
    if SUFFIXES:
        tongue = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[F.lower("suffix")]
    known = F.lower(F.substring_index(F.col("declared"), "-", 1))
    fused = [
        F.col("likely")[j] + evidence(known, x, DECLARED) + evidence(F.coalesce(tongue, F.lit("")), x, SUFFIX) + F.log(F.coalesce(F.col(f"p{j}"), F.lit(overall[j])))
        for j, x in enumerate(languages)
    ]
    joined = scored.join(priors, "host", "left").select(*keys, "letters", F.array(*fused).alias("logs"))
    top = joined.withColumn("top", F.array_max("logs")).withColumn("sum", F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logs"))))
    best = F.array(*map(F.lit, languages))[(F.array_position("logs", F.col("top")) - 1).cast("int")]
    seen = F.col("letters") > 0
    return top.select(*keys, F.when(seen, best).alias("language"), F.when(seen, 1 / F.col("sum")).alias("confidence"), (seen & (1 / F.col("sum") >= LEAST)).alias("accepted"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Rows for identify() of documents, with their source as host. Their lang is what the model learns from, so it is no evidence."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Rows for identify() of web pages: text between tags, the html element's lang, and the address' host and its suffix.

    What isn't closed (a tag, a comment, a script) goes on to the end of the page. A null html has a null text and an empty
    declared language, a null url a null host and suffix; equal rows and null ids are rows like others.
    """
    # possessive, and up to the end where a tag is never closed, so that each character is looked at a few times only
    text = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*+>(?:(?!</\1\s*+>).)*+(?:</\1\s*+>|\z)|<!--(?:(?!-->).)*+(?:-->|\z)|<[^>]*+(?:>|\z)", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    return pages.select("page_id", text.alias("text"), declared.alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language isn't accepted.

    Of rows that share a doc_id each is judged by its own text and source; rows with a null doc_id stay. Null and empty texts
    go, as they have no letters. An empty table stays empty, and docs' further columns may have any names.
    """
    model = train(docs, "doc_id", "text", "lang")
    rows = from_documents(docs).withColumn("mark", digest(F.col("text"), F.col("host")))
    rejected = identify(rows, ["doc_id", "mark"], model).filter("not accepted")
    return drop_rows(docs, rejected.select(F.col("doc_id").alias("id"), F.col("mark").alias("digest")), "doc_id", "text", "source")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents (doc_id) and all pages (page_id), with priors of hosts over both."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = train(docs, "doc_id", "text", "lang")
    rows = from_documents(docs).unionByName(from_pages(pages), allowMissingColumns=True)
    return identify(rows, ["doc_id", "page_id"], model)

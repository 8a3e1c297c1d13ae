"""Exact deduplication by progressive refinement, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, digest, drop_rows, near, table

#: Characters of the normalised text that the second refinement looks at.
PREFIX = 256
#: Groups whose keys (at most a SHA-256 and an id) may be broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000


def normalised(text: Column) -> Column:
    """text without white space (space, tab, line feed, vertical tab, form feed, carriage return); null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for character in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(character), F.lit(""))
    return out


def _decided(docs: DataFrame, id_column: str, text_column: str, hash_all: bool) -> DataFrame:
    """One row per row of docs: id, digest (of the original text), keep_id, group_size, kept, sha; see exact_dedup()."""
    text = F.coalesce(docs[text_column], F.lit(""))
    clean = docs.select(docs[id_column].alias("id"), digest(docs[text_column]).alias("digest"), F.length(text).alias("points"), normalised(text).alias("clean"))
    signed = clean.select("id", "digest", "points", "clean", F.octet_length("clean").alias("size"), F.xxhash64(F.substring("clean", 1, PREFIX)).alias("prefix"))
    shared = cut(signed.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("size", "prefix", F.lit(True).alias("shared")))
    full = F.sha2("clean", 256)
    if shared.count() <= BROADCAST_GROUPS:
        found = signed.join(F.broadcast(shared), ["size", "prefix"], "left").select("id", "digest", "points", "shared", (full if hash_all else F.when(F.col("shared"), full)).alias("sha"))
    else:  # the hash goes ahead of the shuffle, so that no text is shuffled
        found = signed.select("id", "digest", "points", "size", "prefix", full.alias("sha")).join(shared.hint("merge"), ["size", "prefix"], "left")
    found = cut(found.select("id", "digest", "points", F.coalesce("shared", F.lit(False)).alias("shared"), "sha"))
    rest = found.filter("shared")
    best = F.min(F.struct(-F.col("points"), F.col("id").isNull(), F.col("id").alias("keep_id"))).alias("best")
    groups = cut(rest.groupBy("sha").agg(best, F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    joined = rest.join(near(groups, BROADCAST_GROUPS), "sha", "left")
    kept = F.col("best").isNull() | ((F.col("best")["col1"] == -F.col("points")) & F.col("best.keep_id").eqNullSafe(F.col("id")))
    keep_id = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.keep_id"))
    grouped = joined.select("id", "digest", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "sha")
    alone = found.filter("not shared").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(grouped)


def exact_dedup(docs: DataFrame, id_column: str, text_column: str, sha: str | None = None) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept.

    Texts are equal if they are identical after normalised(). Rows are refined by
    the length of the normalised text, then by a hash of its first PREFIX
    characters, counted in one pre-aggregated pass over the nested key; the whole content is hashed (SHA-256) only of rows
    whose length and prefix hash another row shares. Of a group the text with
    the most code points stays, then that with the smallest id.

    With `sha`, that column has the hash of every row's normalised text, for
    which the rest is hashed too. A null text equals an empty one. Rows with
    equal ids whose texts are equal and have as many code points are kept or dropped together; a null id comes
    after all others. Other columns aren't read; no rows give no rows.
    """
    out = _decided(docs, id_column, text_column, sha is not None).drop("digest").withColumnRenamed("id", id_column)
    return out.withColumnRenamed("sha", sha) if sha else out.drop("sha")


def drop_copies(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """docs without the rows that exact_dedup() does not keep.

    Of rows that share an id each is judged by its own text; rows with a null id stay. An empty table stays empty, and docs'
    columns may have any names.
    """
    return drop_rows(docs, _decided(docs, id_column, text_column, False).filter("not kept"), id_column, text_column)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the copy of each that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), "doc_id", "text", sha="text_sha256")


OP2_SQL = """
with clean as (
    select doc_id, length(coalesce(text, '')) as points,
           sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
    from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as kept,
       text_sha256
from clean
"""

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an id and a few numbers that may be broadcast; larger sets are joined by a shuffle.
BROADCAST_IDS = 250_000
_INFER = "spark.sql.constraintPropagation.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir; where that is unset, a temporary one on a local master and an error on a cluster."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    if given is None:
        given = context.getCheckpointDir()
    if given is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="siltlog-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/siltlog-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str | None = None) -> None:
    """Deletes a folder of this application's, or all of them: what was read from it must not be needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path or work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor loses none of it.

    A checkpoint keeps what the optimizer has inferred of its columns, which doubles with each
    round of a loop over cut tables; so nothing is inferred here.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_INFER)
    spark.conf.set(_INFER, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_INFER, before)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffle files and broadcasts are removed only when nothing refers to them there, which else may take half an hour.

    What Python has let go is told to the JVM by a thread that looks every second, so it is waited for: what a
    collection still finds in use is old from then on, and is not looked at again for long.
    """
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


def near(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A cut table as the side of a join on its own unique keys: broadcast up to `limit` rows, merged with a shuffle beyond."""
    return F.broadcast(df) if df.count() <= (BROADCAST_IDS if limit is None else limit) else df.hint("merge")


def lowest(rows: DataFrame, place: str, most: int) -> int | None:
    """The `most`-th lowest value of the column of 64-bit hashes, or the highest if there are fewer; None without rows.

    Hashes are spread evenly, so those far above it are left out first: else every task would
    send `most` of its own to the one that merges them.
    """
    share = min(1.0, 2 * most / max(1, rows.count()))
    few = rows.select(place).filter(F.col(place) <= min((1 << 63) - 1, int((2 * share - 1) * (1 << 63))))
    for values in (few, rows.select(place)):
        n, last = values.orderBy(place).limit(most).agg(F.count(F.lit(1)), F.max(place)).first()
        if n == most or share == 1.0:
            return last
    return last


def digest(*columns: Column) -> Column:
    """A 64-bit digest of a row's columns, by which rows with the same id are told apart; nulls differ from empty strings."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def drop_rows(docs: DataFrame, gone: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """docs without the rows whose id and digest() of `columns` are in gone (id, digest); rows with a null id stay.

    The decision is one of rows: of two rows with one id only those go whose own
    columns were judged so.
    """
    key, mark = (fresh_name(docs.columns, x) for x in ("gone_id", "gone_digest"))
    away = near(cut(gone.filter("id is not null").select(F.col("id").alias(key), F.col("digest").alias(mark)).distinct()), 4 * BROADCAST_IDS)  # the other side has whole texts
    same = (docs[id_column] == F.col(key)) & (digest(*[docs[c] for c in columns]) == F.col(mark))
    return docs.join(away, same, "left_anti")


def fresh_name(columns: Iterable[str], name: str) -> str:
    """name, lengthened until no column has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterable[pa.RecordBatch]:
    """Runs of rows with at most `most` bytes of text each (or one row that has more)."""
    at, held = 0, 0
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
    for i, n in enumerate(lengths):
        n = n or 0
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)

"""Exact nearest neighbours over vectors kept as arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a task's largest arrays of pairs.
CELLS = 1 << 20


def encode_vector(vector: Column, metadata: Column | None = None) -> Column:
    """A vector of floats and its metadata as the value of a key, in JSON."""
    fields = [vector.cast("array<float>").alias("vector"), *([metadata.cast("string").alias("metadata")] if metadata is not None else [])]
    return F.to_json(F.struct(*fields))


def decode_vector(value: Column) -> Column:
    """struct(vector, metadata) of a value; null for values that are no vectors, so that vectors and other values may share a table."""
    found = F.from_json(value.cast("string"), "vector array<float>, metadata string")
    return F.when(found["vector"].isNotNull(), found)


def distance(vector: Column, query: list[float], metric: str = "l2") -> Column:
    """Distance in double precision: l2, inner (negated product) or cosine (1 - similarity)."""
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    v = vector.cast("array<double>")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)

    if metric == "l2":
        return F.sqrt(total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    product = total(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "inner":
        return -product
    norms = F.sqrt(total(F.transform(v, lambda a: a * a))) * float(sum(x * x for x in query) ** 0.5)
    return 1 - product / F.nullif(norms, F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest (id, dist), ties by id: each task keeps k rows, which then are merged."""
    return vectors.select(id_column, distance(F.col(vector_column), query, metric).alias("dist")).orderBy("dist", id_column).limit(k)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_column: str = "vec_id", vector_column: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, id, dist, rank): the k nearest to each query (id_column, vector_column), exactly, ties by id.

    Queries are taken in blocks of `block` vectors, which are broadcast; each task compares them with a slice of
    the vectors at a time, of as many as CELLS allows, and keeps k of each, and the tasks' lists are merged by query.
    A vector of another length, or a null one, is near to nothing.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"query_id {queries.schema[id_column].dataType.simpleString()}, id {kind}, dist double"
    frame = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    parts, held = [], []

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], np.asarray([list(r[1]) for r in rows], dtype=np.float64)))
        return frame.mapInArrow(lambda batches: _nearest(batches, *shared.value, k, metric), schema)

    for row in queries.select(id_column, vector_column).filter(F.col(vector_column).isNotNull()).toLocalIterator():
        if held and (len(held) == block or len(held[-1][1]) != len(row[1])):
            parts.append(search(held))
            held = []
        held.append(row)
    if held:
        parts.append(search(held))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _rough(queries: np.ndarray, vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all pairs (l2: their squares) from one product, and by how much those of each query may be off, at most."""
    product = queries @ vectors.T
    q, v = np.square(queries).sum(axis=1), np.square(vectors).sum(axis=1)
    unit = 8 * (queries.shape[1] + 8) * np.finfo(float).eps
    lengths, longest = np.sqrt(q), np.sqrt(v.max())
    if metric == "l2":
        product *= -2
        product += q[:, None]
        product += v
        return product, unit * np.square(lengths + longest)
    if metric == "inner":
        return np.negative(product, out=product), unit * lengths * longest
    product /= lengths[:, None]
    product /= np.sqrt(v)
    return np.subtract(1, product, out=product), np.full(len(q), unit)


def _exact(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each query to the vector beside it, summed from the first place to the last, as distance() does."""

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))

    if metric == "l2":  # differences, as squares that are subtracted lose near ones
        return np.sqrt(total(np.square(vectors - queries)))
    product = total(vectors * queries)
    if metric == "inner":
        return -product
    return 1 - product / (np.sqrt(total(np.square(vectors))) * np.sqrt(total(np.square(queries))))


def _rows(column: pa.Array, size: int) -> tuple[np.ndarray, pa.Array]:
    """Places of the vectors of that size without nulls, and their numbers one after another."""
    places = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    numbers = column.take(pa.array(places)).flatten()
    if numbers.null_count:
        whole = ~pc.is_null(numbers).to_numpy(zero_copy_only=False).reshape(len(places), size).any(axis=1)
        places, numbers = places[whole], numbers.filter(pa.array(np.repeat(whole, size)))
    return places, numbers


def _nearest(batches: Iterable[pa.RecordBatch], ids: list, queries: np.ndarray, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Pairs that may be among a query's k nearest by a rough distance are compared exactly; a table of pairs has CELLS cells at most, whatever the batch."""
    best: list[list[tuple]] = [[] for _ in ids]
    bound = np.full(len(ids), np.inf)
    size, kinds = queries.shape[1], None
    step, pairs = max(1, CELLS // max(len(ids), size)), max(1, CELLS // max(1, size))
    for batch in batches:
        kinds = batch.schema.field("id").type
        places, numbers = _rows(batch.column("vector"), size)
        for at in range(0, len(places), step):
            own = places[at : at + step]
            vectors = numbers[at * size : (at + len(own)) * size].cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(own), size)
            names = batch.column("id").take(pa.array(own)).to_pylist()
            with np.errstate(all="ignore"):
                rough, off = _rough(queries, vectors, metric)
                limit = bound
                if len(own) >= k and np.isinf(bound).any():
                    limit = np.fmin(bound, np.partition(rough, k - 1, axis=1)[:, k - 1] + off)
                near, there = np.nonzero(~(rough > (limit + off)[:, None]))  # what is no number too
                for i in range(0, len(near), pairs):
                    q, v = near[i : i + pairs], there[i : i + pairs]
                    dist = _exact(queries[q], vectors[v], metric)
                    if metric == "cosine":  # a vector without a direction is near to nothing
                        q, v, dist = (x[~np.isnan(dist)] for x in (q, v, dist))
                    starts = np.flatnonzero(np.diff(q, prepend=-1))
                    for j, end in zip(starts, [*starts[1:], len(q)], strict=True):
                        found = ((d != d, 0.0 if d != d else d, names[x]) for d, x in zip(dist[j:end].tolist(), v[j:end].tolist(), strict=True))
                        best[q[j]] = mine = sorted([*best[q[j]], *found])[:k]
                        if len(mine) == k and not mine[-1][0]:
                            bound[q[j]] = mine[-1][1] ** 2 if metric == "l2" else mine[-1][1]
    flat = [(ids[q], i, float("nan") if bad else d) for q, own in enumerate(best) for bad, d, i in own]
    if flat:
        columns = list(zip(*flat, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], kinds), pa.array(columns[2], pa.float64())], ["query_id", "id", "dist"])


def recall(found: DataFrame, exact: DataFrame, id_column: str = "vec_id") -> float:
    """Share of the exact neighbours that were found."""
    wanted = exact.select(id_column).distinct()
    n = wanted.count()
    return found.select(id_column).distinct().join(wanted, id_column).count() / n if n else 1.0

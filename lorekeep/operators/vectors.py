"""Vector index: exact cosine search over unit vectors.

Vectors are normalised when written, so a search is a dot product.  Scores
are computed in Arrow batches by numpy against a block of query vectors; a
top-k keeps k rows per task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crypto import open_sealed, seal
from ..functions.scalars import normalized, vector_error
from ..schema import VECTOR
from .store import latest

#: Cosines that a task holds at once, and query vectors that go out at once.
CELLS = 4_000_000
QUERY_BLOCK = 16_384


def index_rows(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Valid vectors at unit length, the latest of each (namespace, record_id) if rows have ``seq``."""
    rows = vectors.where(vector_error(F.col("embedding"), dim).isNull())
    if "seq" in vectors.columns:
        rows = latest(rows, ["namespace", "record_id"])
    return rows.withColumn("embedding", normalized(F.col("embedding")))


def rejected(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``vectors`` that cannot be indexed, with ``error``."""
    return vectors.withColumn("error", vector_error(F.col("embedding"), dim)).where("error is not null")


def pinned_dim(index: DataFrame) -> DataFrame:
    """``namespace, dim``: an index's one dimension; more than one is an error the caller sees as ``dims > 1``."""
    return index.groupBy("namespace").agg(F.max(F.size("embedding")).alias("dim"), F.count_distinct(F.size("embedding")).alias("dims"))


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("namespace", "record_id"), ["namespace", "record_id"], "left_anti")


Queries = list[tuple[int, list[float]]]


def _similarities(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names and cosines (rows by queries) of slices of the index, of at most CELLS cosines."""
    for batch in batches:
        step = max(1, CELLS // max(1, len(matrix)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            values = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(values) != part.num_rows * matrix.shape[1]:
                raise ValueError(f"the index has vectors of another dimension than {matrix.shape[1]}")
            rows = values.reshape(part.num_rows, -1)
            norms = np.linalg.norm(rows, axis=1)
            # a product with one vector may sum a row by where it stands, and equal vectors are to have equal scores
            dots = (rows * matrix).sum(axis=1, keepdims=True) if len(matrix) == 1 else rows @ matrix.T
            yield np.array(part.column("record_id").to_pylist(), dtype=object), dots / np.where(norms > 0, norms, 1)[:, None]


def _unit(queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64).reshape(len(queries), -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    if not np.isfinite(matrix).all() or not (lengths > 0).all():
        raise ValueError("a query vector must be finite and not zero")
    return ids, matrix / lengths


_FOUND = "qid long, record_id string, score double"


def _found(ids: np.ndarray, q: np.ndarray, names: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names, pa.string()), pa.array(s)], ["qid", "record_id", "score"])


def id_order(natural: bool) -> list[Column]:
    """By record_id; ``natural`` takes shorter ones first, so that numbers after one prefix count as numbers."""
    return [F.length("record_id")] * natural + [F.col("record_id")]


def scores(index: DataFrame, queries: Queries, k: int, keep: Column | None = None, digits: int | None = None, natural: bool = False) -> DataFrame:
    """``qid, record_id, score``: the ``k`` best rows of each task for each query; ties go by record_id (see ``id_order``).

    A task keeps one running best of ``k`` for each query over all its batches.
    """
    ids, matrix = _unit(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names, s = np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        least = np.full(len(ids), -np.inf)
        for name, part in _similarities(batches, matrix):
            if digits is not None:
                part = np.round(part, digits)
            if len(part) > k:
                least = np.maximum(least, np.partition(part, len(part) - k, axis=0)[len(part) - k])
            row, own = np.nonzero(part >= least)
            q, names, s = np.concatenate([q, own]), np.concatenate([names, name[row]]), np.concatenate([s, part[row, own]])
            text = names.astype(str)
            order = np.lexsort((text, *[np.char.str_len(text)] * natural, -s, q))
            q, names, s = q[order], names[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            least[q[rank == k - 1]] = s[rank == k - 1]
            q, names, s = q[rank < k], names[rank < k], s[rank < k]
        if len(q):
            yield _found(ids, q, names, s)

    source = index if keep is None else index.where(keep)
    return source.select(F.col("record_id").cast("string").alias("record_id"), "embedding").mapInArrow(run, _FOUND)


def within(index: DataFrame, queries: Queries, least: float) -> DataFrame:
    """``qid, record_id, score`` of all rows whose score is at least ``least``."""
    ids, matrix = _unit(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, part in _similarities(batches, matrix):
            row, own = np.nonzero(part >= least)
            if len(row):
                yield _found(ids, own, names[row], part[row, own])

    return index.select(F.col("record_id").cast("string").alias("record_id"), "embedding").mapInArrow(run, _FOUND)


def top_k(index: DataFrame, queries: Queries, k: int, digits: int | None = None) -> DataFrame:
    """``qid, record_id, score, rank``: the exact ``k`` best; ties go by record_id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "record_id")
    return scores(index, queries, k, digits=digits).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_blocks(queries: DataFrame, search: Callable[[Queries], DataFrame], folder: str, block: int = QUERY_BLOCK) -> DataFrame:
    """``search`` for all ``queries`` (``qid, embedding``), so many at a time, each block's answer written to ``folder``.

    The driver holds one block of query vectors, never all; the plan does not
    grow with their number.
    """
    spark = queries.sparkSession
    n = max(1, -(-queries.count() // block))
    schema = None
    for b in range(n):
        rows = [(r["qid"], list(r["embedding"])) for r in queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b).collect()]
        if rows:
            found = search(rows)
            schema = found.schema
            found.write.mode("overwrite").parquet(f"{folder}/block={b}")
    if schema is None:
        raise ValueError("no queries")
    return spark.read.schema(schema).parquet(folder).select(schema.names)


def save_index(index: DataFrame, path: str, version: int, key: bytes | None = None) -> None:
    """Write a version of an index; with ``key`` each vector is sealed, bound to its record."""
    if key is not None:
        index = index.withColumn("embedding", seal(F.to_json("embedding"), key, F.concat_ws("\n", "namespace", "record_id")))
    index.select("namespace", "record_id", "embedding").write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def open_index(spark, path: str, key: bytes | None = None) -> DataFrame:
    """The newest version of an index, an empty one if none was written; a vector that was tampered with, or another key, fails the read."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], VECTOR)
    rows = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).drop("version")
    if key is None:
        return rows
    plain = open_sealed(F.col("embedding"), key, F.concat_ws("\n", "namespace", "record_id")).cast("string")
    sure = F.when(plain.isNull(), F.raise_error(F.lit("a vector does not open"))).otherwise(plain)
    return rows.withColumn("embedding", F.from_json(sure, "array<float>"))


def search(index: DataFrame, query: list[float], k: int, natural: bool = False) -> DataFrame:
    """``record_id, score`` of one query."""
    return scores(index, [(0, query)], k, natural=natural).select("record_id", "score").orderBy(F.desc("score"), *id_order(natural)).limit(k)


def size_of(index: DataFrame) -> DataFrame:
    return index.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))

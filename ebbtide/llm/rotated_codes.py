"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is the centre plus a rest of some length; the rest's direction is
turned by a random rotation and stored as one sign bit a dimension, with its
length and the share of the direction that the signs keep. From bits and scalars
the inner product with a query is estimated without bias, and the error stays
within a multiple of a known width. Rows are dealt evenly to blocks; a block of
base rows meets a block of queries in one task, where the queries are compared
with the packed codes and only vectors whose upper bound reaches the score of the best
ones found so far are ranked by exact products of the original vectors. Blocks' best rows
are merged by query.

Cases: vectors that are null, zero or hold null or non-finite components take no
part, nor do those of another length than the commonest (the longer of two
equally common); a repeated vec_id counts once, with its smallest vector; ties
go to the smaller vec_id; a query without candidates has no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.session import stage


@dataclass(frozen=True)
class Settings:
    base_rows: int = 8192  # rows of a block; a task holds one block of each
    query_rows: int = 4096
    queries_at_once: int = 64
    widths: float = 1.6  # error bound in standard widths
    seed: int = 11


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return rows.join(F.broadcast(common.select("n")), F.size("embedding") == F.col("n"), "left_semi")  # one row


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length of the rest, and the share of its direction that the signs keep."""
    rest = (vectors - centre) @ turn.T
    length = np.linalg.norm(rest, axis=1)
    kept = np.abs(rest).sum(axis=1) / (np.maximum(length, 1e-300) * math.sqrt(vectors.shape[1]))
    return np.packbits(rest >= 0, axis=1), length, np.where(length > 0, kept, 1.0)


def bounds(queries: np.ndarray, bits: np.ndarray, length: np.ndarray, kept: np.ndarray, centre: np.ndarray, turn: np.ndarray, widths: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and their error bounds."""
    dims = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dims).astype(np.float32) * np.float32(2 / math.sqrt(dims)) - np.float32(1 / math.sqrt(dims))
    turned = (queries @ turn.T).astype(np.float32)
    scale = (length / kept).astype(np.float32)
    estimate = (turned @ signs.T) * scale + (queries @ centre).astype(np.float32)[:, None]
    spread = length * np.sqrt(np.maximum(1 - kept**2, 0)) / kept / math.sqrt(max(dims - 1, 1))
    return estimate, widths * np.linalg.norm(queries, axis=1).astype(np.float32)[:, None] * spread.astype(np.float32)


def exact(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of chosen rows in double precision, summed in the order of the components."""
    total = np.zeros(len(q))
    for k in range(queries.shape[1]):
        total += queries[q, k] * vectors[v, k]
    return total


def best_in_block(queries, query_ids, vectors, vec_ids, codes, centre, turn, k: int, settings: Settings):
    """Query ids, vec ids and exact scores of the k best rows of one block for each query.

    The k-th best exact score among the rows of largest estimate is the bar;
    then all rows are ranked exactly whose upper bound reaches it.
    """
    out = []
    for begin in range(0, len(queries), settings.queries_at_once):
        own, ids = queries[begin : begin + settings.queries_at_once], query_ids[begin : begin + settings.queries_at_once]
        estimate, error = bounds(own, *codes, centre, turn, settings.widths)
        same = ids[:, None] == vec_ids[None, :]
        estimate[same] = -np.inf
        bar = np.full(len(own), -np.inf)
        tried = min(4 * k, estimate.shape[1])
        if tried > k:
            likely = np.argpartition(-estimate, tried - 1, axis=1)[:, :tried]
            sure = exact(own, vectors, np.repeat(np.arange(len(own)), tried), likely.ravel()).reshape(likely.shape)
            sure[np.take_along_axis(same, likely, 1)] = -np.inf
            bar = np.partition(sure, tried - k, axis=1)[:, tried - k]
        q, v = np.nonzero((estimate + error >= bar[:, None] - 1e-6) & ~same)
        score = exact(own, vectors, q, v)
        order = np.lexsort((vec_ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < k
        out.append((ids[q[top]], vec_ids[v[top]], score[top]))
    return [np.concatenate(x) for x in zip(*out)]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k rows of largest inner product but itself."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, vec_id, embedding).select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")), "vectors")
    size, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    empty = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not asked:
        return spark.createDataFrame([], empty)
    dims = rows.select(F.size("embedding")).first()[0]
    centre = np.array(rows.agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(dims)])).first()[0])
    turn = rotation(dims, settings.seed)
    base_blocks, query_blocks = math.ceil(size / settings.base_rows), math.ceil(asked / settings.query_rows)

    # codes once for each row, not once for each block it meets
    coded_schema = T.StructType([*rows.schema.fields, T.StructField("bits", T.BinaryType()), T.StructField("length", T.DoubleType()), T.StructField("kept", T.DoubleType())])

    def code(batches):
        for batch in batches:
            if not len(batch):
                continue
            own = np.array(batch.column("embedding").flatten()).reshape(len(batch), dims)
            bits, length, kept = encode(own, centre, turn)
            packed = pa.array([b.tobytes() for b in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(length), pa.array(kept)], names=[*batch.schema.names, "bits", "length", "kept"])

    coded = rows.mapInArrow(code, coded_schema)
    base = coded.withColumn("base_block", F.pmod(F.xxhash64("vec_id"), F.lit(base_blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asking = (
        rows.where("is_query")
        .withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int"))
        .withColumn("base_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(base_blocks - 1).cast("long"))))
    )
    keys = ["base_block", "query_block"]
    found = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = lambda t: np.array(t.column("embedding").combine_chunks().flatten()).reshape(len(t), dims)
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        bits = np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint8).reshape(len(right), -1)
        codes = (bits, right.column("length").to_numpy(), right.column("kept").to_numpy())
        q, v, s = best_in_block(matrix(left), left.column("vec_id").to_numpy(), matrix(right), right.column("vec_id").to_numpy(), codes, centre, turn, k, settings)
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    met = asking.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(meet, found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

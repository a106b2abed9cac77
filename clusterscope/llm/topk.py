"""Exact top-k search by inner product over norm-sorted blocks with rotated partial sums.

Vectors are sorted by descending length and packed into blocks.  The eigenvectors
of the vectors' Gram matrix (the right singular vectors of the vector
matrix) rotate the space so that the first coordinates carry most of every
product.  Against a query block, a vector block is passed over when
|q| * |x| cannot reach the query's k-th best score so far; for the others the first
coordinates are multiplied, the rest is bounded by the residual lengths
(Cauchy-Schwarz), and only vectors whose bound reaches that score get their exact
integer product.  The block of the longest vectors gives the first bounds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterscope.session import cut, ship_package

K = 5
SCALE = 256
BLOCK, QUERY_BLOCK = 2048, 256
HEAD = 0.25                  # share of the rotated coordinates in the partial sums
EXACT = float(1 << 52)       # whole numbers up to here are exact in a double


def _components(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("x")
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return batch.column("vec_id").to_numpy(), out


def _pack(ids: np.ndarray, x: np.ndarray) -> bytes:
    return struct.pack("<QQ", *x.shape) + ids.astype("<i8").tobytes() + x.astype("<f8").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, d = struct.unpack_from("<QQ", raw)
    return np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<f8", n * d, 16 + 8 * n).reshape(n, d)


def _floored(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            values = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False))
            offsets = x.offsets.to_numpy() - x.offsets[0].as_py()
            squares = np.concatenate([[0.0], np.cumsum(values * values)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.sqrt(squares[offsets[1:]] - squares[offsets[:-1]])),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["vec_id", "length", "x"])
    return run


def _blocks(width: int, size: int):
    """Blocks of ``size`` vectors of a sorted partition: part, number, longest, block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, xs = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), np.zeros((0, width))

        def put(i, x):
            longest = float(np.sqrt((x * x).sum(axis=1)).max())
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()),
                                               "longest": [longest], "block": pa.array([_pack(i, x)], pa.binary())})
        for batch in batches:
            more = _components(batch, width)
            ids, xs = np.concatenate([ids, more[0]]), np.concatenate([xs, more[1]])
            while len(ids) >= size:
                yield put(ids[:size], xs[:size])
                ids, xs, number = ids[size:], xs[size:], number + 1
        if len(ids):
            yield put(ids, xs)
    return run


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            _, x = _components(batch, width)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": np.arange(width * width), "value": total.ravel()})
    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _search(rotation: np.ndarray, k: int, bounds_only: bool):
    """Top k of every query of a row's query block in its vector block; or just their k-th scores."""
    head = max(1, int(len(rotation) * HEAD))

    def block_pair(queries: bytes, floor: list[float], block: bytes):
        q_ids, q = _unpack(queries)
        x_ids, x = _unpack(block)
        q_len, x_len = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
        exact = q_len.max() * x_len.max() < EXACT
        qr, xr = q @ rotation, x @ rotation
        q_rest, x_rest = (np.sqrt((m[:, head:] ** 2).sum(axis=1)) for m in (qr, xr))
        partial = qr[:, :head] @ xr[:, :head].T
        slack = 1e-9 * (q_len.max() * x_len.max() + 1)
        for i in range(len(q_ids)):
            near = int(np.searchsorted(-x_len * q_len[i], -(floor[i] - slack), side="right"))   # x_len descends
            reach = np.flatnonzero(partial[i, :near] + q_rest[i] * x_rest[:near] >= floor[i] - slack)
            reach = reach[x_ids[reach] != q_ids[i]]
            if not len(reach):
                continue
            if exact:
                scores = x[reach] @ q[i]
            else:   # whole numbers of any size
                whole = [int(v) for v in q[i]]
                scores = np.array([sum(a * int(b) for a, b in zip(whole, row)) for row in x[reach]], dtype=object)
                scores = np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)
            top = _best(scores, x_ids[reach], k)
            yield int(q_ids[i]), x_ids[reach][top], scores[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                queries, block = row.column("queries")[0].as_py(), row.column("block")[0].as_py()
                n = struct.unpack_from("<Q", queries)[0]
                floor = row.column("floor")[0].as_py() or [-np.inf] * n
                found = list(block_pair(queries, floor, block))
                if bounds_only:
                    ids, _ = _unpack(queries)
                    at = {q: float(s[-1]) for q, _, s in found if len(s) >= k}
                    yield pa.RecordBatch.from_pydict({"part": row.column("part"), "number": row.column("number"), "queries": row.column("queries"),
                                                      "floor": pa.array([[at.get(int(q), -np.inf) for q in ids]], pa.list_(pa.float64()))})
                    continue
                counts = [len(v) for _, v, _ in found]
                join = lambda parts, kind: pa.array(np.concatenate(parts).astype(np.int64) if parts else [], kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], counts).astype(np.int64)),
                                                  join([v for _, v, _ in found], pa.int64()), join([s for _, _, s in found], pa.int64())],
                                                 names=["query_id", "vec_id", "score"])
    return run


def _need(floor: list[float], queries: bytes) -> float:
    """The least length a vector needs to reach any of the queries' floors."""
    _, q = _unpack(queries)
    lengths = np.sqrt((q * q).sum(axis=1))
    floor = np.array(floor)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(floor <= 0, 0.0, np.where(lengths > 0, floor / lengths, np.inf))
    return float(need.min() * (1 - 1e-9))


def _with_need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        need = [_need(f, q) for f, q in zip(batch.column("floor").to_pylist(), batch.column("queries").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(need, pa.float64())], names=[*batch.schema.names, "need"])


def top_k(vectors: DataFrame, every: int = 50, k: int = K, scale: int = SCALE) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the ``k`` other rows of highest inner product.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Component x counts as
    floor(scale * x).  Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id, and a query with fewer candidates gets all of them.  Vectors that are null or
    hold a null or non-finite component take no part, nor do rows without a vec_id; a
    shorter vector counts as filled up with zeros.  A vector with a component beyond 1e307 / scale
    (about 3.9e304) is left out too, as its scaled value would not be finite.  Rows with one vec_id are candidates of
    their own, but none of its queries; their queries are answered together.  Scores beyond
    a long are clipped to it.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 1e307 / scale))
    whole = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
                .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(finite)
                .mapInArrow(_floored(scale), "vec_id long, length double, x array<double>"))
    width = max(whole.agg(F.max(F.size("x"))).first()[0] or 0, 1)
    # width * width numbers, whatever the number of vectors
    sums = whole.mapInArrow(_gram(width), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    gram = np.zeros(width * width)
    gram[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    rotation = np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1]

    by_length = [F.desc("length"), F.asc("vec_id")]
    packed = lambda rows, size: (rows.repartitionByRange(*by_length).sortWithinPartitions(*by_length)
                                 .mapInArrow(_blocks(width, size), "part int, number int, longest double, block binary"))
    blocks = cut(packed(whole, BLOCK))
    queries = packed(whole.where(F.col("vec_id") % every == 0), QUERY_BLOCK).select("part", "number", F.col("block").alias("queries"))
    parts = blocks.agg(F.coalesce(F.min("part"), F.lit(0)).alias("first"), F.coalesce(F.max("part"), F.lit(0)).alias("last")).first()
    # The first block of the first part holds the longest vectors; its size is bounded by BLOCK.
    longest = blocks.where((F.col("part") == F.lit(parts["first"])) & (F.col("number") == 0)).select(
        F.col("part").alias("block_part"), "block")
    pair_schema = "part int, number int, queries binary, floor array<double>"
    seeded = (queries.withColumn("block_part", F.col("part") * 0 + F.lit(parts["first"])).join(F.broadcast(longest), "block_part")
              .withColumn("floor", F.lit(None).cast("array<double>")).mapInArrow(_search(rotation, k, True), pair_schema))
    seeded = cut(seeded.mapInArrow(_with_need, f"{pair_schema}, need double"))

    light = seeded.select(F.col("part").alias("q_part"), F.col("number").alias("q_number"), "need",
                          F.explode(F.sequence(F.lit(parts["first"]), F.lit(parts["last"]))).alias("part"))
    pairs = light.join(blocks.select("part", "number", "longest"), "part").where("longest >= need").drop("need", "longest")
    found = (pairs.join(blocks.select("part", "number", "block"), ["part", "number"]).select("q_part", "q_number", "block")
             .join(seeded.select(F.col("part").alias("q_part"), F.col("number").alias("q_number"), "queries", "floor"), ["q_part", "q_number"])
             .select("queries", "floor", "block").mapInArrow(_search(rotation, k, False), "query_id long, vec_id long, score long"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", order.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

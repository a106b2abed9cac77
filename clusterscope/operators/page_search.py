"""Top-k retrieval (Q1/Q5) over all postings: blocks of queries meet blocks of pages.

The query terms' impacts are dealt by page, ``PAGES`` pages of a site to a block, and the query terms by
query, ``QUERIES`` to a block.  Each pair of blocks is scored at once in a small dense array, and a cell of such pairs keeps the
``k`` best pages of every query, so no row per query and page is ever shuffled: what travels grows with
the impacts and with the hits.  Every posting of every query term counts; nothing is pruned.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TOP_K
from ..session import cut, parallelism, ship_package

PAGES = 512
QUERIES = 512
PAGE_SCHEMA = "domain string, p_id array<long>, p_at array<int>, p_term array<string>, p_s array<double>"
QUERY_SCHEMA = ("q_domain string, q_id array<string>, q_n array<long>, q_at array<int>, q_term array<string>, "
                "q_tf array<long>, q_req array<boolean>, q_proh array<boolean>")
SCORE_SCHEMA = "base_id string, q_domain string, domain string, page_id long, score double"


def one(values: pa.Array) -> pa.ListArray:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, of rows sorted by key."""
    held, now = [], None
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in keys]
        marks = list(zip(*rows))
        start = 0
        while start < len(marks):
            end = start + 1
            while end < len(marks) and marks[end] == marks[start]:
                end += 1
            if held and marks[start] != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = marks[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(t: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(t.column(name).chunks)


def places(*columns: list) -> np.ndarray:
    """Row number -> number of the run of equal values that it lies in."""
    rows = list(zip(*columns))
    return np.cumsum([0] + [a != b for a, b in zip(rows, rows[1:])])


def _packed_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ("domain", "pb")):
        at = places(column(t, "page_id").to_pylist())
        first = np.unique(at, return_index=True)[1]
        yield pa.RecordBatch.from_arrays(
            [column(t, "domain").slice(0, 1), one(column(t, "page_id").take(pa.array(first))), one(pa.array(at, pa.int32())),
             one(column(t, "term")), one(column(t, "s"))], names=["domain", "p_id", "p_at", "p_term", "p_s"])


def _packed_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ("q_domain", "qb")):
        at = places(column(t, "query_id").to_pylist())
        first = pa.array(np.unique(at, return_index=True)[1])
        yield pa.RecordBatch.from_arrays(
            [column(t, "q_domain").slice(0, 1), one(column(t, "query_id").take(first)), one(column(t, "n_req").take(first)),
             one(pa.array(at, pa.int32())), *(one(column(t, c)) for c in ("term", "qtf", "req", "proh"))],
            names=["q_domain", "q_id", "q_n", "q_at", "q_term", "q_tf", "q_req", "q_proh"])


def page_blocks(impacts: DataFrame, terms: DataFrame, fields: DataFrame, score) -> DataFrame:
    """The postings of ``terms`` by blocks of pages; ``score`` is a posting's boosted impact."""
    ship_package(impacts.sparkSession)
    many = fields.groupBy("domain").agg(F.count(F.lit(1)).alias("many"))
    p = impacts.join(terms, "term", "left_semi").select("domain", "page_id", "term", score.alias("s"))
    p = p.join(F.broadcast(many), "domain", "left")
    block = F.expr(f"pmod(xxhash64(page_id), greatest(1, ceil(coalesce(many, 1) / {PAGES})))")
    p = p.select("domain", block.alias("pb"), "page_id", "term", "s")
    return p.repartition("domain", "pb").sortWithinPartitions("domain", "pb", "page_id").mapInArrow(_packed_pages, PAGE_SCHEMA)


def query_blocks(qt: DataFrame) -> DataFrame:
    """``query_terms`` by blocks of queries; those bound to a site lie apart from the others."""
    ship_package(qt.sparkSession)
    many = -(-qt.select("query_id", "q_domain").distinct().count() // QUERIES)
    q = qt.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(max(1, many))))
    q = q.select("q_domain", "qb", "query_id", F.col("n_req").cast("long").alias("n_req"), "term", F.col("qtf").cast("long").alias("qtf"), "req", "proh")
    return q.repartition("q_domain", "qb").sortWithinPartitions("q_domain", "qb", "query_id").mapInArrow(_packed_queries, QUERY_SCHEMA)


def numbers(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def by_code(codes: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """Order of the rows by code, and each code's range in it; codes below 0 are left out."""
    order = np.argsort(codes, kind="stable")
    order = order[np.searchsorted(codes[order], 0):]
    found, starts = np.unique(codes[order], return_index=True)
    return order, dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)])))


def _hits(page: dict, query: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of pages and one of queries: places of queries and of their ``k`` best pages, scores as ranked, scores."""
    terms = query["q_term"].values.dictionary_encode()
    held = pc.fill_null(pc.index_in(page["p_term"].values, value_set=terms.dictionary), -1).to_numpy(zero_copy_only=False)
    p_order, p_runs = by_code(held)
    q_order, q_runs = by_code(terms.indices.to_numpy(zero_copy_only=False))
    p_at, p_s = (page[c].values.to_numpy(zero_copy_only=False)[p_order] for c in ("p_at", "p_s"))
    q_at, q_tf, q_req, q_proh = (query[c].values.to_numpy(zero_copy_only=False)[q_order] for c in ("q_at", "q_tf", "q_req", "q_proh"))
    needed = query["q_n"].values.to_numpy(zero_copy_only=False)
    score = np.zeros((len(needed), len(page["p_id"].values)))
    met = np.zeros(score.shape, bool) if len(p_s) and p_s.min() <= 0 else None
    required = np.zeros(score.shape, np.int32) if needed.any() else None
    banned = np.zeros(score.shape, bool) if q_proh.any() else None
    for code, (a, b) in p_runs.items():
        c, d = q_runs[code]
        place = np.ix_(q_at[c:d], p_at[a:b])
        score[place] += np.outer(q_tf[c:d], p_s[a:b])
        if met is not None:
            met[place] |= (q_tf[c:d] > 0)[:, None]
        if required is not None:
            required[place] += q_req[c:d][:, None]
        if banned is not None:
            banned[place] |= q_proh[c:d][:, None]
    good = score > 0 if met is None else met
    if required is not None:
        good &= required == needed[:, None]
    if banned is not None:
        good &= ~banned
    # as top_k ranks: by the score rounded to 9 places, then by page (blocks are sorted by page)
    near = np.where(good, np.floor(score * 1e9 + 0.5), -np.inf)
    if score.shape[1] > k:
        last = np.partition(near, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
        level, above = near == last, near > last
        good &= above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    at, on = np.nonzero(good)
    return at, on, near[at, on], score[at, on]


def _result(ids: pa.Array, q_domain: str | None, domain: str | None, at: np.ndarray, pages: pa.Array, score: np.ndarray) -> pa.RecordBatch:
    n = len(at)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([q_domain] * n, pa.string()), pa.array([domain] * n, pa.string()), pages, pa.array(score)],
                                      names=["base_id", "q_domain", "domain", "page_id", "score"])


def _scored(k: int):
    """The hits of each block of pages joined with a block of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                at, on, _, score = _hits(row, row, k)
                yield _result(row["q_id"].values, row["q_domain"].as_py(), row["domain"].as_py(), at, row["p_id"].values.take(pa.array(on)), score)
    return run


class _Best:
    """The ``k`` best pages of every query of a block so far, on one site."""

    def __init__(self, k: int):
        self.k, self.rows, self.many = k, [], 0

    def add(self, at: np.ndarray, pages: pa.Array, near: np.ndarray, score: np.ndarray) -> None:
        page = pc.fill_null(pages, LEAST).to_numpy(zero_copy_only=False)
        self.rows.append((at, page, near, score, pages.is_null().to_numpy(zero_copy_only=False)))
        self.many += len(at)
        if self.many > MERGED:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        at, page, near, score, null = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((page, ~null, -near, at))             # a null page goes first, as in top_k
        first = np.searchsorted(at[order], at[order], side="left")
        keep = order[np.arange(len(order)) - first < self.k]
        self.rows = [tuple(x[keep] for x in (at, page, near, score, null))]
        self.many = 0
        return self.rows[0]


LEAST = -1 << 63
MERGED = 1 << 18             # rows of a query block from which they are cut down to the best
HELD = 32 << 20              # bytes of a cell's pages that a task holds in memory; more lie in a file


def _cells(k: int):
    """The hits of the rows of each cell, blocks of pages first: those are laid by, and every block of queries meets them one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, writer = None, None, None
        for batch in batches:
            for i, (g, is_page) in enumerate(zip(batch.column("g").to_pylist(), batch.column("p_id").is_valid().to_pylist())):
                if g != cell:
                    if held is not None:
                        held.close()
                    cell, held, writer = g, tempfile.SpooledTemporaryFile(max_size=HELD), None
                row = batch.slice(i, 1)
                if is_page:
                    row = row.select(["domain", "p_id", "p_at", "p_term", "p_s"])
                    writer = writer or pa.ipc.new_stream(held, row.schema)
                    writer.write_batch(row)
                elif writer is not None:
                    query = {n: row.column(n)[0] for n in row.schema.names}
                    best: dict[str | None, _Best] = {}
                    held.seek(0)
                    for laid in pa.ipc.open_stream(held):
                        page = {n: laid.column(n)[0] for n in laid.schema.names}
                        at, on, near, score = _hits(page, query, k)
                        best.setdefault(page["domain"].as_py(), _Best(k)).add(at, page["p_id"].values.take(pa.array(on)), near, score)
                    held.seek(0, 2)
                    for domain, found in best.items():
                        at, page, _, score, null = found.merge()
                        yield _result(query["q_id"].values, None, domain, at, pa.array(page, pa.int64(), mask=null), score)
        if held is not None:
            held.close()
    return run


def best_pages(qt: DataFrame, impacts: DataFrame, fields: DataFrame, score, k: int = TOP_K) -> DataFrame:
    """``(query_id, base_id, domain, page_id, score)`` like ``match_scores``, of each query the ``k`` best
    pages of every cell at least.  ``qt`` are the ``query_terms``, ``score`` is a posting's impact.

    Blocks of pages and of queries lie in groups; two groups meet in a cell, where each block is read
    once and pages wait in a file: a task's memory is that of a pair of blocks, what travels is each side times the groups of the other."""
    qt = cut(qt)
    packed = cut(query_blocks(qt))
    pages = page_blocks(impacts, qt.select("term").distinct(), fields, score)
    free, bound = packed.where("q_domain is null"), packed.where("q_domain is not null")
    cells = 4 * parallelism(impacts.sparkSession)
    # a block of pages is the larger one: fewer copies of it
    of_queries = max(1, min(free.count(), int(cells ** 0.5 / 2)))
    of_pages = -(-cells // of_queries)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = pages.withColumn("gp", F.pmod(F.xxhash64("domain", F.element_at("p_id", 1)), F.lit(of_pages))).withColumn("gq", every(of_queries))
    right = free.withColumn("gq", F.pmod(F.xxhash64(F.element_at("q_id", 1)), F.lit(of_queries))).withColumn("gp", every(of_pages))
    met = left.unionByName(right, allowMissingColumns=True).withColumn("g", F.col("gp") * of_queries + F.col("gq")).drop("gp", "gq", "q_domain")
    met = met.repartition(cells, "g").sortWithinPartitions("g", F.col("p_id").isNull())
    s = met.mapInArrow(_cells(k), SCORE_SCHEMA)
    if not bound.isEmpty():
        s = s.unionByName(pages.join(bound, F.col("domain") == F.col("q_domain")).mapInArrow(_scored(k), SCORE_SCHEMA))
    return s.select(F.when(F.col("q_domain").isNull(), F.concat("base_id", F.lit("@"), "domain")).otherwise(F.col("base_id")).alias("query_id"),
                    "base_id", "domain", "page_id", "score")

"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets are one class from the start.  A class has
``BANDS * ROWS`` minima; a band hashes some of them in full, and then only the
low ``BITS`` bits of each minimum are kept, packed into longs.  Classes that share a
band are candidates; the number of equal low-bit fields, corrected for fields
that agree by chance, estimates their similarity; candidates far below the
threshold go, and the others are confirmed on their full shingle sets.

Bands: two sets of similarity 0.85 miss each other in all 48 bands of 8 with
probability 2e-7.  The estimate's standard error is 0.0215 there, so ``SLACK`` is
five of them.  ``banding`` and ``slack`` give the same chances at other thresholds.

A bucket of m classes does not become m * m pairs.  Members are compared
with the bucket's leaders: first with one, then, where a bucket still holds
more than one component, with 16 (if any is large), then its components' members with each other.
So large groups of copies cost a few comparisons each, and no link between components is left
out.  A member meets its leaders in one row, then ``CHUNK`` members meet as many (of one component
alone they don't); what a member looks like is gathered per member, not per pair, and the full sets
are compared block against block, so that only links become rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterscope.llm.graph import components
from clusterscope.llm.texts import ASCII_LOWER, Rolling, mix, row_runs, text_bytes
from clusterscope.session import cut, ship_package

BANDS, ROWS, BITS = 48, 8, 2
LEADERS = 1, 16              # of a bucket, in the rounds before the last
FEW = 2048                   # members of the largest bucket up to which the rounds before the last but the first are left out
CHUNK = 128                  # members of a bucket that meet others in one row
BLOCK = 32                   # classes whose sets are read together, 64 at most
SHINGLE = 5
PERCENT = 85
SLACK = 0.11
MISS = 2.4e-7                # chance that two sets at the threshold share no band
PIECE_BYTES = 1 << 20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_WORDS = BANDS * ROWS * BITS // 64
_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands from the ``BANDS * ROWS`` minima keep to ``MISS``."""
    similar = percent / 100
    for rows in range(14, 0, -1):
        missed = math.log1p(-similar ** rows) if similar < 1 else -math.inf
        bands = max(1, math.ceil(math.log(MISS) / missed)) if missed else math.inf
        if bands * rows <= BANDS * ROWS:
            return bands, rows
    raise ValueError(f"{BANDS * ROWS} minima are too few for {percent} percent")


def slack(percent: int) -> float:
    """What an estimate may fall short of the threshold: five standard errors, ``SLACK`` at least."""
    agree = percent / 100 + (1 - percent / 100) / (1 << BITS)
    return max(SLACK, 5 * math.sqrt(agree * (1 - agree) / (BANDS * ROWS)) / (1 - 1 / (1 << BITS)))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The distinct hashes of every row's shingles of ``width`` words, ascending."""
    data = ASCII_LOWER[data]
    inside = ~SPACE[data]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    first = np.flatnonzero(inside & (row_start[:-1] | np.append(True, ~inside[:-1])[:len(data)]))
    last = np.flatnonzero(inside & (row_start[1:] | np.append(~inside[1:], True)[:len(data)])) + 1
    words = Rolling(data).ranges(first, last)
    bounds = np.searchsorted(first, offsets)
    counts = np.diff(bounds)
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for t in range(width if len(grams) else 0):
        grams += words[t:t + len(grams)] * _ODD[t]
    grams = mix(grams)
    out = []
    for i, n in zip(bounds.tolist(), counts.tolist()):
        if n >= width:
            out.append(np.unique(grams[i:i + n - width + 1]))
        elif n:
            out.append(mix((words[i:i + n] * _ODD[:n]).sum(keepdims=True) + _ODD[8 + n]))
        else:
            out.append(grams[:0])
    return out


def _minima(hashes: np.ndarray) -> np.ndarray:
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (_A[:, None] * low[None, i:i + 4096] + _B[:, None] * high[None, i:i + 4096]).min(axis=1))
    return least


def _signatures(batches: Iterator[pa.RecordBatch], n_bands: int = BANDS, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for first, last in row_runs(offsets, PIECE_BYTES):
            sets = shingle_hashes(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            minima = np.stack([_minima(s) for s in sets])
            bands = np.zeros((len(sets), n_bands), np.uint64)
            for t in range(rows):
                bands += minima[:, t:n_bands * rows:rows].astype(np.uint64) * _ODD[16 + t]
            bands = mix(bands + np.arange(n_bands, dtype=np.uint64) * _ODD[30])
            fields = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(sets), _WORDS, -1)
            packed = (fields << (np.arange(fields.shape[2], dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
            set1 = np.array([s.sum(dtype=np.uint64) for s in sets])
            set2 = np.array([mix(s ^ _ODD[40]).sum(dtype=np.uint64) for s in sets])
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * n_bands, pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(set1.view(np.int64)), pa.array(set2.view(np.int64)), lists,
                 *(pa.array(np.ascontiguousarray(packed[:, w]).view(np.int64)) for w in range(_WORDS))],
                names=["doc_id", "n_shingles", "set1", "set2", "bands", *(f"low{w}" for w in range(_WORDS))])


SIGNATURE_SCHEMA = ("doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, "
                    + ", ".join(f"low{w} long" for w in range(_WORDS)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for first, last in row_runs(offsets, PIECE_BYTES):
            sets = shingle_hashes(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])


def estimated_similarity(mine: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """Collision-corrected similarity of two packed signatures, given their columns by name."""
    differ = None
    for name in (f"low{w}" for w in range(_WORDS)):
        x = mine(name).bitwiseXOR(other(name))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = n if differ is None else differ + n
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(BANDS * ROWS) - chance) / (1 - chance)


def _alike(least: float):
    """(node, alike) of the members of two chunks of a bucket (of one, if ``same``) that lie in different components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, chance = np.uint64(0x5555555555555555), 1 / (1 << BITS)
        for batch in batches:
            same = batch.column("same").to_pylist()
            for i in range(len(batch)):
                x, y = (_rows_of(batch.column(c), i) for c in ("held_a", "held_b"))
                differ = np.zeros((len(x["node"]), len(y["node"])), np.int64)
                for w in range(_WORDS):
                    d = x[f"low{w}"].view(np.uint64)[:, None] ^ y[f"low{w}"].view(np.uint64)[None, :]
                    differ += np.bitwise_count((d | (d >> np.uint64(1))) & odd)
                fits = ((1 - differ / (BANDS * ROWS) - chance) / (1 - chance) >= least) & (x["component"][:, None] != y["component"][None, :])
                if same[i]:
                    fits = np.tril(fits, -1)
                nodes = np.flatnonzero(fits.any(axis=1))
                m, k = np.nonzero(fits[nodes])
                ends = np.searchsorted(m, np.arange(len(nodes) + 1)).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array(y["block"][k], pa.int64()), pa.array(y["node"][k], pa.int64())], names=["block", "other"])
                yield pa.RecordBatch.from_arrays([pa.array(x["node"][nodes], pa.int64()), pa.ListArray.from_arrays(ends, entries)], names=["node", "alike"])
    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block number for every ``BLOCK`` neighbouring rows of a partition."""
    base, seen = TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(base + (seen + np.arange(len(batch))) // BLOCK)], names=["node", "block"])
        seen += len(batch)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a node looks like, block by block: (node, block, others)."""
    for batch in batches:
        out: list[tuple[int, int, np.ndarray]] = []
        lists = batch.column("alike")
        for i, node in enumerate(batch.column("node").to_pylist()):
            entries = lists[i].values
            at, other = (np.unique(np.stack([entries.field(c).to_numpy() for c in ("block", "other")]), axis=1))
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out.extend((node, int(at[k]), part) for k, part in zip(first, np.split(other, first[1:])))
        yield _candidate_batch(out)


def _candidate_batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    nodes, blocks, others = zip(*rows) if rows else ((), (), ())
    ends = np.cumsum([0, *map(len, others)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *others]), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blocks, pa.int64()), lists], names=["node", "block", "others"])


CANDIDATE_SCHEMA = "node long, block long, others array<long>"


def shared_tokens(held: list[np.ndarray], own: list[np.ndarray]) -> np.ndarray:
    """The number of tokens that each set of ``own`` shares with each of ``held``; at most 64 of them, all without repeats."""
    tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint64), [len(s) for s in held])
    order = np.argsort(tokens, kind="stable")
    tokens, bit = tokens[order], np.left_shift(np.uint64(1), owner[order])
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[:len(tokens)])
    if not len(first):
        return np.zeros((len(own), len(held)), np.int64)
    tokens, holders = tokens[first], np.bitwise_or.reduceat(bit, first)      # bit j: set j holds the token
    out = np.zeros((len(own), len(held)), np.int64)
    for i, s in enumerate(own):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        met = holders[at[tokens[at] == s]]
        out[i] = np.unpackbits(met.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[:len(held)]
    return out


def _rows_of(column: pa.Array, i: int, *lists: str) -> dict[str, list | np.ndarray]:
    """The fields of the structs in row ``i`` of a list column, those of ``lists`` as an array per struct."""
    structs = column[i].values
    out: dict[str, list | np.ndarray] = {}
    for k in range(structs.type.num_fields):
        name, field = structs.type.field(k).name, structs.field(k)
        if name in lists:
            ends, values = field.offsets.to_numpy(), field.values.to_numpy()
            out[name] = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        else:
            out[name] = field.to_numpy()
    return out


def _linked(percent: int):
    """Links (a, b) of what a row holds of two blocks: ``mine`` (node, own, others) and ``held`` (node, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                mine, held = _rows_of(batch.column("mine"), i, "own", "others"), _rows_of(batch.column("held"), i, "shingles")
                shared = shared_tokens(held["shingles"], mine["own"])
                n_own, n_held = (np.array([len(s) for s in sets], np.int64) for sets in (mine["own"], held["shingles"]))
                links = shared * 100 >= (n_own[:, None] + n_held[None, :] - shared) * percent
                links &= np.stack([np.isin(held["node"], others) for others in mine["others"]])
                x, y = np.nonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(mine["node"][x], pa.int64()), pa.array(held["node"][y], pa.int64())], names=["a", "b"])
    return run


def _confirmed(candidates: DataFrame, sets: DataFrame, blocks: DataFrame, placed_in: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among ``candidates(node, block, others)``, by the full sets.  Two blocks meet in one row,
    whatever the number of their candidates; ``placed_in(node, block)`` names each node's own."""
    mine = sets.join(placed_in.select("node", F.col("block").alias("from")), "node").select("node", "from", F.col("shingles").alias("own"))
    met = candidates.join(mine, "node").repartition("block").groupBy("block", "from").agg(F.collect_list(F.struct("node", "own", "others")).alias("mine"))
    return met.join(blocks, "block").select("mine", "held").mapInArrow(_linked(percent), "a long, b long")


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: those of the linked components' graph."""
    at = lambda end: component.toDF(end, f"{end}_c")
    edges = links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))
    new = components(edges).toDF("component", "new")
    return cut(component.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components of documents whose 5-word shingle sets overlap by ``percent`` of their union.

    One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_shingles, component_id (smallest doc_id reachable over links) and
    kept (doc_id = component_id).  A text of one to four words is one shingle;
    a null text or one without words has none, is linked with nothing and kept.
    Rows that share a doc_id are one node of the link graph.  Rows without a
    doc_id take no part in links: component_id is null and they are kept.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bands, rows = banding(percent)
    signed = cut(texts.mapInArrow(lambda batches: _signatures(batches, n_bands, rows), SIGNATURE_SCHEMA))
    low = [f"low{w}" for w in range(_WORDS)]
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("set1", "set2").agg(F.min_by(F.struct("bands", *low), "doc_id").alias("s"),
                                                   F.min("doc_id").alias("node"))
    classes = cut(classes.select("set1", "set2", "node", "s.*"))
    banded = classes.select("node", F.explode("bands").alias("key"))
    # Aggregates are written before they are joined, so that AQE can split the join's frequent keys.
    shared = cut(banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", "lo"))
    members = cut(banded.join(shared, "key"))
    # Classes that meet the same smallest class lie next to each other: their sets are read in blocks.
    hubs = members.groupBy("node").agg(F.min("lo").alias("hub"))
    component = cut(hubs.select("node", F.col("node").alias("component"), "hub"))
    order = ["hub", "node"]
    placed_in = component.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "node long, block long")
    placed_in = cut(placed_in)
    component, members = component.select("node", "component"), members.select("key", "node")
    lows = cut(classes.select("node", *low).join(placed_in, "node"))
    sets = cut(texts.join(component.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
               .mapInArrow(_sets, "node long, shingles array<long>"))
    blocks = cut(sets.join(placed_in, "node").groupBy("block").agg(F.collect_list(F.struct("node", "shingles")).alias("held")))

    for leaders in (*LEADERS, None):
        placed = members.join(component, "node")
        if leaders != 1:                                 # at first every bucket is open
            open_ = cut(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi"))
            largest = open_.agg(F.max("size")).first()[0]
            if not largest:
                break
            members = members.join(open_.select("key"), "key")
            if leaders and largest <= FEW:
                continue
            placed = placed.join(open_.select("key"), "key")
        placed = placed.join(lows, "node")
        placed = cut(placed) if leaders else placed
        packed = F.struct("node", "component", "block", *low)
        # A row per member and its leaders or per two CHUNKs, not per pair; then a row per member with those that look alike.
        if leaders:
            if leaders == 1:
                lead = placed.groupBy("key").agg(F.min(packed).alias("l")).select("key", F.array("l").alias("leaders"))
            else:
                rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
                lead = placed.withColumn("rank", rank).where(f"rank <= {leaders}").groupBy("key").agg(F.collect_list(packed).alias("leaders"))
            alike = F.filter("leaders", lambda l: (l["component"] != F.col("component")) & (
                estimated_similarity(F.col, lambda name: l[name]) >= percent / 100 - slack(percent)))
            met = placed.join(cut(lead), "key").select("node", F.transform(alike, lambda l: F.struct(l["block"].alias("block"), l["node"].alias("other"))).alias("alike"))
        else:
            rank = F.row_number().over(Window.partitionBy("key").orderBy("component", "node"))
            chunks = cut(placed.withColumn("rank", rank).withColumn("part", F.expr(f"(rank - 1) div {CHUNK}"))
                         .groupBy("key", "part").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.collect_list(packed).alias("held")))
            a, b = (chunks.select("key", *(F.col(c).alias(f"{c}_{end}") for c in ("part", "lo", "hi", "held"))) for end in "ab")
            met = (a.join(b, "key").where("part_b <= part_a and least(lo_a, lo_b) < greatest(hi_a, hi_b)").select((F.col("part_a") == F.col("part_b")).alias("same"), "held_a", "held_b")
                   .mapInArrow(_alike(percent / 100 - slack(percent)), "node long, alike array<struct<block: long, other: long>>"))
        met = met.where(F.size("alike") > 0).groupBy("node").agg(F.flatten(F.collect_list("alike")).alias("alike"))
        candidates = cut(met.mapInArrow(_by_block, CANDIDATE_SCHEMA))
        links = cut(_confirmed(candidates, sets, blocks, placed_in, percent))
        if not links.isEmpty():
            component = _merged(component, links)

    # Classes that hold one doc_id are one node.
    held = linkable.select("doc_id", "set1", "set2").distinct()
    shared_ids = held.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    of_class = (classes.select("set1", "set2", "node").join(component, "node", "left")
                .select("set1", "set2", F.coalesce("component", "node").alias("component")))
    both = held.join(shared_ids, "doc_id").join(of_class, ["set1", "set2"])
    across = cut(both.groupBy("doc_id").agg(F.min("component").alias("a")).join(both.select("doc_id", F.col("component").alias("b")), "doc_id")
                 .where("a <> b").select("a", "b"))
    if not across.isEmpty():
        joined = components(across).toDF("component", "smaller")
        of_class = of_class.join(joined, "component", "left").select("set1", "set2", F.coalesce("smaller", "component").alias("component"))
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return (signed.select("doc_id", "n_shingles", F.when(~own, F.col("set1")).alias("set1"), F.when(~own, F.col("set2")).alias("set2"))
            .join(of_class, ["set1", "set2"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with its columns, whose doc_id stands for its component; of rows that
    agree in doc_id and text one stays, and rows without a doc_id all stay.  Rows of one doc_id with different texts are one
    document: all of its texts stay or go."""
    ids = cut(near_duplicates(docs, **options).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(ids, "id")
    single, several = kept.where("n = 1").select("row"), kept.where("n > 1")
    if not ids.where("n > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy("id", "row.text").orderBy(F.xxhash64("row")))
        single = single.unionByName(several.withColumn("nth", first).where("nth = 1").select("row"))
    return single.unionByName(rows.where("id is null").select("row")).select("row.*")

"""Set similarity join of documents' word n-grams with signature trees.

Two sets that overlap by the threshold share one of their first tokens, in any order that all sets
keep: a set of n tokens needs n - ceil(t * n) + 1 of them (its *prefix*).  The order is by hash, with
tokens that many prefixes hold put last, so that a passage quoted everywhere is no key.  A key's sets are
a *bucket*; buckets of equal members are one.

A set's signature is a bitmap of its tokens (at least twice as many bits as tokens).  In a bucket the
signatures, sorted by component and size, are the leaves of a tree: a node holds the OR of
its leaves' bitmaps, the range of their sizes and of their components, and the most tokens that any of them has
beyond its bits.  A dual traversal starts from the root with itself.  A pair of nodes is
passed over if no two sizes fit, if all leaves are in one component already, or if the common bits and the
tokens beyond the bits cannot make up the overlap that the smallest sizes need; of any other pair the children are
paired.  Pairs of leaves that pass are confirmed on their full sets.

Upper levels are rows that Spark joins level by level; the lowest (``TILE`` leaves) lies within a task.  Before that,
members of large buckets are paired with a few leaders of theirs, so that a large group of copies becomes one
component, which the traversal then passes over at its top.  What looks alike is gathered per member and
compared in blocks, so no pair that isn't a link becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterscope.llm.graph import components
from clusterscope.llm.neardup import CANDIDATE_SCHEMA, _by_block, _confirmed, _merged, _numbered, shingle_hashes
from clusterscope.llm.texts import mix, row_runs, text_bytes
from clusterscope.session import cut, discard, ship_package

SHINGLE = 4
PERCENT = 85
HOT_ROWS = 64                # prefixes from which a token goes last
RUN_KEYS = 1 << 20           # prefix tokens that a task counts at once
HOT_BITS = 22                # size of the table of such tokens, 2 ** 22 bits; a wrong one only moves a token
LEAST_BITS = 512             # of a bitmap, and of the bitmaps of the upper levels
LEADERS, LEAD_ROUNDS = 8, 2  # of a bucket of over LEAD_FROM members
LEAD_FROM = 32
NEAR_ROUNDS = 1              # rounds in which a candidate meets one block of its partners
TILE, TILE_BYTES = 256, 1 << 18
SUB = 16                     # leaves of a node within a tile
FAN = 32                     # children of a node above the tiles
PIECE_BYTES = 1 << 20
_SEED = np.uint64(0x5851F42D4C957F2D)
_UNION = [f"u{i}" for i in range(LEAST_BITS // 64)]


# --- sets, prefixes and signatures ---------------------------------------------------

def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` of which any set that overlaps enough holds one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def class_of(tokens: np.ndarray) -> np.uint64:
    """A 64-bit name of a whole set."""
    return mix(np.array([tokens.sum(dtype=np.uint64)]))[0] ^ mix(tokens ^ _SEED).sum(dtype=np.uint64)


def _sets_of(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = text_bytes(batch.column("text"))
    for first, last in row_runs(offsets, PIECE_BYTES):
        yield first, last, shingle_hashes(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], shingle)


def _frequent(shingle: int, percent: int):
    """Tokens that stand in several prefixes by hash of a task's run of rows, with their number."""
    def counted(runs: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(runs), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for _, _, sets in _sets_of(batch, shingle):
                for s in sets:
                    runs.append(s[:prefix_size(len(s), percent)])
                    held += len(runs[-1])
                if held >= RUN_KEYS:
                    yield counted(runs)
                    runs, held = runs[:1], 0
        yield counted(runs)
    return run


def _prefixed(shingle: int, percent: int, hot: np.ndarray):
    def keys_of(tokens: np.ndarray) -> np.ndarray:
        p = prefix_size(len(tokens), percent)
        late = hot[(tokens & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)]
        return np.concatenate([tokens[~late], tokens[late]])[:p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()                           # a class's keys come once from a task
        for batch in batches:
            for first, last, sets in _sets_of(batch, shingle):
                names = [int(class_of(s).astype(np.int64)) if len(s) else None for s in sets]
                keys = []
                for s, name in zip(sets, names):
                    keys.append(s[:0] if name in seen else keys_of(s))
                    seen.add(name)
                if len(seen) > RUN_KEYS:
                    seen.clear()
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), batch.column("text_key").slice(first, last - first),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64))), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "class", "keys", "bits"])
    return run


PREFIX_SCHEMA = "doc_id long, text_key long, n_shingles long, class long, keys array<long>, bits binary"


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The tokens' bits, as 64-bit words; a shorter bitmap is the OR of a longer one's parts."""
    bits = max(LEAST_BITS, 1 << int(2 * len(tokens) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[((tokens >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view("<u8")


def fold(words: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0)


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in _sets_of(batch, shingle):
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(first, last - first),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])
    return run


# --- bounds -----------------------------------------------------------------------------

def possible_overlap(x: np.ndarray, n_x: np.ndarray, y: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """The most tokens that sets with bitmaps ``x`` (rows) and ``y`` can share: common bits, and
    tokens beyond the bits of the set that has fewer of them."""
    size = min(x.shape[1], y.shape[1])
    x, y = (np.bitwise_or.reduce(m.reshape(len(m), -1, size), axis=1) for m in (x, y))
    common = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
    beyond = [n - np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m, n in ((x, n_x), (y, n_y))]
    return common + np.minimum(beyond[0][:, None], beyond[1][None, :])


def _enough(possible, n_x, n_y, percent):
    least, most = np.minimum(n_x, n_y), np.maximum(n_x, n_y)
    return (100 * least >= percent * most) & ((100 + percent) * possible >= percent * (n_x + n_y))


def _alike(percent: int):
    """Pairs whose signatures allow a link: (node, block, others)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.array(batch.column(c).to_pylist(), np.int64) for c in ("n", "other_n")]
            fits = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("bits"), batch.column("other_bits"))):
                if 100 * min(sizes[0][i], sizes[1][i]) >= percent * max(sizes[0][i], sizes[1][i]):
                    x, y = (np.frombuffer(v.as_buffer(), "<u8")[None] for v in (x, y))
                    fits[i] = _enough(possible_overlap(x, sizes[0][i:i + 1], y, sizes[1][i:i + 1])[0, 0], sizes[0][i], sizes[1][i], percent)
            take = pa.array(np.flatnonzero(fits))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("node", "block", "other")], names=["node", "block", "other"])
    return run


# --- trees --------------------------------------------------------------------------------

class _Node:
    """Leaves of a tile: OR, sizes, components, tokens beyond the bits."""

    def __init__(self, leaves: np.ndarray, bits: list[np.ndarray], n: np.ndarray, component: np.ndarray):
        self.leaves, self.n, self.component = leaves, n[leaves], component[leaves]
        size = min(len(bits[i]) for i in leaves)
        self.bits = np.stack([fold(bits[i], size) for i in leaves])
        self.union = np.bitwise_or.reduce(self.bits, axis=0)
        self.low, self.high = int(self.n.min()), int(self.n.max())

    def may_link(self, other: _Node, percent: int) -> bool:
        if 100 * self.high < percent * other.low or 100 * other.high < percent * self.low:
            return False
        one = self.component[0]
        if (self.component == one).all() and (other.component == one).all():
            return False
        size = min(len(self.union), len(other.union))
        common = int(np.bitwise_count(fold(self.union, size) & fold(other.union, size)).sum())
        beyond = min(int((m.n - np.bitwise_count(np.bitwise_or.reduce(m.bits.reshape(len(m.bits), -1, size), axis=1)).sum(axis=1, dtype=np.int64)).max())
                     for m in (self, other))
        return (100 + percent) * (common + beyond) >= percent * (self.low + other.low)


class Tile:
    """The leaves of one row of the tile table, and the nodes over them."""

    def __init__(self, row: dict):
        self.nodes, self.blocks = np.array(row["nodes"], np.int64), np.array(row["blocks"], np.int64)
        n, component = np.array(row["sizes"], np.int64), np.array(row["components"], np.int64)
        bits = [np.frombuffer(b, "<u8") for b in row["bits"]]
        self.tree = [_Node(np.arange(i, min(i + SUB, len(n))), bits, n, component) for i in range(0, len(n), SUB)]


def traverse(a: Tile, b: Tile | None, percent: int) -> Iterator[tuple[int, int, list[int]]]:
    """(node, block, others) of leaves of ``a`` and of ``b`` (of ``a`` itself if None) that may link."""
    alike: dict[tuple[int, int], list[int]] = {}
    for s, left in enumerate(a.tree):
        for t, right in enumerate((b or a).tree):
            if (b is None and t < s) or not left.may_link(right, percent):
                continue
            fits = _enough(possible_overlap(left.bits, left.n, right.bits, right.n), left.n[:, None], right.n[None, :], percent)
            fits &= left.component[:, None] != right.component[None, :]
            if b is None and s == t:
                fits &= np.triu(np.ones_like(fits), 1)
            for i, j in zip(*np.nonzero(fits)):
                k = right.leaves[j]
                alike.setdefault((int(a.nodes[left.leaves[i]]), int((b or a).blocks[k])), []).append(int((b or a).nodes[k]))
    return ((node, block, others) for (node, block), others in alike.items())


_LEAF = ("nodes", "blocks", "sizes", "components", "bits")
TILE_SCHEMA = ("key long, id long, low_n long, high_n long, low_c long, high_c long, beyond long, nodes array<long>, blocks array<long>, "
               "sizes array<long>, components array<long>, bits array<binary>, " + ", ".join(f"{u} long" for u in _UNION))


def _tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Tiles of ``most`` leaves, of rows sorted by key, component and size."""
    part, number, key, size = TaskContext.get().partitionId() << 32, 0, None, 0
    held: dict[str, list] = {c: [] for c in _LEAF}
    out: list[dict] = []

    def close():
        nonlocal number, size
        if held["nodes"]:
            low = np.stack([fold(np.frombuffer(b, "<u8"), len(_UNION)) for b in held["bits"]])
            beyond = np.array(held["sizes"]) - np.bitwise_count(low).sum(axis=1, dtype=np.int64)
            out.append({"key": key, "id": part + number, "low_n": min(held["sizes"]), "high_n": max(held["sizes"]), "low_c": min(held["components"]),
                        "high_c": max(held["components"]), "beyond": int(beyond.max()), **{c: list(v) for c, v in held.items()},
                        **dict(zip(_UNION, np.bitwise_or.reduce(low, axis=0).view(np.int64).tolist()))})
            number, size = number + 1, 0
            for v in held.values():
                v.clear()

    def batch_of(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.list_(pa.binary() if c == "bits" else pa.int64()) if c in _LEAF else pa.int64())
                                                                  for c in ("key", "id", "low_n", "high_n", "low_c", "high_c", "beyond", *_LEAF, *_UNION)]))
    for batch in batches:
        for k, *leaf in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "block", "n", "component", "bits"))):
            if k != key or len(held["nodes"]) == most or size >= TILE_BYTES:
                close()
                key = k
            for c, v in zip(_LEAF, leaf):
                held[c].append(v)
            size += len(leaf[-1])
            if len(out) >= 200:
                yield batch_of(out)
                out.clear()
    close()
    if out:
        yield batch_of(out)


def _within(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                other = Tile({c: row[f"b_{c}"] for c in _LEAF}) if row.get("b_nodes") is not None else None
                found: dict[int, list[dict]] = {}        # a row per node, however many blocks its likes lie in
                for node, block, others in traverse(Tile(row), other, percent):
                    found.setdefault(node, []).extend({"block": block, "other": o} for o in others)
                kind = pa.list_(pa.struct([("block", pa.int64()), ("other", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), kind)], names=["node", "alike"])
    return run


ALIKE_SCHEMA = "node long, alike array<struct<block: long, other: long>>"


def _may_link(percent: int):
    """The traversal's test of two upper nodes, ``a`` and ``b``."""
    common = sum((F.bit_count(F.col(f"a.{u}").bitwiseAND(F.col(f"b.{u}"))) for u in _UNION), F.lit(0))
    overlap = common + F.least("a.beyond", "b.beyond")
    return ((F.col("a.high_n") * 100 >= F.col("b.low_n") * percent) & (F.col("b.high_n") * 100 >= F.col("a.low_n") * percent)
            & (F.least("a.low_c", "b.low_c") < F.greatest("a.high_c", "b.high_c"))
            & (overlap * (100 + percent) >= (F.col("a.low_n") + F.col("b.low_n")) * percent))


def _traversed(tiles: DataFrame, percent: int) -> DataFrame:
    """(node, alike: block, other) of all pairs of leaves, in one bucket and not in one component, that may link;
    a node has a row for each two tiles."""
    alike = tiles.where("low_c < high_c").select(*_LEAF).mapInArrow(_within(percent), ALIKE_SCHEMA)
    summary = tiles.drop(*_LEAF)
    if (summary.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) < 2:
        return alike
    levels = [summary]
    while levels[-1].groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > FAN:
        ranges = [F.min(c).alias(c) if c.startswith("low") else F.max(c).alias(c) for c in ("low_n", "high_n", "low_c", "high_c", "beyond")]
        levels.append(cut(levels[-1].groupBy("key", F.expr(f"id div {FAN}").alias("id")).agg(*ranges, *(F.bit_or(u).alias(u) for u in _UNION))))
    top = levels.pop()
    pairs = top.alias("a").join(top.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") <= F.col("b.id")) & _may_link(percent)).select(
        "a.key", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    while levels:
        below = levels.pop()
        up = F.expr(f"id div {FAN}")
        a = pairs.join(below.withColumn("a_id", up), ["key", "a_id"]).select("key", "b_id", *(F.col(c).alias(f"a_{c}") for c in summary.columns if c != "key"))
        both = a.join(below.withColumn("b_id", up), ["key", "b_id"])
        both = both.select(F.struct(*(F.col(f"a_{c}").alias(c) for c in summary.columns if c != "key")).alias("a"),
                           F.struct(*(F.col(c) for c in summary.columns)).alias("b"))
        pairs = cut(both.where((F.col("a.id") <= F.col("b.id")) & _may_link(percent)).select(
            "b.key", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")))
    leaves = tiles.select("id", *_LEAF)
    met = (pairs.where("a_id < b_id").join(leaves.withColumnRenamed("id", "a_id"), "a_id")
           .join(leaves.select(F.col("id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in _LEAF)), "b_id"))
    return alike.unionByName(met.select(*_LEAF, *(f"b_{c}" for c in _LEAF)).mapInArrow(_within(percent), ALIKE_SCHEMA))


# --- the join ----------------------------------------------------------------------------------

def _hot_table(counts: DataFrame) -> np.ndarray:
    """Flags by a token's low bits: whether one with these bits is in many prefixes.  Tasks leave out what they meet
    once, so a token may go unflagged; any table gives one order for all sets, so results don't hang on it."""
    many = counts.groupBy("key").agg(F.sum("n").alias("n")).where(f"n > {HOT_ROWS}")
    # At most 2 ** HOT_BITS numbers, whatever the number of tokens.
    at = many.select(F.col("key").bitwiseAND(F.lit((1 << HOT_BITS) - 1)).alias("at")).distinct().toArrow().column("at").to_numpy()
    flags = np.zeros(1 << HOT_BITS, bool)
    flags[at] = True
    return flags


def _buckets(linkable: DataFrame, percent: int) -> DataFrame:
    """(key, node) of the keys that several classes hold, one key for each set of members.  A class
    whose neighbours by size in the bucket are too small or too large for it is no member."""
    alone, by_size = Window.partitionBy("key"), Window.partitionBy("key").orderBy("n", "node")
    shared = (linkable.select(F.col("class").alias("node"), F.explode("keys").alias("key")).withColumn("lo", F.min("node").over(alone))
              .withColumn("hi", F.max("node").over(alone)).where("lo <> hi").select("key", "node"))
    shared = cut(shared.distinct())
    sizes = linkable.groupBy(F.col("class").alias("node")).agg(F.max("n_shingles").alias("n"))
    fits = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.lead("n").over(by_size) * percent)
    members = cut(shared.join(sizes, "node").withColumn("fits", F.coalesce(fits, F.lit(False))).where("fits").select("key", "node"))
    same = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x1"),
            F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("x2")]
    told = members.groupBy("key").agg(*same).groupBy("lo", "hi", "n", "x1", "x2").agg(F.min("key").alias("key"))
    return cut(members.join(cut(told.select("key")), "key"))


def _open(members: DataFrame, component: DataFrame, over: int = 1) -> DataFrame:
    """The members, with their components, of buckets that hold several and more than ``over`` members."""
    placed = cut(members.join(component, "node"))
    several = cut(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
                  .where(f"lo <> hi and size > {over}").select("key"))
    return placed.join(several, "key")


def _likely(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidates (node, block, others) without the others that 16 bits of every token rule out: shared
    values, and tokens beyond the values of the set that has fewer of them, bound the overlap."""
    short = F.transform("shingles", lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short"))
    brief = sets.select("node", F.size("shingles").alias("n"), F.array_distinct(short).alias("brief"))
    named = candidates.select("block", F.explode("others").alias("node")).distinct()
    blocks = brief.join(named, "node").groupBy("block").agg(F.collect_list(F.struct("node", "n", "brief")).alias("held"))

    def fits(x):
        possible = F.size(F.array_intersect("brief", x["brief"])) + F.least(F.col("n") - F.size("brief"), x["n"] - F.size(x["brief"]))
        return F.array_contains("others", x["node"]) & (possible * (100 + percent) >= (F.col("n") + x["n"]) * percent)
    kept = F.transform(F.filter("held", fits), lambda x: x["node"])
    return candidates.join(brief, "node").join(blocks, "block").select("node", "block", kept.alias("others")).where(F.size("others") > 0)


def _apart(candidates: DataFrame, component: DataFrame) -> DataFrame:
    """The candidates (node, block, others) without the others of the node's own component."""
    at = lambda end: component.toDF(end, f"{end}_c")
    pairs = candidates.select("node", "block", F.explode("others").alias("other")).join(at("node"), "node").join(at("other"), "other")
    return pairs.where("node_c <> other_c").groupBy("node", "block").agg(F.collect_list("other").alias("others"))


def similarity_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Components of documents whose word n-gram sets overlap by ``percent`` of their union.

    One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles and component_id
    (smallest doc_id reachable over links, itself included).  A text of fewer words than ``shingle`` is one shingle; a null text or one
    without words has none and is linked with nothing.  Rows that share a doc_id are one node of the link
    graph, also with different texts.  Rows without a doc_id take no part in links: component_id is null.  An empty table
    gives no rows.  Hashes of shingles and sets have 64 bits; all else is exact.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    hot = _hot_table(texts.mapInArrow(_frequent(shingle, percent), "key long, n long"))
    signed = cut(texts.mapInArrow(_prefixed(shingle, percent, hot), PREFIX_SCHEMA))
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(linkable.groupBy(F.col("class").alias("node")).agg(F.min(F.struct("doc_id", "text_key")).alias("at")))
    members = _buckets(linkable, percent)
    hubs = members.join(members.groupBy("key").agg(F.min("node").alias("lo")), "key").groupBy("node").agg(F.min("lo").alias("hub"))
    hubs = cut(hubs)
    # Classes that meet the same smallest class lie next to each other: their sets are read in blocks.
    placed_in = cut(hubs.repartitionByRange("hub", "node").sortWithinPartitions("hub", "node").mapInArrow(_numbered, "node long, block long"))
    at = classes.join(placed_in, "node").select("node", "block", "at.*")
    signatures = cut(linkable.select("doc_id", "text_key", F.col("class").alias("node"), F.col("n_shingles").alias("n"), "bits")
                     .join(at, ["doc_id", "text_key", "node"]).select("node", "n", "bits", "block").dropDuplicates(["node"]))
    # Keys and bitmaps of all rows aren't read again.
    wide, signed = signed, cut(signed.select("doc_id", "n_shingles", "class"))
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    discard(wide)
    component = cut(hubs.select("node", F.col("node").alias("component")))
    sets = None                                          # full ones, of classes that have been candidates

    def confirm(alike: DataFrame, last: DataFrame | None = None) -> DataFrame:
        nonlocal sets
        candidates = cut(alike.groupBy("node", "block").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")))
        if last is not None:
            discard(last)
        wanted = candidates.select("node").unionByName(candidates.select(F.explode("others").alias("node"))).distinct()
        wanted = wanted if sets is None else wanted.join(sets, "node", "left_anti")
        at = cut(classes.join(wanted, "node").select("node", "at.*"))
        new = cut(texts.join(at, ["doc_id", "text_key"]).select("node", "text").mapInArrow(_full_sets(shingle), "node long, shingles array<long>"))
        sets = new if sets is None else sets.unionByName(new)
        # A candidate meets one block of its partners first: what that makes one component isn't compared again.
        merged, left = component, cut(_likely(candidates, sets, percent))
        for step in range(NEAR_ROUNDS + 1):
            near = left
            if step < NEAR_ROUNDS:
                near = cut(left.join(left.groupBy("node").agg(F.min("block").alias("block")), ["node", "block"]))
            named = near.select("block", F.explode("others").alias("node")).distinct()
            blocks = sets.join(named, "node").groupBy("block").agg(F.collect_list(F.struct("node", "shingles")).alias("held"))
            links = cut(_confirmed(near, sets, blocks, placed_in, percent))
            if not links.isEmpty():
                merged = _merged(merged, links)
            if step < NEAR_ROUNDS:
                left = cut(_apart(left.join(near.select("node", "block"), ["node", "block"], "left_anti"), merged))
                if left.isEmpty():
                    break
        return merged

    for step in range(LEAD_ROUNDS):
        here = cut(_open(members, component, LEAD_FROM).join(signatures.select("node", "n"), "node"))
        if here.isEmpty():
            break
        lead = F.min(F.struct("node", "n", "component"))
        if step:                                         # one of each of the first few components
            rank = F.row_number().over(Window.partitionBy("key").orderBy("component"))
            leaders = here.groupBy("key", "component").agg(lead.alias("l")).withColumn("rank", rank).where(f"rank <= {LEADERS}")
        else:
            leaders = here.groupBy("key").agg(lead.alias("l"))
        leaders = cut(leaders.select("key", F.col("l.node").alias("other"), F.col("l.n").alias("other_n"), F.col("l.component").alias("other_component")))
        fits = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent
        pairs = here.join(leaders, "key").where("component <> other_component").where(fits).select("node", "other").distinct()
        theirs = signatures.select(F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("bits").alias("other_bits"), "block")
        alike = pairs.join(signatures.drop("block"), "node").join(theirs, "other").mapInArrow(_alike(percent), "node long, block long, other long")
        component = confirm(alike.select("node", "block", F.array("other").alias("others")))

    order, tile = ["key", "component", "n", "node"], TILE
    rows = _open(members, component).join(signatures, "node").select("key", "node", "block", "n", "component", "bits")
    tiles = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _tiles(batches, tile), TILE_SCHEMA))
    gathered = _traversed(tiles, percent).groupBy("node").agg(F.flatten(F.collect_list("alike")).alias("alike"))
    component = confirm(gathered.mapInArrow(_by_block, CANDIDATE_SCHEMA), tiles)

    # Classes under one doc_id are linked through it.
    of_doc = linkable.select("doc_id", F.col("class").alias("node")).distinct()
    twice = of_doc.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a <> hi").select("doc_id", "a")
    across = cut(of_doc.join(twice, "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    linked = classes.select("node").join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    if not across.isEmpty():
        linked = _merged(cut(linked), across)
    named = linked.join(classes.select("node", "at.doc_id"), "node")
    smallest = cut(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    of_class = cut(linked.join(smallest, "component").select(F.col("node").alias("class"), "component_id"))
    key = F.when(F.col("doc_id").isNotNull(), F.col("class"))
    return (signed.select("doc_id", "n_shingles", key.alias("class")).join(of_class, "class", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))

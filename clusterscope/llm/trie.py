"""Prefix trie of conversations in node tables addressed by minimal perfect hashes.

1. *Digests.*  A conversation's first d turns have a digest: the hash of the digest of its
   first d - 1 turns and of the d-th turn.  Equal digests are one node of the trie; Spark
   enumerates the distinct ones with their counts (partial aggregates, so a beginning that
   everyone shares is one row per task).
2. *Shards.*  A node belongs to the band of its number of conversations (up to ``UNIT``,
   up to ``UNIT * FAN``, ...).  Along a path the bands only fall, so the nodes of one band fall
   into subtrees; such a subtree is never parted, and holds no more than ``FAN`` nodes (``UNIT`` in the
   lowest band) of one depth, however many conversations share its top.
3. *Node tables.*  A task builds one minimal perfect hash for the digests of some subtrees: every
   digest gets a slot of its own, 0 to n - 1, and a look-up counts only if the slot
   holds the very digest that was asked for.  Counts are scattered into flat arrays by slot, parents
   become an array of slots, and subtree sums are accumulated through it, deepest nodes first.
   The tops' sums go to their parents in the next band; there is one round per band.

Memory of a task: a few hundred bytes for each node of its subtrees, no texts.  A conversation's turns are
numbered in one task as they stream by; none are held but the first ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterscope.session import cut, ship_package

EVERY, HEADS = 20, 4         # whose first turns are taken over, and of how many at most one less
UNIT, FAN = 2048, 2048       # conversations of a subtree in the lowest band; factor from band to band
SHARD_NODES = 1 << 16        # nodes from which a task solves what it has gathered
CHUNK_IDS = 1 << 15          # ids hashed as one string
ROOT = bytes(16)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


# --- 1. digests ---------------------------------------------------------------

def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def rebuilt_turns(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """(base, conv_id, is_base, head, turn, role, digest, words): every turn, with the conversation
    whose first turns its own conversation takes over and how many."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    base = F.col("conv_id") - F.col("conv_id") % every
    return rows.where("conv_id is not null").select(
        base.alias("base"), "conv_id", (base == F.col("conv_id")).alias("is_base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("head"), "turn", "role",
        turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


PREFIX_SCHEMA = "digest binary, parent binary, depth int, conv_id long, words long, ended boolean"


def _prefixes(heads: int):
    """Prefix nodes of rows sorted by base, the base itself first, conversation and turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, conv, at, want, pending = None, None, 0, 0, None
        taken: list[tuple[bytes, int]] = []              # the base's first turns
        out: list[tuple] = []

        def put(node):
            nonlocal pending
            if pending is not None:
                out.append((*pending, node is None))
            pending = node

        def follow(turn: bytes, words: int):
            parent = pending[0]
            put((hashlib.blake2b(parent + turn, digest_size=16).digest(), parent, pending[2] + 1, conv, words))

        for batch in batches:
            for b, c, is_base, head, digest, words in zip(*(batch.column(n).to_pylist() for n in ("base", "conv_id", "is_base", "head", "digest", "words"))):
                if c != conv or b != base:
                    put(None)
                    if b != base:
                        base, taken = b, []
                    conv, at, want = c, 0, 0 if is_base else head
                    put((ROOT, None, 0, c, 0))
                    for turn in taken[:want]:
                        follow(*turn)
                if is_base and at < heads - 1:
                    taken.append((digest, words))
                if at >= want:
                    follow(digest, words)
                at += 1
            if len(out) >= 10_000:
                yield _prefix_batch(out)
                out.clear()
        put(None)
        yield _prefix_batch(out)
    return run


def _prefix_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["digest", "parent", "depth", "conv_id", "words", "ended"])


def prefixes(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """One row per rebuilt conversation and prefix, the textless one included."""
    order = [F.col("base"), F.col("is_base").desc(), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return (rebuilt_turns(conversations, every, heads).repartition("base").sortWithinPartitions(*order)
            .select("base", "conv_id", "is_base", "head", "digest", "words").mapInArrow(_prefixes(heads), PREFIX_SCHEMA))


# --- 3. node tables -------------------------------------------------------------

class Slots:
    """Minimal perfect hash of distinct 16-byte digests.  On every level the keys that are
    alone in their cell keep it, the others go on to the next; a slot is the number of
    kept cells before its own."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, before = keys, 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("digests repeat")
            size = 2 * len(left) + 1
            cell = self._cell(left, len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            self.levels.append((alone, before + np.cumsum(alone) - alone))
            before += int(alone.sum())
            left = left[~alone[cell]]
        self.held = np.zeros_like(keys)
        slots = self._place(keys)
        self.held[slots] = keys
        if not np.array_equal(self.of(keys), slots):
            raise ValueError("slots collide")

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys[:, 0] ^ (keys[:, 1] + np.uint64(level)) * _MIX[0]
        x = (x ^ (x >> np.uint64(29))) * _MIX[1]
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            cell = self._cell(keys[left], level, len(alone))
            here = alone[cell]
            out[left[here]] = rank[cell[here]]
            left = left[~here]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots; -1 where the slot doesn't hold the key."""
        out = self._place(keys)
        ours = out >= 0
        ours[ours] = (self.held[out[ours]] == keys[ours]).all(axis=1)
        return np.where(ours, out, -1)


def _keys(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u8").reshape(-1, 2)


def subtree_sums(digest: list[bytes], parent: list[bytes | None], depth, n_convs, words, children, leaves, saved) -> tuple[np.ndarray, ...]:
    """(n_children, n_leaves, saved_tokens) of whole subtrees' nodes, in the order given.  ``children``,
    ``leaves`` and ``saved`` are what subtrees solved before add to a node."""
    keys = _keys(digest)
    slots = Slots(keys)
    at, n = slots.of(keys), len(keys)
    up = np.full(n, -1, np.int64)                        # parents' slots; -1 outside
    up[at] = slots.of(_keys([ROOT if p is None else p for p in parent]))
    up[at[[p is None for p in parent]]] = -1
    kids, ends, spared, level = (np.zeros(n, np.int64) for _ in range(4))
    kids[at], ends[at], level[at] = children, leaves, depth
    spared[at] = (np.asarray(n_convs, np.int64) - 1) * np.asarray(words, np.int64) + np.asarray(saved, np.int64)
    inside = np.flatnonzero(up >= 0)
    np.add.at(kids, up[inside], 1)
    ends[kids == 0] = 1
    order = inside[np.argsort(level[inside], kind="stable")]
    _, first = np.unique(level[order], return_index=True)
    for nodes in reversed(np.split(order, first[1:])):
        np.add.at(ends, up[nodes], ends[nodes])
        np.add.at(spared, up[nodes], spared[nodes])
    return kids[at], ends[at], spared[at]


SUM_COLUMNS = ["digest", "parent", "depth", "n_convs", "words", "add_children", "add_leaves", "add_saved"]
SOLVED_SCHEMA = "digest binary, parent binary, top boolean, n_children long, n_leaves long, saved_tokens long"


def _solve(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Subtree sums of rows sorted by their subtree's top (``unit``), in shards of ``most`` nodes or one subtree."""
    held: list[list] = [[] for _ in range(1 + len(SUM_COLUMNS))]

    def solved(upto: int) -> pa.RecordBatch:
        unit, *columns = ([x[:upto] for x in held])
        for x in held:
            del x[:upto]
        sums = subtree_sums(*columns)
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array([u == d for u, d in zip(unit, columns[0])]),
             *(pa.array(s) for s in sums)], names=["digest", "parent", "top", "n_children", "n_leaves", "saved_tokens"])

    for batch in batches:
        for have, name in zip(held, ["unit", *SUM_COLUMNS]):
            have.extend(batch.column(name).to_pylist())
        if len(held[0]) >= most:
            last = held[0][-1]
            whole = next((i for i in range(len(held[0]) - 1, -1, -1) if held[0][i] != last), -1) + 1
            if whole:
                yield solved(whole)
    if held[0]:
        yield solved(len(held[0]))


# --- ends ------------------------------------------------------------------------

def _id_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Decimal ids of rows sorted by digest and id, joined in runs of ``most``: (digest, first id, ids)."""
    digest, ids = None, []

    def run() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"digest": pa.array([digest], pa.binary()), "first": pa.array([ids[0]], pa.int64()),
                                           "ids": [",".join(map(str, ids))]})
    for batch in batches:
        for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (d != digest or len(ids) == most):
                yield run()
                ids = []
            digest = d
            ids.append(c)
    if ids:
        yield run()


def _run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of every digest, which follow each other in order."""
    digest, state, out = None, None, []
    for batch in batches:
        for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if d != digest:
                if state:
                    out.append((digest, state.hexdigest()))
                digest, state = d, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in out], pa.binary()), "ends_sha256": pa.array([s for _, s in out], pa.string())})
        out = []
    if state:
        yield pa.RecordBatch.from_pydict({"digest": pa.array([digest], pa.binary()), "ends_sha256": [state.hexdigest()]})


def end_hashes(ends: DataFrame, chunk: int = CHUNK_IDS) -> DataFrame:
    """(digest, ends_sha256) of ``ends(digest, conv_id)``.  Ids are sorted and joined over all
    tasks, a crowded node's too; only its few runs then meet in one."""
    runs = (ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
            .mapInArrow(lambda batches: _id_runs(batches, chunk), "digest binary, first long, ids string"))
    return runs.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_run_hashes, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = EVERY, heads: int = HEADS, unit: int = UNIT, fan: int = FAN,
                shard: int = SHARD_NODES, chunk: int = CHUNK_IDS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text; other columns are ignored).

    A conversation c takes over the first crc32(c) % ``heads`` turns of conversation c - c % ``every``
    (the remainder has c's sign) in place of as many of its own.  A null role or text is empty; turns are ordered with null
    first, equal ones by role and then by the turn's digest; repeated rows are turns of their own; rows without a conv_id
    take no part; an empty table has no nodes, not even a root.  A conversation left without turns ends at the root.

    Returns digest, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends
    (members that end here) and ends_sha256.
    """
    ship_package(conversations.sparkSession)
    rows = cut(prefixes(conversations, every, heads))
    said = F.struct("parent", "depth", "words")
    nodes = rows.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ended").alias("n_ends"),
                                       F.min(said).alias("a"), F.max(said).alias("b"))
    agreed = F.when(F.col("a").eqNullSafe(F.col("b")), F.col("a")).otherwise(F.raise_error(F.lit("two prefixes with one digest")).cast("struct<parent:binary,depth:int,words:bigint>"))
    step = F.lit(0)
    most = nodes.agg(F.max("n_convs")).first()[0] or 0
    bands, limit = 1, unit
    while limit < most:
        step = step + (F.col("n_convs") > F.lit(limit)).cast("int")
        bands, limit = bands + 1, limit * fan
    nodes = cut(nodes.withColumn("a", agreed).select("digest", "conv_id", "n_convs", "n_ends", "a.*", step.alias("band")))

    # The top of a node's subtree: on any member's path, the first node of the band.
    crowded = nodes.where("band > 0").select("digest", "band")
    tops = (rows.select("conv_id", "depth", "digest").join(crowded, "digest", "left").withColumn("band", F.coalesce("band", F.lit(0)))
            .groupBy("conv_id", "band").agg(F.min_by("digest", "depth").alias("unit")))
    placed = cut(nodes.join(tops, ["conv_id", "band"]).select("unit", "band", "digest", "parent", "depth", "n_convs", "words"))
    solved, added = None, None
    for band in range(bands):
        here = placed.where(F.col("band") == band)
        if added is None:
            here = here.select("*", *(F.lit(0).cast("long").alias(f"add_{c}") for c in ("children", "leaves", "saved")))
        else:
            here = here.join(added, "digest", "left").na.fill(0, ["add_children", "add_leaves", "add_saved"])
        done = cut(here.select("unit", *SUM_COLUMNS).repartition("unit").sortWithinPartitions("unit").mapInArrow(
            lambda batches: _solve(batches, shard), SOLVED_SCHEMA))
        solved = done if solved is None else solved.unionByName(done)
        passed = done.where("top and parent is not null").groupBy(F.col("parent").alias("digest")).agg(
            F.count("*").alias("add_children"), F.sum("n_leaves").alias("add_leaves"), F.sum("saved_tokens").alias("add_saved"))
        # What goes past the next band waits for its own.
        added = passed if added is None else added.unionByName(passed).groupBy("digest").agg(
            *(F.sum(c).alias(c) for c in ("add_children", "add_leaves", "add_saved")))
        added = cut(added)

    ends = cut(end_hashes(rows.where("ended").select("digest", "conv_id"), chunk))
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    sums = solved.select("digest", "n_children", "n_leaves", "saved_tokens")
    return (nodes.join(sums, "digest").join(ends, "digest", "left").join(parents, "parent", "left")
            .select("digest", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", "n_ends", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))

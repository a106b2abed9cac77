"""Exact removal of long repeated byte strings with an enhanced suffix array.

A string of ``min_len`` bytes that starts at two places of the corpus is a
repeat.  The work is cut into pieces that Spark can shuffle:

1. *Anchors.*  Every window of ``min_len`` bytes picks the smallest hash of its
   ``GRAM``-byte grams, so equal windows pick equal grams.  Neighbouring windows with the
   same pick form a segment: about one in 85 bytes starts one.  Anchors that
   occur once are dropped.
2. *Classes.*  Segments with equal anchor and text are one class; a class of
   two or more occurrences is a repeat group as a whole, however many copies
   there are, and needs no comparison.
3. *Suffix arrays.*  Classes with a common anchor but different texts go
   together: their suffixes are sorted by prefix doubling, neighbours get their
   common-prefix lengths, and one stack scan visits the common-prefix interval
   tree.  An interval whose occurrences are preceded by different bytes (or by
   a segment's start) is left-diverse: a maximal repeat group.  Every occurrence
   is put out with the deepest such group that holds it; the groups above it
   are found by length, as their texts are prefixes of its own.

An anchor with very many distinct texts (a passage that much of the corpus
quotes, each time among other words) is thinned first: every task marks the windows of such texts in a
table of fixed size, the tables are added, and runs of windows whose cells were met
once are cut off; what is left of the texts collapses into few classes.  A window that stays by a
chance hit does no harm, as the suffix arrays decide.  Anchors that are still crowded have their
windows counted exactly by Spark.  No step gathers the copies of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterscope.llm.texts import Rolling, row_runs, sliding_min, text_bytes, with_text_key
from clusterscope.session import cut, ship_package

MIN_LEN = 200
GRAM = 32
PIECE_BYTES = 2 << 20        # bytes handled at once by numpy
MANY_TEXTS = 2000            # distinct texts of an anchor from which its windows are counted first
TABLE_BITS = 24              # of each of the two tables of windows met
TABLE_PART = 1 << 16         # bytes of a table that are added together
POSITION_BITS = np.uint64(24)


# --- 1. anchors ---------------------------------------------------------------

def _segments(data: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, text hash) of all segments of these rows."""
    rolling = Rolling(data)
    gram = min(GRAM, min_len)
    grams = rolling.grams(gram)
    if len(grams) < min_len - gram + 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    picks = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), min_len - gram + 1)
    lengths = np.diff(offsets)
    inside = np.zeros(len(picks) + 1, np.int8)
    long = np.flatnonzero(lengths >= min_len)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - min_len + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    change = np.ones(len(picks), bool)
    change[1:] = (picks[1:] != picks[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(np.append(inside[:-1] & (change[1:] | ~inside[1:]), inside[-1])) + 1
    anchor = grams[(picks[first] & low).astype(np.int64)]
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first - offsets[row], stop - first, anchor, rolling.ranges(first, stop - 1 + min_len)


def _long_rows(data: np.ndarray, offsets: np.ndarray, min_len: int) -> Iterator[tuple[int, int, int]]:
    """Byte ranges (row, start, end) of one over-long row, which overlap by ``min_len - 1``."""
    start = 0
    while start < len(data):
        yield 0, start, min(len(data), start + PIECE_BYTES)
        if start + PIECE_BYTES >= len(data):
            return
        start += PIECE_BYTES - min_len + 1


def _segment_rows(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            data, offsets = text_bytes(batch.column("text"))
            for first, last in row_runs(offsets, PIECE_BYTES):
                part = data[offsets[first]:offsets[last]]
                bounds = offsets[first:last + 1] - offsets[first]
                pieces = [(0, part, bounds)]
                if len(part) > PIECE_BYTES:
                    pieces = [(a, part[a:b], np.array([0, b - a])) for _, a, b in _long_rows(part, bounds, min_len)]
                for shift, piece, at in pieces:
                    row, lo, windows, anchor, text = _segments(piece, at, min_len)
                    take = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(text.view(np.int64)), ids.take(take), keys.take(take),
                         pa.array(lo + shift, pa.int64()), pa.array(windows, pa.int32())],
                        names=["anchor", "segment", "doc_id", "text_key", "lo", "windows"])
    return run


SEGMENT_SCHEMA = "anchor long, segment long, doc_id long, text_key long, lo long, windows int"


# --- 3. suffix arrays -----------------------------------------------------------

def _ranks(symbols: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of every position by its first ``length`` symbols), doubling up to ``depth``."""
    n, length = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(length, np.int64)])
    key = np.zeros(n, np.int64)
    for t in range(length):
        key = (key << 9) | padded[t:t + n]
    out = []
    while True:
        order = np.argsort(key)                          # equal keys get one rank, in whatever order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        out.append((length, rank))
        if length >= depth:
            return out
        later = np.full(n, 0, np.int64)
        later[:max(0, n - length)] = rank[length:] + 1
        key = rank * (n + 1) + later
        length *= 2


def _common(levels, symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common-prefix length of the suffixes at a and at b, ``most`` at most."""
    n = len(symbols)
    got = np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        same = (rank[x] == rank[y]) & (a + got < n) & (b + got < n)
        got += np.where(same, length, 0)
    for _ in range(6):
        x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        got += (symbols[x] == symbols[y]) & (a + got < n) & (b + got < n)
    return np.minimum(got, most)


def maximal_repeats(texts: list[bytes], min_len: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats of at least ``min_len`` bytes among (and within) the texts, each of
    which is under ``2 * min_len`` bytes long: (group, text, start, length) per occurrence
    and its deepest left-diverse interval."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.zeros(starts[-1], np.int16)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    places = np.arange(len(joined)) + owner            # one separator after each text
    symbols[places] = joined.astype(np.int16) + 1
    levels = _ranks(symbols, min_len)
    remaining = np.zeros(len(symbols), np.int64)
    remaining[places] = starts[owner + 1] - 1 - places
    positions = np.flatnonzero(remaining >= min_len)
    if len(positions) < 2:
        return []
    # Ordered by twice the last level's length, so by all that a text holds.
    length, rank = levels[-1]
    later = np.where(positions + length < len(symbols), rank[np.minimum(positions + length, len(symbols) - 1)] + 1, 0)
    suffixes = positions[np.argsort(rank[positions] * (len(symbols) + 1) + later, kind="stable")]
    common = np.zeros(len(suffixes) + 1, np.int64)       # common[i]: of suffixes i-1 and i
    common[1:-1] = _common(levels, symbols, suffixes[:-1], suffixes[1:],
                           np.minimum(remaining[suffixes[:-1]], remaining[suffixes[1:]]))
    before = np.where(suffixes > 0, symbols[np.maximum(suffixes - 1, 0)], 0).astype(np.int64)
    # A block is a run of suffixes that share min_len bytes; one whose occurrences all follow the same
    # byte holds no left-diverse interval.  A separator before a suffix counts as a byte of its own.
    head = np.flatnonzero(common[:-1] < min_len)
    size = np.diff(np.append(head, len(suffixes)))
    low, high = np.minimum.reduceat(before, head), np.maximum.reduceat(before, head)
    found: list[tuple[int, int, int, int]] = []
    text_of = np.searchsorted(starts, suffixes, side="right") - 1
    for block in np.flatnonzero((size > 1) & ((low != high) | (low == 0))):
        i, j = int(head[block]), int(head[block] + size[block])
        _scan(common[i + 1:j].tolist(), before[i:j].tolist(), i, found)
    return [(group, int(text_of[s]), int(suffixes[s] - starts[text_of[s]]), length) for group, s, length in found]


def _scan(common: list[int], before: list[int], shift: int, found: list[tuple[int, int, int]]) -> None:
    """Stack scan of one block's interval tree, bottom-up; puts out (group, suffix, length).

    A stack entry is [length, the byte before all occurrences or -1 if they differ,
    suffixes that no deeper left-diverse interval has taken]."""
    def put(node):
        if node[1] < 0:
            group = len(found)
            found.extend((group, s + shift, node[0]) for s in node[2])
            node[2] = []

    stack: list[list] = []
    n = len(before)
    for i in range(n):
        value = common[i] if i < n - 1 else 0
        carried = [0, before[i] or -1, [i]]             # a leaf; no byte before it: diverse with any other
        while stack and stack[-1][0] > value:
            node = stack.pop()
            node[1] = node[1] if node[1] == carried[1] else -1
            node[2] += carried[2]
            put(node)
            carried = node
        if i == n - 1:
            return
        if stack and stack[-1][0] == value:
            top = stack[-1]
            top[1] = top[1] if top[1] == carried[1] else -1
            top[2] += carried[2]
        else:
            stack.append([value, carried[1], carried[2]])


def _suffix_groups(min_len: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = [(rows[t][0], group, rows[t][1], rows[t][2], rows[t][3] + start, length)
               for group, t, start, length in maximal_repeats([r[4] for r in rows], min_len)]
        cols = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["anchor", "node", "doc_id", "text_key", "start", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, since = 0, 0                               # bytes held; where the last anchor's rows begin
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "lo", "content"))):
                if rows and row[0] != rows[-1][0]:
                    if held >= PIECE_BYTES:
                        yield solve(rows)
                        rows, held = [], 0
                    since = len(rows)
                rows.append(row)
                held += len(row[4])
        if rows:
            yield solve(rows)
    return run


def _contents(min_len: int):
    """The bytes of the segments listed with each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out: dict[str, list] = {c: [] for c in ("anchor", "doc_id", "text_key", "lo", "windows", "n", "content")}
            size = 0
            for r, (doc, key, segments) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(),
                                                         batch.column("segments").to_pylist())):
                for s in segments:
                    a = offsets[r] + s["lo"]
                    out["content"].append(data[a:a + s["windows"] - 1 + min_len].tobytes())
                    for name, value in (("anchor", s["anchor"]), ("doc_id", doc), ("text_key", key), ("lo", s["lo"]),
                                        ("windows", s["windows"]), ("n", s["n"])):
                        out[name].append(value)
                    size += s["windows"] + min_len
                if size > 8 * PIECE_BYTES:
                    yield _content_batch(out)
                    out, size = {c: [] for c in out}, 0
            yield _content_batch(out)
    return run


def _content_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"windows": pa.int32(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], names=list(out))


CONTENT_SCHEMA = "anchor long, doc_id long, text_key long, lo long, windows int, n long, content binary"


def _windows_of(batch: pa.RecordBatch, min_len: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place within it, hash) of all windows of the contents, piece by piece."""
    data, offsets = text_bytes(batch.column("content"))
    for first, last in row_runs(offsets, PIECE_BYTES):
        windows = np.diff(offsets[first:last + 1]) - min_len + 1
        row = np.repeat(np.arange(first, last), windows)
        within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = offsets[row] - offsets[first] + within
        yield row, within, Rolling(data[offsets[first]:offsets[last]]).ranges(at, at + min_len)


def _cells(hashes: np.ndarray) -> np.ndarray:
    """A window's cell in each of the two tables, which lie one after the other."""
    low = np.uint64((1 << TABLE_BITS) - 1)
    return np.stack([hashes & low, ((hashes >> np.uint64(TABLE_BITS)) & low) + np.uint64(1 << TABLE_BITS)]).astype(np.int64)


def _met_tables(min_len: int):
    """Parts of a task's tables, as bits: cells met by a window, and by more than one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(2 << TABLE_BITS, np.uint8)
        for batch in batches:
            n = batch.column("n").to_numpy()
            for row, _, hashes in _windows_of(batch, min_len):
                for cells in _cells(hashes):
                    at, times = np.unique(np.concatenate([cells, cells[n[row] > 1]]), return_counts=True)
                    met[at] = np.minimum(met[at] + times, 2)
        if not met.any():
            return
        once, twice = np.packbits(met > 0), np.packbits(met > 1)
        for part in range(len(once) // TABLE_PART):
            here = slice(part * TABLE_PART, (part + 1) * TABLE_PART)
            if once[here].any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "once": [once[here].tobytes()], "twice": [twice[here].tobytes()]})
    return run


def _added_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, *bits in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "twice"))):
            once, twice = (np.frombuffer(b, np.uint8) for b in bits)
            have = held.get(part)
            held[part] = [once, twice] if have is None else [have[0] | once, have[1] | twice | (have[0] & once)]
    for part, (_, twice) in held.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "twice": [twice.tobytes()]})


def _met_twice(contents: DataFrame, min_len: int) -> np.ndarray:
    """Flags of the cells of both tables that several windows met.  2 ** (TABLE_BITS + 1) bits, whatever the input."""
    parts = (contents.mapInArrow(_met_tables(min_len), "part int, once binary, twice binary").repartition("part")
             .mapInArrow(_added_parts, "part int, twice binary").toArrow())
    bits = np.zeros(2 << TABLE_BITS >> 3, np.uint8)
    for part, twice in zip(parts.column("part").to_pylist(), parts.column("twice").to_pylist()):
        bits[part * TABLE_PART:(part + 1) * TABLE_PART] = np.frombuffer(twice, np.uint8)
    return bits


def _met_runs(min_len: int, bits: np.ndarray):
    """The contents' runs of windows that are marked in both tables, as contents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(bits).view(bool)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("anchor", "doc_id", "text_key", "lo", "windows", "n", "content")}
            rows = {c: batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "lo", "n", "content")}
            for row, within, hashes in _windows_of(batch, min_len):
                first, second = _cells(hashes)
                met = np.flatnonzero(flags[first] & flags[second])
                if not len(met):
                    continue
                head = np.flatnonzero(np.concatenate([[True], (np.diff(row[met]) != 0) | (np.diff(within[met]) != 1)]))
                for i, length in zip(met[head].tolist(), np.diff(np.append(head, len(met))).tolist()):
                    r, skip = int(row[i]), int(within[i])
                    for c in ("anchor", "doc_id", "text_key", "n"):
                        out[c].append(rows[c][r])
                    out["lo"].append(rows["lo"][r] + skip)
                    out["windows"].append(length)
                    out["content"].append(rows["content"][r][skip:skip + length - 1 + min_len])
            yield _content_batch(out)
    return run


def _window_hashes(min_len: int):
    """All windows of these contents with their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, within, hashes in _windows_of(batch, min_len):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("anchor", "doc_id", "text_key", "lo", "n")),
                     pa.array(within.astype(np.int32)), pa.array(hashes.view(np.int64))],
                    names=["anchor", "doc_id", "text_key", "lo", "n", "within", "hash"])
    return run


WINDOW_SCHEMA = "anchor long, doc_id long, text_key long, lo long, n long, within int, hash long"


def _thinned(contents: DataFrame, min_len: int) -> DataFrame:
    """Cut windows met once off the contents of crowded anchors: the rows of the
    contents, one for each run of windows that are left."""
    windows = contents.mapInArrow(_window_hashes(min_len), WINDOW_SCHEMA)
    met = windows.groupBy("anchor", "hash").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "hash")
    place = ["anchor", "doc_id", "text_key", "lo"]
    island = F.col("within") - F.row_number().over(Window.partitionBy(*place).orderBy("within"))
    runs = (windows.join(met, ["anchor", "hash"]).withColumn("island", island)
            .groupBy(*place, "island").agg(F.min("within").alias("skip"), F.count("*").alias("left")))
    c, r = contents.alias("c"), runs.alias("r")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in place]
    return c.join(r, on[0] & on[1] & on[2] & on[3]).select(
        "c.anchor", "c.doc_id", "c.text_key", (F.col("c.lo") + F.col("r.skip")).alias("lo"),
        F.col("r.left").cast("int").alias("windows"), "c.n",
        F.substr("c.content", F.col("r.skip") + 1, (F.col("r.left") + min_len - 1).cast("int")).alias("content"))


def repeat_spans(docs: DataFrame, min_len: int = MIN_LEN, many_texts: int = MANY_TEXTS) -> DataFrame:
    """Repeat groups with all their occurrences: (doc_id, text_key, start, end, group, node).

    ``start`` and ``end`` are byte offsets in the UTF-8 text.  (group, node) names a
    group; groups are maximal within a segment, so a repeat much longer than a
    window comes out in overlapping parts.  A null text holds nothing; rows
    that share doc_id and text are occurrences of their own, with equal spans.
    """
    ship_package(docs.sparkSession)
    texts = with_text_key(docs)
    segments = texts.mapInArrow(_segment_rows(min_len), SEGMENT_SCHEMA)
    twice = segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    kept = cut(segments.join(twice, "anchor"))
    # One row per distinct segment text, with its number of occurrences and one place where it stands.
    place = F.min(F.struct("doc_id", "text_key", "lo", "windows")).alias("place")
    classes = cut(kept.groupBy("anchor", "segment").agg(F.count("*").alias("n"), place))
    copies = kept.join(classes.where("n > 1").select("anchor", "segment"), ["anchor", "segment"]).select(
        "doc_id", "text_key", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") - 1 + min_len).alias("end"),
        F.col("anchor").alias("group"), F.col("segment").alias("node"))

    several = classes.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1")
    per_text = (classes.join(several, "anchor").groupBy("place.doc_id", "place.text_key")
                .agg(F.collect_list(F.struct("anchor", "place.lo", "place.windows", "n")).alias("segments")))
    t, p = texts.alias("t"), per_text.alias("p")
    contents = cut(t.join(p, F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.text_key") == F.col("p.text_key")))
                   .select("t.doc_id", "t.text_key", "t.text", "p.segments")
                   .mapInArrow(_contents(min_len), CONTENT_SCHEMA))

    crowded = several.where(F.col("texts") > many_texts).select("anchor")
    many = cut(contents.join(crowded, "anchor").select(contents.columns))
    if not many.isEmpty():
        many = cut(many.mapInArrow(_met_runs(min_len, _met_twice(many, min_len)), CONTENT_SCHEMA))
    still = cut(many.groupBy("anchor").agg(F.count_distinct(F.xxhash64("content")).alias("texts")).where(F.col("texts") > many_texts).select("anchor"))
    exact = _thinned(many.join(still, "anchor").select(many.columns), min_len)
    thin = cut(many.join(still, "anchor", "left_anti").select(exact.columns).unionByName(exact).withColumn("segment", F.xxhash64("content")))
    thin_classes = thin.groupBy("anchor", "segment").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "text_key", "lo", "windows", "content")).alias("place"))
    thin_copies = thin.join(thin_classes.where("n > 1").select("anchor", "segment"), ["anchor", "segment"]).select(
        "doc_id", "text_key", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") - 1 + min_len).alias("end"),
        F.col("anchor").alias("group"), F.col("segment").alias("node"))

    compared = (contents.join(crowded, "anchor", "left_anti").drop("windows")
                .unionByName(thin_classes.select("anchor", "n", "place.doc_id", "place.text_key", "place.lo", "place.content")))
    found = (compared.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "text_key", "lo")
             .mapInArrow(_suffix_groups(min_len), "anchor long, node long, doc_id long, text_key long, start long, length int"))
    return (copies.unionByName(thin_copies)
            .unionByName(found.select("doc_id", "text_key", "start", (F.col("start") + F.col("length")).alias("end"),
                                      F.col("anchor").alias("group"), "node")))


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows = []
        for r, spans in enumerate(batch.column("spans").to_pylist()):
            raw = data[offsets[r]:offsets[r + 1]].tobytes()
            parts, at, count, removed, reach = [], 0, 0, 0, -1
            for span in sorted((s["start"], s["end"]) for s in spans or ()):
                if span[0] > reach:                      # touching runs are one run
                    count += 1
                    parts.append(raw[at:span[0]])
                    removed += span[1] - span[0]
                elif span[1] > reach:
                    removed += span[1] - reach
                at = reach = max(reach, span[1])
            parts.append(raw[at:])
            rows.append((len(raw), removed, count, b"".join(parts)))
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()),
             pa.array([hashlib.sha256(x).hexdigest() for x in cols[3]], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, many_texts: int = MANY_TEXTS) -> DataFrame:
    """Texts without the bytes that lie in a repeat of ``min_len`` bytes.

    One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the
    remaining bytes; a cut may split a character) and kept_sha256.  A null or
    empty text gives zeros and the digest of no bytes; an empty table no rows.
    All occurrences of a repeat go, the first as well.  Rows with equal doc_id
    and text are two occurrences of their text.
    """
    spans = repeat_spans(docs, min_len, many_texts).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"))
    t, s = with_text_key(docs).alias("t"), spans.alias("s")
    joined = t.join(s, F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.text_key") == F.col("s.text_key")), "left")
    return joined.select("t.doc_id", "t.text", "s.spans").mapInArrow(
        _without_spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")

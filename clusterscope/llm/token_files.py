"""Token-id files: independent zstandard frames with a seek table.

Layout of a file (all numbers little-endian):

* one zstandard frame per run of whole documents (``FRAME_BYTES`` of ids, or one
  longer document), each with its content checksum;
* a skippable frame (``INDEX_MAGIC``) with the documents: ids per document (u32), doc_ids
  (i64; ``NO_ID`` for null), documents per frame (u32) and the three counts;
* the seek table, a skippable frame in the public seekable-zstandard layout:
  compressed size, size and checksum (low 32 bits of XXH64) of every frame, then
  number of frames, a flag byte and ``SEEK_MAGIC``.

A reader takes the table from the end of the file and decompresses only the
frames of the documents it wants.  Files are written by tasks under a name of their
own and renamed when complete, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterscope.llm.texts import row_runs, text_bytes
from clusterscope.session import cut, ensure_checkpoint_dir, ship_package

FRAME_BYTES = 256 << 10
INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
END_ID = 0
RUN_BYTES = 1 << 20          # of text encoded at once
CACHE_WORDS, CACHE_CHARS = 150_000, 64
TOGETHER = 200               # new words encoded as one text
MARKS, CUT = ".,;:!?", "\x01"           # what may end a word as a token of its own; stands before it once cut off


# --- files ---------------------------------------------------------------------

def _open(uri: str, mode: str):
    """A shared folder that the executors mount, or any store that pyarrow reaches."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return open(uri, mode)
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_file(path)


def _publish(part: str, final: str) -> None:
    if final.startswith(("file:", "/")):
        plain = lambda u: "/" + u[5:].lstrip("/") if u.startswith("file:") else u
        os.replace(plain(part), plain(final))
    else:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(final)
        store.move(fs.FileSystem.from_uri(part)[1], path)


def _make_folder(uri: str) -> None:
    if uri.startswith(("file:", "/")):
        os.makedirs("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri, exist_ok=True)
    else:
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)


class Writer:
    """Writes one file; ``add`` takes documents (their packed ids) in order."""

    def __init__(self, out, id_type: np.dtype, frame_bytes: int = FRAME_BYTES):
        self.out, self.type, self.frame_bytes = out, np.dtype(id_type).newbyteorder("<"), frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.table, self.counts, self.ids, self.per_frame = [], [], [], []
        self.held, self.documents, self.size = [], 0, 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        if self.documents and self.size + len(raw) > self.frame_bytes:
            self._frame()
        self.held.append(raw)
        self.size += len(raw)
        self.documents += 1
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(raw) // self.type.itemsize)

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.per_frame.append(self.documents)
        self.held, self.documents, self.size = [], 0, 0

    def close(self) -> None:
        if self.documents:
            self._frame()
        index = (np.array(self.counts, "<u4").tobytes() + np.array(self.ids, "<i8").tobytes() + np.array(self.per_frame, "<u4").tobytes()
                 + struct.pack("<QQQ", len(self.ids), len(self.per_frame), self.type.itemsize))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *entry) for entry in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Reads the documents of one file; only the frames that hold them are decompressed."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table at the end of the file")
        start = end - 9 - 12 * frames - 8
        source.seek(start)
        if struct.unpack("<II", source.read(8)) != (TABLE_MAGIC, 12 * frames + 9):
            raise ValueError("broken seek table")
        self.table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        source.seek(int(self.starts[-1]))
        magic, size = struct.unpack("<II", source.read(8))
        index = source.read(size)
        if magic != INDEX_MAGIC or self.starts[-1] + 8 + size != start:
            raise ValueError("broken document index")
        n, _, width = struct.unpack("<QQQ", index[-24:])
        self.type = np.dtype(f"<u{width}")
        self.counts = np.frombuffer(index, "<u4", n).astype(np.int64)
        self.ids = np.frombuffer(index, "<i8", n, 4 * n)
        per_frame = np.frombuffer(index, "<u4", frames, 12 * n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(per_frame)])           # first document of each frame
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])         # first id of each document

    def frame(self, k: int) -> np.ndarray:
        self.source.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: wrong checksum")
        return np.frombuffer(raw, self.type)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number, ids) of all documents, frame by frame."""
        for k in range(len(self.table)):
            ids = self.frame(k)
            for d in range(self.first[k], self.first[k + 1]):
                a = self.begin[d] - self.begin[self.first[k]]
                yield d, ids[a:a + self.counts[d]]

    def document(self, number: int) -> np.ndarray:
        k = int(np.searchsorted(self.first, number, side="right")) - 1
        a = self.begin[number] - self.begin[self.first[k]]
        return self.frame(k)[a:a + self.counts[number]]


# --- encoding --------------------------------------------------------------------

#: White space other than the blank and the line feed.
ODD_SPACE = re.compile(r"[^\S \n]")


class Encoder:
    """Ids of a text by a byte-level BPE file of the tokenizers library, as packed numbers.

    Its pre-tokenizer starts a new token at every single blank between two visible
    characters, so the text is cut there; the words repeat much and are encoded
    once.  New words are encoded together, and as only a word's first token begins
    with the blank, the ids tell where each word starts.  Texts with other neighbours of a
    blank, or with a special token's string, are encoded whole.  A mark between a letter or digit and a blank is a token
    of its own; it is cut off its word (``CUT`` before it), as words without it repeat more.
    """

    def __init__(self, path: str, id_type: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.type = Tokenizer.from_file(path), np.dtype(id_type).newbyteorder("<")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True     # the blank's byte in such files
        ids = lambda text: self._ids(text).tobytes()
        alone = [m for m in MARKS if all(ids(f" {w}{m} {w}") == ids(f" {w}") + ids(m) + ids(f" {w}") for w in ("a", "Z", "9", "\u00e9"))]
        self.known = {CUT + m: ids(m) for m in alone}    # packed ids by word, each with a blank before it
        self.marked = re.compile(f"([{re.escape(''.join(alone))}]) (?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]..)") if alone else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def _learn(self, plain: list[str], odd: set[str]) -> dict[str, bytes]:
        """Ids of new words; ``odd`` ones, empty or with a line feed at their end, one by one."""
        found = {w: self._ids(" " + w).tobytes() for w in odd}
        if plain:
            texts = [" " + " ".join(plain[i:i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]
            ids = np.concatenate([np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            starts = np.flatnonzero(self.blank_first[ids])
            if len(starts) != len(plain):                # not a file of this kind
                return found | {w: self._ids(" " + w).tobytes() for w in plain}
            raw, at = ids.tobytes(), (np.append(starts, len(ids)) * ids.itemsize).tolist()
            found.update(zip(plain, [raw[a:b] for a, b in zip(at, at[1:])]))
        return found

    def _cut(self, text: str) -> bool:
        """Whether all blanks are single ones between visible characters."""
        return not ("  " in text or "\n " in text or " \n" in text or ODD_SPACE.search(text) or CUT in text
                    or any(s in text for s in self.specials))

    def _words(self, text: str) -> list[str] | None:
        if not self._cut(text):
            return None
        return (self.marked.sub(f" {CUT}\\1 ", text) if self.marked else text).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self._words(t) for t in texts]
        asked: set[str] = set()
        for w in words:
            asked.update(islice(w or (), 1, None))
        # Only a text's last word can be empty or end in a line feed.
        odd = {w[-1] for w in words if w and len(w) > 1 and w[-1][-1:] in ("", "\n")}
        learnt = self._learn(list(asked.difference(self.known, odd)), odd)
        ids_of = (self.known | learnt).__getitem__
        out = [self._ids(text).tobytes() if w is None else                             # no blank before the first word
               self._ids(w[0]).tobytes() + b"".join(map(ids_of, islice(w, 1, None))) for text, w in zip(texts, words)]
        if len(self.known) < CACHE_WORDS:                # the frequent words come early
            self.known.update((w, x) for w, x in learnt.items() if len(w) <= CACHE_CHARS)
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str, id_type: str) -> Encoder:
    return Encoder(path, id_type)


def _id_type(path: str) -> str:
    from tokenizers import Tokenizer
    return "u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "u4"


def _write_part(folder: str, tokenizer: str, id_type: str, end_id: int, frame_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer, id_type), np.array([end_id], np.dtype(id_type).newbyteorder("<")).tobytes()
        number = TaskContext.get().partitionId()
        final = f"{folder}/part-{number:06d}.ids.zst"
        part = f"{folder}/.{uuid.uuid4().hex}.tmp"
        writer = None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            _, offsets = text_bytes(batch.column("text"))
            for first, last in row_runs(offsets, RUN_BYTES):
                texts = [t or "" for t in batch.column("text").slice(first, last - first).to_pylist()]
                writer = writer or Writer(_open(part, "wb"), id_type, frame_bytes)
                for doc_id, packed in zip(ids[first:last], encoder.encode(texts)):
                    writer.add(doc_id, packed + end)
        if writer:
            writer.close()
            _publish(part, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "path": [final],
                                              "documents": [len(writer.ids)], "ids": [int(sum(writer.counts))]})
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, order: list | None = None, end_id: int = END_ID,
                      frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the documents' ids in the order of ``order`` (doc_id, then text) over the files of ``folder``.

    Returns one row per file: part (its place), path, documents, ids and base (ids in
    the files before it).  A null text is an empty document, which holds just ``end_id``;
    a null doc_id sorts first; repeated rows are documents of their own; an empty table
    writes no file.
    """
    ship_package(docs.sparkSession)
    _make_folder(folder)
    order = order or ["doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in order if c != "doc_id"])
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    files = cut(rows.select("doc_id", "text").mapInArrow(_write_part(folder, tokenizer, _id_type(tokenizer), end_id, frame_bytes),
                                "part int, path string, documents long, ids long"))
    # A row per file; files hold many thousand documents, so this list stays short.
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("base", F.coalesce(before, F.lit(0)))


def _read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            with _open(path, "rb") as source:
                reader = Reader(source)
                rows: list[tuple] = []
                for d, ids in reader.documents():
                    rows.append((int(reader.ids[d]), base + int(reader.begin[d]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _documents(rows)
                        rows = []
                yield _documents(rows)


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    ids = [None if r[0] == NO_ID else r[0] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of the files listed by ``write_token_files``: doc_id, start (ids of all
    documents before it), n_tokens and ids_crc32 (of the ids as little-endian u32)."""
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, 1)
    return files.select("path", "base", "part").repartition(4 * tasks).mapInArrow(
        _read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files/{uuid.uuid4().hex}"


def token_output(docs: DataFrame, tokenizer: str, order: list | None = None) -> DataFrame:
    """Write ``docs`` to a fresh folder under the session's shared folder and read the files back."""
    return read_token_files(write_token_files(docs, fresh_folder(docs.sparkSession), tokenizer, order))


def in_file_order(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with columns that say where its rows stand in the files it is read from, and their
    names for ``order``; by doc_id if it isn't read from files."""
    try:
        rows = docs.select("doc_id", "text", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).alias("at_part"),
                           F.col("_metadata.file_name").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    except AnalysisException:
        return docs, ["doc_id"]
    number = F.when(F.col("at_part") == "", F.lit(0)).otherwise(F.col("at_part")).cast("decimal(38,0)")
    return rows.withColumn("at_part", number), ["at_part", "at_file", "at_row"]

"""Patched frame-of-reference blocks of token ids, and files of them.

A block holds 1024 ids: its minimum, the ids less the minimum in ``width`` bits each, and the ids that need more bits as exceptions.
``width`` is that of a chosen percentile of the block. A file is a row of segments, each closed by one newline byte; a segment has whole
documents and is read without the others, so neither writing nor reading holds more than one.

Segment: "PFR2", its bytes u64, documents u64, blocks u64, starts of the blocks within its data u64 each, doc_id i64 each, whether doc_id is
null u8 each, ids of each document u64 each, then the data: its blocks.
Block: minimum u32, width u8, 1 unused byte, ids used u16, exceptions u16, then the packed ids (16 * width words of 64 bits),
then the exceptions' places u16 and values u32 (less the minimum). All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import materialise
from cloakframe.llm.fasttok import tokenizer

BLOCK = 1024
HEAD = struct.Struct("<IBxHH")
MAGIC = b"PFR2"
FRONT = struct.Struct("<4sQQQ")
#: A segment is closed when it has so many blocks (some 2 MB), and a file when it has so many segments.
SEGMENT_BLOCKS, FILE_SEGMENTS = 1024, 32


def _bits(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _pack(d: np.ndarray, w: int) -> np.ndarray:
    """d: (m, BLOCK) of values under 2**w, as (m, BLOCK / 64 * w) words."""
    x = d.reshape(len(d), BLOCK // 64, 64).astype(np.uint64)
    out = np.zeros((len(d), BLOCK // 64, w), np.uint64)
    for i in range(64 if w else 0):
        k, s = divmod(i * w, 64)
        out[:, :, k] |= x[:, :, i] << np.uint64(s)
        if s + w > 64:
            out[:, :, k + 1] |= x[:, :, i] >> np.uint64(64 - s)
    return out.reshape(len(d), -1)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    m = len(words)
    out = np.zeros((m, BLOCK // 64, 64), np.uint32)
    x = words.reshape(m, BLOCK // 64, w)
    mask = np.uint64((1 << w) - 1)
    for i in range(64 if w else 0):
        k, s = divmod(i * w, 64)
        v = x[:, :, k] >> np.uint64(s)
        if s + w > 64:
            v = v | (x[:, :, k + 1] << np.uint64(64 - s))
        out[:, :, i] = (v & mask).astype(np.uint32)
    return out.reshape(m, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """ids: uint32, in blocks of BLOCK; the last may be short."""
    m = -(-len(ids) // BLOCK)
    used = np.full(m, BLOCK, np.int64)
    if len(ids) % BLOCK:
        used[-1] = len(ids) % BLOCK
        ids = np.concatenate([ids, np.full(m * BLOCK - len(ids), ids[-1], np.uint32)])
    v = ids.reshape(m, BLOCK)
    low = v.min(axis=1)
    d = v - low[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile / 100)) - 1))
    width = _bits(np.partition(d, at, axis=1)[:, at])
    over = d.astype(np.uint64) >> width[:, None].astype(np.uint64) > 0
    n_over = over.sum(axis=1)
    out: list = [None] * m
    for w in np.unique(width):
        pick = np.flatnonzero(width == w)
        words = _pack(d[pick] & np.uint32((1 << int(w)) - 1), int(w))
        for k, i in enumerate(pick):
            tail = b""
            if n_over[i]:
                where = np.flatnonzero(over[i])
                tail = where.astype("<u2").tobytes() + d[i, where].astype("<u4").tobytes()
            out[i] = HEAD.pack(int(low[i]), int(w), int(used[i]), int(n_over[i])) + words[k].astype("<u8").tobytes() + tail
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    heads = [HEAD.unpack_from(raw, int(s)) for s in starts]
    out = np.empty((len(starts), BLOCK), np.uint32)
    by: dict[int, list[int]] = {}
    for i, h in enumerate(heads):
        by.setdefault(h[1], []).append(i)
    for w, pick in by.items():
        if w:
            words = np.stack([np.frombuffer(raw, "<u8", BLOCK // 64 * w, int(starts[i]) + HEAD.size) for i in pick])
            out[pick] = _unpack(words, w)
        else:
            out[pick] = 0
    for i, (low, w, _, n) in enumerate(heads):
        if n:
            at = int(starts[i]) + HEAD.size + BLOCK // 64 * w * 8
            out[i, np.frombuffer(raw, "<u2", n, at)] = np.frombuffer(raw, "<u4", n, at + 2 * n)
        out[i] += np.uint32(low)
    flat = out.reshape(-1)
    if heads and heads[-1][2] < BLOCK:
        flat = flat[: len(flat) - BLOCK + heads[-1][2]]
    return flat


class Writer:
    """Turns documents into segments; the caller closes each with a newline byte."""

    def __init__(self, percentile: float, blocks: int = SEGMENT_BLOCKS):
        self.percentile, self.limit = percentile, blocks * BLOCK
        self.clear()

    def clear(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0
        self.doc_ids: list = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.doc_ids.append(doc_id)

    def segment(self, last: bool = False) -> bytes | None:
        """The documents added since the one before, if they fill a segment or are the last."""
        if not self.held or self.size < self.limit and not last:
            return None
        ids, step = np.concatenate(self.held).astype(np.uint32), 128 * BLOCK
        blocks = [b for i in range(0, len(ids), step) for b in encode_blocks(ids[i : i + step], self.percentile)]
        sizes = np.array([len(b) for b in blocks], np.int64)
        index = [(np.cumsum(sizes) - sizes).astype("<u8").tobytes(), np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), np.array([d is None for d in self.doc_ids], np.uint8).tobytes(), np.array([len(x) for x in self.held], "<u8").tobytes()]
        total = FRONT.size + sum(map(len, index)) + int(sizes.sum())
        out = b"".join([FRONT.pack(MAGIC, total, len(self.held), len(blocks)), *index, *blocks])
        self.clear()
        return out


class Segment:
    """A segment that begins at ``at`` of raw; ids are decoded when asked for."""

    def __init__(self, raw: bytes, at: int = 0):
        if len(raw) - at < FRONT.size + 1 or raw[at : at + 4] != MAGIC:
            raise ValueError("not a segment of frame-of-reference blocks")
        _, total, docs, blocks = FRONT.unpack_from(raw, at)
        self.raw, self.end = raw, at + total + 1
        if len(raw) < self.end or raw[self.end - 1 : self.end] != b"\n":
            raise ValueError("a segment is cut short")
        at += FRONT.size
        starts = np.frombuffer(raw, "<u8", blocks, at).astype(np.int64)
        ids = np.frombuffer(raw, "<i8", docs, at + 8 * blocks)
        none = np.frombuffer(raw, "u1", docs, at + 8 * blocks + 8 * docs)
        self.lens = np.frombuffer(raw, "<u8", docs, at + 8 * blocks + 9 * docs).astype(np.int64)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, none, strict=True)]
        self.starts = starts + at + 8 * blocks + 17 * docs

    def all(self) -> np.ndarray:
        return decode_blocks(self.raw, self.starts)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from the blocks that have them."""
        hi = int(self.lens[: k + 1].sum())
        lo = hi - int(self.lens[k])
        if lo == hi:
            return np.zeros(0, np.uint32)
        first = lo // BLOCK
        return decode_blocks(self.raw, self.starts[first : -(-hi // BLOCK)])[lo - first * BLOCK : hi - first * BLOCK]


def segments(raw: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(raw):
        yield (s := Segment(raw, at))
        at = s.end


def write_token_blocks(docs: DataFrame, path: str, spec: str, end_id: int | None = None, percentile: float = 98.0, doc_id: str = "doc_id", text: str = "text", segment_blocks: int = SEGMENT_BLOCKS, file_segments: int = FILE_SEGMENTS) -> None:
    """Encode every text and write the ids under path in ascending doc_id order, file names in order too.

    Null texts are encoded as empty (only end_id). Null doc_ids come first. Rows with one doc_id are each a document, ordered by a hash
    of the text, by which they may be dealt to several tasks. Other columns are ignored. An empty table gives files without documents.
    Spark's own writer commits the files, so a task that is lost or run twice leaves none behind. A segment holds a very long text whole.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, out = tokenizer(known.value), Writer(percentile, segment_blocks)
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def row(last: bool) -> Iterator[pa.RecordBatch]:
            if (segment := out.segment(last)) is not None:
                yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.binary())})

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i in range(0, len(ids), 512):
                for d, x in zip(ids[i : i + 512], tok.encode(texts[i : i + 512]), strict=True):
                    out.add(d, np.concatenate([x, end]))
                    yield from row(False)
        yield from row(True)

    order = ["doc_id", "h"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("h")
    rows.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", file_segments).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): files numbered in their order."""
    part, after = (F.regexp_extract("path", x, 1).cast("long") for x in (r"part-(\d+)-", r"-c(\d+)\."))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select((part * 1_000_000 + after).alias("file"), "content")


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files under path; start counts the ids of all documents before."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                before = 0
                for s in segments(raw.as_py()):
                    ends = np.cumsum(s.lens)
                    flat = s.all().astype("<u4")
                    crc = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends.tolist(), s.lens.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crc), name, np.int64)), pa.array(s.doc_ids, pa.int64()), pa.array(ends - s.lens + before, pa.int64()), pa.array(s.lens, pa.int64()), pa.array(crc, pa.int64())], names=["file", "doc_id", "local", "n_tokens", "ids_crc32"])
                    before += int(ends[-1]) if len(ends) else 0

    read = materialise(_files(spark, path).mapInArrow(decode, "file long, doc_id long, local long, n_tokens long, ids_crc32 long"), "pfor-read")
    sizes = read.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row a file
    return read.join(F.broadcast(starts), "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents named, decoded from the blocks that have them; absent ones give no row, several of one name each a row."""
    wanted = frozenset(doc_ids)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(1):
                for s in segments(raw.as_py()):
                    found = [(d, s.document(k).tolist()) for k, d in enumerate(s.doc_ids) if d in wanted]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return _files(spark, path).mapInArrow(pick, "doc_id long, ids array<long>")

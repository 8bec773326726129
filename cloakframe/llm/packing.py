"""Best-fit decreasing packing of tokenised documents into sequences.

Lengths are whole numbers up to the sequence length, so the packing of any number of documents is decided on the
histogram of their lengths (at most ``capacity`` rows on the driver): documents of one length are placed run by run, each run
into the tightest open bins, which a segment tree over the remaining capacities finds. The result equals
placing the documents one by one; every document then finds its run by its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import materialise
from cloakframe.llm.fasttok import tokenizer

SHIFT = 40  # ranks within a length stay under 2**40


class CapacityTree:
    """Segment tree of the remaining capacities that open bins have."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, on: bool) -> None:
        i = at + self.size
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least need that an open bin has."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(runs, bins used). A run: length << SHIFT | first rank, first bin, items a bin, tokens before in the bin."""
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0

    def put(left: int, lo: int, hi: int) -> None:
        if left and lo < hi:
            open_bins.setdefault(left, []).append((lo, hi))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            cap = tree.tightest(length)
            if cap is None:
                cap, lo = capacity, bins
                hi = bins = bins + -(-left // (capacity // length))
            else:
                lo, hi = open_bins[cap].pop()
                if not open_bins[cap]:
                    tree.set(cap, False)
            each = cap // length
            placed = min(left, each * (hi - lo))
            full, rest = divmod(placed, each)
            runs.append((length << SHIFT | rank, lo, each, capacity - cap))
            put(cap, lo + full + (rest > 0), hi)
            if rest:
                put(cap - rest * length, lo + full, lo + full + 1)
            put(cap - each * length, lo, lo + full)
            left, rank = left - placed, rank + placed
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 4), bins


def token_pieces(docs: DataFrame, spec: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, or pieces of capacity tokens of which the first may be shorter."""
    known = docs.sparkSession.sparkContext.broadcast(spec)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(known.value)
        for b in batches:
            names, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            out: list = []
            for k in range(0, len(texts), 512):
                for d, ids in zip(names[k : k + 512], tok.encode(texts[k : k + 512]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at, piece, step = 0, 0, len(ids) % capacity or capacity
                    while at < len(ids):
                        out.append((d, piece, at, step, zlib.crc32(ids[at : at + step])))
                        at, piece, step = at + step, piece + 1, capacity
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_best_fit(docs: DataFrame, spec: str, end_id: int = 0, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Null texts are packed as empty: one piece that holds only end_id. Null doc_ids and repeated rows are packed like any others;
    rows that are equal in all columns are interchangeable. An empty table gives an empty table. Other columns are ignored.
    """
    pieces = materialise(token_pieces(docs, spec, end_id, capacity, doc_id, text), "pieces")
    salts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs, _ = best_fit_runs(histogram, capacity)
    key, first_bin, each, before = (runs[:, i].copy() for i in range(4))
    before_salt = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1).join(before_salt, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy().astype(np.int64) for i in (3, 5))
            i = np.searchsorted(key, length << SHIFT | rank, "right") - 1
            j = rank - (key[i] & ((1 << SHIFT) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first_bin[i] + j // each[i]), pa.array(before[i] + j % each[i] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

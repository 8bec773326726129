"""Token counts by a map-side two-tier lookup; no pre-token is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.fasttok import IdCache, tokenizer

#: Sampled rows from which the frequent table is made. The table only saves time: a pre-token that it lacks is encoded.
SAMPLE_ROWS = 2000
TABLE_SIZE = 32768


def frequent_lengths(docs: DataFrame, spec: str, text: str = "text", sample_rows: int = SAMPLE_ROWS, table_size: int = TABLE_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths) of the most frequent pre-tokens of about sample_rows rows: at most table_size entries of 8 + 2 bytes."""
    total = docs.count()
    known = docs.sparkSession.sparkContext.broadcast(spec)
    share = min(1.0, sample_rows / max(1, total))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, found = tokenizer(known.value), {}
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for g in tok.groups(texts)[0]:
                *parts, _ = tok.split([texts[i] for i in g])
                at = tok.resolve(*parts)
                ln = tok.cache.len[at]
                keys, idx, n = np.unique(parts[3], return_index=True, return_counts=True)
                for k, size, c in zip(keys.tolist(), ln[idx].tolist(), n.tolist(), strict=True):
                    was = found.get(k)
                    found[k] = (size, c + (was[1] if was else 0))
        top = sorted(((c, k, size) for k, (size, c) in found.items() if c > 1), reverse=True)[:table_size]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x[1] for x in top], np.uint64).astype(np.int64)), pa.array([x[2] for x in top], pa.int64()), pa.array([x[0] for x in top], pa.int64())], names=["key", "len", "n"])

    sampled = docs.where(F.rand(17) < share).select(text).mapInArrow(tally, "key long, len long, n long")
    rows = sampled.groupBy("key").agg(F.max("len").alias("len"), F.sum("n").alias("n")).where("len < 65536").orderBy(F.desc("n"), "key").limit(table_size).collect()
    return np.array([r["key"] for r in rows], np.int64).astype(np.uint64), np.array([r["len"] for r in rows], np.uint16)


def token_counts(docs: DataFrame, spec: str, text: str = "text", limit: int = 1024, out: str = "n_tokens") -> DataFrame:
    """docs with ``out`` (long) and ``over_limit`` (boolean) in place of any columns so named.

    spec: the JSON text of a tokenizers file. Null texts count as empty: 0 tokens. Rows keep their other columns; repeated rows
    are counted each. An empty table gives an empty table. Special strings inside texts count as the library counts them.
    A very long text must fit a task. Two tiers are asked for each pre-token: a broadcast table of at most TABLE_SIZE frequent ones, then a bounded cache in the worker.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((spec, *frequent_lengths(docs, spec, text)))
    base = docs.drop(out, "over_limit")
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.LongType()), T.StructField("over_limit", T.BooleanType())])
    at = base.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, keys, lens = table.value
        tok, first = tokenizer(spec), IdCache(17)
        first.add(keys, [(int(n),) for n in lens])
        for b in batches:
            n = tok.count([t or "" for t in b.column(at).to_pylist()], first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names)

    return base.mapInArrow(count, schema)

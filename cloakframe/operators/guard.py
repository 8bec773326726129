"""Requests that are let through: keys, sizes, client addresses and rates."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BODY_BYTES = 10 * 1024 * 1024
OPEN_PATHS = ("/health",)


def resolve_keys(entries: Iterable[dict], enabled: bool = True) -> list[str]:
    """Values of {value} or {env} entries, a value before an environment variable; unresolved ones are left out."""
    keys = [v for e in entries if (v := e.get("value") or os.environ.get(e.get("env", ""), ""))]
    if enabled and not keys:
        raise ValueError("authentication is on and no key is known")
    return keys


def authorised(df: DataFrame, keys: DataFrame, header: str = "authorization", path: str = "path") -> DataFrame:
    """df with ``authorised``. keys: (key); joined by hash, so any number of them is fine."""
    token = F.when(F.col(header).startswith("Bearer "), F.substring(header, 8, 1 << 20))
    known = keys.select(F.col("key").alias("__key"), F.lit(True).alias("__ok")).distinct()
    joined = df.withColumn("__token", token).join(known, F.col("__token") == F.col("__key"), "left")
    return joined.withColumn("authorised", F.col(path).isin(*OPEN_PATHS) | F.coalesce("__ok", F.lit(False))).drop("__token", "__key", "__ok")


def within_size(body: Column, limit: int = MAX_BODY_BYTES) -> Column:
    return F.lit(True) if limit == 0 else F.octet_length(body) <= limit


def client_ip(forwarded: Column, real: Column, socket: Column) -> Column:
    """The first of the addresses that reads as ip:port, else 0.0.0.0."""
    shape = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[[0-9A-Fa-f:.]+\]):\d{1,5}$"

    def ip(c: Column) -> Column:
        t = F.trim(c)
        return F.when(t.rlike(shape), F.regexp_replace(F.regexp_replace(t, r":\d{1,5}$", ""), r"[\[\]]", ""))

    return F.coalesce(ip(F.split_part(forwarded, F.lit(","), F.lit(1))), ip(real), ip(socket), F.lit("0.0.0.0"))


def rate_limited(df: DataFrame, rate: float, burst: float | None = None, key: str = "ip", ts: str = "ts", order: str | None = None) -> DataFrame:
    """df with ``allowed``: a token bucket for each key, refilled at ``rate`` a second up to ``burst`` (rate if none), one token a request.

    Requests of a key are sequential by nature. A key's rows stream through a sorted task in batches with only the bucket as state,
    so a hot key takes time but no memory. Requests of one key at one time are taken in the order of ``order``.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    top = float(burst or rate)
    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType())])
    ki, ti = df.columns.index(key), df.columns.index(ts)

    def run(batches):
        last, tokens, seen = None, top, 0
        for b in batches:
            out = []
            for k, at in zip(b.column(ki).to_pylist(), b.column(ti).cast(pa.timestamp("us", b.column(ti).type.tz)).cast(pa.int64()).to_pylist(), strict=True):
                if last is None or k != last[0]:
                    tokens = top
                else:
                    tokens = min(top, tokens + (at - seen) / 1e6 * rate)
                last, seen = (k,), at
                out.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=schema.names)

    return df.repartition(key).sortWithinPartitions(key, ts, *([order] if order else [])).mapInArrow(run, schema)

"""Streams of text chunks and of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cloakframe import kernel
from cloakframe.policy import Policy

CHUNKS = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("chunk", T.StringType()), T.StructField("error", T.StringType())])


def last_blank(s: str) -> int:
    """One past the last white space, 0 if there is none."""
    return next((i for i in range(len(s), 0, -1) if s[i - 1].isspace()), 0)


class ChunkRedactor:
    """The buffer of one stream: what ends in white space goes out redacted, the rest waits; an error drops what waits."""

    def __init__(self, policy: Policy, detectors: list, held: str = "", holdback: int = 0):
        self.policy, self.detectors, self.held, self.holdback = policy, detectors, held, holdback

    def _out(self, s: str) -> str:
        return kernel.redact(self.detectors, self.policy, s).text

    def push(self, chunk: str) -> str | None:
        self.held += chunk
        cut = last_blank(self.held[: max(0, len(self.held) - self.holdback)])
        if not cut:
            return None
        out, self.held = self.held[:cut], self.held[cut:]
        return self._out(out)

    def fail(self) -> None:
        self.held = ""

    def finish(self) -> str | None:
        out, self.held = self.held, ""
        return self._out(out) if out else None


def fold(rows: Iterator[dict], buffer: ChunkRedactor) -> Iterator[tuple[int, str | None, str | None]]:
    """(seq, chunk, error) that come out of rows (seq, chunk, error, is_end) in order."""
    for r in rows:
        if r["error"] is not None:
            buffer.fail()
            yield r["seq"], None, r["error"]
            continue
        out = buffer.push(r["chunk"]) if r["chunk"] else None
        if r["is_end"]:
            out = (out or "") + (buffer.finish() or "") or None
        if out is not None:
            yield r["seq"], out, None


class _Processor(StatefulProcessor):
    def __init__(self, policy: Policy, detectors: list, holdback: int, ttl_seconds: int | None):
        self.policy, self.detectors, self.holdback, self.ttl = policy, detectors, holdback, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "held string", self.ttl and self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()[0] if self.state.exists() else ""
        buffer = ChunkRedactor(self.policy, self.detectors, held, self.holdback)
        frame = pd.concat(list(rows)).sort_values("seq").astype(object)
        records = frame.where(frame.notna(), None).to_dict("records")
        out = list(fold(iter(records), buffer))
        if buffer.held:
            self.state.update((buffer.held,))
        else:
            self.state.clear()
        yield pd.DataFrame([(key[0], int(s), c, e) for s, c, e in out], columns=["stream_id", "seq", "chunk", "error"])

    def close(self) -> None:
        pass


def redact_stream(df: DataFrame, policy: Policy | None = None, detectors: list | None = None, holdback: int = 0, ttl_seconds: int | None = None) -> DataFrame:
    """Redacted chunks of streams (stream_id, seq, chunk, is_end, error): a streaming DataFrame; the state is the text that waits.

    holdback: characters that are kept back besides, against values that white space splits across chunks.
    ttl_seconds: text that waits longer for more of its stream is dropped, so that streams without an end keep no state. Such a
    query runs until it is stopped, also with the trigger that takes what is there.
    Needs the RocksDB state store. Chunks of a stream are taken by seq within a batch.
    """
    dets = kernel.built_in() if detectors is None else detectors
    return df.groupBy("stream_id").transformWithStateInPandas(_Processor(policy or Policy(), dets, holdback, ttl_seconds), CHUNKS, "append", "ProcessingTime" if ttl_seconds else "None")


def redact_chunks(df: DataFrame, policy: Policy | None = None, detectors: list | None = None, holdback: int = 0) -> DataFrame:
    """The same over a table: rows of a stream pass a sorted task one by one, so long streams need no memory."""
    import pyarrow as pa

    p, dets = policy or Policy(), kernel.built_in() if detectors is None else detectors
    names = ["stream_id", "seq", "chunk", "is_end", "error"]

    def run(batches):
        key, buffer = None, None
        for b in batches:
            cols, out = [c.to_pylist() for c in b.columns], []
            for sid, seq, chunk, is_end, error in zip(*cols, strict=True):
                if buffer is None or sid != key:
                    key, buffer = sid, ChunkRedactor(p, dets, "", holdback)
                out += [(sid, *x) for x in fold(iter([{"seq": seq, "chunk": chunk, "error": error, "is_end": is_end}]), buffer)]
            parts = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.string()), pa.array(parts[3], pa.string())], names=CHUNKS.names)

    rows = df.select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), "chunk", F.coalesce("is_end", F.lit(False)).alias("is_end"), "error").select(*names)
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, CHUNKS)


class _Bucket(StatefulProcessor):
    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, at = self.state.get() if self.state.exists() else (self.burst, None)
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for ts in frame["ts"]:
            now = ts.timestamp()
            tokens = tokens if at is None else min(self.burst, tokens + max(0.0, now - at) * self.rate)
            at = now
            out.append((key[0], ts, tokens >= 1))
            tokens -= tokens >= 1
        self.state.update((float(tokens), float(at)))
        yield pd.DataFrame(out, columns=["ip", "ts", "allowed"])

    def close(self) -> None:
        pass


def limit_stream(df: DataFrame, rate: float, burst: float | None = None) -> DataFrame:
    """(ip, ts, allowed) of a stream of requests (ip, ts): a token bucket for each address, kept as state."""
    return df.select("ip", "ts").groupBy("ip").transformWithStateInPandas(_Bucket(rate, float(burst or rate)), "ip string, ts timestamp, allowed boolean", "append", "None")


def reconstruct_chunks(df: DataFrame, chunk: str = "chunk", tokens: str = "tokens") -> DataFrame:
    """df with every token in each chunk replaced by its original; a token that two chunks split stays as it is."""
    from cloakframe.operators.chat import reconstruct

    return df.withColumn(chunk, reconstruct(F.col(chunk), F.col(tokens)))


def pii_rate(df: DataFrame, window: str = "1 minute", late: str = "5 minutes", ts: str = "ts", detections: str = "detections") -> DataFrame:
    """Detections by type in tumbling windows with a watermark."""
    each = df.withWatermark(ts, late).select(ts, F.explode(detections).alias("d"))
    return each.groupBy(F.window(ts, window), F.col("d.pii_type").alias("pii_type")).agg(F.count("*").alias("n"))

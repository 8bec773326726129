"""Shared helpers: scratch storage, table access, distributed numbering and components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one only where the setting is absent and the master is local (tests, laptops)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cloakframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}-{tag}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, is computed once and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*done: DataFrame) -> None:
    """Remove tables of materialise() that nothing reads any more."""
    for df in done:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of some ten bytes a row with at most so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def global_rank(df: DataFrame, keys: list, tag: str, name: str = "_pos") -> DataFrame:
    """df with a gapless 0-based position in the order of keys, without a single-task sort.

    Rows are range-partitioned and sorted; each task numbers its own rows; the tasks' totals (one row a task)
    give every task its start. Only df's own columns travel, so pass narrow tables.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.LongType()), T.StructField("_local", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, np.int64)), pa.array(np.arange(seen, seen + n, dtype=np.int64))], names=[*b.schema.names, "_pid", "_local"])
            seen += n

    local = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema), tag)
    sizes = local.groupBy("_pid").agg(F.count("*").alias("_n"))
    starts = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_start"))
    return local.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_local")).drop("_pid", "_local", "_start")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star contraction until nothing changes; rounds grow with the logarithm of the component sizes. Each
    round's edges are written to the shared folder and replace those before. Smallest neighbours are pre-aggregated; while they are few
    they are broadcast, and otherwise they are written, so that Spark can split a node with very many neighbours in the join with them.
    """
    cur = materialise(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "cc")
    before = None
    while True:
        stats = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        if (now := (stats["n"], stats["h"])) == before:
            break
        before, used = now, [cur]

        def hold(df: DataFrame, few: bool = stats["n"] <= BROADCAST_ROWS // 2, used: list = used) -> DataFrame:
            if few:
                return F.broadcast(df)
            used.append(materialise(df, "cc-low"))
            return used[-1]

        ends = cur.select(F.col("hi").alias("u"), F.col("lo").alias("m")).unionByName(cur.select(F.col("lo").alias("u"), F.col("lo").alias("m")))
        low = hold(ends.groupBy("u").agg(F.min("m").alias("m")))
        large = materialise(cur.join(low, F.col("lo") == F.col("u")).select(F.col("m").alias("lo"), "hi").distinct(), "cc-large")
        used.append(large)
        least = hold(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        tied = large.join(least, F.col("hi") == F.col("u"))
        cur = materialise(tied.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").unionByName(tied.select(F.col("m").alias("lo"), "hi")).distinct(), "cc")
        discard(*used)
    roots = cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty, without making Python strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]

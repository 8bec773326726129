"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import global_rank, materialise


def stratified_shards(docs: DataFrame, shards: int = 16, seed: str = "shard-1", stratum: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stratum, size, text_crc32, shard, slot) of every row.

    Rows of a stratum are ranked in a seeded order; rank r of n rows gets the fraction (r + 0.5) / n; all rows in the order
    of their fractions are cut into shards whose counts differ by one at most, so each shard has the mixture of the whole.
    Slots are gapless from 0 within a shard, in that order. Null texts have size 1; null strata are a stratum; null doc_ids are
    ordered as empty names; rows that are equal are interchangeable. An empty table gives an empty table. Text is read once and never moved.
    """
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(stratum).alias("stratum"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias("h"))
    ties = ["h", "doc_id", "text_crc32", "size"]
    ranked = global_rank(materialise(narrow, "narrow"), ["stratum", *ties], "by-stratum")
    strata = ranked.groupBy(F.col("stratum").alias("s")).agg(F.count("*").alias("n"), F.min("_pos").alias("first"))
    placed = ranked.join(strata, F.col("stratum").eqNullSafe(F.col("s"))).withColumn("fraction", (F.col("_pos") - F.col("first") + 0.5) / F.col("n")).drop("_pos", "s", "n", "first")
    ordered = global_rank(materialise(placed, "fractions"), ["fraction", *ties], "by-fraction")
    total = max(1, ordered.count())
    shard = F.floor(F.col("_pos") * shards / F.lit(total)) if total * shards > 2**62 else F.expr(f"_pos * {shards}L div {total}L")
    return ordered.withColumn("shard", shard.cast("int")).select("doc_id", "stratum", "size", "text_crc32", "shard", (F.col("_pos") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).alias("slot"))

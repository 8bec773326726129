"""Removal of lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import materialise

#: Space and the control characters from tab to carriage return.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shared keys up to this many (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 500_000
ROW, NULL, KEPT, REST = "__cloakframe_row", "__cloakframe_null", "__cloakframe_kept", "__cloakframe_rest"


def line_key(line):
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with the shared lines taken out of ``text``, and ``n_lines``, ``n_dropped`` (long) in place of any columns so named.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of at least min_chars code points that at
    least min_docs distinct documents (doc_ids) have lose all their lines. Other lines stay as they were, in order.
    A null or empty text has one empty line; null stays null. A null doc_id is one document of its own name. Repeated rows are
    kept, and count once. An empty table gives an empty table. The lines of one text meet in one task again, so a text must fit a
    task; other columns, whatever their names, are kept as they are.
    """
    base = docs.drop("n_lines", "n_dropped")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    digest = F.unhex(F.md5(F.col("k").cast("binary")))
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode_outer(F.array_distinct(F.transform(lines, line_key))).alias("k")).where(F.length("k") >= min_chars)
    shared = materialise(keyed.select(digest.alias("key"), "d").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key", F.lit(True).alias("gone")), "shared-lines")
    if shared.count() <= broadcast_keys:
        shared = F.broadcast(shared)
    # one branch, so that a row's id is made once: the other columns travel with the row's first line
    rest = F.struct(F.col(text).isNull().alias(NULL), *[F.col(c) for c in base.columns if c != text])
    each = base.select(F.monotonically_increasing_id().alias(ROW), rest.alias(REST), lines.alias(KEPT)).select(ROW, REST, F.posexplode_outer(KEPT).alias("pos", "line"))
    each = each.select(ROW, F.when(F.col("pos") == 0, F.col(REST)).alias(REST), "pos", "line", line_key(F.col("line")).alias("k"))
    # a line without a key gets a name that no digest has, so that such lines don't meet in one task
    marked = each.withColumn("key", F.when(F.length("k") >= min_chars, digest).otherwise(F.concat(F.lit("-"), F.col(ROW).cast("string")).cast("binary"))).drop("k").join(shared, "key", "left")
    kept = marked.groupBy(ROW).agg(F.first(REST, ignorenulls=True).alias(REST), F.count("*").alias("n_lines"), F.count("gone").alias("n_dropped"), F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "line"))).alias(KEPT))
    body = F.when(~F.col(f"{REST}.{NULL}"), F.array_join(F.transform(F.array_sort(KEPT), lambda x: x["line"]), "\n"))
    return kept.select(*[body.alias(c) if c == text else F.col(REST)[c].alias(c) for c in base.columns], "n_lines", "n_dropped")

"""A cleaning pipeline: toxic documents go, shared lines go, near copies go but one, benchmark leaks go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontam, jaccard, lines, packing, toxicity
from cloakframe.llm.common import materialise, table
from cloakframe.llm.entry import toxicity_model, vocabulary
from cloakframe.session import ship

#: Some stages can't be expressed in SQL (a fitted lexicon, a tokenizer).
ORACLE_SQL = None


REST = "__cloakframe_others"


def aside(docs: DataFrame) -> DataFrame:
    """(doc_id, text, REST): the other columns, whatever their names, are put aside as one."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]).alias(REST))


def back(kept: DataFrame, columns: list[str]) -> DataFrame:
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(REST)[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores at 0.5 or more go. It is fitted on labelled rows of docs.

    Null and empty texts match nothing and stay, unless most labels are toxic and no entry can be learned. Repeated rows share their fate; a
    null doc_id has no label. An empty table stays empty. Other columns are kept, whatever their names.
    """
    model = toxicity_model(docs, table(ship(spark), sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, score="__cloakframe_score").where("__cloakframe_score < 0.5").drop("__cloakframe_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go; n_chars follows the text.

    Every document stays, with an empty text if all its lines go; null stays null, and its n_chars becomes null. Repeated rows of one
    doc_id are one document when lines are counted, and all stay. Rows without a doc_id are one document too. An empty table stays
    empty. Other columns are kept, whatever their names.
    """
    kept = back(lines.dedup_lines(aside(docs), min_docs=10, min_chars=1), docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that five-word shingles with a similarity of 0.8 or more connect, one stays: that with the smallest doc_id, nulls last.

    Rows of one doc_id with different texts are rows of their own; of those in one component the text with the smallest hash stays, and
    of rows that repeat both doc_id and text any one. Rows without words stay. An empty table stays empty. Other columns are kept, whatever
    their names.
    """
    ship(spark)
    key = "__cloakframe_hash"
    groups = jaccard.jaccard_groups(docs, words=5, percent=80, doc_id="doc_id", text="text", count_links=False).where("node is not null")
    rows = materialise(groups.groupBy("doc_id", F.col("text_hash").alias(key)).agg(F.any_value("component").alias("component"), F.count("*").alias("n")), "groups")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key)).alias("first")).select("first.doc_id", f"first.{key}")

    def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        same = right.select(F.col("doc_id").alias("__cloakframe_id"), F.col(key).alias("__cloakframe_key"))
        return left.join(same, F.col("doc_id").eqNullSafe(F.col("__cloakframe_id")) & (F.col(key) == F.col("__cloakframe_key")), how)

    kept = matched(docs.withColumn(key, F.xxhash64("text")), matched(rows, first, "left_anti"), "left_anti")
    repeated = matched(rows.where("n > 1"), first, "left_semi")
    if not repeated.isEmpty():
        kept = matched(kept, repeated, "left_anti").unionByName(matched(kept, repeated, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a run of ten words of a benchmark item (or a shorter item whole) go.

    Null and empty texts have no words and stay; rows without a doc_id and repeated rows are judged by their texts. An empty table or
    benchmark drops nothing. Other columns are kept, whatever their names.
    """
    found = decontam.contamination(aside(docs), table(ship(spark), sf_dir, "benchmark"), window=10)
    return back(found.where("n_hit = 0"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, best fit decreasing: a row for each piece.

    Null texts are packed as empty; rows without a doc_id and repeated rows are packed like any others. An empty table gives no rows.
    Other columns are left out.
    """
    ship(spark)
    return packing.pack_best_fit(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir, each written to the shared folder and read again."""
    docs = table(ship(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs

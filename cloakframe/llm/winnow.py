"""Winnowing fingerprints of documents. DataFrame functions only.

A text is cut into words: runs without blanks of up to LONG characters, and single characters where a run is longer (up to its last
LONG), so that text without blanks is cut the same way wherever it begins. Every run of GRAM words has a rolling hash, the cyclic polynomial
of its words' hashes; neighbouring runs share its halves. Of every WINDOW hashes in a row the smallest is kept with its
position, of equal ones the rightmost. Two texts that share a run of GRAM + WINDOW - 1 words share at least one kept hash. The rule
is the same for texts of any length; one with fewer than WINDOW hashes is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import materialise

#: GRAM is a power of two.
GRAM, WINDOW, LONG = 4, 5, 24
WORDS = f"[^ \\t-\\r]{{1,{LONG}}}+(?![^ \\t-\\r])|[^ \\t-\\r]"
#: A kept value is a 32-bit hash, then 31 bits of (LAST - position): the smallest value is the smallest hash at its rightmost place.
LAST = (1 << 31) - 1


def _rolled(words: Column, gram: int) -> Column:
    """The hash of each run of gram words: rotl(w0, gram - 1) ^ ... ^ rotl(w[gram - 1], 0), each half once for both runs that have it."""

    def halves(half: int):
        def join(a: Column, i: Column) -> Column:
            x = F.get(a, i)
            return F.shiftleft(x, half).bitwiseOR(F.shiftrightunsigned(x, 64 - half)).bitwiseXOR(F.get(a, i + half))

        return lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - half - 1), lambda i: join(a, i))

    half = 1
    while half < gram:
        words = once_in(words, halves(half))
        half *= 2
    return words


def once_in(value: Column, use) -> Column:
    """use(value), where a one-element array carries value into a lambda, so that it isn't computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def kept(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The kept values of a text, in order of position. A text of fewer than ``gram`` words has one run, and so has a text without words."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))
    words = once_in(words, lambda a: F.when(F.size(a) >= gram, a).otherwise(F.concat(a, F.array_repeat(F.lit(0).cast("long"), F.lit(gram) - F.size(a)))))
    values = once_in(_rolled(words, gram), lambda h: F.transform(h, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(LAST) - i)))

    def smallest(v: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - window, F.lit(0))), lambda i: F.least(*[F.get(v, i + j) for j in range(window)])))

    return once_in(values, smallest)


def hashes(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: F.shiftright(v, 31)))


def positions(values: Column) -> Column:
    """The first word of each kept run."""
    return F.transform(values, lambda v: (F.lit(LAST) - v.bitwiseAND(F.lit(LAST))).cast("int"))


def fingerprint(values: Column) -> Column:
    """Kept values as text: hash:position, comma-joined."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 31))), F.lit(":"), (F.lit(LAST) - v.bitwiseAND(F.lit(LAST))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes as a share of all hashes of both."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return shared / (F.size(a) + F.size(b) - shared)


def winnow(docs: DataFrame, text: str = "text", out: str = "kept") -> DataFrame:
    """docs with ``out``: the kept values of each text. Null texts count as empty."""
    return docs.withColumn(out, kept(F.coalesce(F.col(text), F.lit(""))))


def successors(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """((id, th, n, next_id, next_th), whether rows repeat): the next document of each in descending doc_id order, after the last the first.

    Distinct (doc_id, text) pairs are ordered, those of one doc_id by a hash of the text, null doc_ids last. Only ids, hashes and lengths
    are sorted; each sorted part looks up its own successors, and the parts' first rows (one a part) join the ends.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).cast("long").alias("raw"), F.xxhash64(body).alias("th"), F.length(body).alias("n"))
    narrow = materialise(narrow.groupBy("raw", "th", "n").agg(F.count("*").alias("c")), "ids")
    repeats = (narrow.agg(F.max("c")).first()[0] or 0) > 1
    order = [F.col("raw").desc_nulls_last(), F.col("th")]
    parts = materialise(narrow.drop("c").repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "parts")
    w = Window.partitionBy("pid").orderBy(*order)
    here = F.struct(F.col("raw"), F.col("th"))
    near = parts.withColumn("after", F.lead(here).over(w)).withColumn("at", F.row_number().over(w))
    heads = near.where("at = 1").select("pid", here.alias("head"))
    ring = Window.orderBy("pid")
    joins = heads.select("pid", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("over"))
    found = near.join(F.broadcast(joins), "pid").withColumn("after", F.coalesce("after", "over"))
    return found.select(*named("raw", ""), "th", "n", *named("after.raw", "next_"), F.col("after.th").alias("next_th")), repeats


def named(raw: str, prefix: str) -> list[Column]:
    """A doc_id as two columns without nulls, which joins compare."""
    return [F.coalesce(F.col(raw), F.lit(0).cast("long")).alias(f"{prefix}id"), F.col(raw).isNull().alias(f"{prefix}none")]


def once(value: Column, name: str) -> Column:
    """A column that later columns read without computing it again."""
    return F.explode(F.array(value)).alias(name)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last third of the code points replaced by the first as many of the next document in descending doc_id order.
    Null texts count as empty; texts without words are alike. Null doc_ids come last. Repeated rows are each returned, with one successor. A
    single document is its own successor. An empty table gives an empty table. A text may have 2**31 words and must fit a task.
    Other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # both joins below read exactly these columns by the same keys, so the texts are exchanged once and the exchange is used again
    base = docs.select(F.col(doc_id).cast("long").alias("raw"), body.alias("text")).select(*named("raw", ""), F.xxhash64("text").alias("th"), "text")
    after, repeats = successors(docs, doc_id, text)
    after = materialise(after, "successors")
    keys = ["id", "none", "th"]
    donors = base.join(after.select(F.col("next_id").alias("id"), F.col("next_none").alias("none"), F.col("next_th").alias("th"), F.col("id").alias("to_id"), F.col("none").alias("to_none"), F.col("th").alias("to_th"), "n"), keys)
    donors = donors.select(F.col("to_id").alias("id"), F.col("to_none").alias("none"), F.col("to_th").alias("th"), F.substring("text", F.lit(1), F.floor(F.col("n") / 3).cast("int")).alias("head"), hashes(kept(F.col("text"))).alias("next"))
    if repeats:
        donors = donors.dropDuplicates(keys)
    n = F.length("text")
    joined = base.join(donors, keys).select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "text", n.alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head")).alias("edited"), "next")
    found = joined.select("doc_id", F.col("n_chars").cast("long"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), once(F.struct(kept(F.col("text")).alias("own"), kept(F.col("edited")).alias("edited")), "v"), "next")
    own = found.select("doc_id", "n_chars", "edited_sha256", "v", "next", once(F.struct(hashes(F.col("v.own")).alias("own"), hashes(F.col("v.edited")).alias("edited")), "h"))
    return own.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("v.own")).alias("fingerprint"), fingerprint(F.col("v.edited")).alias("edited_fingerprint"), likeness(F.col("h.own"), F.col("h.edited")).alias("near_edited"), likeness(F.col("h.own"), F.col("next")).alias("near_next"))

"""Registered queries of the ten operators, each over whole tables, and their SQL equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import bootstrap_pii, decontam, jaccard, lines, packing, pfor, sharding, token_counts, toxicity, winnow
from cloakframe.llm.common import scratch_path, table
from cloakframe.session import ship


def vocabulary(name: str) -> str:
    """The text of a tokenizer file, read on the driver and sent to the workers, who need no copy of the file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_pfor_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(ship(spark), "token-blocks")
    pfor.write_token_blocks(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return pfor.read_token_blocks(spark, path)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit_toxicity(toxicity.labelled_sample(docs, labels.where(~held_out())))


def op2_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bootstrap_pii.find_pii(table(ship(spark), sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in bootstrap_pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(own)).cast("long").alias("n_discovered"))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(ship(spark), sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(table(ship(spark), sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(ship(spark), sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.stratified_shards(table(ship(spark), sf_dir, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(ship(spark), sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", "over_limit")


def queries() -> dict:
    return {f.__name__: f for f in (op1_pfor_token_blocks, op2_toxicity_lexicon, op3_winnowing, op4_bootstrapped_pii, op5_jaccard_components, op6_best_fit_packing, op7_line_dedup, op8_benchmark_decontamination, op9_stratified_shards, op10_token_counts)}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
with recursive docs as (
  select row_number() over () as row_no, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents
), shingles as (
  select distinct row_no, doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end as s
  from (select row_no, doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from docs where len(w) > 0)
), sizes as (
  select row_no, doc_id, count(*) as n from shingles group by 1, 2
), shared as (
  select a.row_no as x, b.row_no as y, count(*) as both_have from shingles a join shingles b on a.s = b.s and a.row_no <> b.row_no group by 1, 2
), links as (
  select x, y from shared join sizes p on p.row_no = x join sizes q on q.row_no = y where 100 * both_have >= 85 * (p.n + q.n - both_have)
), reach(x, y) as (
  select row_no, row_no from docs union select r.x, l.y from reach r join links l on l.x = r.y
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id, coalesce(k.n, 0)::bigint as n_links
from docs d left join sizes s on s.row_no = d.row_no left join (select x, count(*) as n from links group by 1) k on k.x = d.row_no
join (select r.x, min(e.doc_id) as component_id from reach r join docs e on e.row_no = r.y group by 1) c on c.x = d.row_no
"""

OP7_SQL = f"""
with each as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents
), keyed as (
  select *, {LOWER.format("trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13)))")} as k from each
), shared as (
  select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(shared.k) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where shared.k is null), '')) as kept_sha256
from keyed left join shared on keyed.k = shared.k group by doc_id
"""

OP8_SQL = f"""
with d as (
  select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), item_windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + 9], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
), doc_windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from item_windows) where len(w) >= n)
), found as (
  select doc_id, i, dw.n, item_id from doc_windows dw join item_windows using (n, s)
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by 1
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item_id::varchar as item from found) group by 1
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

OP9_SQL = """
with recursive steps(n, k, c) as (
  select i, 0, i::bigint from range(256) t(i) union all select n, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8
), crc_table as (
  select list(c order by n) as t from steps where k = 8
), d as (
  select doc_id, source, strlen(coalesce(text, '')) + 1 as size, md5(concat('shard-1:', coalesce(doc_id::varchar, ''))) as h,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: concat('0x', x)::bigint), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) as text_crc32
  from documents, crc_table
), ranked as (
  select *, (row_number() over (partition by source order by h, doc_id) - 0.5::double) / count(*) over (partition by source) as fraction from d
), ordered as (
  select *, row_number() over (order by fraction, h, doc_id) - 1 as pos, count(*) over () as total from ranked
)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, (pos * 16 // total)::int as shard,
  pos - ((pos * 16 // total) * total + 15) // 16 as slot, null::int as grown_shard
from ordered
"""


def oracle_sql() -> dict:
    return {"op5_jaccard_components": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_benchmark_decontamination": OP8_SQL, "op9_stratified_shards": OP9_SQL}

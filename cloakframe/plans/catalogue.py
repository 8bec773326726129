"""Registered queries of the engine and their SQL equivalents.

Types that the documents lack are looked for in carrier texts, which are computed from keys by SQL that both engines read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import kernel
from cloakframe.functions import arrow, native, phoneplan
from cloakframe.operators import audit, chat, detection, guard
from cloakframe.policy import Policy
from cloakframe.session import ship
from cloakframe.streaming import streams
from cloakframe.types import CONFIDENCE_RANK, ORDER, TYPES

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in documents by type, with what stands for them by default."""
    found = detection.with_detections(table(ship(spark), sf_dir, "documents").select("doc_id", "text"))
    return detection.regulatory(detection.exploded(found, "doc_id").groupBy("pii_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "text")


# --- carrier texts -----------------------------------------------------------------------------------------------

def pad(x: str, n: int) -> str:
    return f"lpad(cast({x} as varchar(20)), {n}, '0')"


K = "o_orderkey"
CARRIERS = {
    "ssn": ("orders", K, f"concat('SSN: ', {pad(K + ' % 1000', 3)}, '-', {pad(K + ' % 100', 2)}, '-', {pad(K + ' * 7 % 10000', 4)}, ' ok')"),
    "card": ("orders", K, f"concat('Card ', case {K} % 5 when 0 then '4' when 1 then '55' when 2 then '37' when 3 then '6011' else '9' end, {pad(K + ' * 7919 % 100000000', 8)}, {pad(K + ' % 1000', 3)}, case when {K} % 3 = 0 then '0000' else '000' end, ' end')"),
    "passport": ("customer", "c_custkey", f"concat('Passport ', case c_custkey % 4 when 0 then 'AB' when 1 then 'C' when 2 then '' else 'XYZ' end, {pad('c_custkey * 104729 % 10000000', 7)}, ' valid')"),
    "national_id": ("customer", "c_custkey", f"concat('ID ', case c_custkey % 5 when 0 then concat({pad('c_custkey % 10000', 4)}, ' ', {pad('c_custkey * 3 % 10000', 4)}, ' ', {pad('c_custkey * 7 % 10000', 4)}) when 1 then concat('ABCDE', {pad('c_custkey % 10000', 4)}, 'F') when 2 then {pad('c_custkey * 104729 % 1000000000', 9)} when 3 then concat('1', {pad('c_custkey * 104729 % 1000000000000', 12)}) else {pad('c_custkey % 100000', 5)} end, ' x')"),
    "iban": ("customer", "c_custkey", f"concat('Pay DE', {pad('98 - (c_custkey * 104729 % 1000000000 * 1000000 + 131400) % 97', 2)}, '00000000', {pad('c_custkey * 104729 % 1000000000', 9)}, case when c_custkey % 4 = 0 then '1' else '0' end, '.')"),
    "ipv6": ("customer", "c_custkey", f"concat('Host ', case c_custkey % 4 when 0 then concat('fe80::', cast(c_custkey % 10000 as varchar(20))) when 1 then concat('2001:db8:0:0:0:0:0:', cast(c_custkey % 10000 as varchar(20))) when 2 then concat('1:2:3:', cast(c_custkey % 10000 as varchar(20))) else '::1' end, ' up')"),
    "address": ("supplier", "s_suppkey", "concat('Ship to: ', cast(s_suppkey as varchar(20)), case s_suppkey % 4 when 0 then ' Main Street' when 1 then ' Old Oak Avenue' when 2 then ' Something' else ' Pine Rd' end, '; thanks')"),
    "overlap": ("orders", K, f"concat('Ref ', {pad(K + ' * 7919 % 1000', 3)}, '-', {pad(K + ' % 100', 2)}, '-', {pad(K + ' * 3 % 10000', 4)}, ' and u', cast({K} as varchar(20)), '@mail.example.com')"),
}


def carrier(spark: SparkSession, d: str, name: str) -> DataFrame:
    source, key, text = CARRIERS[name]
    return table(spark, d, source).select(F.col(key).alias("id"), F.expr(text).alias("text"))


def carried(name: str) -> str:
    source, key, text = CARRIERS[name]
    return f"select {key} as id, {text} as text from {source}"


EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def spans_sql(src: str, pattern: str, valid: str, keys: str = "doc_id") -> str:
    """(keys, start, end, original) of the matches, in DuckDB: gaps and hits side by side."""
    return f"""
      select {keys}, before_len as start, before_len + strlen(hit) as "end", hit as original from (
        select *, sum(strlen(gap)) over w + coalesce(sum(strlen(hit)) over (partition by {keys} order by i rows between unbounded preceding and 1 preceding), 0) as before_len,
          case when gap = '' then coalesce(right(lag(hit) over w2, 1), '') else right(gap, 1) end as prev,
          case when lead(gap) over w2 = '' then coalesce(left(lead(hit) over w2, 1), '') else left(lead(gap) over w2, 1) end as nxt
        from (select {keys}, unnest(range(1, len(g) + 1)) as i, unnest(g) as gap, unnest(list_append(h, null)) as hit
          from (select {keys}, string_split_regex(text, '{pattern}') as g, regexp_extract_all(text, '{pattern}') as h from ({src})))
        window w as (partition by {keys} order by i rows between unbounded preceding and current row), w2 as (partition by {keys} order by i))
      where hit is not null and {valid}"""


DOCS = "select doc_id, lang, text from documents"
V_EMAIL = "not contains(split_part(hit, '@', 1), '..')"
V_IPV4 = "len(list_filter(string_split(hit, '.'), lambda p: p::int <= 255 and (p = '0' or p not like '0%'))) = 4"
CARD = r"\d(?:[ -]*\d){12,18}"
DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"


def luhn_sql(d: str) -> str:
    return f"list_sum(list_transform(range(length({d})), lambda i: case when i % 2 = 1 then (case when substr({d}, length({d}) - i, 1)::int * 2 > 9 then substr({d}, length({d}) - i, 1)::int * 2 - 9 else substr({d}, length({d}) - i, 1)::int * 2 end) else substr({d}, length({d}) - i, 1)::int end)) % 10 = 0"


def network_sql(d: str) -> str:
    def p(k):
        return f"left({d}, {k})::int"

    return f"""case when left({d}, 1) = '4' and length({d}) in (13, 16) then 'visa'
      when length({d}) = 16 and ({p(2)} between 51 and 55 or {p(4)} between 2221 and 2720) then 'mastercard'
      when {p(4)} = 6011 or {p(2)} = 65 or {p(3)} between 644 and 649 or length({d}) = 16 and {p(6)} between 622126 and 622925 then 'discover'
      when length({d}) = 15 and {p(2)} in (34, 37) then 'amex'
      when length({d}) = 16 and {p(4)} between 3528 and 3589 then 'jcb'
      when length({d}) = 14 and ({p(3)} between 300 and 305 or {p(3)} = 309 or {p(2)} in (36, 38, 39)) then 'diners'
      when {p(4)} in (5018, 5020, 5038, 5893, 6304, 6759, 6761, 6762, 6763) then 'maestro'
      when {p(2)} in (62, 81) and length({d}) between 16 and 19 then 'unionpay' end"""


LENIENT_CARD = f"not regexp_matches(prev, '[0-9]') and not regexp_matches(coalesce(nxt, ''), '[0-9]') and length({DIGITS}) between 13 and 19"
STRICT_CARD = f"{LENIENT_CARD} and {luhn_sql(DIGITS)} and {network_sql(DIGITS)} is not null"


def each(df: DataFrame, column, *keys: str) -> DataFrame:
    """(keys, x) for each element of an array column, which is computed once: explode() would have it filtered below, and so computed again."""
    return df.select(*keys, F.explode_outer(column).alias("x")).where("x is not null")


def found(df: DataFrame, pii_type: str, key: str = "doc_id", strict: bool = True) -> DataFrame:
    """(key, start, end, original) by Catalyst expressions."""
    return each(df, native.detect(F.col("text"), pii_type, strict), key).select(key, "x.start", "x.end", "x.original")


def masked(df: DataFrame, pii_type: str, key: str = "doc_id", strict: bool = True) -> DataFrame:
    return found(df, pii_type, key, strict).select(key, "start", native.mask(F.lit(pii_type), F.col("original")).alias("masked"))


def out(sql: str, columns: str = 'doc_id, start::int as start, "end"::int as "end", original') -> str:
    return f"select {columns} from ({sql})"


IDS = 'id, start::int as start, "end"::int as "end", original'

# --- lone detectors ----------------------------------------------------------------------------------------------


@query(f"select doc_id, count(*) as n from ({spans_sql(DOCS, EMAIL, V_EMAIL)}) group by doc_id")
def q_email_detect(spark, d):
    return found(docs(spark, d), "email").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(out(spans_sql(DOCS, EMAIL, V_EMAIL)))
def q_email_spans(spark, d):
    return found(docs(spark, d), "email")


EMAIL_MASK = "concat(regexp_replace(split_part(original, '@', 1), '[^.]', '█', 'g'), '@', repeat('█', strlen(regexp_extract(split_part(original, '@', 2), '^(.*)\\.[^.]*$', 1))), '.', regexp_extract(original, '([^.]*)$', 1))"


@query(out(spans_sql(DOCS, EMAIL, V_EMAIL), f"doc_id, start::int as start, {EMAIL_MASK} as masked"))
def q_email_mask(spark, d):
    return masked(docs(spark, d), "email")


@query(out(spans_sql(DOCS, IPV4, V_IPV4)))
def q_ipv4_detect(spark, d):
    return found(docs(spark, d), "ip_address_v4")


@query(out(spans_sql(DOCS, IPV4, V_IPV4), "doc_id, start::int as start, repeat('█', strlen(original)) as masked"))
def q_ipv4_mask(spark, d):
    return masked(docs(spark, d), "ip_address_v4")


@query(out(spans_sql(DOCS, CARD, STRICT_CARD)))
def q_card_detect_strict(spark, d):
    return found(docs(spark, d), "credit_card")


@query(out(spans_sql(DOCS, CARD, LENIENT_CARD)))
def q_card_detect_lenient(spark, d):
    return found(docs(spark, d), "credit_card", strict=False)


@query(f"select id, regexp_extract(text, '[0-9]+') as digits, {network_sql('''regexp_extract(text, '[0-9]+')''')} as network from ({carried('card')})")
def q_card_network(spark, d):
    c = carrier(spark, d, "card").withColumn("digits", F.regexp_extract("text", "[0-9]+", 0))
    return c.select("id", "digits", native.card_network(F.col("digits")).alias("network"))


@query(out(spans_sql(carried("card"), CARD, LENIENT_CARD, "id"), "id, concat(repeat('█', length(original) - 4), right(original, 4)) as masked"))
def q_card_mask(spark, d):
    return masked(carrier(spark, d, "card"), "credit_card", "id", strict=False).select("id", "masked")


@query(f"select id, {luhn_sql('''regexp_extract(text, '[0-9]+')''')} as ok from ({carried('card')})")
def q_luhn(spark, d):
    return carrier(spark, d, "card").select("id", native.luhn(F.regexp_extract("text", "[0-9]+", 0)).alias("ok"))


MOD97 = "(substr(x, 5)::hugeint * 1000000 + 131400 + substr(x, 3, 2)::hugeint) % 97"


@query(f"select id, ({MOD97})::bigint as remainder from (select id, regexp_extract(text, '[A-Z]{{2}}[0-9]+') as x from ({carried('iban')}))")
def q_iban_mod97(spark, d):
    return carrier(spark, d, "iban").select("id", native.iban_mod97(F.regexp_extract("text", "[A-Z]{2}[0-9]+", 0)).alias("remainder"))


@query(f"select id, x as original from (select id, regexp_extract(text, '[A-Z]{{2}}[0-9]+') as x from ({carried('iban')})) where {MOD97} = 1")
def q_iban_detect(spark, d):
    return found(carrier(spark, d, "iban"), "iban", "id").select("id", "original")


@query(f"select id, concat(left(x, 2), repeat('█', length(x) - 6), right(x, 4)) as masked from (select id, regexp_extract(text, '[A-Z]{{2}}[0-9]+') as x from ({carried('iban')})) where {MOD97} = 1")
def q_iban_mask(spark, d):
    return masked(carrier(spark, d, "iban"), "iban", "id").select("id", "masked")


SSN = r"\b(?:\d{3}-\d{2}-\d{4}|\d{9})\b"
V_SSN = "left(hit, 3)::int not in (0, 666) and left(hit, 3)::int < 900 and substr(hit, 5, 2)::int > 0 and right(hit, 4)::int > 0"


@query(out(spans_sql(carried("ssn"), SSN, V_SSN, "id"), IDS))
def q_ssn_detect_strict(spark, d):
    return found(carrier(spark, d, "ssn"), "ssn", "id")


@query(out(spans_sql(carried("ssn"), SSN, "true", "id"), IDS))
def q_ssn_detect_lenient(spark, d):
    return found(carrier(spark, d, "ssn"), "ssn", "id", strict=False)


@query(out(spans_sql(carried("ssn"), SSN, V_SSN, "id"), "id, regexp_replace(original, '[0-9]', '█', 'g') as masked"))
def q_ssn_mask(spark, d):
    return masked(carrier(spark, d, "ssn"), "ssn", "id").select("id", "masked")


PASSPORT = r"\b(?:[A-Z]{1,2}\d{6,10}|\d{6,10}[A-Z]?)\b"


@query(out(spans_sql(carried("passport"), PASSPORT, "true", "id"), IDS))
def q_passport_detect(spark, d):
    return found(carrier(spark, d, "passport"), "passport_number", "id")


@query(out(spans_sql(carried("passport"), PASSPORT, "true", "id"), "id, concat(regexp_extract(original, '^[^0-9]*'), repeat('█', length(original) - length(regexp_extract(original, '^[^0-9]*')))) as masked"))
def q_passport_mask(spark, d):
    return masked(carrier(spark, d, "passport"), "passport_number", "id").select("id", "masked")


NATIONAL = kernel.PATTERNS["national_id"]


@query(out(spans_sql(carried("national_id"), NATIONAL, "true", "id"), IDS))
def q_national_id_detect(spark, d):
    return found(carrier(spark, d, "national_id"), "national_id", "id")


@query(f"select id, concat(string_agg(case when c between '0' and '9' and later >= 4 then '█' else c end, '' order by i)) as masked from (select id, i, c, count(*) filter (where c between '0' and '9') over (partition by id order by i rows between 1 following and unbounded following) as later from (select id, unnest(range(1, length(original) + 1)) as i, unnest(string_split(original, '')) as c from ({out(spans_sql(carried('national_id'), NATIONAL, 'true', 'id'), IDS)}))) group by id")
def q_national_id_mask(spark, d):
    return masked(carrier(spark, d, "national_id"), "national_id", "id").select("id", "masked")


PHONE = r"\+?[\d\s\-\.\(\)]{7,25}"
T_HIT = "regexp_replace(hit, '^\\s+|\\s+$', '', 'g')"
T_DIGITS = f"regexp_replace({T_HIT}, '[^0-9]', '', 'g')"
V_PHONE_SHAPE = f"""{T_HIT} <> '' and length({T_DIGITS}) between 7 and 15
  and (regexp_matches(hit, '^\\s') or not regexp_matches(prev, '[A-Za-z0-9]')) and (regexp_matches(hit, '\\s$') or not regexp_matches(coalesce(nxt, ''), '[A-Za-z0-9]'))"""
_HOME = " or ".join(f"length({T_DIGITS}) = {n} and starts_with({T_DIGITS}, '{h}')" for h, n in sorted({x for c in phoneplan.DEFAULT_COUNTRIES for x in phoneplan.national_lengths(c)}))
_PLANS = list(dict.fromkeys(phoneplan.PLANS.values()))
_ABROAD = " or ".join(f"starts_with({T_DIGITS}, '{c}') and length({T_DIGITS}) - {len(c)} between {lo} and {hi + len(t)}" for c, t, lo, hi in _PLANS)
_STARTS = " or ".join(f"starts_with({T_DIGITS}, '{c}')" for c in sorted({p[0] for p in _PLANS}))
V_PHONE = f"{V_PHONE_SHAPE} and {T_DIGITS} not in ('0000000000', '1111111111', '1234567890') and case when starts_with({T_HIT}, '+') then not starts_with({T_DIGITS}, '0') and case when {_STARTS} then ({_ABROAD}) else length({T_DIGITS}) between 8 and 15 end else ({_HOME}) end"


def phones_sql(valid: str, columns: str) -> str:
    return f"select doc_id, {columns} from (select *, original as hit from ({spans_sql(DOCS, PHONE, valid)}))"


@query(phones_sql(V_PHONE_SHAPE, f"start::int + strlen(hit) - strlen(regexp_replace(hit, '^\\s+', '')) as start, {T_HIT} as original"))
def q_phone_candidates(spark, d):
    m = native.matches(F.col("text"), "(?U)" + PHONE)
    rows = docs(spark, d).select("doc_id", F.explode(m).alias("m"))
    whole = F.regexp_replace("m.original", r"(?U)^\s+|\s+$", "")
    start = F.col("m.start") + F.octet_length("m.original") - F.octet_length(F.regexp_replace("m.original", r"(?U)^\s+", ""))
    ok = (whole != "") & F.length(native.digits(whole)).between(7, 15)
    ok &= F.col("m.original").rlike(r"(?U)^\s") | ~F.col("m.before").rlike("[A-Za-z0-9]")
    ok &= F.col("m.original").rlike(r"(?U)\s$") | ~F.col("m.after").rlike("[A-Za-z0-9]")
    return rows.where(ok).select("doc_id", start.alias("start"), whole.alias("original"))


@query(phones_sql(V_PHONE, f"start::int + strlen(hit) - strlen(regexp_replace(hit, '^\\s+', '')) as start, {T_HIT} as original"))
def q_phone_detect(spark, d):
    return found(docs(spark, d), "phone_number").select("doc_id", "start", "original")


@query(phones_sql(V_PHONE, f"regexp_replace({T_HIT}, '[0-9]', '█', 'g') as masked"))
def q_phone_mask(spark, d):
    return masked(docs(spark, d), "phone_number").select("doc_id", "masked")


@query(f"select id, case id % 4 when 2 then null else split_part(text, ' ', 2) end as original from ({carried('ipv6')}) where id % 4 <> 2")
def q_ipv6_detect(spark, d):
    det = kernel.built_in(["ip_address_v6"])[0]
    c = carrier(spark, d, "ipv6").withColumn("d", arrow.detect_one(F.col("text"), det))
    return each(c, F.col("d"), "id").select("id", F.col("x.original").alias("original"))


@query(f"select id, regexp_extract(text, '^Ship to: ([^;]*);', 1) as original from ({carried('address')}) where id % 4 <> 2")
def q_address_detect(spark, d):
    det = kernel.built_in(["physical_address"])[0]
    c = carrier(spark, d, "address").withColumn("d", arrow.detect_one(F.col("text"), det))
    return each(c, F.col("d"), "id").select("id", F.col("x.original").alias("original"))


@query(out(spans_sql(DOCS, "token = \"[0-9a-f]{8}", "true"), "doc_id, start::int as start, original"))
def q_custom_regex(spark, d):
    det = kernel.Custom("secret", 'token = "[0-9a-f]{8}', confidence="high")
    return docs(spark, d).transform(lambda rows: each(rows, arrow.detect_one(F.col("text"), det), "doc_id")).select("doc_id", "x.start", "x.original")


@query(out(spans_sql(DOCS, "(?i)licensed under", "true"), "doc_id, start::int as start, original"))
def q_custom_flags(spark, d):
    det = kernel.Custom("licence", "licensed under", flags="i")
    return docs(spark, d).transform(lambda rows: each(rows, arrow.detect_one(F.col("text"), det), "doc_id")).select("doc_id", "x.start", "x.original")


CORE = r"regexp_replace(hit, '^[^\p{L}]+|[^\p{L}]+$', '', 'g')"


@query(f"select conv_id, turn, (start + strlen(regexp_extract(original, '^[^\\p{{L}}]*')))::int as start, {CORE.replace('hit', 'original')} as original from ({spans_sql('select conv_id, turn, text from conversations', '[^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]+', f"regexp_matches({CORE}, '^{chr(92)}p{{Lu}}{chr(92)}p{{L}}*$') and strlen({CORE}) > 1", 'conv_id, turn')})")
def q_name_heuristic(spark, d):
    rows = each(table(spark, d, "conversations"), arrow.detect_one(F.col("text"), kernel.Names()), "conv_id", "turn")
    return rows.select("conv_id", "turn", "x.start", "x.original")


# --- composite detection -----------------------------------------------------------------------------------------

@query(f"""
select id, case when regexp_matches(n, '^(000|666|9)') or substr(n, 5, 2) = '00' or right(n, 4) = '0000' then 'phone_number' else 'ssn' end as pii_type, n as original
from (select id, regexp_extract(text, '[0-9-]+') as n from ({carried('overlap')}))
union all select id, 'email', regexp_extract(text, 'u[0-9]+@mail.example.com') from ({carried('overlap')})""")
def q_resolve_overlaps(spark, d):
    c = carrier(spark, d, "overlap").withColumn("d", native.detect_all(F.col("text"), ("email", "phone_number", "ssn")))
    return each(c, F.col("d"), "id").select("id", "x.pii_type", "x.original")


_OWNER: dict[str, str] = {}
for _t in TYPES.values():
    for _a in _t.anchors:
        _OWNER.setdefault(_a, _t.name)
_ANCHOR = "|".join(re.escape(a) if len(a) == 1 and not a.isspace() else a for a in _OWNER)
_OWNERS = " ".join(f"when '{a}' then '{t}'" for a, t in _OWNER.items())
# windows of 64 bytes on both sides of each anchor, for the first type that has the anchor; those that meet are one
WINDOWS = f"""select doc_id, detector, min(lo)::int as start, max(hi)::int as "end" from (
    select *, sum(fresh) over (partition by doc_id, detector order by lo, hi) as island from (
      select *, case when lo <= lag(hi) over (partition by doc_id, detector order by lo, hi) then 0 else 1 end as fresh from (
        select doc_id, case original {_OWNERS} end as detector, greatest(0, start - 64) as lo, least(size, "end" + 64) as hi
        from ({spans_sql(DOCS, _ANCHOR, "true")}) join (select doc_id, strlen(text) as size from documents) using (doc_id))))
  group by doc_id, detector, island"""


@query(f"select detector, count(*) as n_windows, sum(\"end\" - start)::bigint as n_bytes, count(distinct doc_id) as n_docs from ({WINDOWS}) group by detector")
def q_anchor_scan(spark, d):
    windows = each(docs(spark, d), arrow.anchor_windows(F.col("text")), "doc_id").select("doc_id", "x.*")
    return windows.groupBy("detector").agg(F.count("*").alias("n_windows"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"), F.countDistinct("doc_id").alias("n_docs"))


@query(WINDOWS)
def q_anchor_windows(spark, d):
    return each(docs(spark, d), arrow.anchor_windows(F.col("text")), "doc_id").select("doc_id", "x.*")


def ranked_sql(pii_type: str, spans: str) -> str:
    t = TYPES[pii_type]
    return f"select doc_id, '{t.name}' as pii_type, '{t.confidence}' as confidence, {t.priority} as p, {CONFIDENCE_RANK[t.confidence]} as c, {-ORDER[t.name]} as o, start::int as start, (start + strlen(original))::int as \"end\", original from ({spans})"


#: All types that documents have; a span gives way to one that overlaps it with a higher rank.
COMPOSITE = f"""with c as ({" union all ".join((
    ranked_sql("email", spans_sql(DOCS, EMAIL, V_EMAIL)), ranked_sql("ip_address_v4", spans_sql(DOCS, IPV4, V_IPV4)), ranked_sql("credit_card", spans_sql(DOCS, CARD, STRICT_CARD)),
    ranked_sql("phone_number", phones_sql(V_PHONE, f"start::int + strlen(hit) - strlen(regexp_replace(hit, '^\\s+', '')) as start, {T_HIT} as original"))))})
  select doc_id, (row_number() over (partition by doc_id order by start) - 1)::int as position, pii_type, confidence, start, "end", original from c a
  where not exists (select 1 from c b where a.doc_id = b.doc_id and b.start < a."end" and b."end" > a.start and row(b.p, b.c, strlen(b.original), b.o) > row(a.p, a.c, strlen(a.original), a.o))"""


@query(COMPOSITE)
def q_anchored_detect(spark, d):
    return detection.exploded(detection.with_detections(docs(spark, d)), "doc_id")


@query(COMPOSITE)
def q_full_detect(spark, d):
    return detection.exploded(detection.with_detections(docs(spark, d), anchored=False), "doc_id")


NUMBER_TYPE = "case when regexp_matches(n, '^(000|666|9)') or substr(n, 5, 2) = '00' or right(n, 4) = '0000' then 'PHONE' else 'SSN' end"
OVERLAP_PARTS = f"select id, text, n, {NUMBER_TYPE} as kind from (select id, text, regexp_extract(text, '[0-9-]+') as n from ({carried('overlap')}))"


@query(f"select id, concat('Ref [REDACTED_', kind, '] and [REDACTED_EMAIL]') as redacted from ({OVERLAP_PARTS})")
def q_redact_composite(spark, d):
    """Detection of all types around anchors, overlaps resolved, redacted."""
    return carrier(spark, d, "overlap").select("id", arrow.redact(F.col("text"), Policy().with_mode("replace")).alias("redacted"))


@query(f"select id, concat('Ref [[', kind, '_1]] and [[EMAIL_0]]') as redacted from ({OVERLAP_PARTS})")
def q_typed_tokens(spark, d):
    return carrier(spark, d, "overlap").select("id", arrow.typed_tokens(F.col("text")).alias("redacted"))


@query(f"select id, concat('Ref [HASH] and [HASH]') as shape, 2::bigint as n_hashes from ({OVERLAP_PARTS})")
def q_redact_hash_places(spark, d):
    """Where hashes stand; their values are held against published vectors by a test."""
    hashed = carrier(spark, d, "overlap").select("id", arrow.redact(F.col("text"), Policy().with_mode("hash")).alias("r"))
    return hashed.select("id", F.regexp_replace("r", r"\[HASH:[0-9a-f]{16}\]", "[HASH]").alias("shape"), F.size(F.array_distinct(F.regexp_extract_all("r", F.lit("HASH:([0-9a-f]{16})"), F.lit(1)))).cast("long").alias("n_hashes"))


@query(f"select id, concat('Ref [REDACTED_', kind, '] and [REDACTED_EMAIL]') as redacted from ({OVERLAP_PARTS})")
def q_stream_joined(spark, d):
    """The carrier in chunks of seven characters: values that chunks cut are found, and the chunks that come out join to the redacted text."""
    cut = carrier(spark, d, "overlap").select("id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "chunk"), F.ceil(F.length("text") / 7).alias("n"))
    rows = cut.select(F.col("id").cast("string").alias("stream_id"), "seq", "chunk", (F.col("seq") == F.col("n") - 1).alias("is_end"), F.lit(None).cast("string").alias("error"))
    out = streams.redact_chunks(rows, Policy().with_mode("replace"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")
    return out.groupBy(F.col("stream_id").cast("long").alias("id")).agg(joined.alias("redacted"))


# --- policy and redaction ----------------------------------------------------------------------------------------

SSN_OFF = f"select id, 'email' as pii_type, count(*) as n from (select id from ({carried('overlap')})) group by id"


@query(SSN_OFF)
def q_policy_type_filter(spark, d):
    policy = Policy().disable("ssn", "phone_number")
    c = carrier(spark, d, "overlap").withColumn("d", native.keep(policy, F.col("text"), native.detect_all(F.col("text"), ("email", "phone_number", "ssn"))))
    return each(c, F.col("d"), "id").groupBy("id", F.col("x.pii_type").alias("pii_type")).agg(F.count("*").alias("n"))


def profile(spark, d, policy):
    c = carrier(spark, d, "ssn")
    return c.select("id", native.redact(policy, F.col("text"), native.detect(F.col("text"), "ssn", policy.strict)).alias("redacted"))


SSN_MASKED = f"case when {V_SSN.replace('hit', 'n')} then replace(text, n, regexp_replace(n, '[0-9]', '█', 'g')) else text end"


def profile_sql(expr: str) -> str:
    return f"select id, {expr} as redacted from (select id, text, regexp_extract(text, '[0-9-]+') as n from ({carried('ssn')}))"


@query(profile_sql("text"))
def q_profile_gdpr(spark, d):
    return profile(spark, d, Policy.gdpr())


@query(profile_sql(SSN_MASKED))
def q_profile_hipaa(spark, d):
    return profile(spark, d, Policy.hipaa())


@query(profile_sql(SSN_MASKED))
def q_profile_pci_dss(spark, d):
    return profile(spark, d, Policy.pci_dss())


def simple_redact(spark, d, policy, types=("email", "ip_address_v4")):
    return docs(spark, d).select("doc_id", native.redact(policy, F.col("text"), native.detect_all(F.col("text"), types)).alias("redacted"))


def replaced_sql(inner: str = "text") -> str:
    return f"regexp_replace({inner}, '{EMAIL}', '[REDACTED_EMAIL]', 'g')"


EMAILS_REPLACED = f"select doc_id, {replaced_sql()} as redacted from documents"


@query(EMAILS_REPLACED)
def q_redact_replace(spark, d):
    return simple_redact(spark, d, Policy().with_mode("replace"), ("email",))


@query(EMAILS_REPLACED.replace("[REDACTED_EMAIL]", "[MAIL]"))
def q_placeholder_override(spark, d):
    return simple_redact(spark, d, Policy().with_placeholder("email", "[MAIL]"), ("email",))


@query(f"select doc_id, string_agg(concat(gap, case when hit is null then '' else concat('[[PII_', i - 1, ']]') end), '' order by i) as redacted from (select doc_id, unnest(range(1, len(g) + 1)) as i, unnest(g) as gap, unnest(list_append(h, null)) as hit from (select doc_id, string_split_regex(text, '{EMAIL}') as g, regexp_extract_all(text, '{EMAIL}') as h from documents)) group by doc_id")
def q_redact_tokenize(spark, d):
    return simple_redact(spark, d, Policy().with_mode("tokenize"), ("email",))


@query(f"select doc_id, string_agg(concat(gap, case when original is null then '' else {EMAIL_MASK} end), '' order by i) as redacted from (select doc_id, unnest(range(1, len(g) + 1)) as i, unnest(g) as gap, unnest(list_append(h, null)) as original from (select doc_id, string_split_regex(text, '{EMAIL}') as g, regexp_extract_all(text, '{EMAIL}') as h from documents)) group by doc_id")
def q_redact_mask(spark, d):
    return simple_redact(spark, d, Policy(), ("email",))


LAST_FOUR = "regexp_extract(original, '(?:[0-9][ -]*){4}$')"
MASKED = f"""case pii_type when 'email' then {EMAIL_MASK} when 'ip_address_v4' then repeat('█', strlen(original)) when 'phone_number' then regexp_replace(original, '[0-9]', '█', 'g')
  else concat(regexp_replace(left(original, length(original) - length({LAST_FOUR})), '[0-9]', '█', 'g'), {LAST_FOUR}) end"""


@query(f"""with s as (select *, {MASKED} as masked, coalesce(lag("end") over (partition by doc_id order by start), 0) as before from ({COMPOSITE})),
  r as (select doc_id, string_agg(concat(decode(array_slice(encode(text), before + 1, start)), masked), '' order by start) as head, max("end") as last from s join documents using (doc_id) group by doc_id)
  select doc_id, case when head is null then text else concat(head, decode(array_slice(encode(text), last + 1, strlen(text)))) end as redacted from documents left join r using (doc_id)""")
def q_redact_all_types(spark, d):
    """All types; words around a match are asked for where they tell what it is, no blank or sign near a number."""
    return docs(spark, d).select("doc_id", arrow.redact(F.col("text"), anchored=kernel.WORDS).alias("redacted"))


@query()
def q_redact_hash(spark, d):
    dets = kernel.built_in(["email", "ip_address_v4"])
    return docs(spark, d).select("doc_id", arrow.redact(F.col("text"), Policy().with_mode("hash"), dets).alias("redacted"))


@query(f"""with o as (select *, case pii_type when 'email' then 'EMAIL' when 'phone_number' then 'PHONE' when 'credit_card' then 'CC' else 'PII' end as stem from ({COMPOSITE})),
  n as (select doc_id, original, any_value(stem) as stem, row_number() over (partition by doc_id order by max(start) desc) - 1 as k from o group by doc_id, original),
  s as (select o.doc_id, start, "end", concat('[[', n.stem, '_', k, ']]') as token, coalesce(lag("end") over (partition by o.doc_id order by start), 0) as before from o join n on n.doc_id = o.doc_id and n.original = o.original),
  r as (select doc_id, string_agg(concat(decode(array_slice(encode(text), before + 1, start)), token), '' order by start) as head, max("end") as last from s join documents using (doc_id) group by doc_id)
  select doc_id, case when head is null then text else concat(head, decode(array_slice(encode(text), last + 1, strlen(text)))) end as redacted from documents left join r using (doc_id)""")
def q_token_redactor(spark, d):
    return docs(spark, d).select("doc_id", arrow.typed_tokens(F.col("text")).alias("redacted"))


WORD = "(^|[^A-Za-z0-9])Licensed([^A-Za-z0-9]|$)"


@query(f"select doc_id, regexp_replace(text, '{WORD}', '\\1████████\\2', 'g') as redacted from documents")
def q_blocklist(spark, d):
    return docs(spark, d).select("doc_id", native.redact(Policy().with_blocklist(["Licensed"]), F.col("text"), native.detect(F.lit(""), "email")).alias("redacted"))


@query(f"select id, text as redacted from ({carried('overlap')})")
def q_allowlist(spark, d):
    policy = Policy().with_allowlist(["mail.example.com"])
    c = carrier(spark, d, "overlap")
    return c.select("id", native.redact(policy, F.col("text"), native.detect(F.col("text"), "email")).alias("redacted"))


@query(f"select id, regexp_replace(text, 'Ref', '███') as redacted from ({carried('overlap')})")
def q_block_allow(spark, d):
    policy = Policy().with_blocklist(["Ref", "and"]).with_allowlist(["and"]).disable("email")
    c = carrier(spark, d, "overlap")
    return c.select("id", native.redact(policy, F.col("text"), native.detect(F.col("text"), "email")).alias("redacted"))


# --- JSON --------------------------------------------------------------------------------------------------------

@query("select event_id, props ->> '$.k' as k, cast(null as varchar) as error from events")
def q_json_redact(spark, d):
    e = table(spark, d, "events").select("event_id", arrow.redact_json(F.col("props")).alias("r"))
    return e.select("event_id", F.get_json_object("r.json", "$.k").alias("k"), F.col("r.error").alias("error"))


NESTED = f"concat('{{\"user\":{{\"note\":\"', replace(text, '.', '.'), '\",\"age\":', cast(id % 90 as varchar(20)), '}}}}')"


@query(f"select id, case when {V_SSN.replace('hit', "regexp_extract(text, '[0-9-]+')")} then regexp_replace(text, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}', '###') else text end as note, cast(id % 90 as varchar) as age from ({carried('ssn')})")
def q_json_redact_nested(spark, d):
    c = carrier(spark, d, "ssn")
    j = c.select("id", arrow.redact_json(F.expr(NESTED), Policy().with_placeholder("ssn", "###"), kernel.built_in(["ssn"])).alias("r"))
    return j.select("id", F.get_json_object("r.json", "$.user.note").alias("note"), F.get_json_object("r.json", "$.user.age").alias("age"))


@query("select c_custkey as id, concat('{\"model\":\"m', c_custkey, '\"}') as json from customer")
def q_strip_internal(spark, d):
    doc = F.concat(F.lit('{"provider":"openai","_internal_session":"s","model":"m'), F.col("c_custkey").cast("string"), F.lit('"}'))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), arrow.strip_internal_fields(doc).alias("json"))


# --- chat --------------------------------------------------------------------------------------------------------

def requests(spark, d, text=None) -> DataFrame:
    """A request for each conversation, its turns as messages; null parameters where a conversation's number says so."""
    text = F.col("text") if text is None else text
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", text.alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    r = table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("messages"))
    even = F.col("conv_id") % 2 == 0
    return r.select("conv_id", "messages", F.lit("m").alias("model"), F.when(even, 100).alias("max_tokens"), F.when(even, 0.5).alias("temperature"), F.lit(None).cast("double").alias("top_p"), F.lit(None).cast("boolean").alias("stream"))


FLAGGED = "with t as (select conv_id, turn, role, text, turn % 3 = 1 as hit, count(*) filter (where turn % 3 = 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as k, row_number() over (partition by conv_id order by turn) - 1 as place from conversations)"


def flagged(spark, d) -> DataFrame:
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    r = r.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"), F.transform("t", lambda t: t["turn"] % 3 == 1).alias("flags"))
    return chat.apply_flags(r, "messages", "flags")


MAILED = "case when turn % 3 = 1 then concat(text, ' u', conv_id, '@mail.example.com') else text end"


def mailed(spark, d) -> DataFrame:
    """requests() in which every third message has an address."""
    text = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" u"), F.col("conv_id").cast("string"), F.lit("@mail.example.com"))).otherwise(F.col("text"))
    return requests(spark, d, text)


@query(f"with m as (select conv_id, turn, role, {MAILED} as text from conversations), t as (select *, regexp_matches(text, '{EMAIL}') as hit from m) select conv_id, (row_number() over w - 1)::int as place, role, case when hit then concat('[[PII_', count(*) filter (where hit) over w - 1, ']]') else text end as content from t window w as (partition by conv_id order by turn)")
def q_chat_tokenize(spark, d):
    sent = chat.tokenise(mailed(spark, d), detectors=kernel.built_in(["email"]))
    return sent.select("conv_id", F.posexplode_outer("messages").alias("place", "m")).select("conv_id", "place", "m.role", "m.content")


@query(f"{FLAGGED} select conv_id, place::int as place, text as content from t")
def q_chat_reconstruct(spark, d):
    r = flagged(spark, d).select("conv_id", "tokens", F.posexplode("messages").alias("place", "m"))
    return r.select("conv_id", "place", chat.reconstruct(F.col("m.content"), F.col("tokens")).alias("content"))


@query("select conv_id, max_by(text, turn) as content, 200 as status from conversations group by conv_id")
def q_chat_complete(spark, d):
    r = chat.complete(requests(spark, d), chat.echo)
    return r.select("conv_id", F.get("reply.choices", 0)["message"]["content"].alias("content"), "status")


@query(f"{FLAGGED}, n as (select conv_id, string_agg(concat('[[PII_', coalesce(k, 0), ']] = redacted value (', case when length(text) = 0 then '' when length(text) = 1 then '*' when length(text) = 2 then concat(left(text, 1), '*') when length(text) = 3 then concat(left(text, 1), '*', right(text, 1)) else concat(left(text, 1), '***', right(text, 1)) end, ')'), chr(10) order by turn) as listed from t where hit group by conv_id) select c.conv_id, case when listed is null then null else concat('{chat.NOTE_HEAD}', listed, '{chat.NOTE_TAIL}') end as note from (select distinct conv_id from conversations) c left join n using (conv_id)")
def q_system_note(spark, d):
    return flagged(spark, d).select("conv_id", chat.system_note(F.col("tokens")).alias("note"))


def flow(spark, d) -> DataFrame:
    """Requests to configured and other providers, of whose replies some fail and some can't be read; the others repeat the last message."""
    k = F.col("conv_id")
    rows = mailed(spark, d).withColumn("provider", F.when(k % 4 == 1, "OpenAI").when(k % 4 == 2, "Anthropic").when(k % 4 == 3, "nowhere"))

    def respond(provider, body):
        last = F.try_element_at(F.from_json(body, "messages array<struct<role string, content string>>")["messages"], F.lit(-1))["content"]
        said = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), last.alias("text"))).alias("content"), F.lit("end_turn").alias("stop_reason")))
        return F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "no { json").when(provider == "anthropic", said).otherwise(chat.echo(body))

    return chat.exchange(rows, respond, ["openai", "anthropic"], detectors=kernel.built_in(["email"]))


FLOW = f"""select conv_id, case conv_id % 4 when 2 then 'anthropic' when 3 then 'nowhere' else 'openai' end as provider, max_by({MAILED}, turn) as said,
  case when conv_id % 4 = 3 then 404 when conv_id % 5 < 2 then 502 else 200 end as status,
  case when conv_id % 4 = 3 then null when conv_id % 5 = 0 then 'request_error' when conv_id % 5 = 1 then 'parse_error' end as error_kind
  from conversations group by conv_id"""


@query(f"select conv_id, provider, status, case when status = 200 then said end as content, case when status = 404 then 'Unknown provider: nowhere' when error_kind = 'request_error' then 'Provider request failed' when error_kind = 'parse_error' then 'Failed to parse provider response' end as error from ({FLOW})")
def q_chat_flow(spark, d):
    return flow(spark, d).select("conv_id", "provider", "status", F.get("reply.choices", 0)["message"]["content"].alias("content"), "error")


@query(f"select 'requests' as metric, provider, null as error, count(*) as n from ({FLOW}) where status <> 404 group by 2 union all select 'errors', provider, error_kind, count(*) from ({FLOW}) where error_kind is not null group by 2, 3")
def q_provider_counters(spark, d):
    return audit.provider_counters(flow(spark, d))


@query("select s_suppkey as id, case when n = 0 then '' when n = 1 then '*' when n = 2 then concat(left(s, 1), '*') when n = 3 then concat(left(s, 1), '*', right(s, 1)) else concat(left(s, 1), '***', right(s, 1)) end as masked from (select s_suppkey, left(s_name, (s_suppkey % 6)::int) as s, length(left(s_name, (s_suppkey % 6)::int)) as n from supplier)")
def q_mask_original(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), native.mask_original(F.left("s_name", (F.col("s_suppkey") % 6).cast("int"))).alias("masked"))


MESSAGES_SQL = "select conv_id, count(*) filter (where role <> 'system') as n_said, max_by(text, turn) filter (where role = 'system') as last_system, min_by(text, turn) filter (where role = 'system') as first_system, string_agg(concat(role, ': ', text), concat(chr(10), chr(10)) order by turn) as joined, count(*) as n from conversations group by conv_id"


def fields(spark, d, provider: str, **paths: str) -> DataFrame:
    r = chat.translate_request(provider, requests(spark, d))
    return r.select("conv_id", *[F.get_json_object("body", p).alias(k) for k, p in paths.items()])


@query(f"select conv_id, case when conv_id % 2 = 0 then '100' else '4096' end as max_tokens, last_system as system, cast(n_said as int) as n_messages from ({MESSAGES_SQL})")
def q_provider_anthropic(spark, d):
    r = chat.translate_request("anthropic", requests(spark, d))
    return r.select("conv_id", F.get_json_object("body", "$.max_tokens").alias("max_tokens"), F.get_json_object("body", "$.system").alias("system"), F.size(F.from_json("body", "messages array<struct<role string>>")["messages"]).alias("n_messages"))


@query(f"select conv_id, case when conv_id % 2 = 0 then '100' end as max_tokens, first_system as system, cast(n_said as int) as n_contents from ({MESSAGES_SQL})")
def q_provider_gemini(spark, d):
    r = chat.translate_request("gemini", requests(spark, d))
    return r.select("conv_id", F.get_json_object("body", "$.generationConfig.maxOutputTokens").alias("max_tokens"), F.get_json_object("body", "$.systemInstruction.parts[0].text").alias("system"), F.size(F.from_json("body", "contents array<struct<role string>>")["contents"]).alias("n_contents"))


@query(f"select conv_id, joined as message, case when conv_id % 2 = 0 then '100' end as max_tokens from ({MESSAGES_SQL})")
def q_provider_cohere(spark, d):
    return fields(spark, d, "cohere", message="$.message", max_tokens="$.max_tokens")


@query(f"select conv_id, last_system as system, case when conv_id % 2 = 0 then '100' else '4096' end as max_tokens, case when n_said > 0 then 'text' end as kind from ({MESSAGES_SQL})")
def q_provider_bedrock(spark, d):
    return fields(spark, d, "bedrock", system="$.system", max_tokens="$.max_tokens", kind="$.messages[0].content[0].type")


@query(f"select conv_id, case when conv_id % 2 = 0 then '100' else '4096' end as max_tokens, 'm' as model from ({MESSAGES_SQL})")
def q_provider_mistral(spark, d):
    return fields(spark, d, "mistral", max_tokens="$.max_tokens", model="$.model")


REPLIES = {
    "anthropic": '{"content":[{"type":"text","text":"a"},{"type":"tool"},{"type":"text","text":"b"}],"stop_reason":"max_tokens"}',
    "gemini": '{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]},"finishReason":"STOP"}],"usageMetadata":{"promptTokenCount":10,"candidatesTokenCount":8,"totalTokenCount":18}}',
    "cohere": '{"message":{"content":{"text":"ab"}},"stop_reason":"END_TURN"}',
    "bedrock": '{"content":[{"type":"text","text":"ab"}],"stop_reason":"end_turn"}',
    "openai": '{"choices":[{"message":{"role":"assistant","content":"ab"},"finish_reason":"stop"}]}',
}


@query("select * from (values ('anthropic', 'ab', 'length', null::int), ('gemini', 'ab', 'stop', 18), ('cohere', 'ab', 'stop', null), ('bedrock', 'ab', 'stop', null), ('openai', 'ab', 'stop', null)) t(provider, content, finish, total)")
def q_provider_responses(spark, d):
    rows = None
    for name, reply in REPLIES.items():
        r = spark.range(1).select(F.lit(name).alias("provider"), chat.translate_response(name, F.lit(reply)).alias("r"))
        r = r.select("provider", F.get("r.choices", 0)["message"]["content"].alias("content"), F.get("r.choices", 0)["finish_reason"].alias("finish"), F.col("r.usage.total_tokens").alias("total"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query("select * from (values ('gpt-4', 'model', 'openai', 'openai'), ('claude-3-sonnet-20240229', 'model', 'anthropic', 'anthropic'), ('default', 'model', 'mine', 'mine')) t(id, object, owned_by, provider)")
def q_models(spark, d):
    return chat.models(spark, ["openai", "anthropic", "mine"])


@query("select c_custkey as id, case c_custkey % 3 when 0 then 'openai' when 1 then 'cohere' else 'nowhere' end as provider, case when c_custkey % 3 = 2 then 404 end as status from customer")
def q_provider_routing(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 1, "Cohere").when(F.col("c_custkey") % 3 == 2, "nowhere")
    return chat.route(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), name.alias("provider")), ["openai", "cohere"]).select("id", "provider", "status")


# --- audit, metrics, guards --------------------------------------------------------------------------------------

@query(out(spans_sql(DOCS, EMAIL, V_EMAIL), f"doc_id, 'pii_detected' as event, 'email' as pii_type, 'medium' as confidence, start::int as start, \"end\"::int as \"end\", strlen(original)::int as original_len, {EMAIL_MASK} as redacted_form"))
def q_audit_detection(spark, d):
    rows = docs(spark, d).withColumn("detections", native.detect(F.col("text"), "email"))
    return audit.detection_events(rows, "doc_id")


@query(f"select doc_id, 'request_processed' as event, n > 0 as had_pii, n::int as detection_count, n > 0 as redacted from (select doc_id, len(list_filter(regexp_extract_all(text, '{EMAIL}'), lambda hit: {V_EMAIL})) as n from documents where length(text) > 0)")
def q_audit_request(spark, d):
    return audit.request_events(detection.redacted(docs(spark, d), detectors=kernel.built_in(["email"])), "doc_id")


COUNTED = f"(select lang, 'email' as pii_type from documents join ({spans_sql(DOCS, EMAIL, V_EMAIL)}) using (doc_id) union all select lang, 'ip_address_v4' from documents join ({spans_sql(DOCS, IPV4, V_IPV4)}) using (doc_id))"


def counted(spark, d) -> DataFrame:
    return docs(spark, d).withColumn("detections", native.detect_all(F.col("text"), ("email", "ip_address_v4")))


@query(f"select pii_type, count(*) as n from {COUNTED} group by 1")
def q_metrics_by_type(spark, d):
    return detection.exploded(counted(spark, d), "lang").groupBy("pii_type").agg(F.count("*").alias("n"))


@query(f"select lang, count(*) as n from {COUNTED} group by 1")
def q_metrics_by_lang(spark, d):
    return detection.exploded(counted(spark, d), "lang").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"select lang, pii_type, count(*) as n from {COUNTED} group by rollup (lang, pii_type)")
def q_metrics_rollup(spark, d):
    return audit.pii_counters(counted(spark, d), "lang")


def calls(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit("POST").alias("method"), F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.when(F.col("event_id") % 10 == 0, 502).otherwise(200).alias("status"), F.col("value").alias("duration"))


@query("select endpoint, status, count(*) as n from (select concat('POST /', event_type) as endpoint, case when event_id % 10 = 0 then '502' else '200' end as status from events) group by grouping sets ((endpoint, status), (endpoint), (status), ())")
def q_request_counters(spark, d):
    return audit.request_counters(calls(spark, d))


@query("select le, n from (select unnest(['0.5', '1.0', '10.0', '+Inf']) as le, unnest([count(*) filter (where value <= 0.5), count(*) filter (where value <= 1.0), count(*) filter (where value <= 10.0), count(value)]) as n from events)")
def q_duration_histogram(spark, d):
    return audit.duration_histogram(calls(spark, d), bounds=(0.5, 1.0, 10.0))


@query("select c_custkey as id, c_custkey % 4 = 0 or c_custkey % 3 = 0 as authorised from customer")
def q_auth_filter(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 0, "Bearer key1").when(k % 4 == 1, "key1").otherwise("Bearer nope").alias("authorization"), F.when(k % 3 == 0, "/health").otherwise("/v1").alias("path"))
    return guard.authorised(rows, spark.createDataFrame([("key1",), ("key2",)], "key string")).select("id", "authorised")


@query("select doc_id, strlen(text) <= 2000 as fits from documents")
def q_size_limit(spark, d):
    return docs(spark, d).select("doc_id", guard.within_size(F.col("text"), 2000).alias("fits"))


@query("select c_custkey as id, case c_custkey % 3 when 0 then '10.0.0.1' when 1 then '10.0.0.2' else '0.0.0.0' end as ip from customer")
def q_client_ip(spark, d):
    k = F.col("c_custkey")
    fwd = F.when(k % 3 == 0, "10.0.0.1:80, 10.9.9.9:1").when(k % 3 == 1, "bad")
    real = F.when(k % 3 == 1, "10.0.0.2:443")
    return table(spark, d, "customer").select(k.alias("id"), guard.client_ip(fwd, real, F.lit(None).cast("string")).alias("ip"))


@query("""
with recursive e as (select user_id, event_id, epoch_us(ts) as tick, row_number() over (partition by user_id order by ts, event_id) as i from events),
b(user_id, i, tick, tokens, allowed) as (
  select user_id, i, tick, 1.0::double, true from e where i = 1
  union all
  select e.user_id, e.i, e.tick, least(2.0, b.tokens + (e.tick - b.tick) / 1e6 * 0.00001) - case when least(2.0, b.tokens + (e.tick - b.tick) / 1e6 * 0.00001) >= 1 then 1 else 0 end, least(2.0, b.tokens + (e.tick - b.tick) / 1e6 * 0.00001) >= 1
  from b join e on e.user_id = b.user_id and e.i = b.i + 1)
select user_id, count(*) filter (where allowed) as allowed, count(*) as n from b group by 1""")
def q_rate_limit(spark, d):
    e = guard.rate_limited(table(spark, d, "events").select("user_id", "ts", "event_id"), 0.00001, 2.0, key="user_id", order="event_id")
    return e.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n"))


# --- streams -----------------------------------------------------------------------------------------------------

@query()
def q_stream_redact(spark, d):
    """Documents in chunks of 64 characters, redacted as streams."""
    n = F.greatest(F.ceil(F.length("text") / 64).cast("int"), F.lit(1))
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,64}"), F.lit(0))
    chunks = docs(spark, d).select(F.col("doc_id").cast("string").alias("stream_id"), n.alias("n"), F.posexplode_outer(cut).alias("seq", "chunk"))
    rows = chunks.select("stream_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("chunk", F.lit("")).alias("chunk"), (F.coalesce("seq", F.lit(0)) == F.col("n") - 1).alias("is_end"), F.lit(None).cast("string").alias("error"))
    return streams.redact_chunks(rows)


@query("select conv_id, turn, replace(replace(text, 'the', 'THE'), 'a ', 'A ') as chunk from conversations")
def q_stream_reconstruct(spark, d):
    tokens = F.create_map(F.lit("the"), F.lit("THE"), F.lit("a "), F.lit("A "))
    return streams.reconstruct_chunks(table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("chunk"), tokens.alias("tokens"))).drop("tokens")

"""Detection, validation, masking and splicing as Catalyst expressions: no Python in the plan.

Java patterns carry (?U), so \\d, \\w, \\s and \\b follow Unicode. All places are UTF-8 byte offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import phoneplan
from cloakframe.kernel import BLOCK, PATTERNS
from cloakframe.policy import Policy
from cloakframe.types import CONFIDENCE_RANK, DETECTION, ORDER, TYPES, info

#: Types that Catalyst expressions find; the address pattern and the IPv6 parser need the Arrow functions.
NATIVE = ("email", "phone_number", "ssn", "credit_card", "ip_address_v4", "iban", "passport_number", "national_id")
_GUARD = {"email": r"@", "ssn": r"\d", "credit_card": r"\d", "ip_address_v4": r"\.\d", "iban": r"[A-Z]{2}\d", "passport_number": r"\d", "national_id": r"\d", "phone_number": r"\d"}


def lit(x) -> Column:
    return F.lit(x)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once: an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), fn), 0)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, original, before, after>> of the matches of a pattern that never matches nothing.

    Gaps (split) and matches alternate, so a running sum of their byte lengths gives every place.
    """
    both = F.struct(F.regexp_extract_all(text, lit(pattern), lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return let(both, _places)


def _places(both: Column) -> Column:
    hits, gaps = both["hits"], both["gaps"]
    parts = F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit"), F.get(gaps, i + 1).alias("next"), F.coalesce(F.get(hits, i + 1), lit("")).alias("follows")))
    zero = F.struct(lit(0).alias("pos"), lit("").alias("last"), F.array().cast("array<struct<start:int,end:int,original:string,before:string,after:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.octet_length(p["gap"])
        end = start + F.octet_length(p["hit"])
        before = F.when(p["gap"] != "", F.right(p["gap"], lit(1))).otherwise(acc["last"])
        after = F.when(p["next"] != "", F.left(p["next"], lit(1))).otherwise(F.left(p["follows"], lit(1)))
        one = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("original"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("pos"), F.right(p["hit"], lit(1)).alias("last"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def closed(m: Column, kind: str = "[A-Za-z0-9]") -> Column:
    return ~m["before"].rlike(kind) & ~m["after"].rlike(kind)


def luhn(d: Column) -> Column:
    return F.coalesce(d.rlike("^[0-9]{2,}$") & F.call_function("luhn_check", d), lit(False))


def card_network(d: Column) -> Column:
    """Network of a card number by issuer range and length, null if none."""
    n = F.length(d)

    def p(k: int) -> Column:
        return F.left(d, lit(k)).try_cast("int")

    return (
        F.when((F.left(d, lit(1)) == "4") & n.isin(13, 16), "visa")
        .when((n == 16) & (p(2).between(51, 55) | p(4).between(2221, 2720)), "mastercard")
        .when((p(4) == 6011) | (p(2) == 65) | p(3).between(644, 649) | (n == 16) & p(6).between(622126, 622925), "discover")
        .when((n == 15) & p(2).isin(34, 37), "amex")
        .when((n == 16) & p(4).between(3528, 3589), "jcb")
        .when((n == 14) & (p(3).between(300, 305) | (p(3) == 309) | p(2).isin(36, 38, 39)), "diners")
        .when(p(4).isin(5018, 5020, 5038, 5893, 6304, 6759, 6761, 6762, 6763), "maestro")
        .when(p(2).isin(62, 81) & n.between(16, 19), "unionpay")
    )


def iban_mod97(s: Column) -> Column:
    """Remainder by 97 of an account number, letters as 10 to 35, the first four characters last."""
    c = F.regexp_replace(s, r"[\s-]", "")
    turned = F.concat(F.substring(c, lit(5), F.length(c)), F.left(c, lit(4)))

    def add(acc: Column, ch: Column) -> Column:
        v = F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
        return ((acc * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("long")

    return F.aggregate(F.split(turned, ""), lit(0).cast("long"), lambda a, ch: F.when(ch == "", a).otherwise(add(a, ch)))


def ipv4_valid(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: p.rlike("^[0-9]{1,3}$") & (p.try_cast("int") <= 255) & ((p == "0") | ~p.startswith("0")))


def ssn_valid(s: Column) -> Column:
    d = F.replace(s, lit("-"), lit(""))
    area, group, serial = (F.substring(d, a, n).try_cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    return F.coalesce(d.rlike("^[0-9]{9}$") & ~area.isin(0, 666) & (area < 900) & (group > 0) & (serial > 0), lit(False))


def phone_valid(s: Column, countries: Iterable[str] = phoneplan.DEFAULT_COUNTRIES) -> Column:
    """By the plans: international with a plus sign, else a form that one of the countries dials."""
    d = digits(s)
    n = F.length(d)
    codes = sorted({p[0] for p in phoneplan.PLANS.values()})
    known = F.lit(False)
    for code, trunk, lo, hi in dict.fromkeys(phoneplan.PLANS.values()):
        known = known | (d.startswith(code) & (n - len(code)).between(lo, hi + len(trunk)))
    starts = F.lit(False)
    for c in codes:
        starts = starts | d.startswith(c)
    abroad = ~d.startswith("0") & F.when(starts, known).otherwise(n.between(8, 15))
    home = F.lit(False)
    for head, size in sorted({x for c in countries if c in phoneplan.PLANS for x in phoneplan.national_lengths(c)}):
        home = home | (n == size) & d.startswith(head)
    return n.between(7, 15) & ~d.isin(*phoneplan.NEVER) & F.when(s.startswith("+"), abroad).otherwise(home)


def _phones(text: Column, countries) -> Column:
    found = matches(text, "(?U)" + PATTERNS["phone_number"])
    trimmed = F.transform(
        found,
        lambda m: F.struct(
            (m["start"] + F.octet_length(m["original"]) - F.octet_length(F.regexp_replace(m["original"], r"(?U)^\s+", ""))).alias("start"),
            (m["end"] - F.octet_length(m["original"]) + F.octet_length(F.regexp_replace(m["original"], r"(?U)\s+$", ""))).alias("end"),
            F.regexp_replace(m["original"], r"(?U)^\s+|\s+$", "").alias("original"),
            F.when(m["original"].rlike(r"(?U)^\s"), lit(" ")).otherwise(m["before"]).alias("before"),
            F.when(m["original"].rlike(r"(?U)\s$"), lit(" ")).otherwise(m["after"]).alias("after"),
        ),
    )
    return F.filter(trimmed, lambda m: (m["original"] != "") & closed(m) & phone_valid(m["original"], countries))


def detect(text: Column, pii_type: str, strict: bool = True, countries: Iterable[str] = phoneplan.DEFAULT_COUNTRIES) -> Column:
    """Detections of one type over the whole text; null text gives none."""
    if pii_type not in NATIVE:
        raise ValueError(f"{pii_type} has no native form; use operators.detect")
    body = F.coalesce(text, lit(""))
    if pii_type == "phone_number":
        found = _phones(body, tuple(countries))
    else:
        found = matches(body, "(?U)" + PATTERNS[pii_type])
        keep = {
            "email": lambda m: ~F.contains(F.split_part(m["original"], lit("@"), lit(1)), lit("..")),
            "ssn": lambda m: ssn_valid(m["original"]) if strict else lit(True),
            "credit_card": lambda m: closed(m, "[0-9]") & F.length(digits(m["original"])).between(13, 19) & ((luhn(digits(m["original"])) & card_network(digits(m["original"])).isNotNull()) if strict else lit(True)),
            "ip_address_v4": lambda m: ipv4_valid(m["original"]) if strict else lit(True),
            "iban": lambda m: closed(m) & F.length(F.regexp_replace(m["original"], r"[\s-]", "")).between(15, 34) & m["original"].rlike(r"^[A-Z0-9 \-]+$") & (iban_mod97(m["original"]) == 1),
            "passport_number": lambda m: closed(m) & m["original"].rlike("^[A-Z0-9]+$"),
            "national_id": lambda m: closed(m) & m["original"].rlike(r"^[A-Z0-9\s]+$"),
        }[pii_type]
        found = F.filter(found, keep)
    full = F.transform(found, lambda m: F.struct(lit(pii_type).alias("pii_type"), lit(TYPES[pii_type].confidence).alias("confidence"), m["start"].alias("start"), m["end"].alias("end"), m["original"].alias("original")))
    none = F.array().cast(f"array<{DETECTION.simpleString()}>")
    return F.when(body.rlike("(?U)" + _GUARD[pii_type]), full).otherwise(none)


def _rank(d: Column) -> Column:
    """A number that grows with priority, then confidence, then length."""
    priority, level = lit(0), lit(0)
    for t in TYPES.values():
        priority = F.when(d["pii_type"] == t.name, t.priority).otherwise(priority)
    for name, r in CONFIDENCE_RANK.items():
        level = F.when(d["confidence"] == name, r).otherwise(level)
    return (priority * 10 + level).cast("long") * lit(1 << 32) + (d["end"] - d["start"]).cast("long")


def _order(d: Column) -> Column:
    place = lit(len(ORDER))
    for name, i in ORDER.items():
        place = F.when(d["pii_type"] == name, i).otherwise(place)
    return place


def resolve(detections: Column) -> Column:
    """One detection of any that overlap stays: the one with the higher rank, in a single pass by start."""
    keyed = F.transform(detections, lambda d: F.struct(d["start"].alias("s"), (-_rank(d)).alias("r"), _order(d).alias("o"), d.alias("d")))
    none = F.array().cast(f"array<struct<r:bigint,d:{DETECTION.simpleString()}>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(x["r"].alias("r"), x["d"].alias("d")))
        return F.when((F.size(acc) == 0) | (x["d"]["start"] >= last["d"]["end"]), F.concat(acc, one)).when(x["r"] < last["r"], F.concat(F.slice(acc, lit(1), F.size(acc) - 1), one)).otherwise(acc)

    return F.transform(F.aggregate(F.array_sort(keyed), none, lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["r"].alias("r"), x["d"].alias("d")))).otherwise(step(a, x))), lambda x: x["d"])


def detect_all(text: Column, types: Iterable[str] = NATIVE, strict: bool = True) -> Column:
    """Detections of several types over the whole text, overlaps resolved."""
    return resolve(F.concat(*[detect(text, t, strict) for t in types]))


def blocks(s: Column) -> Column:
    return F.repeat(lit(BLOCK), F.octet_length(s))


def _last_four(s: Column) -> Column:
    return F.when(F.length(digits(s)) < 4, blocks(s)).otherwise(F.regexp_replace(s, "[0-9](?=(?:[^0-9]*[0-9]){4})", BLOCK))


def mask(pii_type: Column, s: Column) -> Column:
    domain = F.substring_index(s, "@", -1)
    head = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    email = F.concat(F.regexp_replace(F.substring_index(s, "@", 1), "[^.]", BLOCK), lit("@"), blocks(head), lit("."), F.substring_index(domain, ".", -1))
    c = F.regexp_replace(s, r"[\s-]", "")
    middle = F.concat(F.left(c, lit(2)), F.repeat(lit(BLOCK), F.length(c) - 6), F.right(c, lit(4)))
    iban = F.when(F.length(c) < 8, blocks(s)).when(F.contains(s, lit(" ")), F.array_join(F.regexp_extract_all(middle, lit(".{1,4}"), lit(0)), " ")).otherwise(middle)
    first = F.regexp_extract(s, "^[^0-9]*", 0)
    passport = F.concat(first, F.repeat(lit(BLOCK), F.length(s) - F.length(first)))
    return (
        F.when(pii_type == "email", email)
        .when(pii_type.isin("phone_number", "ssn"), F.regexp_replace(s, "[0-9]", BLOCK))
        .when(pii_type.isin("credit_card", "national_id"), _last_four(s))
        .when(pii_type == "iban", iban)
        .when(pii_type == "passport_number", passport)
        .otherwise(blocks(s))
    )


def placeholder(pii_type: Column, policy: Policy | None = None) -> Column:
    out = lit(info("other:").placeholder)
    for t in TYPES:
        out = F.when(pii_type == t, policy.placeholder_for(t) if policy else info(t).placeholder).otherwise(out)
    return out


def form(policy: Policy, d: Column, number: Column) -> Column:
    """What stands for a detection; hashing needs the Arrow functions."""
    if policy.mode == "tokenize":
        return F.concat(lit("[[PII_"), number.cast("string"), lit("]]"))
    if policy.mode == "hash":
        raise ValueError("hash mode has no native form; use operators.redact")
    out = placeholder(d["pii_type"]) if policy.mode == "replace" else mask(d["pii_type"], d["original"])
    for t, text in policy.placeholders.items():
        out = F.when(d["pii_type"] == t, text).otherwise(out)
    return out


def splice(text: Column, spans: Column) -> Column:
    """text with each span (start, end, form) replaced, in their order; a span that begins before the last one's end repeats text."""
    raw = text.cast("binary")
    zero = F.struct(lit("").alias("out"), lit(0).alias("at"))
    done = F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(F.concat(a["out"], F.when(s["start"] > a["at"], F.substring(raw, a["at"] + 1, s["start"] - a["at"]).cast("string")).otherwise(""), s["form"]).alias("out"), s["end"].alias("at")),
    )
    return F.concat(done["out"], F.substring(raw, done["at"] + 1, F.octet_length(text)).cast("string"))


def quoted(term: str) -> str:
    return "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in term)


def term_spans(text: Column, terms: Iterable[str]) -> Column:
    """Whole-word occurrences of the terms, term by term."""
    found = [F.filter(matches(text, quoted(t)), lambda m: closed(m)) for t in terms if t]
    return F.concat(*found) if found else matches(lit(""), "x")


def overlaps(d: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (d["start"] < s["end"]) & (d["end"] > s["start"]))


def keep(policy: Policy, text: Column, detections: Column) -> Column:
    """Detections of enabled types that touch no allowed term."""
    on = F.filter(detections, lambda d: d["pii_type"].isin(*sorted(policy.enabled)) if policy.enabled else lit(False))
    return let(term_spans(text, policy.allowlist), lambda spans: F.filter(on, lambda d: ~overlaps(d, spans))) if policy.allowlist else on


def redact(policy: Policy, text: Column, detections: Column) -> Column:
    """text redacted, given its detections. Null stays null."""
    kept = keep(policy, text, detections)
    spans = F.transform(kept, lambda d, i: F.struct(d["start"].alias("start"), lit(0).alias("k"), i.alias("i"), d["end"].alias("end"), form(policy, d, i).alias("form")))
    if policy.blocklist:
        terms = term_spans(text, policy.blocklist)
        if policy.allowlist:
            terms = let(F.struct(terms.alias("t"), term_spans(text, policy.allowlist).alias("a")), lambda x: F.filter(x["t"], lambda s: ~overlaps(s, x["a"])))
        spans = F.array_sort(F.concat(spans, F.transform(terms, lambda s, i: F.struct(s["start"].alias("start"), lit(1).alias("k"), i.alias("i"), s["end"].alias("end"), blocks(s["original"]).alias("form")))))
    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(splice(text, s)))


def mask_original(s: Column) -> Column:
    n = F.length(s)
    return F.when(n == 0, "").when(n == 1, "*").when(n == 2, F.concat(F.left(s, lit(1)), lit("*"))).when(n == 3, F.concat(F.left(s, lit(1)), lit("*"), F.right(s, lit(1)))).otherwise(F.concat(F.left(s, lit(1)), lit("***"), F.right(s, lit(1))))

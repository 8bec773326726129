"""Personal data: exact base patterns, then bootstrapped contextual extraction.

Base entities (e-mail, IPv4, card, phone) are the seeds, and so are long hexadecimal values
that something is set to, which are no spans by themselves. What stands
beside seeds gives lexical patterns: the word before with the signs behind it, two words before, or the words on both sides.
Patterns and instances form a graph whose edges Spark scores in turns: an instance is as sure as its surest patterns make it, a
pattern as sure as the identifier-shaped instances in its place are on the whole. Sure patterns then admit identifiers of a similar
shape that no base pattern matches; values so admitted are seeds of the next generation, until none is added.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import bounded, materialise

KINDS = ("email", "ip", "card", "phone")
#: With what only patterns find: opaque values such as access tokens.
ALL_KINDS = (*KINDS, "secret")
#: Kinds that are told apart by their context, or by nothing.
FAMILY = {"email": "email", "ip": "ip", "card": "number", "phone": "number", "secret": "secret"}

# The base patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Shapes of identifiers that a sure pattern may admit, by kind: written-out addresses, and numbers of other lengths or without a plus sign.
_WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?)[A-Za-z0-9-]{1,63}){1,8}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "number": re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"),
}
#: Opaque values: runs of letters, digits and the signs of base64, of both letters and digits.
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z0-9_+/-]{16,512}+={0,2}(?![A-Za-z0-9_+/=@])")
_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_ASSIGNED = re.compile(r"[=:]\s{0,3}[\"'`]?\Z")
_WORD_BEFORE = re.compile(r"([^\W\d_]{2,32})((?:\s{0,3}[^\w\s]){0,4})\s{0,3}\Z")
_WORD_AFTER = re.compile(r"\W{0,6}([^\W\d_]{2,32})")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: the part before each @ ends at the last match or @."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        part = text[after:at]
        start = at - (len(part) - len(part.rstrip(_LOCAL)))
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            after = m.end()
        at = text.find("@", after)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def wide_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Identifier-shaped spans (kind or 'number', start, end) that touch no base span."""
    taken = sorted(s for v in base.values() for s in v)
    found: list[tuple[str, int, int]] = []
    for kind, rx in _WIDE.items():
        if kind == "email" and not any(x in text for x in ("at", "AT", "At", "aT")) or kind == "ip" and ":" not in text:
            continue
        found += [(kind, *m.span()) for m in rx.finditer(text)]
    for m in _OPAQUE.finditer(text):
        if len(_DIGIT.findall(m[0])) >= 3 and sum(map(str.isalpha, m[0])) >= 3:
            found.append(("secret", *m.span()))
    out, k, last = [], 0, 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= last and not (k < len(taken) and taken[k][0] < b):
            out.append((kind, a, b))
            last = b
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before with the signs behind it, the two words before, the words on both sides."""
    head = text[max(0, start - 80) : start].lower()
    m = _WORD_BEFORE.search(head)
    if not m:
        return []
    one = m[1] + "".join(m[2].split())
    out = [f"{one} _"]
    if m2 := _WORD_BEFORE.search(head[: m.start(1)]):
        out.append(f"{m2[1]} {one} _")
    if m3 := _WORD_AFTER.match(text[end : end + 40].lower()):
        out.append(f"{one} _ {m3[1]}")
    return out


def may_be(shape: str, text: str) -> list[str]:
    """The kinds that a span of a shape may be."""
    if shape != "number":
        return [shape]
    n = len(_DIGIT.findall(text))
    return ["card"] * (13 <= n <= 19) + ["phone"] * (7 <= n <= 15)


def _name(s: str) -> int:
    return struct.unpack("<q", hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest())[0]


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, family, kind, fits, instance, n): what stands beside every seed, and beside every other identifier-shaped span (kind null).

    fits: the kinds that such a span may be. Each task adds up its own rows first, so a context that is everywhere is a row a task. Instances are hashed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}

        def rows():
            cols = list(zip(*found, strict=True)) if found else [()] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(list(found.values()), pa.int64())], names=["pattern", "family", "kind", "fits", "instance", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                base = base_spans(t)
                spans = [(FAMILY[k], k, (), a, e) for k, v in base.items() for a, e in v]
                for shape, a, e in wide_spans(t, base):
                    own = "secret" if shape == "secret" and _HEX.fullmatch(t[a:e]) and _ASSIGNED.search(t[max(0, a - 6) : a]) else None
                    spans.append((shape, own, () if own else tuple(may_be(shape, t[a:e])), a, e))
                for family, kind, fits, a, e in spans:
                    value = _name(t[a:e].lower())
                    for p in patterns(t, a, e):
                        k = (p, family, kind, fits, value)
                        found[k] = found.get(k, 0) + 1
            if len(found) > 100_000:
                yield rows()
                found.clear()
        yield rows()

    return docs.select(F.col(text)).mapInArrow(run, "pattern string, family string, kind string, fits array<string>, instance long, n long").groupBy("pattern", "family", "kind", "fits", "instance").agg(F.sum("n").alias("n"))


def score_patterns(edges: DataFrame, rounds: int = 3, min_score: float = 0.8, min_instances: int = 4, prior: float = 2.0) -> DataFrame:
    """(pattern, family, kind, score) of the sure patterns; of several kinds of a family the surest.

    A seed of a kind is worth 1. A pattern's worth for a kind is the sum of its instances' worths by all identifier-shaped instances of
    the family in its place, those of no kind included, plus prior; an unknown instance's worth is that of its best pattern for the kind.
    After ``rounds`` turns a pattern with min_score and min_instances seeds is sure, and what it admits are seeds of the next generation,
    which may make further patterns sure; generations follow until nothing new is admitted. Worths are joined to edges as
    written tables, broadcast while they are few, and each turn is written to the shared folder.
    """
    edges = materialise(edges, "contexts")
    totals = edges.groupBy("pattern", "family").agg(F.countDistinct("instance").alias("of"))
    base = edges.where("kind is not null").select("pattern", "family", "kind", "instance")
    unknown = edges.where("kind is null").select("pattern", "family", "instance", F.explode("fits").alias("kind"))
    promoted = None
    while True:
        seeds, rest = base, unknown
        if promoted is not None:
            held = bounded(promoted)
            seeds = base.unionByName(unknown.join(held, ["instance", "kind"], "left_semi"))
            rest = unknown.join(held, ["instance", "kind"], "left_anti")
        counted = seeds.groupBy("pattern", "family", "kind").agg(F.countDistinct("instance").alias("seeds")).where(F.col("seeds") >= min_instances)  # others can't become sure
        known = materialise(counted.join(totals, ["pattern", "family"]), "patterns")
        keys = ["pattern", "family", "kind"]
        open_edges = materialise(rest.join(bounded(known.select(*keys)), keys, "left_semi"), "open")
        worth = known.select(*keys, "seeds", "of", (F.col("seeds") / (F.col("of") + prior)).alias("score"))
        for _ in range(0 if open_edges.isEmpty() else rounds):
            instances = open_edges.join(bounded(worth.select(*keys, "score")), keys).groupBy("instance", "kind").agg(F.max("score").alias("worth"))
            gained = open_edges.join(instances, ["instance", "kind"]).groupBy(*keys).agg(F.sum("worth").alias("gain"))
            worth = materialise(known.join(gained, keys, "left").select(*keys, "seeds", "of", ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("of") + prior)).alias("score")), "worth")
        sure = worth.where(F.col("score") >= min_score)
        new = materialise(open_edges.join(bounded(sure.select(*keys)), keys, "left_semi").select("instance", "kind").distinct(), "admitted")
        if new.isEmpty():
            return sure.groupBy("pattern", "family").agg(F.max_by("kind", F.struct("score", "seeds", "kind")).alias("kind"), F.max("score").alias("score"))
        promoted = new if promoted is None else materialise(promoted.unionByName(new), "promoted")


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
#: Sure patterns up to this many (about 60 bytes each) are broadcast; more are taken in parts, a pass over the texts each.
BROADCAST_PATTERNS = 200_000


def find_pii(docs: DataFrame, text: str = "text", out: str = "spans", broadcast_patterns: int = BROADCAST_PATTERNS, **scoring) -> DataFrame:
    """docs with ``out``: all spans (kind, start, end, base), by kind in the order of ALL_KINDS, then by start; code points, end exclusive.

    Base spans are those of the base patterns, leftmost and non-overlapping for each kind. Spans that a sure pattern admits overlap none of them.
    Null texts count as empty and have no spans. Repeated rows are each returned, and their entities are one instance. An empty table
    gives an empty table. A column named as ``out`` is replaced. Texts are scanned twice, whole, and never shuffled; a very long one takes
    time in proportion. Of patterns of several kinds that admit a span, the most specific decides.
    """
    sure = materialise(score_patterns(contexts(docs, text), **scoring), "sure")
    base = docs.drop(out)
    at, names = base.columns.index(text), [*base.columns, out]
    schema = T.StructType([*base.schema.fields, T.StructField(out, SPANS)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    spark = docs.sparkSession

    def scan(df: DataFrame, known: dict, again: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for b in batches:
                rows = []
                before = b.column(len(names) - 1).to_pylist() if again else None
                for i, t in enumerate(b.column(at).to_pylist()):
                    t = t or ""
                    found = base_spans(t)
                    spans = {k: [(a, e, True) for a, e in found.get(k, ())] for k in ALL_KINDS}
                    for x in before[i] if again else ():
                        if not x["base"]:
                            spans[x["kind"]].append((x["start"], x["end"], False))
                    had = {(a, e) for v in spans.values() for a, e, own in v if not own}
                    for shape, a, e in wide_spans(t, found) if known else ():
                        fits = may_be(shape, t[a:e])
                        good = [k for p in patterns(t, a, e) if (k := known.get((p, shape))) in fits]
                        if good and (a, e) not in had:
                            spans[good[-1]].append((a, e, False))
                    rows.append([{"kind": k, "start": a, "end": e, "base": own} for k in ALL_KINDS for a, e, own in sorted(spans[k])])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 1], pa.array(rows, arrow)], names=names)

        return df.mapInArrow(run, schema)

    # Patterns beyond the bound are taken in parts; each part is one more pass that adds to the spans found before.
    parts = max(1, -(-sure.count() // broadcast_patterns))
    cur = base
    for k in range(parts):
        some = sure if parts == 1 else sure.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        cur = scan(cur, {(r["pattern"], r["family"]): r["kind"] for r in some.collect()}, k > 0)
        if k + 1 < parts:
            cur = materialise(cur, "pii-part")
    return cur

"""Exact set-similarity groups over word shingles by token-group matrices.

1. Every text becomes a set of hashed shingles; equal sets are one node from here on.
2. Nodes are partitioned into families: nodes that share one of many keys of minimum hashes, directly or over others.
   Keys are dense enough that a pair at the threshold shares none with a probability under ``miss``.
3. Within a family the search is exact. Its members are put into small groups of similar sets; each group has the union
   of its members' tokens; the overlap of a query with that union bounds its overlap with each member, and only groups whose
   bound reaches the threshold are opened. Every member counts its links; where no counts are asked for, members already known
   to be connected aren't compared again.
   A family beyond one block is cut into blocks of sets that share their smallest token. Each block stores the union of its tokens as
   a bitmap of hashes, from which the overlap of every set of another block is bounded from above; sets are sent only to the
   blocks where that bound reaches the threshold.
4. The links found (a spanning set for each block pair) are contracted to components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import bounded, components, discard, materialise, text_bytes

ROWS = 6  # minimum hashes in a key
#: A family is cut into up to BLOCKS blocks of LEAST_DOCS sets, so that one family doesn't wait for one task, and beyond into blocks of at most
#: about BLOCK_DOCS sets or BLOCK_TOKENS tokens.
BLOCKS, LEAST_DOCS, BLOCK_DOCS, BLOCK_TOKENS = 16, 128, 1024, 1_000_000
GROUP = 32
UNIONS = 256  # token unions that one task holds at a time
#: Words beyond so many bytes are named by a digest: long ones can be made that have equal polynomials.
LONG = 256
SAMPLE, HOT, SALTS = 5_000, 0.005, 64
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.frombuffer(hashlib.shake_256(b"shingle bytes").digest(2048), np.uint64)
_BASE = np.uint64(0xE7037ED1A0B428DB)
_BASE_INV = np.uint64(pow(0xE7037ED1A0B428DB, -1, 1 << 64))
#: A-Z as a-z; space and tab to carriage return as space; all else as it is.
_NORMAL = np.array([c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of each text; texts of fewer than k words have one shingle or none."""
    n_docs = len(off) - 1
    empty = np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    if not len(raw):
        return empty
    b = _NORMAL[raw]
    word = b != 32
    start = word.copy()
    start[1:] &= ~word[:-1]
    firsts = off[:-1][off[:-1] < off[1:]]
    start[firsts] = word[firsts]
    w0 = np.flatnonzero(start)
    if not len(w0):
        return empty
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    lasts = off[1:][off[:-1] < off[1:]] - 1
    stop[lasts] = word[lasts]
    w1 = np.flatnonzero(stop) + 1
    size = w1 - w0
    # hash of each word: a polynomial over its bytes, then shingles: a polynomial over the words
    n = len(b)
    pw = np.full(n, _BASE, np.uint64)
    pw[0] = 1
    pw = np.multiply.accumulate(pw)
    cum = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * pw, out=cum[1:])
    inv = np.full(n, _BASE_INV, np.uint64)
    inv[0] = 1
    inv = np.multiply.accumulate(inv)
    h = _mix((cum[w1] - cum[w0]) * inv[w0] + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[w0[i] : w1[i]].tobytes(), digest_size=8).digest(), "little")
    doc = np.searchsorted(off, w0, "right") - 1
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n_words) - n_words
    n_sh = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    total = int(n_sh.sum())
    sh_doc = np.repeat(np.arange(n_docs), n_sh)
    at = first[sh_doc] + np.arange(total) - (np.cumsum(n_sh) - n_sh)[sh_doc]
    span = np.minimum(n_words[sh_doc], k)
    s = np.zeros(total, np.uint64)
    for j in range(k):
        on = j < span
        s[on] = _mix(s[on] * _BASE + h[at[on] + j] + np.uint64(j + 1))
    order = np.lexsort((s, sh_doc))
    s, sh_doc = s[order], sh_doc[order]
    keep = np.ones(total, bool)
    keep[1:] = (s[1:] != s[:-1]) | (sh_doc[1:] != sh_doc[:-1])
    counts = np.bincount(sh_doc[keep], minlength=n_docs)
    return s[keep], np.concatenate([[0], np.cumsum(counts)])


def text_sets(raw: np.ndarray, off: np.ndarray, k: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets(), of a text alone beyond ``most`` bytes part by part, so that memory follows its set rather than its length."""
    if len(off) != 2 or len(raw) <= most:
        return shingle_sets(raw, off, k)
    word = np.concatenate([[False], _NORMAL[raw] != 32, [False]])
    w0, w1 = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    found, at = np.zeros(0, np.uint64), 0
    while at < len(w0):
        to = min(len(w0), max(at + k, int(np.searchsorted(w1, w0[at] + most))))
        if len(w0) - to < k:
            to = len(w0)
        part = raw[w0[at] : w1[to - 1]]
        found = np.union1d(found, shingle_sets(part, np.array([0, len(part)]), k)[0])
        at = to if to == len(w0) else to - k + 1
    return found, np.array([0, len(found)])


def slices(off: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def digests(sets: np.ndarray, off: np.ndarray) -> list:
    """128-bit names of the sets; None for empty ones."""
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def bands(threshold: float, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))


def _multipliers(n: int) -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(b"minimum hashes").digest(4 * n), np.uint32) | np.uint32(1)


def band_keys(s: np.ndarray, n_bands: int) -> np.ndarray:
    """Keys of one set: each of ROWS minimum hashes."""
    mult = _multipliers(n_bands * ROWS)
    x = (s >> np.uint64(16)).astype(np.uint32)
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * mult[None, :]).min(axis=0), out=low)
    rows = low.reshape(n_bands, ROWS).astype(np.uint64)
    key = np.arange(n_bands, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * _BASE + rows[:, j])
    return key.view(np.int64)


def set_rows(docs: DataFrame, k: int, doc_id: str, text: str, n_bands: int) -> DataFrame:
    """(doc_id, at, text_hash, node, n_shingles, low, keys) of every row; at is row_key, low the smallest token; node is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            for lo, hi in slices(off):
                sets, so = text_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                ends = list(zip(so[:-1].tolist(), so[1:].tolist(), strict=True))
                low = [int(sets[x].view(np.int64)) if y > x else None for x, y in ends]
                keys = [band_keys(sets[x:y], n_bands) if y > x else None for x, y in ends]
                own = [b.column(c).slice(lo, hi - lo) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digests(sets, so), pa.binary()), pa.array(np.diff(so), pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "at", "text_hash", "node", "n_shingles", "low", "keys"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("at"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, at long, text_hash long, node binary, n_shingles long, low long, keys array<long>")


def row_key(doc_id: str, text: str):
    """Where a row's text is found again: a hash of both, so that rows of one doc_id with different texts don't meet."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def family_links(sets: list[np.ndarray], side: list[int], percent: int, copies: list[int] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that connect all that similarity connects, number of links of each set). side: 0 or 1; with both, only pairs across are compared.

    A link to a set counts as many times as the set has copies; without copies nothing is counted.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    low = np.array([s[0] for s in sets])
    order = np.lexsort((size, low))  # similar sets often share their smallest token
    both = len(set(side)) > 1
    if both:
        order = np.concatenate([order[np.array(side)[order] == 0], order[np.array(side)[order] == 1]])
    groups = []
    for lo in range(0, n, GROUP):
        for part in ({0, 1} if both else {side[0]}):
            m = [int(i) for i in order[lo : lo + GROUP] if not both or side[i] == part]
            if m:
                groups.append(np.array(m))
    ids = [flat[first[i] : first[i] + size[i]] for i in range(n)]
    union_tok = [np.unique(np.concatenate([ids[i] for i in g])) for g in groups]
    # the matrix: for each token the groups whose union has it
    tok = np.concatenate(union_tok)
    grp = np.repeat(np.arange(len(groups)), [len(u) for u in union_tok])
    by = np.argsort(tok, kind="stable")
    tok, grp = tok[by], grp[by]
    begin = np.searchsorted(tok, np.arange(len(tokens) + 1))
    inside = [np.concatenate([ids[i] for i in g]) for g in groups]
    edges = [np.concatenate([[0], np.cumsum(size[g])])[:-1] for g in groups]
    smallest, largest = [int(size[g].min()) for g in groups], [int(size[g].max()) for g in groups]
    where = np.empty(n, np.int64)
    for k, g in enumerate(groups):
        where[g] = k
    flag = np.zeros(len(tokens), bool)
    forest, links = Forest(n), []
    weight, n_links = None if copies is None else np.array(copies, np.int64), np.zeros(n, np.int64)
    for q in order.tolist():
        need = -(-percent * int(size[q]) // 100)
        cnt = begin[ids[q] + 1] - begin[ids[q]]
        at = np.repeat(begin[ids[q]] - (np.cumsum(cnt) - cnt), cnt) + np.arange(int(cnt.sum()))
        bound = np.bincount(grp[at], minlength=len(groups))
        open_groups = np.flatnonzero(bound >= need)
        root = forest.find(q)
        flag[ids[q]] = True
        for k in open_groups.tolist():
            g = groups[k]
            if k > where[q] or both and side[g[0]] == side[q]:
                continue
            if 100 * largest[k] < percent * size[q] or percent * smallest[k] > 100 * size[q]:
                continue
            if weight is None and all(forest.find(i) == root for i in g.tolist()):
                continue
            shared = np.add.reduceat(flag[inside[k]].astype(np.int64), edges[k])
            good = 100 * shared >= percent * (size[g] + size[q] - shared)
            if weight is not None:
                met = g[good & (g != q)]
                n_links[q] += weight[met].sum()
                if k != where[q]:  # within a group each of two sets has its turn as q
                    n_links[met] += weight[q]
            for i in g[good].tolist():
                if i != q and (r := forest.find(i)) != root:
                    forest.up[r] = root
                    links.append((q, i))
        flag[ids[q]] = False
    return links, n_links


def pivot_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): every node (nid, keys) with the smallest node that has the same key.

    Keys that a sample shows in HOT of the nodes or more (each node has as many keys as bands, so at most bands / HOT are such) are dealt
    to SALTS tasks each, whose smallest nodes are then tied together. All keys are exchanged once.
    """
    step = max(1, nodes.count() // SAMPLE)
    seen = nodes.where(F.pmod(F.xxhash64("nid"), F.lit(step)) == 0)
    least = max(20, HOT * seen.count())
    hot = materialise(seen.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key", F.lit(True).alias("hot")), "hot-keys")
    keyed = nodes.select("nid", F.explode("keys").alias("key")).join(F.broadcast(hot), "key", "left")
    keyed = keyed.select("nid", "key", F.when(F.col("hot"), F.pmod(F.xxhash64("nid"), F.lit(SALTS)) + 1).otherwise(0).cast("int").alias("salt")).repartition("key", "salt")
    firsts = keyed.groupBy("key", "salt").agg(F.min("nid").alias("pivot"), F.max("nid").alias("last"))
    edges = keyed.join(firsts.where("pivot < last"), ["key", "salt"]).where("nid <> pivot").select(F.col("nid").alias("a"), F.col("pivot").alias("b"))
    heads = firsts.where("salt > 0").select("key", F.col("pivot").alias("head"))
    tops = heads.groupBy("key").agg(F.min("head").alias("top"))
    return edges.unionByName(heads.join(tops, "key").where("head <> top").select(F.col("head").alias("a"), F.col("top").alias("b"))).distinct()


def place(sizes: DataFrame) -> DataFrame:
    """sizes (family, node, n, low, ...) with block and nb: sets of a family with one smallest token are put in one block as far as it has room."""
    docs = F.count("*")
    fewest = F.greatest(F.least(F.ceil(docs / LEAST_DOCS), F.lit(BLOCKS)), F.ceil(docs / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    many = materialise(sizes.groupBy("family").agg(fewest.alias("nb"), (docs / fewest).alias("each")).where("nb > 1"), "many")  # a row for each block at most
    if many.isEmpty():
        return sizes.withColumns({"block": F.lit(0), "nb": F.lit(1)})
    known = sizes.join(bounded(many), "family", "left")
    lows = known.where("nb > 1").groupBy("family", "low").agg(F.ceil(F.count("*") / F.min("each")).cast("int").alias("part"))
    large = materialise(lows.where("part > 1"), "large-lows")
    part = F.pmod(F.xxhash64("node"), F.coalesce("part", F.lit(1)))
    block = F.when(F.col("nb") > 1, F.pmod(F.pmod(F.xxhash64("low"), F.col("nb")) + part, F.col("nb"))).otherwise(0)
    return known.join(bounded(large), ["family", "low"], "left").withColumns({"block": block.cast("int"), "nb": F.coalesce("nb", F.lit(1))}).drop("part", "each")


def union_bitmap(sets: list[np.ndarray]) -> bytes:
    """The tokens of all sets: a bit for each value of their leading bits, some eight bits a token."""
    tokens = np.unique(np.concatenate(sets))
    size = min(24, max(10, int(8 * len(tokens) - 1).bit_length()))
    bits = np.zeros(1 << size, bool)
    bits[tokens >> np.uint64(64 - size)] = True
    return np.packbits(bits).tobytes()


def overlap_bounds(sets: list[np.ndarray], bitmap: bytes) -> np.ndarray:
    """For each set at least as many as its tokens in the union."""
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8))
    size = len(bits).bit_length() - 1
    found = bits[np.concatenate(sets) >> np.uint64(64 - size)].astype(np.int64)
    return np.add.reduceat(found, np.cumsum([0, *map(len, sets[:-1])]))


def sent_sets(homes: DataFrame, percent: int) -> DataFrame:
    """(node, family, bi, bj, block, copies, set): every set of a family of several blocks with each other block whose token union may have a partner of it."""
    keys = ["family", "block"]
    cut = homes.where("nb > 1")

    def unite(t: pa.Table) -> pa.Table:
        held = union_bitmap([np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()])
        return pa.table({"family": t.column("family")[:1], "block": t.column("block")[:1], "nb": t.column("nb")[:1], "tokens": pa.array([held], pa.binary())})

    unions = materialise(cut.select("family", "block", "nb", "set").groupBy(*keys).applyInArrow(unite, "family long, block int, nb int, tokens binary"), "unions")
    others = unions.select("family", F.col("block").alias("other"), "tokens", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block")).where("block <> other")
    others = others.withColumn("chunk", F.floor(F.col("other") / UNIONS).cast("int"))
    queries = cut.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("nb") - 1) / UNIONS).cast("int"))))

    def qualify(t: pa.Table, u: pa.Table) -> pa.Table:
        rows, to = [], []
        if len(t) and len(u):
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            need = np.array([-(-percent * len(s) // 100) for s in sets])
            for other, held in zip(u.column("other").to_pylist(), u.column("tokens").to_pylist(), strict=True):
                good = np.flatnonzero(overlap_bounds(sets, held) >= need)
                rows.append(good)
                to.append(np.full(len(good), other, np.int32))
        at, to = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*to, np.zeros(0, np.int32)]).astype(np.int32)
        picked = t.select(["node", "family", "block", "copies", "set"]).take(pa.array(at))
        return picked.append_column("other", pa.array(to, pa.int32()))

    sent = queries.groupBy("family", "block", "chunk").cogroup(others.groupBy("family", "block", "chunk")).applyInArrow(qualify, "node binary, family long, block int, copies long, set binary, other int")
    return sent.select("node", "family", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "copies", "set")


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", miss: float = 1e-9, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, n_links, component, text_hash) of every row.

    Two rows link when 100 * shared shingles >= percent * all shingles of both. component_id is the smallest doc_id that links reach.
    Texts of fewer than ``words`` words are one shingle; null texts and texts without words have no shingle, link with nothing and
    have their own doc_id. Repeated rows are each returned. Rows with one doc_id and different texts are rows of their own; a null
    doc_id never is the smallest. An empty table gives an empty table. node names the shingle set (null if empty).
    n_links is the number of other rows that a row links with, copies and repeated rows each counted; null without ``count_links``, which
    saves comparisons of sets already connected. component is the smallest node that links reach, which names the component also where doc_ids
    repeat or are null; text_hash is xxhash64 of the text. Other columns are ignored.
    """
    rows = materialise(set_rows(docs, words, doc_id, text, bands(percent / 100, miss)), "rows")
    nodes = materialise(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("at").alias("at"), F.min("n_shingles").alias("n"), F.min("low").alias("low"), F.any_value("keys").alias("keys"), F.count("*").alias("copies")).withColumn("nid", F.xxhash64("node")), "nodes")
    family = materialise(components(pivot_edges(nodes)).select(F.col("node").alias("nid"), F.col("root").alias("family")), "family")
    sizes = materialise(nodes.select("nid", "node", "n", "at", "low", "copies").join(family.hint("merge"), "nid"), "families")
    placed = materialise(place(sizes).select("node", "at", "family", "block", "nb", "copies"), "placed")

    def member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat doc_id and text meet in one task and give one set
        for b in batches:
            raw, off = text_bytes(b.column(1))
            want = b.column(0).to_pylist()
            for lo, hi in slices(off):
                s, so = text_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                names = digests(s, so)
                pick = []
                for i in range(hi - lo):
                    if names[i] is not None and names[i] == want[lo + i] and names[i] not in seen:
                        seen.add(names[i])
                        pick.append(i)
                rows = [b.column(c).take(pa.array([lo + i for i in pick], pa.int64())) for c in (0, 2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([s[so[i] : so[i + 1]].tobytes() for i in pick], pa.binary())], names=["node", "family", "block", "nb", "copies", "set"])

    # placed grows with the documents, so it is never broadcast: at every size the texts are exchanged once, and only the rows of placed are hashed
    texts = docs.select(row_key(doc_id, text).alias("at"), F.col(text).alias("text")).join(placed.hint("shuffle_hash"), "at")
    homes = materialise(texts.select("node", "text", "family", "block", "nb", "copies").mapInArrow(member_sets, "node binary, family long, block int, nb int, copies long, set binary"), "homes")
    dealt = homes.select("node", "family", F.col("block").alias("bi"), F.col("block").alias("bj"), "block", "copies", "set")
    if not homes.where("nb > 1").isEmpty():
        dealt = dealt.unionByName(sent_sets(homes, percent))

    def match(t: pa.Table) -> pa.Table:
        names, kept = t.column("node").to_pylist(), {}
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        blk, payload = t.column("block").to_pylist(), t.column("set").to_pylist()
        for i, x in enumerate(names):  # where Spark splits a task of many repeated rows, each part gives their node
            kept.setdefault(x, i)
        pick = sorted(kept.values())
        links, counts = [], np.zeros(len(pick), np.int64)
        if len(pick) > 1 and (bi == bj or len({blk[i] for i in pick}) == 2):
            copies = t.column("copies").to_pylist()
            links, counts = family_links([np.frombuffer(payload[i], np.uint64) for i in pick], [0 if bi == bj else int(blk[i] == bj) for i in pick], percent, [copies[i] for i in pick] if count_links else None)
        met = np.flatnonzero(counts).tolist()  # a row (a, null, n): n links of a in this block pair
        a, b = [names[pick[x]] for x, _ in links] + [names[pick[x]] for x in met], [names[pick[y]] for _, y in links] + [None] * len(met)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array([None] * len(links) + counts[met].tolist(), pa.int64())})

    links = materialise(dealt.groupBy("family", "bi", "bj").applyInArrow(match, "a binary, b binary, n long"), "links")
    linked = materialise(components(links.where("b is not null").select("a", "b")), "linked")
    counted = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    least = materialise(linked.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = linked.join(bounded(least), "root").select("node", "component_id", "root")
    n_links = F.col("copies") - 1 + F.coalesce("others", F.lit(0)) if count_links else F.lit(None).cast("long")
    final = materialise(nodes.join(named, "node", "left").join(counted, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), n_links.alias("n_links"), F.coalesce("root", "node").alias("component")), "named")
    discard(nodes, family, sizes, placed, homes, links, linked, least)
    alone = F.col("node").isNull()
    none = F.lit(0 if count_links else None).cast("long")
    return rows.drop("keys", "low").join(final, "node", "left").select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", F.when(alone, none).otherwise(F.col("n_links")).alias("n_links"), "component", "text_hash")

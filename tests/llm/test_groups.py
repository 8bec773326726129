"""Similarity groups, fingerprints, lines, benchmark windows and shards against brute force."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cloakframe.llm import decontam, jaccard, lines, sharding, winnow
from cloakframe.llm.common import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t-\r]+", lower(t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def near_copies(seed):
    rnd = random.Random(seed)
    rows = []
    for n in [2, 3, 4, 5, 7, 8, 12, 30, 80, 150] * 4:
        base = [f"w{rnd.randint(0, 900)}" for _ in range(n)]
        for _ in range(rnd.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(n)] = f"x{rnd.randint(0, 9)}"
            rows.append((len(rows), " ".join(w[: -1 if rnd.random() < 0.3 and n > 2 else n])))
    rows += [(None, rows[0][1]), (None, None), (7, "same name, other text"), (7, "same name, other text"), (9000, ""), (9001, " \n"), (9002, "One"), (9003, "oNE\x0b")]
    return rows


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_groups(spark, k, percent):
    rows = near_copies(k)
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, node string")
    got = jaccard.jaccard_groups(df, k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_groups(rows, k, percent))


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 8)
    monkeypatch.setattr(jaccard, "LEAST_DOCS", 4)  # families beyond one block are dealt out as pairs of blocks
    rows = [(i, t) for i, t in near_copies(3) if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.jaccard_groups(df, 4, 85).select("doc_id", "n_shingles", "component_id").collect())) == Counter(brute_groups(rows, 4, 85))


@pytest.mark.parametrize("block", [1024, 30, 8])
def test_jaccard_counts_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    monkeypatch.setattr(jaccard, "LEAST_DOCS", min(block, 128))
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    family = [" ".join(f"x{j}" if i == at else w for i, w in enumerate(base)) for j, at in enumerate(rnd.randrange(120) for _ in range(70))]
    rows = near_copies(5) + [(10_000 + i, t) for i, t in enumerate(family + family[:9])]
    sets = [(d, {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if (w := re.findall(r"[^ \t-\r]+", lower(t or ""))) else set()) for d, t in rows]
    want = Counter((d, sum(bool(s) and 100 * len(s & o) >= 85 * len(s | o) for j, (_, o) in enumerate(sets) if j != i)) for i, (d, s) in enumerate(sets))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_groups(df, 4, 85)
    assert Counter(map(tuple, got.select("doc_id", "n_links").collect())) == want


def test_one_doc_id_for_many_rows(spark, monkeypatch):
    sizes = {}

    def counting(df, tag, write=jaccard.materialise):
        out = write(df, tag)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialise", counting)
    base = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(f"x{j}" if i == j else w for i, w in enumerate(base))) for j in range(20)]
    rows += [(7, rows[0][1])] * 30 + [(None, rows[1][1])] * 30 + [(7, f"other text {j} of that name") for j in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = jaccard.jaccard_groups(df, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_groups(rows, 4, 85))
    assert sizes["homes"] == sizes["placed"] == 20  # each set is sent once, whatever rows share its doc_id or repeat it


@pytest.mark.parametrize("similarity,percent", [(0.8, 80), (0.85, 85)])
def test_pairs_at_the_threshold_share_a_key(similarity, percent):
    rng = np.random.default_rng(percent)
    n_bands = jaccard.bands(percent / 100, 1e-9)
    met, bands = [], 0
    for k in range(600):
        n = int(rng.integers(20, 400))
        both = round(2 * n * similarity / (1 + similarity))
        tokens = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64) * np.uint64(2)
        x, y = (jaccard.band_keys(np.sort(t), n_bands) for t in (tokens[:n], np.concatenate([tokens[:both], tokens[n:]])))
        met.append(int((x == y).sum()))
        bands += n_bands
    assert min(met) >= 1  # none of 600 pairs is missed
    assert abs(sum(met) / bands - similarity**jaccard.ROWS) < 0.03  # keys meet as independent minimum hashes do


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALTS", 4)
    rnd = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{i}" if j == rnd.randrange(200) else w for j, w in enumerate(base))) for i in range(80)] + [(1000 + i, " ".join(f"y{i}-{j}" for j in range(20))) for i in range(300)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_groups(rows, 4, 85))


@pytest.mark.parametrize("most", [20, 300])
def test_long_texts_are_shingled_in_parts(most):
    rnd = random.Random(15)
    for text in (" ".join(rnd.choice(["a", "bb", "Ccc", "d" * 40]) for _ in range(500)), "x" * 400, "  a  b " * 90, " " * 500, "a " * 3 + "z" * 300):
        raw = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(raw)])
        for k in (4, 5):
            want, got = jaccard.shingle_sets(raw, off, k), jaccard.text_sets(raw, off, k, most)
            assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


def test_union_bounds_never_undercount():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64) * np.uint64(2)) for _ in range(12)]
        held = jaccard.union_bitmap(sets[:8])
        bounds = jaccard.overlap_bounds(sets, held)
        union = np.concatenate(sets[:8])
        assert all(b >= np.isin(s, union).sum() for b, s in zip(bounds, sets, strict=True)) and (bounds[8:] < [max(4, 0.5 * len(s)) for s in sets[8:]]).all()


def test_jaccard_empty(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (5, 5), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == got[100] == 100


@functools.cache
def brute_kept(t):
    """(hash, position) of the kept runs, by the definition: each run hashed anew, each window searched anew."""
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^ \t-\r]{1,24}+(?![^ \t-\r])|[^ \t-\r]", t)]
    words += [0] * (winnow.GRAM - len(words))
    runs = []
    for i in range(len(words) - winnow.GRAM + 1):
        h = 0
        for j, w in enumerate(words[i : i + winnow.GRAM]):
            k = winnow.GRAM - 1 - j
            h ^= (w << k | w >> (64 - k)) & (1 << 64) - 1 if k else w
        runs.append(h & 0xFFFFFFFF)
    out = {}
    for i in range(max(1, len(runs) - winnow.WINDOW + 1)):
        part = runs[i : i + winnow.WINDOW]
        at = max(j for j in range(len(part)) if part[j] == min(part)) + i
        out[runs[at], at] = 1
    return list(out)


def brute_near(a, b):
    x, y = {h for h, _ in brute_kept(a)}, {h for h, _ in brute_kept(b)}
    return len(x & y) / len(x | y)


def test_fingerprints(spark):
    rnd = random.Random(11)
    rows = [(1, None), (2, ""), (None, "a b c d e f g h"), (None, " \n"), (-(1 << 63), "least id"), (7, "x" * 100), (8, "x" * 99 + "y"), (9, "漢字 😀 z"), (10, "漢字仮名" * 60), (20, " ".join(f"w{i}" for i in range(400))), (21, " ".join(f"v{i}" for i in range(50)))]
    rows += [(30 + n, " ".join(f"w{rnd.randrange(40)}" for _ in range(n))) for n in range(1, 45, 3)] + [(100, "long " * 9_000 + "tail"), (101, "q" * 9_000), (102, "same"), (102, "same"), (102, "other text, same id")]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, kept int, th string")
    got = winnow.edited_fingerprints(df).collect()
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    first = {}
    for i, t in order:  # rows of one id are in the order of a hash; take it from the result
        first.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        # among the successors that the order of ids allows, one must explain all columns
        at = list(first).index(r.doc_id)
        nexts = {t for k in (at, (at + 1) % len(first)) for t in first[list(first)[k]]}
        ok = []
        for t in first[r.doc_id]:
            for nxt in nexts:
                n = len(t)
                edited = t[: n - n // 3] + nxt[: n // 3]
                say = lambda x: ",".join(f"{h:x}:{p}" for h, p in brute_kept(x))
                want = (n, hashlib.sha256(edited.encode()).hexdigest(), say(t), say(edited), brute_near(t, edited), brute_near(t, nxt))
                have = (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
                if want == have and not (len(first[r.doc_id]) == 1 and nxt == t and len(first[list(first)[(at + 1) % len(first)]]) and nxt not in first[list(first)[(at + 1) % len(first)]]):
                    ok.append(t)
        assert ok, r.doc_id
        by[r.doc_id] += 1
    assert by == Counter(i for i, _ in rows)
    alone = winnow.edited_fingerprints(df.where("doc_id = 20")).first()
    assert alone.near_next == 1
    assert winnow.edited_fingerprints(df.limit(0)).count() == 0


def test_winnowing_guarantee(spark):
    rnd = random.Random(8)
    shared = [f"s{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1)]
    rows = [(" ".join([f"a{rnd.random()}" for _ in range(60)] + shared + [f"b{rnd.random()}" for _ in range(60)]),) for _ in range(20)]
    sets = [set(r.h) for r in spark.createDataFrame(rows, "text string").select(winnow.hashes(winnow.kept(F.col("text"))).alias("h")).collect()]
    assert all(a & b for a in sets for b in sets)


def test_texts_without_blanks_are_cut_alike_wherever_they_begin(spark):
    rnd = random.Random(9)
    t = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(3000))
    near = spark.createDataFrame([(t, "一" + t)], "a string, b string").select(winnow.likeness(winnow.hashes(winnow.kept(F.col("a"))), winnow.hashes(winnow.kept(F.col("b"))))).first()[0]
    assert near > 0.99


def test_likeness_has_no_step_at_any_length(spark):
    rnd = random.Random(10)
    rows = [(n, " ".join(w), " ".join([*w, "more"])) for n in range(10, 60) for w in ([f"w{rnd.randrange(10**9)}" for _ in range(n)],) for _ in range(6)]
    near = spark.createDataFrame(rows, "n int, a string, b string").select("n", winnow.likeness(winnow.hashes(winnow.kept(F.col("a"))), winnow.hashes(winnow.kept(F.col("b")))).alias("x"))
    assert all(r.x >= 0.5 for r in near.collect())


def brute_lines(rows, least):
    names = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            names[lower(x.strip(" \t\n\x0b\x0c\r"))].add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (k := lower(x.strip(" \t\n\x0b\x0c\r"))) or len(names[k]) < least]
        out.append((d, None if t is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_lines(spark, broadcast):
    rnd = random.Random(4)
    pool = ["A line", " a LINE\t", "b", "", "  ", "É", "é", "c c"]
    rows = [(i, "\n".join(rnd.choice([*pool, f"own {i} {j}"]) for j in range(rnd.randint(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "A line\nb"), (3, rows[3][1]), (102, "\n\n"), (103, "b\n" * 500)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_lines int, key string")
    got = lines.dedup_lines(df, 5, 1, broadcast_keys=broadcast)
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == Counter(brute_lines(rows, 5))
    assert lines.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_lines_of_shuffled_input(spark, broadcast):
    rnd = random.Random(14)
    rows = [(i, "\n".join([f"own {i}", rnd.choice("abcdefgh"), "", f"end {i}"]), f"s{i % 7}") for i in range(400)]
    df = spark.createDataFrame([(*r, "n", "r") for r in rows], "doc_id long, text string, source string, k string, pos string")
    want = Counter((d, t, n, g) for d, t, n, g in brute_lines([r[:2] for r in rows], 50))
    source = {i: s for i, _, s in rows}
    for part in (df.repartition(37), df.groupBy(*df.columns).count().drop("count"), df.join(df.select("doc_id").distinct(), "doc_id").orderBy("text").repartition("source"), df.coalesce(1)):
        got = lines.dedup_lines(part, 50, 1, broadcast_keys=broadcast).collect()
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want
        assert all(r.source == source[r.doc_id] and (r.k, r.pos) == ("n", "r") for r in got)


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def brute_hits(text, items, size):
    w, hit, found = words_of(text), set(), set()
    for item, t in items:
        iw = words_of(t)
        for k in range(max(1, len(iw) - size + 1) if iw else 0):
            part = iw[k : k + size]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("window_chars", [2_000_000, 40])
def test_contamination(spark, window_chars):
    rnd = random.Random(6)
    items = [(i, " ".join(f"q{rnd.randint(0, 9)}" for _ in range(n))) for i, n in enumerate([0, 1, 3, 4, 5, 6, 12, 12])] + [(None, "q1 q2 q3 q4"), (50, None), (6, "q1 q1 q1 q1")]
    texts = [" ".join(f"Q{rnd.randint(0, 9)}" if rnd.random() < 0.9 else "é-é" for _ in range(rnd.randint(0, 60))) for _ in range(40)] + [None, "", "...", f"x {items[6][1].upper()}! y"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, items int")
    got = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"), window=4, window_chars=window_chars).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], items, 4)
        marked = sum(len(words_of(texts[r.doc_id][s.start : s.end])) for s in r.hit_spans)
        assert marked == r.n_hit
    none = decontam.contamination(df, spark.createDataFrame([], "item_id long, text string"), window=4)
    assert none.agg(F.sum("n_hit")).first()[0] == 0 and decontam.contamination(df.limit(0), none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_shards(spark):
    rows = [(i, f"t{i}" if i % 9 else None, "big" if i % 3 else f"s{i % 15}") for i in range(1000)] + [(None, "n", None), (4, "t4", "big")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, shard int")
    got = sharding.stratified_shards(df, 16).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 16 and max(sizes) - min(sizes) <= 1
    share = sum(r.stratum == "big" for r in got) / len(got)
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
        assert abs(sum(r.stratum == "big" for r in v) - share * len(v)) <= 4
    for r in got:
        t = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.stratified_shards(df.repartition(3), 16).collect()} == {(r.doc_id, r.shard, r.slot) for r in got}
    assert sharding.stratified_shards(df.limit(0)).count() == 0

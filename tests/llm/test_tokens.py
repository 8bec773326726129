"""Tokenising, token blocks, packing and counts against the library and brute force."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from cloakframe.llm import fasttok, jaccard, packing, pfor, token_counts
from cloakframe.llm.entry import vocabulary
from cloakframe.llm.fasttok import FastTokenizer

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def fuzz(n, alphabet, size, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, size))) for _ in range(n)]


TEXTS = [*fuzz(1500, "ab'stremdvl ZÉé1²9  \n\t.,!-$ ’x€漢́\x1c\xa0", 40, 3), *fuzz(3000, "abstremdvl' ' \n.1é", 30, 4), "", "'s", "it's 're'll''s", "a<|endoftext|>b", " <|startoftext|>q", "İstanbul ǅ"]


@pytest.mark.parametrize("name", FILES)
def test_encodes_as_the_library(name):
    t = FastTokenizer(vocabulary(name))
    assert t.kind
    want = t.library(TEXTS)
    assert [list(x) for x in t.encode(TEXTS)] == want
    assert t.count(TEXTS).tolist() == [len(x) for x in want]
    t.cache.bits = 8  # a full cache is emptied, and grows for a text that needs more
    t.cache.clear()
    assert [list(x) for x in t.encode(TEXTS)] == want


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, 50_000, n).astype(np.uint32)
        ids[rng.random(n) < 0.01] = 4_000_000_000
        for p in (0, 50, 98, 100):
            w, raw = pfor.Writer(p, blocks=2), b""
            for i in range(0, n, 700):
                w.add(i if i else None, ids[i : i + 700])
                raw += (x + b"\n") if (x := w.segment()) is not None else b""
            raw += (x + b"\n") if (x := w.segment(last=True)) is not None else b""
            found = list(pfor.segments(raw))
            assert np.concatenate([np.zeros(0, np.uint32), *(x.all() for x in found)]).tolist() == ids.tolist()
            assert [d for x in found for d in x.doc_ids] == [i or None for i in range(0, n, 700)] and len(found) >= n / 2800
            assert [x.document(k).tolist() for x in found for k in range(len(x.lens))] == [ids[i : i + 700].tolist() for i in range(0, n, 700)]
    for bad in (b"x" * 64, raw[:-1], raw[:-9] + b"\n", raw + b"?"):
        with pytest.raises(ValueError):
            list(pfor.segments(bad))


def test_long_spans_with_equal_polynomials():
    a = [0]
    while len(a) < 4096:  # Thue-Morse words and their complements have equal polynomials modulo 2**64
        a += [1 - x for x in a]
    x, y = (np.array([97 + (v ^ k) for v in a], np.int32) for k in (0, 1))
    both = np.concatenate([x, y])
    h = fasttok.span_hashes(both, np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]
    sets, off = jaccard.shingle_sets(np.concatenate([both[:4096], [32], both[4096:]]).astype(np.uint8), np.array([0, 4097, 8193]), 4)
    assert len(set(sets.tolist())) == 2


ROWS = [(5, "The quick brown fox"), (1, None), (3, ""), (3, "again, it's here"), (None, "no name"), (9, "tail " * 3000), (5, "The quick brown fox")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in ROWS], "doc_id long, text string, n_tokens string, start int")


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, 42 if x[1] is None else np.array([xxhash.xxh64_intdigest(x[1].encode(), seed=42)], np.uint64).view(np.int64)[0], x[1] or ""))


@pytest.mark.parametrize("segment,files", [(1024, 32), (1, 1)])
def test_token_blocks(spark, docs, tmp_path, segment, files):
    path = str(tmp_path / "blocks")
    rows = [*ROWS, *[(None, f"one of many without a name {i} " * 40) for i in range(120)]]
    more = spark.createDataFrame([(i, t, "x", 7, b"") for i, t in rows], "doc_id long, text string, n_tokens string, h int, segment binary")
    pfor.write_token_blocks(more, path, vocabulary("word_bpe_49k.json"), end_id=1, segment_blocks=segment, file_segments=files)
    got = sorted(pfor.read_token_blocks(spark, path).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_str(vocabulary("word_bpe_49k.json"))
    at, want = 0, {}
    for r, (i, t) in zip(got, in_order(rows), strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        want.setdefault(i, []).append(ids.tolist())
    picked = pfor.read_documents(spark, path, [9, 3, 77]).collect()
    assert sorted((r.doc_id, r.ids) for r in picked) == sorted((i, x) for i in (9, 3) for x in want[i])
    if segment == 1:
        assert len([p for p in (tmp_path / "blocks").iterdir() if p.name.startswith("part-")]) > 6


def test_token_blocks_of_an_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    pfor.write_token_blocks(docs.limit(0), path, vocabulary("word_bpe_49k.json"), end_id=1)
    assert pfor.read_token_blocks(spark, path).count() == 0 and pfor.read_documents(spark, path, [1]).count() == 0


def test_counts(docs):
    lib = Tokenizer.from_str(vocabulary("byte_bpe_50k.json"))
    got = token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), limit=100)
    assert got.columns == ["doc_id", "text", "start", "n_tokens", "over_limit"]
    for r in got.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 100)
    assert token_counts.token_counts(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def one_by_one(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(bins) if r >= x]
        if fits:
            bins[min(fits)[1]] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def test_runs_equal_best_fit_one_by_one():
    rng = np.random.default_rng(2)
    for capacity in (1, 10, 37, 64):
        for _ in range(60):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 250)).tolist()
            histogram = {n: lengths.count(n) for n in set(lengths)}
            runs, bins = packing.best_fit_runs(histogram, capacity)
            assert bins == one_by_one(lengths, capacity)
            fill = {}
            for n, c in histogram.items():
                for r in range(c):
                    i = np.searchsorted(runs[:, 0], n << packing.SHIFT | r, "right") - 1
                    j = r - (runs[i, 0] & ((1 << packing.SHIFT) - 1))
                    fill.setdefault(int(runs[i, 1] + j // runs[i, 2]), []).append((int(runs[i, 3] + j % runs[i, 2] * n), n))
            assert len(fill) == bins
            for pieces in fill.values():
                at = 0
                for o, n in sorted(pieces):
                    assert o == at
                    at += n
                assert at <= capacity


def test_packing(docs):
    lib = Tokenizer.from_str(vocabulary("byte_bpe_50k.json"))
    got = packing.pack_best_fit(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=64).collect()
    want, lengths = [], []
    for i, t in ROWS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        at, piece, step = 0, 0, len(ids) % 64 or 64
        while at < len(ids):
            want.append((i, piece, at, step, zlib.crc32(np.array(ids[at : at + step], "<u4").tobytes())))
            lengths.append(step)
            at, piece, step = at + step, piece + 1, 64
    key = lambda x: (x[0] or -1, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(bins) == one_by_one(lengths, 64)
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack_best_fit(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0

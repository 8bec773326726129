"""Exact vectorised byte-pair tokenisation: numpy splits text into pre-tokens, a bounded cache maps each to its ids.

Pre-tokens that the cache lacks are encoded once by the tokenizers library; texts with special strings or with
characters outside a range whose classes are certain go to the library whole. The cache is emptied when full, so memory is bounded.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_TOP = 0x2070
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = np.uint64(0xD6E8FEB86659FD93)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower case, certain) by code point below _TOP; what isn't certain is left to the library."""
    cls, low, sure = np.full(_TOP + 1, OTHER, np.uint8), np.arange(_TOP + 1, dtype=np.int32), np.zeros(_TOP + 1, bool)
    for cp in range(_TOP):
        c = chr(cp)
        kind = unicodedata.category(c)
        if cp in (9, 10, 11, 12, 13, 32):
            cls[cp], sure[cp] = SPACE, True
        elif 33 <= cp <= 126 or 0xA1 <= cp <= 0x24F and cp not in (0xAD, 0x130) or 0x2010 <= cp <= 0x2027:
            cls[cp] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
            lower = c.lower()
            sure[cp] = len(lower) == 1 and unicodedata.normalize("NFC", c) == c and cp < 0x2028
            low[cp] = ord(lower[0])
    return cls, low, sure


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        n = max(n, 1 << 16)
        for i, r in enumerate((_R, _RINV)):
            x = np.full(n, r, np.uint64)
            x[0] = 1
            _POW[i] = np.multiply.accumulate(x)
    return _POW[0], _POW[1]


#: Spans beyond so many characters are named by a digest: long ones can be made that have equal polynomials.
LONG = 256


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """64-bit hash of values[start:end] for each span; equal content gives equal hashes wherever it stands. Spans ascend."""
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        lo = int(start[k])
        j = max(k + 1, int(np.searchsorted(end, lo + step, "right")))
        hi = int(end[k:j].max())
        pw, inv = _powers(hi - lo + 1)
        cum = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((values[lo:hi].astype(np.uint64) + np.uint64(31)) * _K * pw[: hi - lo], out=cum[1:])
        s, e = start[k:j] - lo, end[k:j] - lo
        x = (cum[e] - cum[s]) * inv[s] + (e - s).astype(np.uint64) * _R
        x ^= x >> np.uint64(29)
        x *= _K
        x ^= x >> np.uint64(32)
        out[k:j] = x
        k = j
    for i in np.flatnonzero(end - start > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(values[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class IdCache:
    """Open-addressing table from 64-bit keys to runs of ids."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.off, self.len, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if absent."""
        mask = np.uint64((1 << self.bits) - 1)
        out = np.full(len(keys), -1, np.int32)
        at = (keys >> np.uint64(17)) & mask
        slot = self.slot[at]
        hit = (slot >= 0) & (self.key[at] == keys)
        out[hit] = slot[hit]
        left = np.flatnonzero((slot >= 0) & ~hit)
        at = at[left]
        while len(left):
            at = (at + np.uint64(1)) & mask
            slot = self.slot[at]
            hit = (slot >= 0) & (self.key[at] == keys[left])
            out[left[hit]] = slot[hit]
            on = (slot >= 0) & ~hit
            left, at = left[on], at[on]
        return out

    def room(self, more: int) -> bool:
        return self.n + more <= (1 << self.bits) * 6 // 10

    def add(self, keys: np.ndarray, runs: list) -> None:
        """keys: distinct and absent."""
        lens = np.fromiter(map(len, runs), np.int32, len(runs))
        total = int(lens.sum())
        while len(self.len) < self.n + len(runs):
            self.off, self.len = np.concatenate([self.off, np.zeros_like(self.off)]), np.concatenate([self.len, np.zeros_like(self.len)])
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        new = np.arange(self.n, self.n + len(runs))
        self.len[new] = lens
        self.off[new] = self.used + np.cumsum(lens) - lens
        self.ids[self.used : self.used + total] = np.fromiter((i for r in runs for i in r), np.uint32, total)
        mask = np.uint64((1 << self.bits) - 1)
        at, left = (keys >> np.uint64(17)) & mask, np.arange(len(keys))
        while len(left):
            free = self.slot[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.slot[at[take]], self.key[at[take]] = new[left[take]], keys[left[take]]
            left, at = left[~take], (at[~take] + np.uint64(1)) & mask
        self.n += len(runs)
        self.used += total


class FastTokenizer:
    """Encodes batches of texts exactly as the tokenizers library encodes them, without added special tokens.

    Two layouts are split here: byte-level with the usual pattern, and the lower-casing word layout.
    Any other tokenizer file is encoded by the library alone.
    """

    def __init__(self, spec: str):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        j = json.loads(spec)
        pre, norm = j.get("pre_tokenizer") or {}, j.get("normalizer")
        self.kind = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "byte"
        elif norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            self.kind = "word"
        self.special = [t["content"] for t in j.get("added_tokens", []) if t.get("content")]
        self.cls, self.low, self.sure = _classes()
        self.cache = IdCache()
        self.misses = 0

    def library(self, texts: list[str]) -> list:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, cp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens; doc marks the first character of each text. cp is lower-cased for the word layout."""
        n = len(cp)
        cls = self.cls[cp]
        b = np.empty(n, bool)
        b[0] = True
        np.not_equal(cls[1:], cls[:-1], out=b[1:])
        b |= doc
        run = b.copy()
        nxt = np.zeros(n, bool)  # the next character begins another run of the same text
        nxt[:-1] = run[1:] & ~doc[1:]
        if self.kind == "byte":
            last = np.flatnonzero((cls == SPACE) & nxt)
            b[last] = True
            b[last[cp[last] == 32] + 1] = False
        else:
            b[cls == NUMBER] = True
        apo = np.flatnonzero((cp == 39) & b & run & nxt)
        apo = apo[cls[apo + 1] == LETTER] if len(apo) else apo
        if len(apo):
            c1 = cp[apo + 1]
            one = apo[np.isin(c1, [ord(x) for x in "stmd"])]
            b[one + 1] = False
            b[(one + 2)[one + 2 < n]] = True
            two = apo[apo + 2 < n]
            two = two[(cls[two + 2] == LETTER) & ~doc[two + 2]]
            c1, c2 = cp[two + 1], cp[two + 2]
            two = two[(c1 == 114) & (c2 == 101) | (c1 == 118) & (c2 == 101) | (c1 == 108) & (c2 == 108)]
            b[two + 1] = False
            b[two + 2] = False
            b[(two + 3)[two + 3 < n]] = True
        start = np.flatnonzero(b)
        end = np.append(start[1:], n)
        if self.kind == "word":
            keep = cls[start] != SPACE
            start, end = start[keep], end[keep]
        return start, end

    def split(self, texts: list[str]):
        """(characters, starts, ends and keys of all pre-tokens, number of pre-tokens of each text). Texts must be sure ones."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
        if not len(cp):
            none = np.zeros(0, np.int64)
            return cp, none, none, np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        if self.kind == "word":
            cp = self.low[cp]
        first = np.cumsum(lens) - lens
        doc = np.zeros(len(cp), bool)
        doc[first[lens > 0]] = True
        start, end = self.starts(cp, doc)
        return cp, start, end, span_hashes(cp, start, end), np.diff(np.searchsorted(start, np.append(first, len(cp))))

    def resolve(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The cache entry of every pre-token; the library encodes those that the cache lacks."""
        at = self.cache.find(keys)
        gone = np.flatnonzero(at < 0)
        if len(gone):
            new, idx = np.unique(keys[gone], return_index=True)
            if not self.cache.room(len(new)):
                self.cache.clear()
                gone = np.arange(len(keys))
                new, idx = np.unique(keys, return_index=True)
                while not self.cache.room(len(new)):  # one text alone has more
                    self.cache.bits += 1
                    self.cache.clear()
            pick = gone[idx]
            self.misses += len(pick)
            for i in range(0, len(pick), 8192):
                p = pick[i : i + 8192]
                words = [cp[s:e].tobytes().decode("utf-32-le") for s, e in zip(start[p], end[p], strict=True)]
                self.cache.add(new[i : i + 8192], self.library(words))
            at = self.cache.find(keys)
        return at

    def _sure(self, text: str) -> bool:
        if self.kind is None or any(s in text for s in self.special):
            return False
        if text.isascii() and text.isprintable():
            return True
        cp = np.frombuffer(text.encode("utf-32-le"), np.int32)
        return bool(self.sure[np.minimum(cp, _TOP)].all())

    def groups(self, texts: list[str], chars: int = 1 << 19):
        """Indices of the sure texts in groups of bounded size, and those left to the library."""
        sure, rest, group, size = [], [], [], 0
        for i, t in enumerate(texts):
            if not self._sure(t):
                rest.append(i)
                continue
            if group and size + len(t) > chars:
                sure.append(group)
                group, size = [], 0
            group.append(i)
            size += len(t)
        return [*sure, group] if group else sure, rest

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        sure, rest = self.groups(texts)
        for g in sure:
            *parts, n = self.split([texts[i] for i in g])
            at = self.resolve(*parts)
            ln = self.cache.len[at].astype(np.int64)
            cum = np.concatenate([[0], np.cumsum(ln)])
            flat = self.cache.ids[np.arange(cum[-1]) + np.repeat(self.cache.off[at] - cum[:-1], ln)]
            bounds = cum[np.concatenate([[0], np.cumsum(n)])]
            for k, i in enumerate(g):
                out[i] = flat[bounds[k] : bounds[k + 1]]
        for i in rest:
            out[i] = np.array(self.library([texts[i]])[0], np.uint32)
        return out

    def count(self, texts: list[str], frequent: IdCache | None = None) -> np.ndarray:
        """Tokens of each text. frequent: a table of single lengths that is asked before the cache."""
        out = np.zeros(len(texts), np.int64)
        sure, rest = self.groups(texts)
        for g in sure:
            cp, start, end, keys, n = self.split([texts[i] for i in g])
            ln = np.zeros(len(keys), np.int64)
            left = np.arange(len(keys))
            if frequent is not None:
                at = frequent.find(keys)
                ln[at >= 0] = frequent.ids[frequent.off[at[at >= 0]]]
                left = left[at < 0]
            at = self.resolve(cp, start[left], end[left], keys[left])
            ln[left] = self.cache.len[at]
            cum = np.concatenate([[0], np.cumsum(ln)])
            out[g] = np.diff(cum[np.concatenate([[0], np.cumsum(n)])])
        for i in rest:
            out[i] = len(self.library([texts[i]])[0])
        return out


_KEPT: dict[str, FastTokenizer] = {}


def tokenizer(spec: str) -> FastTokenizer:
    """One tokenizer with its cache for each Python worker and file."""
    name = hashlib.sha1(spec.encode()).hexdigest()
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = FastTokenizer(spec)
    return _KEPT[name]

"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, one scan of every text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloakframe.llm.common import materialise

#: A-Z become lower case; every byte of ASCII that is no letter or digit becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Characters of all windows in one automaton (some 100 bytes of memory each). A larger benchmark is scanned in several passes.
WINDOW_CHARS = 2_000_000


def normal(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows(items: list, size: int) -> dict[str, list[int]]:
    """Window text with a space at both ends, to the places in items of the items that have it. An item of fewer words is one window."""
    found: dict[str, list[int]] = {}
    for i, (_, text) in enumerate(items):
        words = normal(text)
        for k in range(max(1, len(words) - size + 1) if words else 0):
            w = (b" " + b" ".join(words[k : k + size]) + b" ").decode("latin-1")
            if i not in found.setdefault(w, []):
                found[w].append(i)
    return found


_BUILT: dict = {}


def automaton(key: str, items: list, size: int):
    if key not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for w, where in windows(items, size).items():
            a.add_word(w, (len(w), w.count(" ") - 1, where))
        if len(a):
            a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def scan(text: str | None, a) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words of the text, runs of hit words [first, last), places of the items found)."""
    words = normal(text)
    if not words or not len(a):
        return len(words), [], set()
    s = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits, items, spaces = [], set(), None
    for end, (chars, n, where) in a.iter(s):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(s.encode("latin-1"), np.uint8) == 32)
        first = int(np.searchsorted(spaces, end - chars + 1))
        items.update(where)
        if hits and first <= hits[-1][1] and first >= hits[-1][0]:
            hits[-1] = (hits[-1][0], max(hits[-1][1], first + n))
        else:
            hits.append((first, first + n))
    return len(words), merge(hits), items


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans of code points of the original text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = np.frombuffer(raw.tobytes().translate(TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(chars[start[lo]]), int(chars[end[hi - 1]])) for lo, hi in runs]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", window_chars: int = WINDOW_CHARS) -> DataFrame:
    """docs with n_words, n_hit (long), hit_spans (array of start, end: code points of the original text) and items (sorted array of string).

    Columns of docs with those names are replaced. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    Each run of ``window`` words of an item is looked for; a shorter item is looked for whole; one without words or with a null text never occurs.
    A null item_id marks words but isn't listed. Repeated items count once. Null and empty texts have no words and no hits.
    Empty tables give no rows or no hits. The benchmark is read item by item in parts whose windows fit one automaton, so its size isn't bounded, and
    the driver holds two parts at most; each part is one pass over the texts, and the first part is all there is for any usual benchmark.
    """
    spark = docs.sparkSession
    own = ["n_words", "n_hit", "hit_spans", "items"]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    base = docs.drop(*own)
    at = base.columns.index(text)

    def parts() -> Iterator[list]:
        part, size = [], 0
        for r in benchmark.select(item_id, item_text).toLocalIterator():
            words = normal(r[1])
            chars = sum(map(len, words)) * min(window, max(1, len(words)))
            if part and size + chars > window_chars:
                yield part
                part, size = [], 0
            part.append((None if r[0] is None else str(r[0]), r[1]))
            size += chars
        yield part

    held_schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("__cloakframe_runs", span), T.StructField("items", T.ArrayType(T.StringType()))])
    final = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", span), T.StructField("items", T.ArrayType(T.StringType()))])
    n_base = len(base.columns)
    spans_type, names_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
    cur, rest, k = base, parts(), 0
    part = next(rest)
    while part is not None:  # the driver holds this part and the next
        held, after = spark.sparkContext.broadcast(part), next(rest, None)
        last = after is None

        def search(batches: Iterator[pa.RecordBatch], held=held, k=k, last=last) -> Iterator[pa.RecordBatch]:
            items = held.value
            a = automaton(f"{k}:{window}:{hash(tuple(items))}", items, window)
            for b in batches:
                n_words, runs, names, n_hit = [], [], [], []
                old = (b.column(n_base + 1).to_pylist(), b.column(n_base + 2).to_pylist()) if k else None
                for i, t in enumerate(b.column(at).to_pylist()):
                    n, hit, found = scan(t, a)
                    found = {items[x][0] for x in found} - {None}
                    if k:
                        hit = merge([*hit, *((x["start"], x["end"]) for x in old[0][i])])
                        found |= set(old[1][i])
                    n_words.append(n)
                    n_hit.append(sum(hi - lo for lo, hi in hit))
                    runs.append([{"start": lo, "end": hi} for lo, hi in (char_spans(t, hit) if last and hit else hit)])
                    names.append(sorted(found))
                counted = [pa.array(n_hit, pa.int64())] if last else []
                yield pa.RecordBatch.from_arrays([*b.columns[:n_base], pa.array(n_words, pa.int64()), *counted, pa.array(runs, spans_type), pa.array(names, names_type)], names=(final if last else held_schema).names)

        cur = cur.mapInArrow(search, final if last else held_schema)
        if not last:
            cur = materialise(cur, "decontam")
            held.destroy()
        part, k = after, k + 1
    return cur

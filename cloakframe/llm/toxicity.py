"""Toxicity by a weighted lexicon that is matched with Aho-Corasick on folded text.

Folding undoes homoglyphs and digit substitutions. Entries are whole words or beginnings of words, with the weight that
labelled documents give them; exception phrases (a word, or a word with the one before or after it) silence a match. The weights found are
summed and normalised by length; a logistic curve fitted on other labelled documents turns both into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import materialise

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Entries of the lexicon, and exceptions, at most.
ENTRIES = 2_000
#: Lengths of beginnings of words that may become entries.
STEMS = (4, 5, 6, 7)

# Look-alike characters and digit substitutions, by the letter that they stand for.
LOOKALIKES = {
    "a": "аАαΑ@4",
    "b": "ЬьВвβΒ8",
    "c": "сСϲ",
    "d": "ԁ",
    "e": "еЕεΕ3",
    "g": "ɡ9",
    "h": "һНнΗ",
    "i": "іІιΙ1¡!",
    "j": "јЈ",
    "k": "кКκΚ",
    "l": "ӏӀ|",
    "m": "мМΜ",
    "n": "ηΝ",
    "o": "оОοΟ0",
    "p": "рРρΡ",
    "s": "ѕЅ5$",
    "t": "тТτΤ7",
    "u": "υ",
    "v": "νѵ",
    "w": "ѡω",
    "x": "хХχΧ",
    "y": "уУγΥ",
    "z": "Ζ",
}
_STANDS_FOR = {c: k for k, v in LOOKALIKES.items() for c in v}


class _Folding(dict):
    """Code point to what it folds to: compatibility forms and marks undone, then look-alikes, then lower case. Filled as characters are met."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        parts = c if c in _STANDS_FOR or 0xAC00 <= cp <= 0xD7A3 else unicodedata.normalize("NFKD", c)
        kept = [x for x in parts if unicodedata.category(x) not in ("Mn", "Me", "Cf")]
        self[cp] = "".join(_STANDS_FOR.get(x, x) for x in kept).lower()
        return self[cp]


FOLDING = _Folding()
WORD = re.compile(r"[^\W\d_]+")
LOOSE = re.compile(r"[$@!|]+(?![^\W_])|(?<![^\W_])[!|]+")
NUMBER = re.compile(r"(?<![^\W_])[\d.,:+-]*\d(?![^\W_])")


def fold(text: str | None) -> str:
    """Lower case without marks, look-alikes as the letters that they stand for. Signs and digits are folded within words only."""
    t = text or ""
    if any(x in t for x in "$@!|"):
        t = LOOSE.sub(" ", t)
    return NUMBER.sub(" ", t).translate(FOLDING)


def terms(words: list[str]) -> set[str]:
    """'=word' for whole words, '^stem' for beginnings."""
    found: set[str] = set()
    for w in set(words):
        if len(w) >= 3:
            found.add("=" + w)
            found.update("^" + w[:k] for k in STEMS if len(w) > k)
    return found


def phrases(words: list[str], k: int) -> list[str]:
    """The word at k alone, with the one before and with the one after."""
    return [words[k], *([f"{words[k - 1]} {words[k]}"] if k else []), *([f"{words[k]} {words[k + 1]}"] if k + 1 < len(words) else [])]


@dataclass
class ToxicityModel:
    """weights: by term ('=word' or '^stem'). exceptions: words and 'word word' phrases. coef: bias, log total, total by length."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    coef: tuple[float, float, float]

    def automaton(self):
        a = ahocorasick.Automaton()
        by: dict[str, dict[str, float]] = {}
        for term, w in self.weights.items():
            by.setdefault(term[1:], {})[term[0]] = w
        for k, v in by.items():
            a.add_word(k, (len(k), v.get("="), v.get("^")))
        if len(a):
            a.make_automaton()
        return a

    def measure(self, text: str | None, a) -> tuple[float, int]:
        """(weights matched, words). At each word the longest entry counts, unless the word or phrase is an exception."""
        t = fold(text)
        n = t.count(" ") + t.count("\n") + 1
        if not len(a):
            return 0.0, n
        best: dict[int, float] = {}
        for end, (size, whole, stem) in a.iter(t):
            start = end - size + 1
            if start and t[start - 1].isalpha():
                continue
            closed = end + 1 == len(t) or not t[end + 1].isalpha()
            w = whole if closed and whole is not None else stem if not closed else None
            if w is not None:
                best[start] = w
        if not self.exceptions or not best:
            return sum(best.values()), n
        spans = [m.span() for m in WORD.finditer(t)]
        words, starts = [t[a:b] for a, b in spans], [a for a, _ in spans]
        return sum(w for start, w in best.items() if not self.exceptions.intersection(phrases(words, bisect_left(starts, start)))), n

    def score(self, total: float, n: int) -> float:
        b, c1, c2 = self.coef
        z = b + c1 * math.log1p(total) + c2 * total / math.sqrt(n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counts(docs: DataFrame, wanted: frozenset | None) -> dict[str, int]:
    """Documents that have each term; wanted: only these. docs: (text), a bounded sample."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found = terms(WORD.findall(fold(t)))
                c.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["term", "n"])

    rows = docs.mapInArrow(tally, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n >= 3").collect()
    return {r["term"]: r["n"] for r in rows}


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) with the smallest hashes of the text's runs of three folded words: three, or one where y is 1."""
    for b in batches:
        found = []
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = WORD.findall(fold(t))
            runs = {zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))}
            found.append(sorted(runs)[: 1 if y == 1 else 3])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=["text", "y", "sketch"])


def fit_toxicity(labelled: DataFrame, text: str = "text", label: str = "toxic", entries: int = ENTRIES, min_docs: int = 5, min_share: float = 0.02, min_log_odds: float = 2.5) -> ToxicityModel:
    """Fit on labelled rows (text, label 0 or 1): a bounded sample, as of labelled_sample.

    Copies of a text count as one, so that they don't make its words look telling: rows of label 1 that share the smallest hash of their
    runs of three folded words, and rows of label 0 that share the three smallest.
    Four fifths of those give the lexicon, the rest the curve. Null labels are left out; without rows of both labels
    no entry is learned and every score is the share of label 1.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("y"))
    rows = rows.mapInArrow(sketch, "text string, y int, sketch array<long>")
    rows = rows.groupBy("sketch", "y").agg(F.min("text").alias("text")).select("text", "y", (F.pmod(F.xxhash64("sketch"), F.lit(5)) == 0).alias("curve"))
    rows = materialise(rows, "labelled")  # at most train_rows texts
    lex = rows.where(~F.col("curve"))
    size = {r["y"]: r["n"] for r in lex.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        p = min(max((n1 + 0.5) / (n1 + n0 + 1), 1e-6), 1 - 1e-6) if n1 + n0 else 1e-3
        return ToxicityModel({}, frozenset(), (math.log(p / (1 - p)), 0.0, 0.0))
    least = max(min_docs, round(min_share * n1))
    pos = {k: v for k, v in _counts(lex.where("y = 1").select("text"), None).items() if v >= least}
    neg = _counts(lex.where("y = 0").select("text"), frozenset(pos)) if pos else {}
    odds = {k: math.log((v + 0.5) / (n1 + 1)) - math.log((neg.get(k, 0) + 0.5) / (n0 + 1)) for k, v in pos.items()}
    good = {k: min(v, 6.0) for k, v in odds.items() if v >= min_log_odds and pos[k] > 2 * neg.get(k, 0)}
    most: dict[str, int] = {}
    for k in good:
        for m in STEMS:
            if m < len(k) - 1 or k[0] == "=" and m == len(k) - 1:
                stem = "^" + k[1 : 1 + m]
                most[stem] = max(most.get(stem, 0), pos[k])
    chosen: dict[str, float] = {}
    for k in sorted(good, key=lambda k: (len(k), k)):  # a stem must add to the words and stems that begin with it, and then stands for them
        if k[0] == "^" and pos[k] < 1.3 * most.get(k, 0) or any("^" + k[1 : 1 + m] in chosen for m in STEMS if m < len(k) - 1):
            continue
        chosen[k] = good[k]
    chosen = dict(sorted(chosen.items(), key=lambda x: (-x[1] * pos[x[0]], x[0]))[:entries])
    draft = ToxicityModel(chosen, frozenset(), (0.0, 1.0, 0.0))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: dict = {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall(fold(t))
                found = set()
                for k, w in enumerate(words):
                    if "=" + w in chosen or any("^" + w[:m] in chosen for m in STEMS if len(w) > m):
                        found.update(phrases(words, k))
                for x in found:
                    c.setdefault(x, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([x[0] for x in c.values()], pa.int64()), pa.array([x[1] for x in c.values()], pa.int64())], names=["phrase", "n0", "n1"])

    silent = lex.select("text", "y").mapInArrow(matched, "phrase string, n0 long, n1 long").groupBy("phrase").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 >= 3 and n0 > 2 * n1").orderBy(F.desc("n0"), "phrase").limit(entries).collect()
    model = ToxicityModel(chosen, frozenset(r["phrase"] for r in silent), draft.coef)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in batches:
            m = [model.measure(t, a) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.int64()), b.column(1)], names=["s", "n", "y"])

    got = rows.where("curve").select("text", "y").mapInArrow(features, "s double, n long, y int").collect()  # at most train_rows small rows
    if len({r["y"] for r in got}) == 2:
        x = np.array([(1.0, math.log1p(r["s"]), r["s"] / math.sqrt(r["n"])) for r in got])
        y = np.array([r["y"] for r in got], float)
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.05, 0.05])
            step = np.linalg.solve(h, x.T @ (y - p) - np.array([1e-6, 0.05, 0.05]) * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        model.coef = (float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2])))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """docs with ``score`` (double, 0 to 1) in place of any column so named.

    Null and empty texts match nothing and get the score of no match. Repeated rows get equal scores; an empty table gives an empty table.
    Whole texts are scanned, each once and without a shuffle; the model is bounded by ENTRIES.
    """
    base = docs.drop(score)
    at = base.columns.index(text)
    held, names = docs.sparkSession.sparkContext.broadcast(model), [*base.columns, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        a = m.automaton()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(*m.measure(t, a)) for t in b.column(at).to_pylist()], pa.float64())], names=names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(score, T.DoubleType())]))


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most train_rows labelled documents, those that hash first. The labels, so bounded, are broadcast."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

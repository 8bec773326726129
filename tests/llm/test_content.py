"""Toxicity, personal data and the pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import bootstrap_pii as B
from cloakframe.llm import toxicity
from cloakframe.llm.entry import oracle_sql, queries, toxicity_model

D = "/root/testdata/sf0.01"


def test_fold():
    assert toxicity.fold("1d10t іdіоt $cum id​iot") == "idiot idiot scum idiot"
    assert toxicity.fold("at 10.5 and a$$$ x@y") == "at   and a  xay"
    assert toxicity.fold(None) == ""


@pytest.mark.parametrize("text", ["bastard", "BASTARD", "ВAЅТАRD", "вaѕтаrd", "b4st4rd", "b@stard", "bástàrd", "𝐛𝐚𝐬𝐭𝐚𝐫𝐝", "ｂａｓｔａｒｄ", "ＢＡＳＴＡＲＤ", "b\u200bast\u00adard", "𝔹𝕒𝕤𝕥𝕒𝕣𝕕", "8astard", "ba5tard", "bastArd", "ΒΑSΤΑRD"])
def test_folding_undoes_homoglyphs(text):
    assert toxicity.fold(text) == "bastard"


@pytest.mark.parametrize("letter", sorted(toxicity.LOOKALIKES))
def test_folding_table(letter):
    for c in toxicity.LOOKALIKES[letter]:
        assert toxicity.fold(f"q{c}q") == f"q{letter}q"


def test_folding_leaves_signs_and_numbers_outside_words():
    assert toxicity.fold("great! id!ot |a| 12:30 no|w").split() == ["great", "idiot", "a", "nolw"]
    assert toxicity.fold("한글 漢字 ß") == "한글 漢字 ß"


def naive(model, text):
    """The same total without an automaton: at each word the longest entry."""
    t = toxicity.fold(text)
    words = [(m.start(), m[0]) for m in toxicity.WORD.finditer(t)]
    total = 0.0
    for k, (_, w) in enumerate(words):
        weight = model.weights.get("=" + w)
        if weight is None:
            weight = next((model.weights["^" + w[:n]] for n in range(len(w) - 1, 0, -1) if "^" + w[:n] in model.weights), None)
        near = [w, *([f"{words[k - 1][1]} {w}"] if k else []), *([f"{w} {words[k + 1][1]}"] if k + 1 < len(words) else [])]
        if weight is not None and not model.exceptions.intersection(near):
            total += weight
    return total


def test_automaton_matches_as_a_naive_matcher():
    rnd = random.Random(3)
    pool = ["bad", "badly", "badness", "awful", "awfully", "not", "very", "switch", "xbad", "b4d", "B@D", "аwful", "kill", "killer", "é", "漢"]
    m = toxicity.ToxicityModel({"=bad": 2.0, "^badn": 1.5, "^awfu": 3.0, "=awful": 0.5, "=kill": 4.0, "^kil": 0.25}, frozenset({"not bad", "kill switch", "awfully"}), (-2.0, 1.0, 1.0))
    a = m.automaton()
    for _ in range(2000):
        t = "".join(rnd.choice(pool) + rnd.choice([" ", ", ", "\n", "-", "  ", "! "]) for _ in range(rnd.randint(0, 9)))
        assert m.measure(t, a)[0] == pytest.approx(naive(m, t)), t
    long = "word " * 300_000 + "bad"
    assert m.measure(long, a) == (2.0, 300_001)


def test_exceptions_are_learned_and_silence(spark):
    rnd = random.Random(7)

    def prose(n=30):
        return " ".join("".join(rnd.choice("bcdfghlmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4))) for _ in range(n))

    rows = [(f"{prose()} you are vile {prose()}", 1) for _ in range(120)] + [(f"{prose()} the vile weed {prose()}", 0) for _ in range(8)] + [(prose(60), 0) for _ in range(800)]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "text string, toxic int"))
    assert "=vile" in model.weights and {"the vile", "vile weed"} <= model.exceptions and "vile" not in model.exceptions
    df = spark.createDataFrame([(1, f"{prose()} you are vile {prose()}"), (2, f"{prose()} the vile weed {prose()}"), (3, prose(60)), (None, None)], "doc_id long, text string")
    got = [r.score for r in toxicity.score_toxicity(df, model).collect()]
    assert got[0] >= 0.5 > max(got[1:]) and got[1] == pytest.approx(got[2], abs=0.2)


def test_toxicity_query_holds_out_its_fold(spark):
    got = queries()["op2_toxicity_lexicon"](spark, D).collect()
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_model_measures():
    m = toxicity.ToxicityModel({"=bad": 2.0, "^awfu": 3.0}, frozenset({"not bad", "awfully"}), (-2.0, 1.0, 1.0))
    a = m.automaton()
    assert m.measure("bad badly xbad b4d", a)[0] == 4.0
    assert m.measure("not bad awfulness awfully", a)[0] == 3.0
    assert m.measure(None, a)[0] == 0 and m.score(0, 1) < 0.5 < m.score(8, 4)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_model(docs, labels)
    assert len(model.weights) <= toxicity.ENTRIES
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("doc_id", "toxic")
    got = toxicity.score_toxicity(docs.join(held, "doc_id"), model).select("toxic", "score").collect()
    hits = sum(r.score >= 0.5 for r in got if r.toxic)
    false = sum(r.score >= 0.5 for r in got if not r.toxic)
    assert hits >= 0.85 * sum(r.toxic for r in got) and false <= 0.01 * len(got)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(none)
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "idiot", "c"), (3, "idiot", "c")], "doc_id long, text string, score string")
    got = toxicity.score_toxicity(df, model).collect()
    assert all(0 <= r.score < 0.5 for r in got) and len(got) == 4
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(map(int, str(int(x) * (1 + i % 2)))) for i, x in enumerate(reversed(d))) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


@pytest.mark.parametrize("alphabet", ["a1@.-_%+ ", "0123456789 -", "+12()-. 5", "1.2.25", " 4111-"])
def test_base_spans(alphabet):
    rnd = random.Random(5)
    for _ in range(4000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert B.base_spans(t) == brute(t)


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000, "a@b." * 50_000])
def test_base_spans_take_linear_time(text):
    began = time.time()
    B.wide_spans(text, B.base_spans(text))
    assert time.time() - began < 5


@pytest.mark.parametrize("at", ["at", "AT", "At", "aT"])
def test_written_out_addresses_in_any_case(at):
    text = f"JOHN ({at}) EXAMPLE (DOT) COM"
    assert B.wide_spans(text, B.base_spans(text)) == [("email", 0, len(text))]


@pytest.mark.parametrize("bound", [200_000, 1])
def test_patterns_discover_identifiers(spark, bound):
    rows = [(i, f"some words here {w} call me at +1 (202) 555-{i:04d} thanks") for i, w in enumerate("abcdefghij")]
    rows += [(100, "please call me at 202-555-0199 thanks"), (101, "the number 202-555-0199 is here"), (102, None), (103, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in B.find_pii(df, broadcast_patterns=bound).collect()}
    assert got[100] == [("phone", 18, 30, False)] and got[101] == got[102] == got[103] == []
    assert all(len(got[i]) == 1 and got[i][0][3] for i in range(10))
    assert B.find_pii(df.limit(0)).count() == 0


def brute_patterns(edges, rounds, min_score, least, prior):
    """The scoring by its definition, on Python dictionaries."""
    of, seeds, unknown = {}, {}, []
    for p, family, kind, fits, i in edges:
        of.setdefault((p, family), set()).add(i)
        if kind:
            seeds.setdefault((p, family, kind), set()).add(i)
        unknown += [(p, family, k, i) for k in (fits if not kind else ())]
    promoted = set()
    while True:
        own = {k: set(v) for k, v in seeds.items()}
        for p, family, k, i in unknown:
            if (i, k) in promoted:
                own.setdefault((p, family, k), set()).add(i)
        known = {k: len(v) for k, v in own.items() if len(v) >= least}
        rest = {(p, f, k, i) for p, f, k, i in unknown if (i, k) not in promoted and (p, f, k) in known}
        score = {x: n / (len(of[x[:2]]) + prior) for x, n in known.items()}
        for _ in range(rounds if rest else 0):
            worth = {}
            for p, f, k, i in rest:
                worth[i, k] = max(worth.get((i, k), 0), score[p, f, k])
            gain = {}
            for p, f, k, i in rest:
                gain[p, f, k] = gain.get((p, f, k), 0) + worth[i, k]
            score = {x: (n + gain.get(x, 0)) / (len(of[x[:2]]) + prior) for x, n in known.items()}
        sure = {x: v for x, v in score.items() if v >= min_score}
        new = {(i, k) for p, f, k, i in rest if (p, f, k) in sure}
        if not new:
            best = {}
            for (p, f, k), v in sure.items():
                best[p, f] = max(best.get((p, f), (0,)), (v, known[p, f, k], k))
            return {(*x, v[2], round(v[0], 9)) for x, v in best.items()}
        promoted |= new


def test_pattern_scores(spark):
    rnd = random.Random(21)
    for seed in range(3):
        edges = set()
        for i in range(120):
            kind = rnd.choice(["card", "phone", "email", None, None])
            family = "email" if kind == "email" else "number"
            fits = () if kind else rnd.choice([("card",), ("phone",), ("card", "phone"), ()])
            for _ in range(rnd.randint(1, 4)):
                edges.add((f"p{min(rnd.randrange(12), rnd.randrange(12)) if kind != 'phone' else rnd.randrange(4)}", family, kind, fits, i))
        df = spark.createDataFrame([(*e, 1) for e in edges], "pattern string, family string, kind string, fits array<string>, instance long, n long")
        for least, score in ((2, 0.3), (4, 0.5)):
            got = {(r.pattern, r.family, r.kind, round(r.score, 9)) for r in B.score_patterns(df, min_instances=least, min_score=score).collect()}
            assert got == brute_patterns(edges, 3, score, least, 2.0)


def test_hidden_seeds_come_back(spark):
    """Half of the phones, addresses and keys are written so that no base pattern knows them; decoys stand in contexts of no kind."""
    rnd = random.Random(17)

    def noise(n):
        return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(n))

    rows, hidden, decoys = [], set(), set()
    for i in range(240):
        number = f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        value = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        kind = i % 4
        if kind == 0:
            shown = [f"call me at +1 {number}", f"call me at {number}"][i // 4 % 2]
        elif kind == 1:
            shown = [f"write to ann{i}@mail.example.com", f"write to ann{i} (at) mail (dot) example (dot) com"][i // 4 % 2]
        elif kind == 2:
            shown = [f'api key = "{value}"', f'api key = "{value[:20]}Zq_{value[20:24]}"'][i // 4 % 2]
        else:
            shown = rnd.choice([f"order number {rnd.randint(10**9, 10**10 - 1)} was", f"commit {value} broke", f"ratio {rnd.randint(10**7, 10**8)} of"])
            decoys.add(i)
        if kind < 3 and i // 4 % 2:
            hidden.add(i)
        rows.append((i, f"{noise(6)} {shown} {noise(5)}"))
    got = {r.doc_id: [s for s in r.spans if not s.base] for r in B.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i for i, v in got.items() if v and i in hidden}
    wrong = {i for i, v in got.items() if v and i in decoys}
    assert len(found) / len(hidden) >= 0.95 and not wrong  # recall and precision of what was hidden


def test_next_generation(spark):
    """A number that a sure pattern admits makes another context sure, which no base seed stands in."""
    numbers = [f"202-555-{1000 + i}" for i in range(12)]
    rows = [f"please call me at +1 (303) 555-{i:04d} now {chr(97 + i)}" for i in range(20)] + [f"please call me at {n} now" for n in numbers[:11]]
    rows += [f"tel: {n}" for n in numbers] + ["size 4441234567 mm", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in B.find_pii(df.union(df.limit(3))).collect()}
    assert all(got[i] == [("phone", False)] for i in range(20, 43)) and got[43] == got[44] == got[45] == []


def test_personal_data_query(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = queries()["op4_bootstrapped_pii"](spark, D).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r.doc_id])
        own = ",".join(f"{k}:{a}:{e}" for k in B.KINDS for a, e in want[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in B.KINDS) and r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert set(own.split(",")) - {""} <= {":".join(x) for x in spans} and len(spans) == r.n_spans
        assert spans == sorted(spans, key=lambda x: (B.ALL_KINDS.index(x[0]), int(x[1])))
    assert sum(r.n_discovered for r in got) == sum(len(re.findall('token = "[0-9a-f]{32,}"', t)) for t in rows.values()) > 0


def test_registered_queries():
    names = queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert set(oracle_sql()) <= set(names)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").where("toxic = 1").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    kept = steps["toxicity"](spark, docs, D)
    assert kept.columns == columns
    gone = set(before) - {r.doc_id for r in kept.select("doc_id").collect()}
    assert gone and len(gone & toxic) > 0.5 * len(toxic)
    lines = steps["line dedup"](spark, docs, D)
    assert lines.columns == columns and lines.where("n_chars <> length(text)").count() == 0 and lines.count() == len(before)
    alone = steps["n-gram Jaccard join"](spark, docs, D)
    assert alone.columns == columns and 900 < alone.count() < len(before)
    clean = steps["benchmark decontamination"](spark, docs, D)
    assert clean.columns == columns and 950 < clean.count() < len(before)
    packed = corpus_pipeline.run(spark, D)
    total, sequences = packed.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert sequences <= total / 2048 + 2


def test_near_copies_go_row_by_row(spark):
    def text(c):
        return " ".join(f"{c}{i}" for i in range(60))

    # repeated rows; copies without an id; one id with two texts, of which one is a near copy of a smaller id; two components with one least id
    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (None, text("b")), (5, text("a") + " more"), (5, text("c")), (7, text("d")), (7, text("e")), (8, text("e")), (None, text("e")), (9, None), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_copies(spark, df, D)
    want = [(1, text("a")), (None, text("b")), (5, text("c")), (7, text("d")), (7, text("e")), (9, None), (9, None), (9, "")]
    assert got.columns == df.columns and Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_stages_keep_columns_with_names_of_their_own(spark):
    names = ["score", "n_lines", "n_dropped", "node", "component", "n_words", "n_hit", "items", "hit_spans", "key", "at", "k", "d", "th"]
    rows = [(i, f"some plain text number {i} with a few words\nand a second line {i}", "en", "s", 0, *range(len(names))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df.repartition(3), D)
        assert out.columns == df.columns and all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect()), name


def test_stages_bear_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (None, "some text", None, None, 9), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "w " * 5000, "en", "s", 10000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (df, df.limit(0)):
        cur = part
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, cur, D)
            assert (out.count() > 0) == (part is df), name
            if name != "best-fit packing":
                assert out.columns == df.columns
                cur = out

"""Hard negatives, language filters and the divergence audit against plain Python, on awkward tables."""

import math
import random
import re
from collections import Counter

import brute_llm as brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import divergence, language, negatives
from factorloom.llm.transducer import Transducer, build

SF_DIR = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, row string, c0_ string"


def awkward_vectors():
    rng = random.Random(3)
    say = lambda scale: [rng.gauss(0, 1) * scale for _ in range(6)]
    rows = [(i, say(rng.choice([0.1, 0.1, 0.5])), i % 3, "x", "c") for i in range(230)]
    same = say(0.3)
    rows += [(i, same, i % 2, None, "c") for i in range(300, 330)]  # equal vectors, so equal scores
    rows += [(100, say(0.2), 1, "x", "c"), (200, rows[200][1], 2, "x", "c"), (None, say(0.2), 1, "x", "c"), (400, None, 1, "x", "c"), (500, say(0.1), None, "x", "c")]
    rows += [(600, [0.1, float("nan"), 0.2], 1, "x", "c"), (700, [0.1, None], 1, "x", "c"), (800, [float("inf")] * 6, 1, "x", "c")]
    rows += [(900, [], 1, "x", "c"), (901, [0.3, 0.2], 0, "x", "c"), (902, [0.0] * 6, 1, "x", "c"), (1000, [0.0] * 6, 1, "x", "c"), (1100, [0.4, -0.1], 0, "x", "c")]
    return rows


def mined(rows, rule):
    kept = []
    for vec_id, v, label, *_ in rows:
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * float(np.float32(x))) for x in v]
            kept.append((vec_id if vec_id is not None else 2**63 - 1, v, label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (anchor, a, label) in enumerate(kept):
        if anchor % 100 or anchor == 2**63 - 1:
            continue
        scored = sorted((-dot(a, v), vec_id, lab, j) for j, (vec_id, v, lab) in enumerate(kept) if j != i)
        for p, positive, _, _ in [s for s in scored if s[2] == label][: rule.positives]:
            fit = [s for s in scored if s[2] != label and rule.low * -p <= 100 * -s[0] <= rule.high * -p]
            out += [(anchor, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit[: rule.negatives])]
    return sorted((a, None if p == 2**63 - 1 else p, r, None if n == 2**63 - 1 else n, x, y) for a, p, r, n, x, y in out)


@pytest.mark.parametrize("wave", [8192, 4])
def test_negatives(spark, monkeypatch, wave):
    monkeypatch.setattr(negatives, "WAVE", wave)
    rows, rule = awkward_vectors(), negatives.Rule()
    got = negatives.mine(negatives.prepared(spark.createDataFrame(rows, VECTORS).repartition(3)), rule)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    key = lambda r: tuple(2**63 if x is None else x for x in r)
    want = mined(rows, rule)
    assert len(want) > 50
    assert sorted(map(key, (tuple(r) for r in got.collect()))) == sorted(map(key, want))


def test_negatives_of_nothing(spark):
    assert negatives.mine(negatives.prepared(spark.createDataFrame([], VECTORS))).count() == 0
    assert negatives.mine(negatives.prepared(spark.createDataFrame([(1, [1.0], 1, "", "")], VECTORS))).count() == 0


def test_scores_beyond_doubles(spark):
    big = [(100, [1e30, 1.0], 1, "", ""), (1, [1e6, 3.0], 1, "", ""), (2, [0.001, 2.0], 0, "", ""), (3, [3e9, 3e9], 0, "", "")]
    got = negatives.mine(negatives.prepared(spark.createDataFrame(big, VECTORS)))
    assert {abs(r["positive_score"]) <= negatives.LIMIT for r in got.collect()} <= {True}
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**14 + 1, 5.0]])
    assert negatives.products(a, b).tolist() == [[(2**40 + 1) * (2**14 + 1) + 15]]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_pruned_candidates_hold_all_that_reach_the_bound(spread):
    """Clustered vectors take the path of intersected slices, spread ones that of the whole bucket."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 600)] + spread * rng.normal(size=(600, 16))
    vectors = np.floor(1000 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    bucket, anchors = negatives.Bucket(vectors), vectors[:90]
    whole = (anchors @ vectors.T).astype(np.int64)
    bounds = np.sort(whole, axis=1)[:, -10].astype(float)
    assert bucket.feasible(anchors, bounds)[0].all()
    seen = {(i, j) for some, cols, scores in bucket.scored(anchors, bounds) for a, i in enumerate(some) for b, j in enumerate(cols) if scores[a, b] == whole[i, j]}
    assert {(i, j) for i, j in zip(*np.nonzero(whole >= bounds[:, None]), strict=True)} <= seen
    if spread < 1:
        assert len(seen) < whole.size / 4


TEXTS = [
    (1, "der Hund und die Katze sind nicht hier", "de"),
    (2, "der Mann und die Frau sind nicht dort", "de"),
    (3, "the dog and the cat are not here", "en"),
    (4, "the man and the woman are not there", "en"),
    (5, "the sun and the moon are not there", "en"),
    (5, "the sea and the sky", "en"),
    (6, None, "en"),
    (7, "123 -- !!", "xx"),
    (8, "und die Katze", None),
    (None, "der Hund", "de"),
    (9, "日本", "ja"),
]


def slow_votes(text: str, f: language.Filter):
    """The bits of every n-gram of the words, one after the other."""
    letters = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    data = f" {letters} ".encode() if letters else b""
    total, hits = 0, [0] * len(f.languages)
    for n in language.SIZES:
        for i in range(len(data) - n + 1):
            gram = np.array([int.from_bytes(data[i : i + n], "big") | n << 56], np.uint64)
            mask = ~0
            for s in language.slot_numbers(gram, f.hashes, f.masks.shape[1]):
                mask &= int(f.masks[0, s[0]])
            total += 1
            for k in range(len(f.languages)):
                hits[k] += mask >> k & 1
    return total, hits


def test_language(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, letters_ string, c0_ int, `odd.name` int"
    docs = spark.createDataFrame([(*r, "q", 1, 2) for r in TEXTS], schema)
    f = language.fit(docs, language.Rule(share=0.3, slots=1 << 12))
    assert set(f.languages) == {"de", "en", "ja"} and f.languages[0] == "en"
    texts = [t or "" for _, t, _ in TEXTS] + ["x", "und the " * 500, "Ünder çà"]
    column = pa.array([" " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " " if re.search(r"[^\W\d_]", t) else "" for t in texts])
    want = [slow_votes(t, f) for t in texts]
    total, hits = language.votes(column, f)
    assert [(int(a), b.tolist()) for a, b in zip(total, hits, strict=True)] == want
    monkeypatch.setattr(language, "WINDOW", 64)
    again = language.votes(column, f)
    assert (again[0] == total).all() and (again[1] == hits).all()
    got = language.identify(docs, f)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    said = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in got.collect()}
    assert len(said) == len(TEXTS)
    assert said[(6, None)] == said[(7, "123 -- !!")] == ("und", 0.0)
    assert said[(8, "und die Katze")][0] == "de" and said[(5, "the sea and the sky")][0] == "en"
    assert all(0 <= s <= 1 for _, s in said.values())
    assert language.identify(docs.limit(0), f).count() == 0
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_many_languages(spark):
    """More languages than one mask of 64 bits holds."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}qx " * 3, f"l{i:03d}") for i in range(100)]
    f = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(f.masks) == 13
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), f)
    assert all(r["lang"] == r["lang_pred"] for r in got.collect())


def test_language_held_out(spark):
    from factorloom.llm.queries import op12_language_id

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = op12_language_id(spark, SF_DIR).filter("held_out").join(docs, "doc_id").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


@given(st.sets(st.text(alphabet="abcé€xyzlongword", min_size=1, max_size=14), max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_transducer(terms, cuts):
    terms = sorted(t.encode() for t in terms)
    width = max(1, len(terms) // cuts)
    parts = [(terms[i], i, build(terms[i : i + width])) for i in range(0, len(terms), width)]
    asked = terms + [t + b"a" for t in terms] + [t[:-1] for t in terms if len(t) > 1] + [b"zzz", b"\xff"]
    data = np.frombuffer(b" ".join(asked) + b" ", np.uint8)
    ends = np.cumsum([len(a) + 1 for a in asked]) - 1
    starts = ends - [len(a) for a in asked]
    order = {t: i for i, t in enumerate(terms)}
    assert Transducer(parts).ordinals(data, starts, ends).tolist() == [order.get(a, -1) for a in asked]


def test_transducer_is_minimal():
    assert len(build([b"tap", b"taps", b"top", b"tops"])["accept"]) == 5
    assert Transducer([]).ordinals(np.zeros(1, np.uint8), np.array([0]), np.array([1])).tolist() == [-1]


def audited(rows, least=10, first=10):
    fold = [(a or "", b or "", re.findall(divergence.TERM, (t or "").translate(brute.FOLD))) for a, b, t in rows]
    seen, count, groups = {}, Counter(), sorted({(a, b) for a, b, _ in fold})
    for a, b, w in fold:
        for t in set(w):
            seen[a, t] = seen.get((a, t), 0) + 1
    kept = {a: sorted((t for (x, t), n in seen.items() if x == a and n >= least), key=str.encode) for a, _ in groups}
    for a, b, w in fold:
        for t in w:
            if seen[a, t] >= least:
                count[a, b, t] += 1
                count[a, t] += 1

    def rates(a, *b):
        n = sum(count[(a, *b, t)] for t in kept[a])
        return {t: 1 + 10**9 * (count[(a, *b, t)] + 2) // (n + 2 * len(kept[a])) for t in kept[a]}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for a, b in groups:
        own, whole = rates(a, b), rates(a)
        far = sorted((-sum(f(own[t], other[t]) for t in kept[a]), y.encode()) for x, y in groups if x == a and y != b for other in [rates(a, y)])
        out += [(a, b, "pair", y.decode(), -v, i + 1) for i, (v, y) in enumerate(far)]
        near = sorted((-f(own[t], whole[t]), t.encode()) for t in kept[a] if count[a, b, t] and own[t] > whole[t])
        out += [(a, b, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(near[:first])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    """Also with many parts, waves, blocks and groups of sources."""
    if small:
        for name, value in {"PART": 3, "WAVE": 4, "BLOCK": 5, "GROUP": 2}.items():
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(11)
    vocabulary = [f"w{chr(97 + i)}" for i in range(24)] + ["Ünder", "ünder", "日本", "longerthaneight", "longerthaneighty", "X", "x" * 3000]
    rows = [("en", f"s{i % 5}", " ".join(rng.choice(vocabulary[: 12 + 4 * (i % 5)]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [("de", "s1", "nur wenig Text"), ("de", "s2", None), ("de", None, ""), (None, "s1", "a-b 12c"), (None, None, None), ("fr", "only", "un deux")]
    rows += [("en", "s1", " ".join(vocabulary * 300))] + [("en", "s0", "wa wb copies")] * 30 + [("tie", f"t{i % 3}", "a b c d") for i in range(30)]
    got = divergence.audit(spark.createDataFrame([(*r, "q", 1) for r in rows], "lang string, source string, text string, ordinal string, p int").repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == audited(rows)
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_words_with_one_hash(monkeypatch):
    """Words that share a hash are told apart by their bytes."""
    data = np.frombuffer(b"one two one three two on", np.uint8)
    starts, ends = divergence.runs(data, np.array([0, len(data)]))
    want = divergence.word_numbers(data, starts, ends)
    assert len(set(want.tolist())) == 4 and want[0] == want[2] and want[1] == want[4]
    monkeypatch.setattr(divergence, "mix", lambda h: h * np.uint64(0))
    got = divergence.word_numbers(data, starts, ends)
    assert [[x == y for y in got] for x in got] == [[x == y for y in want] for x in want]
    assert divergence.texts(data, starts, ends).to_pylist() == ["one", "two", "one", "three", "two", "on"]

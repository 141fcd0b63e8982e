"""Whitening, language identification and resampling, against plain Python and numpy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import op11_whitening, op12_language, op13_resampling
from trailmark.llm.common import slices, table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<double>, label int, n long, x string, component int"


# whitening


def whole(v):
    return [math.floor(64 * max(min(c, 2.0**52 / 64), -(2.0**52) / 64)) + 1_000_000 for c in v]


def plain_whitening(vectors):
    """vec_id, embedding pairs of one length -> n, deviations, eigenvalues and projections on the eigenvectors."""
    x = [whole(v) for _, v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    near = [s // n for s in sums]
    mean = np.array([(s - n * m) / n for s, m in zip(sums, near, strict=True)])
    centred = lambda rows: np.array([[a - m for a, m in zip(row, near, strict=True)] for row in rows], float) - mean
    values, at = np.linalg.eigh(centred(fit).T @ centred(fit) / n)
    return n, deviation, values[::-1], centred(x) @ at[:, ::-1]


def random_vectors(r, rows, dim):
    scale = [3.0 / (i + 1) for i in range(dim)]
    return [[r.gauss(0.1, s) for s in scale] for _ in range(rows)]


def compare_whitening(got, vectors, components=16):
    n, deviation, values, projected = plain_whitening(vectors)
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, min(components, len(values)) + 1))
    for k, rows in by.items():
        assert sorted((r["vec_id"] or 0, r["n"], r["deviation"]) for r in rows) == sorted((v[0] or 0, n, d) for v, d in zip(vectors, deviation, strict=True))
        assert rows[0]["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
        assert 0 <= rows[0]["identity_error"] < 1e-9
        own = sorted((abs(r["whitened"]), r["vec_id"] or 0) for r in rows)
        expected = sorted((abs(p) / math.sqrt(values[k - 1]), v[0] or 0) for p, v in zip(projected[:, k - 1], vectors, strict=True))
        assert [o[0] for o in own] == pytest.approx([e[0] for e in expected], abs=1e-7)


def test_whitening_of_odd_rows(spark):
    r = random.Random(1)
    long_, short = random_vectors(r, 60, 20), random_vectors(r, 40, 3)
    good = [(i, v) for i, v in enumerate(long_)] + [(7, long_[7]), (7, long_[8]), (None, long_[9])]
    small = [(1_000 + i, v) for i, v in enumerate(short)] + [(1_000, short[0])]
    bad = [(90, None), (91, []), (92, [None] * 20), (93, [*long_[0][:19], math.nan]), (94, [*long_[0][:19], math.inf]), (95, [-math.inf, 1.0, 2.0])]
    rows = [(i, v, 3, 9, "x", 5) for i, v in good + small + bad]
    got = op11_whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    compare_whitening([g for g in got if (g["vec_id"] or 0) < 1_000], good)
    compare_whitening([g for g in got if (g["vec_id"] or 0) >= 1_000], small)
    assert len(got) == 16 * len(good) + 3 * len(small)


def test_whitening_of_the_table(spark):
    vectors = table(spark, SF, "embeddings")
    known = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in vectors.collect() if r["embedding"] is not None]
    compare_whitening(op11_whitening.query(spark, SF).collect(), known)


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "", 0)] * 3, VECTORS)
    got = op11_whitening.whiten(one).collect()
    assert [(g["n"], g["deviation"], g["whitened"], g["explained"], g["identity_error"]) for g in got] == [(1, 0, None, None, None)] * 6
    r = random.Random(2)
    flat = [(i, [a, 0.5, 2 * a], 0, 0, "", 0) for i, a in enumerate(r.gauss(0, 5) for _ in range(30))]
    got = op11_whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    empty = [g for g in got if g["whitened"] is None]
    assert {g["component"] for g in empty} == {3} and {g["explained"] for g in empty} == {0.0}
    assert all(g["identity_error"] < 1e-9 for g in got)
    assert op11_whitening.whiten(one.where("vec_id = 2")).collect() == []


def test_whitening_holds_extremes(spark):
    rows = [(i, [c, 1e300, -1e300], 0, 0, "", 0) for i, c in enumerate((1e18, -1e18, 0.0, 5e15))]
    got = op11_whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    n, deviation, values, _ = plain_whitening([(i, v) for i, v, *_ in rows])
    assert {(g["vec_id"], g["deviation"]) for g in got} == {(i, min(d, 2**63 - 1)) for i, d in enumerate(deviation)}
    assert got[0]["explained"] == pytest.approx(1.0) and n == 3  # two are held at the same limit


def test_jacobi():
    r = np.random.default_rng(3)
    for size in (1, 2, 3, 8, 33):
        m = r.normal(size=(2 * size, size))
        values, vectors = op11_whitening.jacobi(m.T @ m)
        assert values == pytest.approx(np.linalg.eigvalsh(m.T @ m)[::-1], rel=1e-9)
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13
        assert np.abs(m.T @ m @ vectors - vectors * values).max() < 1e-11 * values[0]
        assert (vectors[np.abs(vectors).argmax(axis=0), np.arange(size)] > 0).all()


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix: the product of the eigenvalues is the determinant, to full relative accuracy."""
    d = np.array([1.0, 1e-5, 1e-9, 1e-13])
    m = d[:, None] * np.array([[2, 1, 1, 0.5], [1, 3, 1, 1], [1, 1, 4, 1], [0.5, 1, 1, 5]]) * d
    rows, determinant = [[Fraction(x) for x in row] for row in m], Fraction(1)
    for i in range(4):
        determinant *= rows[i][i]
        for j in range(i + 1, 4):
            by = rows[j][i] / rows[i][i]
            rows[j] = [a - by * b for a, b in zip(rows[j], rows[i], strict=True)]
    assert math.prod(op11_whitening.jacobi(m)[0]) == pytest.approx(float(determinant), rel=1e-12, abs=0)


# languages


def plain_grams(text, order):
    """n-grams of letters within a word and its ends."""
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    return [g for w in spaced.split() for p in [f" {w} "] for g in (p[i : i + order] for i in range(len(p) - order + 1))]


def in_training(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 != 1


def plain_filters(rows, order, rare):
    docs, frequency = Counter(), defaultdict(Counter)
    for doc_id, text, lang in rows:
        if in_training(doc_id) and text is not None and lang is not None:
            docs[lang] += 1
            frequency[lang].update(set(plain_grams(text, order)))
    languages = sorted(docs, key=lambda name: (-docs[name], name))
    least = {name: min(docs[name], max(2, -(-docs[name] // rare))) for name in docs}
    return languages, {name: {g for g, n in frequency[name].items() if n >= least[name]} for name in docs}


@pytest.mark.parametrize("order,rare,sf", [(4, 1_000, "sf0.001"), (3, 20, "sf0.001")])
def test_filters_hold_what_sets_hold(spark, order, rare, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    languages, sets = plain_filters(rows, order, rare)
    filters = op12_language.learn(docs, order, rare)
    assert filters.languages == languages
    predicted = {r["doc_id"]: r for r in op12_language.predict(docs, filters, order).collect()}
    for doc_id, text, _ in rows:
        known = plain_grams(text or "", order)
        got = predicted[doc_id]
        assert got["held_out"] == (not in_training(doc_id))
        if not any(c.isalpha() for c in text or ""):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        shares = [sum(g in sets[name] for g in known) / max(1, len(known)) for name in languages]
        assert filters.shares([text], order)[0] == pytest.approx(shares, abs=0.03 + 2 / max(1, len(known)))
        best = sorted(shares, reverse=True)
        if len(best) > 1 and best[0] - best[1] > 0.1 + 4 / max(1, len(known)):
            assert got["lang_pred"] == languages[shares.index(best[0])]
            assert got["score"] == pytest.approx(best[0] / sum(shares), abs=0.1)


def test_no_gram_of_a_language_is_missed(spark):
    r = random.Random(4)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(2, 9)))
    names = [f"l{i:03}" for i in range(150)]  # over two words of bits
    alphabet = {n: [chr(0x4E00 + 3 * i + k) for k in range(3)] for i, n in enumerate(names)}
    rows = [(i, " ".join(word(alphabet[n]) for _ in range(20)), n) for i, n in enumerate(names * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = op12_language.learn(docs, rare=1)
    languages, sets = plain_filters(rows, 4, 1)
    assert filters.languages == languages and filters.table.shape[1] == 3
    for at, name in enumerate(languages):
        for g in sets[name]:
            digest, _ = op12_language.grams([g.strip()])
            bits = filters.of(digest)
            assert any(int(row[at // 64]) >> (at % 64) & 1 for row in bits)
    got = op12_language.predict(docs, op12_language.learn(docs, rare=1_000)).collect()
    assert sum(g["lang_pred"] == rows[g["doc_id"]][2] for g in got) > 0.98 * len(got)


def test_grams():
    odd = ["", "  ", "ab", "Straße, ÉTÉ 7x", "a b c", "日本語テキスト\n\U0001f600 end", "İstanbul", "x" * 50]
    for order in (2, 3, 4, 5):
        digest, text = op12_language.grams(odd, order)
        plain = [(i, g) for i, t in enumerate(odd) for g in plain_grams(t, order)]
        assert text.tolist() == [i for i, _ in plain]
        assert len(set(digest.tolist())) == len({g for _, g in plain})
        assert len({*zip(digest.tolist(), (g for _, g in plain), strict=True)}) == len({g for _, g in plain})
    assert [*slices([5, 1, 9, 0, 1], 6)] == [(0, 2), (2, 3), (3, 5)]


def test_languages_of_odd_rows(spark, odd_names, no_docs):
    filters = op12_language.learn(odd_names)
    got = op12_language.predict(odd_names, filters).collect()
    assert len(got) == odd_names.count()
    texts = defaultdict(set)
    for d in odd_names.collect():
        texts[d["doc_id"]].add(d["text"])
    for g in got:
        assert 0 <= g["score"] <= 1 and g["held_out"] == (not in_training(g["doc_id"]))
        if all(not any(c.isalpha() for c in t or "") for t in texts[g["doc_id"]]):
            assert g["lang_pred"] == "und"
        else:
            assert g["lang_pred"] in [*filters.languages, "und"]
    assert op12_language.predict(no_docs, op12_language.learn(no_docs)).collect() == []
    unlabelled = odd_names.withColumn("lang", F.lit(None).cast("string"))
    assert {g["lang_pred"] for g in op12_language.predict(odd_names, op12_language.learn(unlabelled)).collect()} == {"und"}


def test_labels_and_sources_do_not_reach_predictions(spark):
    docs = table(spark, SF, "documents")
    filters = op12_language.learn(docs)
    blind = docs.select(F.col("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("y").alias("source"))
    assert sorted(op12_language.predict(blind, filters).collect()) == sorted(op12_language.predict(docs, filters).collect())


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = op12_language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) > 200


# resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_features(text, most):
    own = plain_words(text)
    return [" ".join(own[i : i + n]) for n in range(1, most + 1) for i in range(len(own) - n + 1)]


def plain_resample(docs, target, buckets, most, seed, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for d in docs for f in plain_features(d[1], most))
    t = Counter(bucket(f) for x in target for f in plain_features(x, most))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        found = plain_features(text, most)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(plain_words(text)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = order[: len(order) * percent // 100]
    ranked = [(*r[:4], i) for i, r in enumerate(drawn, 1)]
    left = Counter(rows) - Counter(drawn)
    return sorted(ranked + [(*r[:4], None) for r in left.elements()], key=repr)


@pytest.mark.parametrize("buckets,most,percent", [(10_000, 1, 10), (50, 2, 37), (7, 3, 100), (100, 1, 0)])
def test_resampling(spark, odd_names, buckets, most, percent):
    target = ["mit license and the", None, "", "thon the é " * 30]
    docs = odd_names.union(odd_names.where("doc_id = 3"))
    targets = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = op13_resampling.resample(docs, targets, percent, buckets=buckets, most_words=most)
    known = [(d["doc_id"], d["text"]) for d in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(known, target, buckets, most, 2024, percent, 20)


def test_resampling_of_nothing(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "text string")
    assert op13_resampling.resample(no_docs, none).collect() == []
    assert op13_resampling.resample(odd_docs, none).count() == odd_docs.count()


def test_many_equal_rows(spark):
    """One key holds most rows, and the last drawn key is one of its copies."""
    rows = [(5, 30, 100, 400, 30)] * 900 + [(i, 30, 100, 1_000 - i, 30) for i in range(100, 200)]
    scored = spark.createDataFrame(rows, op13_resampling._SCORED)
    got = op13_resampling.draw(scored, percent=50, range_rows=64).collect()
    drawn = sorted(g["rank"] for g in got if g["rank"])
    assert drawn == list(range(1, 501)) and len(got) == 1_000
    assert Counter(g["doc_id"] == 5 for g in got if g["rank"]) == {True: 400, False: 100}
    assert [g["doc_id"] for g in sorted((g for g in got if g["rank"]), key=lambda g: g["rank"])[:100]] == list(range(100, 200))


@pytest.mark.parametrize("digit", [4, 16])
def test_radix_selection(spark, digit):
    r = random.Random(7)
    extreme = [-(2**63), 2**63 - 1, 0, -1, 1]
    part = lambda: r.choice(extreme) if r.random() < 0.3 else r.randint(-70_000, 70_000)
    keys = [(part(), r.choice([3, 5, part()]), r.randint(0, 2)) for _ in range(300)]
    keyed = spark.createDataFrame(keys, "_k1 long, _k2 long, _k3 long").cache()
    ordered = sorted(keys)
    for k in (1, 2, 150, 299, 300):
        key, among = op13_resampling.radix_select(keyed, k, digit)
        assert key == ordered[k - 1]
        assert among == k - sum(x < key for x in keys)

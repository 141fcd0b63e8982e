"""Operators over whole tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.llm import op03_ctw, op04_topk, op05_near_dedup, op06_mixing, op08_kneser_ney, op09_sharding, op10_pii
from trailmark.llm.common import written
from trailmark.llm.components import components
from trailmark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = c.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    shown = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(df.select(*columns).collect()) == shown(cursor.fetchall())


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[i:] for i in range(width)], strict=False))


def plain_components(rows, width, percent):
    sets = {r["doc_id"]: shingles(r["text"], width) for r in rows if r["doc_id"] is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i, s in sets.items() if s)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def check_components(docs, got, width, percent):
    expected = plain_components(docs.collect(), width, percent)
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert got.count() == docs.count()


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    check_components(odd_docs, op05_near_dedup.near_duplicates(odd_docs, 4, 80), 4, 80)
    assert op05_near_dedup.near_duplicates(no_docs).count() == 0


def test_columns_pass_whatever_their_names(spark, odd_docs, odd_names):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 80)], "doc_id long, quality int, toxic int")
    stages = {
        "near_dedup": op05_near_dedup.keep_one,
        "quality": lambda d: op08_kneser_ney.keep_good(d, labels),
        "personal_data": op10_pii.mask_personal_data,
        "mixing": lambda d: op06_mixing.mixed_documents(d, epochs=1),
    }
    for name, stage in stages.items():
        got = stage(odd_names)
        assert got.schema.simpleString() == odd_names.schema.simpleString(), name
        plain = stage(odd_docs).collect()
        assert sorted(map(repr, got.select(*odd_docs.columns).collect())) == sorted(map(repr, plain)), name
        assert all(r["a.b"] == "dot" and r["_id"] == 0 for r in got.collect()), name


def test_rows_that_share_an_id_but_not_their_text_all_stay(spark, words):
    r = random.Random(15)
    text = lambda: " ".join(r.choice(words) for _ in range(50))
    one, two, three = text(), text(), text()
    edited = one.split(" ")
    edited[-1] = "changed"
    rows = [(1, one), (5, " ".join(edited)), (5, two), (7, two), (7, three), (7, three), (8, three + " x"), (9, ""), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, op05_near_dedup.keep_one(docs, width=4).collect()), key=repr)
    assert kept == sorted([(1, one), (5, two), (7, three), (9, ""), (9, None)], key=repr)
    ids = {(x["doc_id"], x["component_id"]) for x in op05_near_dedup.near_duplicates(docs, 4).collect()}
    assert ids == {(1, 1), (5, 1), (5, 5), (7, 5), (7, 7), (8, 7), (9, 9)}


def test_ids_beyond_the_map_are_joined(odd_docs, monkeypatch):
    monkeypatch.setattr(op05_near_dedup, "MOST_BITS", 1)
    check_components(odd_docs, op05_near_dedup.near_duplicates(odd_docs, 4, 80), 4, 80)


def test_links_of_thousands_of_texts_on_one_template(spark):
    """Over 5,000 texts that share a template: unlike ones crowd the regions, similar ones must all be found.

    Components are those of all links that brute force finds (sets as bits of a matrix).
    """
    r = np.random.default_rng(80)
    n, size = 5_200, 60
    # each text keeps a run of the template's words; how much differs from text to text
    keep = np.clip(r.normal(0.72, 0.32, (n, 1)), 0.2, 0.98)
    own = r.random((n, size)) > keep
    fresh = r.integers(0, 40, (n, size))
    values = np.where(own, 1000 + fresh * size + np.arange(size), np.arange(size))
    docs = spark.createDataFrame([(int(i), " ".join(f"w{x}" for x in row)) for i, row in enumerate(values)], "doc_id long, text string")
    columns, at = np.unique(values, return_inverse=True)
    bits = np.zeros((n, len(columns)), np.float32)
    bits[np.repeat(np.arange(n), size), at.ravel()] = 1
    parent = np.arange(n)
    both = bits @ bits.T
    i, j = np.nonzero(np.triu(100 * both >= 80 * (2 * size - both), 1))
    assert len(i) > 1_000
    found = {x["doc_id"]: x["component_id"] for x in op05_near_dedup.near_duplicates(docs, 1, 80, crowded=256).collect()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {k: root(k) for k in range(n)} == found


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = op05_near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    expected = plain_components(odd_docs.collect(), 5, 80)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in expected.items() if i == c)
    assert ids.count(None) == odd_docs.where("doc_id is null").count()
    assert op05_near_dedup.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("crowded", [0, 1_024])
def test_near_duplicates_of_a_large_group(spark, words, crowded):
    """Copies of one text with few to many edits: links are dense within, and rare between, the edited ones."""
    r = random.Random(9)
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(260):
        text = list(base)
        for _ in range(r.randint(0, 14)):
            text[r.randrange(len(text))] = r.choice(words) + "x"
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, " ".join(r.choice(words) for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_components(docs, op05_near_dedup.near_duplicates(docs, 4, 80, crowded=crowded, neighbours=1), 4, 80)


def test_crowded_pairs_without_a_run_of_equal_values(spark):
    """Pairs of similarity 0.8 whose signatures have no six equal values in a row are found where all is crowded."""
    r, rows = random.Random(11), []
    while len(rows) < 6:
        new = [f"w{r.getrandbits(40)}" for _ in range(50)]
        pair = [" ".join(new[:40] + new[40 + 5 * i : 45 + 5 * i]) for i in (0, 1)]
        x, y = (op05_near_dedup.signature(op05_near_dedup.shingle_set(t, 1)) for t in pair)
        same = "".join("01"[int(v)] for v in x == y)
        if "111111" not in same + same[:5]:
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_components(docs, op05_near_dedup.near_duplicates(docs, 1, 80, crowded=0, neighbours=0), 1, 80)


def test_only_compared_regions_rule_pairs_out():
    """A pair that shares regions of two orders is left to the second where the first was skipped as crowded."""
    sig = np.arange(72, dtype=np.uint32)
    other = sig.copy()
    other[6:30] = 1000 + np.arange(24)
    for skipped, left in ((0, False), (1, True), (2, False)):
        columns = {
            "tree": [1, 1], "is_row": [True, False], "id": [1, 2], "n": [10, 10], "component": [1, 2],
            "signature": [sig.tobytes(), other.tobytes()], "keys": pa.nulls(2, pa.binary()), "skipped": [skipped] * 2,
        }
        assert bool(op05_near_dedup._candidates(pa.table(columns), 80)[2].any()) == left


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 9), (3, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[9] == 7 and got[300] == 3 and 3 in got


def test_components_take_few_rounds(spark, monkeypatch):
    """Links that a task holds are contracted: a long chain takes few rounds."""
    rounds = []
    monkeypatch.setitem(components.__globals__, "written", lambda df: rounds.append(1) or written(df))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([(i, i + 1) for i in range(999)], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1000), 0)
    assert len(rounds) <= 6


@pytest.mark.parametrize("together", [1, 7, 1 << 18])
def test_components_of_parts(spark, monkeypatch, together):
    """Whatever a task holds together, and with links repeated and both ways round."""
    monkeypatch.setitem(components.__globals__, "TOGETHER", together)
    r = random.Random(together)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(230)]
    links += [(b, a) for a, b in links[:50]] + links[:20]
    expected = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in range(400):
        for a, b in links:
            if a != b:
                expected[a] = expected[b] = min(expected[a], expected[b])
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, rows)) == sorted(expected.items())


def test_map_of_ids_takes_few_jobs(spark):
    """Not a job for every partition of a shuffle."""
    confs = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    sc = spark.sparkContext
    sc.setJobGroup("map of ids", "")
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        bits = op05_near_dedup.LEAST_BITS
        found = np.frombuffer(op05_near_dedup._id_map(spark.range(3, 4_000_000, 70_001), bits), np.uint8)
        jobs = len(sc.statusTracker().getJobIdsForGroup("map of ids"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist() == sorted(i % bits for i in range(3, 4_000_000, 70_001))
    assert jobs <= 4


def plain_top_k(rows, k=5, every=50):
    """query_id, norm, rank, vec_id, score by comparing each query with each other row."""
    live = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({x for x in live if x[0] % every == 0}):
        product = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: E731,B023
        best = sorted((-product(w), i) for i, w in live if i != q and len(w) == len(v))[:k]
        out += [(q, product(v), n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [{"candidates": 16, "queries": 2, "fan_in": 2}, {}])
def test_top_k_of_odd_vectors(spark, tiles):
    """Nulls, other lengths, repeated rows (each a candidate), and ids that stand for several vectors."""
    r = random.Random(10)
    vec = lambda n=4: [r.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(n)]
    rows = [(i, vec(), i) for i in range(120)] + [(200, vec(3), 0), (150, vec(3), 0), (201, None, 0), (202, [], 0), (203, [1.0, None, 0.0, 0.0], 0)]
    rows += [(250, [float("nan"), 0.0, 0.0, 0.0], 0), (300, [float("inf"), 0.0, 0.0, 0.0], 0), (None, vec(), 0), (7, rows[7][1], 9)]
    rows += [(8, [1.0, 1.0, 1.0, 1.0], 0)] * 3 + [(50, [0.5, 1.0, 0.25, -1.0], 0), (100, rows[100][1], 0), (9, vec(), 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = op04_topk.top_k(vectors, **tiles).select("query_id", "query_norm", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == plain_top_k([x[:2] for x in rows])
    assert op04_topk.top_k(vectors.limit(0)).count() == 0


def test_top_k_over_many_products(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(900, 6)))]
    monkeypatch.setattr(op04_topk, "CANDIDATES", 64)
    got = list(op04_topk.tile_best(*_as_tile(rows), 5))
    expected = plain_top_k(rows)
    assert [(int(s), int(i)) for scores, ids in got for s, i in zip(scores, ids, strict=True)] == [(x[4], x[3]) for x in expected]


def _as_tile(rows):
    ids = np.array([i for i, _ in rows])
    whole = np.floor(256 * np.array([v for _, v in rows]))
    q = ids % 50 == 0
    return ids[q], whole[q], ids, whole, np.ones(len(ids), np.int64)


def test_top_k_beyond_float(spark):
    rows = [(0, [3e13, 1.0]), (1, [3e13, 2.0]), (2, [3e13, 1.0]), (3, [1.0, 1.0])]
    got = op04_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    assert [r["vec_id"] for r in sorted(got.collect(), key=lambda r: r["rank"])] == [1, 2, 3]


def test_mixture_of_odd_rows(spark, odd_docs, no_docs):
    c = duckdb.connect()
    frame = odd_docs.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841  duckdb reads it by name
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    c.execute("create table documents as select doc_id::bigint as doc_id, text, lang, source from frame")
    cursor = c.execute(op06_mixing.SQL)
    columns = [d[0] for d in cursor.description]
    got = op06_mixing.mixture(odd_docs).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))
    assert op06_mixing.mixture(no_docs).count() == 0
    assert op06_mixing.mixed_documents(odd_docs, epochs=1).columns == odd_docs.columns


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("b", "y", "s3", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in op06_mixing.budgets(leaves, 0.4, 1, {}, {}).collect()}
    assert got["s1"] == 10 and abs(got["s2"] - (402 - 10)) < 1e-6 and abs(got["s3"] - 402) < 1e-6


def test_what_weight_0_leaves_goes_to_the_others(spark):
    """A domain whose languages partly weigh nothing has the capacity of the others only."""
    rows = [("a", "x", "s1", 200), ("a", "y", "s2", 1000), ("b", "x", "s3", 900)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in op06_mixing.budgets(leaves, 0.4, 1, {}, {"y": 0.0}).collect()}
    assert got.keys() == {"s1", "s3"} and abs(got["s1"] - 200) < 1e-6 and abs(got["s3"] - 640) < 1e-6


def test_mixture_of_many_leaves_meets_by_id(odd_docs):
    plain = op06_mixing.mixture(odd_docs).collect()
    joined = op06_mixing.mixture(odd_docs, most_leaves=0).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, joined))


def test_mixture_takes_given_domains(odd_docs):
    got = op06_mixing.mixture(odd_docs, domain=F.coalesce("lang", F.lit("none"))).collect()
    assert {r["domain"] for r in got} >= {"en", "de", "es"} and all(r["domain"] == (r["lang"] or "none") for r in got)


def test_equal_rows_are_numbered_in_parts(spark):
    rows = [(7, "same", "a")] * 50 + [(i, f"t{i}", "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(repr, op09_sharding.interleave(docs, 8, range_rows=4, copies=n).collect())) for n in (3, 1_000)]
    assert got[0] == got[1] and len(got[0]) == 80


def plain_shards(rows, shards, seed):
    """doc_id, crc, shard, slot by the same law, row by row: ranks by digest, fractional ranks, equal cuts."""
    narrow = [(i, source, len(text.encode()) + 8, zlib.crc32(text.encode())) for i, text, source in rows]
    numbered, seen = [], Counter()
    for row in narrow:
        numbered.append((row, seen[row]))
        seen[row] += 1
    text = lambda x: "" if x is None else str(x)
    keyed = [
        (hashlib.md5(":".join([str(seed), text(i), str(crc), str(size), str(n)]).encode()).hexdigest(), i, crc, size, n, source)
        for (i, source, size, crc), n in numbered
    ]
    placed = []
    for source in {x[-1] for x in keyed}:
        own = sorted((x for x in keyed if x[-1] == source), key=lambda x: x[0])
        named = [str(seed) + ":phase"] + ([] if source is None else [source])
        phase = (int(hashlib.md5(":".join(named).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        placed += [((rank + phase) / len(own), x) for rank, x in enumerate(own)]
    placed.sort(key=lambda x: (x[0], x[1][0]))
    out = []
    for place, (_, x) in enumerate(placed):
        shard = place * shards // len(placed)
        out.append((x[1], x[2], shard, place - -(-shard * len(placed) // shards)))
    return sorted(out, key=repr)


def test_shards_by_plain_ranks(spark, odd_docs):
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in odd_docs.collect()]
    got = op09_sharding.interleave(odd_docs, 5, range_rows=6).select("doc_id", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == plain_shards(rows, 5, op09_sharding.SEED)


def test_rare_sources_are_spread_over_all_shards(spark):
    rows = [(i, f"t{i}", f"host{i}") for i in range(3_000)] + [(10_000 + i, f"u{i}", "hot") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op09_sharding.interleave(docs, 24, range_rows=64).collect()
    rare, hot = (Counter(r["shard"] for r in got if (r["source"] == "hot") == x) for x in (False, True))
    assert set(rare) == set(hot) == set(range(24))
    for s in range(24):
        assert abs(rare[s] - 125) <= 36 and abs(hot[s] - 62.5) <= 36 and abs(rare[s] + hot[s] - 187.5) <= 1
    # buckets of about range_rows rows each
    places = Counter(min(69, int(70 * (int(hashlib.md5(f"{op09_sharding.SEED}:phase:host{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32)) for i in range(3_000))
    assert max(places.values()) < 4 * 64


def test_texts_beyond_the_sample_are_passed_over(spark):
    texts = ["x " * 5_000, *[f"a short text number {i}" for i in range(40)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(41)], "doc_id long, quality int, toxic int")
    trained = {i for i in range(41) if hashlib.md5(str(i).encode()).hexdigest() < op08_kneser_ney.TRAINED_BELOW}
    got = {r["text"] for r in op08_kneser_ney.sample(docs, labels, size=3_000).collect()}
    assert got == {texts[i] for i in trained if i} and len(got) > 20
    with pytest.raises(ValueError):
        op08_kneser_ney.sample(docs, labels, size=5)
    assert op08_kneser_ney.sample(docs, labels.limit(0)).count() == 0


def test_thresholds_by_language(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["en", "de"])) for i in range(1_500)]
    scored = spark.createDataFrame([(i, lang, 0.1 * r.random() + (0.5 if lang == "de" else 0.0)) for i, lang in rows], "doc_id long, lang string, log10_perplexity double")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    by_lang, overall = op08_kneser_ney.thresholds(scored, labels)
    held = [x for x in scored.collect() if hashlib.md5(str(x["doc_id"]).encode()).hexdigest() >= op08_kneser_ney.TRAINED_BELOW]
    for lang in ("en", "de"):
        own = sorted(x["log10_perplexity"] for x in held if x["lang"] == lang)
        assert len(own) >= op08_kneser_ney.LEAST
        assert by_lang[lang] == own[math.ceil(0.99 * len(own)) - 1] + op08_kneser_ney.SLACK
    assert overall == sorted(x["log10_perplexity"] for x in held)[math.ceil(0.99 * len(held)) - 1] + op08_kneser_ney.SLACK


def test_shards_match_the_mixture(spark, odd_docs, no_docs):
    got = op09_sharding.interleave(odd_docs, 8, range_rows=4).collect()
    assert len(got) == odd_docs.count()
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    for source, n in Counter(r["source"] for r in got).items():
        for s in counts:
            assert abs(sum(r["source"] == source and r["shard"] == s for r in got) - n / 8) <= 3
    texts = defaultdict(set)
    for r in odd_docs.collect():
        text = (r["text"] or "").encode()
        texts[r["doc_id"]].add((len(text) + 8, zlib.crc32(text)))
    assert all((r["size"], r["text_crc32"]) in texts[r["doc_id"]] for r in got)
    again = op09_sharding.interleave(odd_docs.repartition(5), 8, range_rows=7).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert op09_sharding.interleave(no_docs).count() == 0


def naive_tree(counts, depth):
    """log10 probability of a byte after a context by the same mixture, node by node and bit by bit."""
    by = defaultdict(Counter)
    for gram, n in counts.items():
        for d in range(depth + 1):
            by[d, (gram >> 8) & ((1 << 8 * d) - 1)][gram & 255] += n

    def at(key, prefix, level):
        c = by.get(key, {})
        return tuple(sum(n for b, n in c.items() if b >> (7 - level) == prefix << 1 | bit) for bit in (0, 1))

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    @cache
    def weighted(key, prefix, level):
        own = log_kt(*at(key, prefix, level))
        if key[0] == depth:
            return own
        below = [k for k in by if k[0] == key[0] + 1 and k[1] & ((1 << 8 * key[0]) - 1) == key[1]]
        return np.logaddexp(own, sum(weighted(k, prefix, level) for k in below)) - math.log(2)

    def p_one(d, context, prefix, level):
        key = (d, context & ((1 << 8 * d) - 1))
        z, o = at(key, prefix, level)
        own = (o + 0.5) / (z + o + 1)
        if d == depth or sum(at((d + 1, context & ((1 << 8 * (d + 1)) - 1)), prefix, level)) == 0:
            return own
        w = math.exp(log_kt(z, o) - math.log(2) - weighted(key, prefix, level))
        return w * own + (1 - w) * p_one(d + 1, context, prefix, level)

    def byte(context, x):
        out = 0.0
        for level in range(8):
            p = p_one(0, context, x >> (8 - level), level)
            out += math.log10(p if x >> (7 - level) & 1 else 1 - p)
        return out

    return byte


@pytest.mark.parametrize(("depth", "head"), [(3, 1), (4, 30), (4, 1 << 20)])
def test_context_tree_against_node_by_node(spark, depth, head):
    """Scores of all texts, trained on or not, with few, some and all n-grams in the head."""
    texts = ["abab abba", "abba", "aab é", "bab", "", None, "abba zz", "ABBA aab", "qq", "abba", "ab", "zé", "x"]
    rows = list(enumerate(texts)) + [(3, "bab"), (None, "aab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = [(i, (t or "").encode().lower()) for i, t in rows]
    assert any(op03_ctw.held_out(i) for i, _ in clean)
    counts = Counter(int(g) for i, t in clean if not op03_ctw.held_out(i) for g in op03_ctw.grams([t], depth)[0])
    byte = naive_tree(counts, depth)
    expected = sorted((str(i), round(sum(byte(int(g) >> 8, int(g) & 255) for g in op03_ctw.grams([t], depth)[0]), 4)) for i, t in clean)
    got = op03_ctw.score(docs, depth=depth, head_grams=head, head_words=4).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got) == expected


def test_probabilities_of_all_bytes_sum_to_one(spark):
    """Over all bytes after seen and unseen contexts."""
    grams = [(0x6162 << 16 | 0x63 << 8 | x, 3 if x in (97, 98) else 0) for x in range(256)]
    grams += [(0x7A7A << 16 | 0x7A << 8 | x, 0) for x in range(256)]
    counts = spark.createDataFrame([(None, g, n) for g, n in grams], "word string, gram long, n long")
    sums = Counter()
    for r in op03_ctw.prices(counts, 3).collect():
        sums[r["gram"] >> 8] += 10 ** r["p"]
    assert len(sums) == 2 and all(abs(x - 1) < 1e-9 for x in sums.values())


def test_the_tree_grows_with_the_corpus(spark, words):
    """All contexts stay, however rare: twice the texts have the more nodes."""
    r = random.Random(16)
    rows = [(i, " ".join(r.choice(words) + str(r.randrange(999)) for _ in range(80))) for i in range(60)]
    sizes = [op03_ctw.prices(op03_ctw.corpus_counts(spark.createDataFrame(rows[:n], "doc_id long, text string"))).count() for n in (30, 60)]
    distinct = len(set(op03_ctw.grams([t.encode().lower() for _, t in rows], op03_ctw.DEPTH)[0].tolist()))
    assert sizes[1] == distinct > 1.5 * sizes[0]


@pytest.mark.parametrize("common", [3, 1 << 20])
def test_word_base_of_odd_rows(odd_docs, common):
    rows = odd_docs.collect()
    seen = Counter()
    for r in rows:
        if not op03_ctw.held_out(r["doc_id"]):
            seen.update([*(r["text"] or "").encode().lower().split(), b""])
    total, kinds = sum(seen.values()), len(seen)
    expected = []
    for r in rows:
        tokens = [*(r["text"] or "").encode().lower().split(), b""]
        base = sum(math.log10((seen[t] + 1) / (total + kinds + 1)) for t in tokens)
        expected.append((str(r["doc_id"]), op03_ctw.held_out(r["doc_id"]), len(tokens), sum(seen[t] > 0 for t in tokens), total, f"{base:.6g}"))
    got = [
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6g}")
        for r in op03_ctw.score(odd_docs, depth=3, head_grams=64, head_words=common).collect()
    ]
    assert sorted(got) == sorted(expected)


def test_scores_of_empty_tables(no_docs):
    assert op03_ctw.score(no_docs, depth=3).count() == 0


def plain_kneser_ney(texts, order):
    pad = bytes(order - 1)
    counts = {order: Counter()}
    for t in texts:
        s = pad + t + b"\xff"
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = Counter(c.values())
        if not n[1] or not n[2]:
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * 0.5 for i in (1, 2, 3)]
        return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]

    d = {k: discounts(c) for k, c in counts.items()}

    def p(gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        others = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        if not others:
            return p(gram[1:])
        lost = sum(d[k][min(n, 3) - 1] for n in others)
        n = counts[k][gram]
        return (n - d[k][min(n, 3) - 1] if n else 0) / sum(others) + lost / sum(others) * p(gram[1:])

    return p


def test_kneser_ney_against_plain(spark, words):
    r = random.Random(12)
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(6)]
    tables = op08_kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    p = plain_kneser_ney([t.encode() for t in texts], 3)
    for text in (texts[0].encode(), b"there is a new one \xc3\xa9", b"###", b""):
        s = bytes(2) + text + b"\xff"
        expected = -sum(math.log10(p(s[i : i + 3])) for i in range(len(s) - 2)) / (len(text) + 1)
        assert abs(op08_kneser_ney.log10_perplexity(tables, [text])[0] - expected) < 1e-9


def test_classifier_parts_good_from_bad(spark, words):
    r = random.Random(13)
    good = lambda: " ".join(r.choice(words) for _ in range(60))
    bad = lambda: "".join(chr(r.randint(33, 90)) for _ in range(400))
    rows = [(i, bad() if i % 4 == 0 else good(), "en" if i % 3 else None) for i in range(400)] + [(500, None, "en"), (501, "", "en"), (None, good(), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    out = op08_kneser_ney.classify(docs, labels).collect()
    assert len(out) == len(rows)
    for x in out:
        i = x["doc_id"]
        assert x["kept"] == (i is None or i < 400 and i % 4 > 0), x
    assert op08_kneser_ney.keep_good(docs, labels).columns == docs.columns
    assert op08_kneser_ney.classify(docs, labels.limit(0)).where("kept").count() == 401
    assert op08_kneser_ney.classify(docs.limit(0), labels).count() == 0


def test_classifier_trains_on_all_trusted_texts(spark):
    """More trusted texts than any fixed number of rows: the last ones by digest count like the first."""
    digest = {i: hashlib.md5(str(i).encode()).hexdigest() for i in range(16_000)}
    trained = sorted((i for i in digest if digest[i] < op08_kneser_ney.TRAINED_BELOW), key=digest.get)
    assert len(trained) > 11_000
    late = set(trained[9_000:])
    texts = {i: ("xyz" if i in late else ("ab", "ba a")[i % 2]) for i in digest}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in digest], "doc_id long, quality int, toxic int")
    p = plain_kneser_ney([texts[i].encode() for i in trained], 5)
    got = {r["doc_id"]: r["perplexity"] for r in op08_kneser_ney.classify(docs, labels).collect()}
    assert set(got) == set(digest)
    for i in (trained[0], trained[1], trained[2], trained[3], trained[-1]):
        s = bytes(4) + texts[i].encode() + b"\xff"
        expected = -sum(math.log10(p(s[k : k + 5])) for k in range(len(s) - 4)) / (len(s) - 4)
        assert abs(math.log10(got[i]) - expected) < 1e-9


def test_rare_ngrams_are_joined(spark, odd_docs):
    """With a head of few or no n-grams the others are joined; scores, verdicts and repeated rows stay the same."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = lambda df: sorted(df.collect(), key=lambda r: (str(r["doc_id"]), r["n_bytes"], str(r["perplexity"])))
    whole = rows(op08_kneser_ney.classify(odd_docs, labels))
    for head in (0, 300):
        few = rows(op08_kneser_ney.classify(odd_docs, labels, head=head))
        assert len(few) == len(whole) == odd_docs.count()
        for a, b in zip(few, whole, strict=True):
            assert (a["doc_id"], a["lang"], a["n_bytes"], a["kept"]) == (b["doc_id"], b["lang"], b["n_bytes"], b["kept"])
            assert a["perplexity"] == b["perplexity"] or abs(a["perplexity"] / b["perplexity"] - 1) < 1e-9
        assert len({r["perplexity"] for r in few if r["doc_id"] == 3}) == 1
    kept = op08_kneser_ney.keep_good(odd_docs, labels, head=300)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in whole)


def test_training_flags(spark):
    """The bitmap only rules out: however full it is, the flags are those of the labels."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*range(-50, 3_000), 7, None]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(-20, 2_000)], "doc_id long, quality int, toxic int")
    own = {i for i in range(-20, 2_000) if i % 3 and hashlib.md5(str(i).encode()).hexdigest() < op08_kneser_ney.TRAINED_BELOW}
    expected = Counter((f"t{i}", i in own) for i in [*range(-50, 3_000), 7, None])
    for marks in (op08_kneser_ney.MARKS, 1 << 15, 64):
        joined, ruled_out = op08_kneser_ney.training_flags(docs, labels, marks)
        assert Counter(map(tuple, joined.union(ruled_out).collect())) == expected
        assert marks < 100 or ruled_out.count() > 1_000


def test_classifier_takes_odd_rows(spark, odd_docs):
    """Very long texts, repeated rows, nulls: judged alike, one row each; a model too large is trained on less."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    out = op08_kneser_ney.classify(odd_docs, labels).collect()
    assert len(out) == odd_docs.count()
    assert all(not r["kept"] for r in out if not r["n_bytes"])
    assert len({(r["perplexity"], r["kept"]) for r in out if r["doc_id"] == 3}) == 1
    whole, half = op08_kneser_ney.fit(odd_docs, labels), op08_kneser_ney.fit(odd_docs, labels, most=3_000)
    entries = lambda tables: sum(len(t[0]) + len(t[2]) for t in tables)
    assert entries(half) <= 3_000 < entries(whole)


def test_oracle_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 10

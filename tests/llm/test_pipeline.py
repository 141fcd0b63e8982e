"""The pipeline, stage by stage, against plain rules over what each stage was given."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from trailmark.llm import op08_kneser_ney, op10_pii

SF = "/root/testdata/sf0.001"


def reread(spark, df, folder):
    at = str(folder / "out")
    df.write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(reread(spark, stage(spark, out[-1], SF), tmp_path_factory.mktemp(name)))
    return out


@pytest.fixture(scope="module")
def odd_given(spark, odd_names, tmp_path_factory):
    return reread(spark, odd_names, tmp_path_factory.mktemp("odd"))


def roots_of(texts):
    """id -> text: the smallest id that five-word shingles of similarity 0.8 reach from each, by brute force."""

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i, s in sets.items() if s)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_stage_follows_the_classifier(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in op08_kneser_ney.classify(stages[0], labels).where("kept").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == kept


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    roots = roots_of({r["doc_id"]: r["text"] for r in stages[1].collect()})
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, root in roots.items() if root == i}


def test_personal_data_stage_masks_all(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert after == {i: op10_pii.masked(t) for i, t in before.items()}


def test_mixing_stage_takes_documents_once(stages):
    given, taken = [r["doc_id"] for r in stages[3].collect()], [r["doc_id"] for r in stages[4].collect()]
    assert len(set(taken)) == len(taken) and 0 < len(taken) < len(given) and set(taken) <= set(given)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def digests(text, library):
    ids = library.encode(text or "")
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), hashed(",".join(map(str, ids))), hashed(library.decode(ids))


def counted(rows):
    """Rows by id and digest, for texts are too long to be shown where they differ."""
    return Counter((r["doc_id"], hashlib.md5(repr(sorted(r.items())).encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_odd_rows(spark, odd_docs, odd_given, tmp_path, name):
    """Nulls, empty and very long texts, repeated rows, clashing columns, a map: one defined result each, by plain rules."""
    got = reread(spark, dict(corpus_pipeline.STAGES)[name](spark, odd_given, SF), tmp_path)
    rows = [r.asDict() for r in odd_docs.collect()]
    if name == "tokens":
        library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        found = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect())
        assert found == Counter((r["doc_id"], *digests(r["text"], library)) for r in rows)
        return
    assert got.schema.simpleString() == odd_given.schema.simpleString()
    assert got.where("`a.b` <> 'dot' or _id <> 0 or spans <> 11 or not (tags['k'] <=> source)").count() == 0
    found = counted(r.asDict() for r in got.select(*odd_docs.columns).collect())
    if name == "quality":
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        kept = {(r["doc_id"], r["n_bytes"]) for r in op08_kneser_ney.classify(odd_given, labels).where("kept").collect()}
        assert found == counted(r for r in rows if r["text"] and (r["doc_id"], len(r["text"].encode())) in kept)
    elif name == "near_dedup":
        roots = roots_of({r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None})
        without_id = counted(r for r in rows if r["doc_id"] is None)
        firsts = counted(r for r in rows if r["doc_id"] is not None and roots[r["doc_id"]] == r["doc_id"])
        assert found == Counter(set(firsts)) + without_id
    elif name == "personal_data":
        texts = [(r, None if r["text"] is None else op10_pii.masked(r["text"])) for r in rows]
        assert found == counted({**r, "text": t, "n_chars": r["n_chars"] if t is None else len(t)} for r, t in texts)
    else:
        assert found and not found - counted(rows)


def test_empty_tables_pass_all_stages(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_tokens string, score double, id string, kept boolean"


def document(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 7, "x", 0.5, "y", True)


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice(["th", "er", "on", "an", "re", "é", "ing", "st"]) for _ in range(r.randint(1, 4))) for _ in range(300)]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, clashing column names."""
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(120)
    edited = base.split(" ")
    edited[5] = "changed"
    rows = [
        document(1, base),
        document(2, base),
        document(3, " ".join(edited), "de", "b"),
        document(3, " ".join(edited), "de", "b"),
        document(4, None, None, None),
        document(5, "", "fr"),
        document(6, "  \n\t "),
        document(None, text(60), "en", None),
        document(None, None),
        document(7, "Mail bob@example.com, +1 (599) 555-3756, 10.0.0.255, card 4111 1111 1111 1111. MIT License"),
        document(8, "one"),
        document(9, "one"),
        document(10, text(20_000), "es", "c"),
        document(11, "x" * 200_000),
        document(12, "日本語 \U0001f600 ▁ tab\there\n\nend ", "ja"),
        *[document(20 + i, text(r.randint(1, 150)), r.choice(["en", "de"]), r.choice("abc")) for i in range(60)],
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_names(odd_docs):
    """The odd rows with columns that carry the operators' own names, one with a dot, and a map."""
    from pyspark.sql import functions as F

    own = ["_id", "_row", "row", "_key", "_log10_perplexity", "log10_perplexity", "component_id", "d1", "s", "_domain", "_n", "spans"]
    out = odd_docs.withColumns({c: F.lit(i) for i, c in enumerate(own)})
    return out.withColumn("a.b", F.lit("dot")).withColumn("tags", F.create_map(F.lit("k"), F.col("source")))

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """The smallest documents, with untidy ones: no text, no id, white space, repeats, clashing columns."""
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = " ".join(f"word{i % 700} und{i % 13}" for i in range(6000))
    passage = " ".join(f"shared{i}" for i in range(60))
    odd = [
        (900, None), (901, ""), (902, " \t\n "), (903, "one two"), (904, "one two"), (904, "one two"), (904, "other text here"),
        (None, "a text without an id that is long enough for some words"), (905, long), (906, "aaaa " * 300), (907, "Ünïcödé 日本語   x y " * 30),
        (908, passage + " tail one"), (909, "head two " + passage), (910, "x" * 5000), (911, "<|endoftext|> mid <|endoftext|>end"), (912, "12345 !!! ???"),
        (913, "A\x00B \x0b\x0c nul"), (914, "▁under▁score  double  space "), (915, None),
    ]
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")}
    )
    both = given.unionByName(extra).withColumns(
        {c: F.lit(None).cast("string") for c in ("key", "hashes", "anchors", "n_words", "fingerprint", "score", "part", "host")}
    )
    path = str(tmp_path_factory.mktemp("llm") / "documents")
    both.coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

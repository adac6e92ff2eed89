import pytest
from pyspark.sql import functions as F

SAMPLE = "/root/testdata/sf0.001"
ODD = ["", None, " \t\n ", "x", "Straße İstanbul ΑΣ ﬁ ½ don't I'LL 's <|endoftext|> a<|startoftext|>b 日本語 🙂 \x00\x1c é K", "one two three four", "ONE two\tthree\nfour", "lorem " * 3000, "z" * 5000, "same text here for all of us", "same text here for all of us"]


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SAMPLE}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, empty and long texts, and columns whose names operators use."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (None, "same text here for all of us"), (3, "x")]
    clash = {n: F.lit(n) for n in ("cut", "language", "start", "length", "rank", "key", "mark", "part", "row", "kind", "body", "places")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)

import public_tokenizers
import pytest
from odd_rows import CLASHES, ROWS, schema

@pytest.fixture(scope="session")
def bpe():
    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def library(bpe):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(*r, *["x"] * len(CLASHES)) for r in ROWS]
    return spark.createDataFrame(rows, schema(CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], schema())


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

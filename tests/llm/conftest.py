import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def tokenizer_file():
    return str(public_tokenizers.path("word_bpe_49k.json"))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, name string, level int, sha string, batch int, pos int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
    texts = [None, "", " ", "a", "a", "A", "one two three four five six", "one two  three four five six", "x" * 3000, "x" * 3000, long, long + " end", "é" * 60, "ß ünïcode 日本語 \U0001f600 " * 9, "\x00\t\n odd", "the same line\n" * 50]
    rows = [(i, t, "en", "s", len(t or ""), "k", "n", 1, "sha", 2, 3) for i, t in enumerate(texts)]
    rows += [(None, "null id text", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), rows[3], rows[10]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

import pytest

WIDE = "doc_id long, text string, h string, b int, bits string, maybe boolean, sha string, id string, fp long, part int, score string, found string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = "very long text with many words " * 4000
    rows = [
        (1, "Same text here"), (2, "same TEXT here"), (2, "same TEXT here"), (3, None), (4, ""), (5, "É same"), (6, "é same"), (None, "same text here"), (None, None),
        (7, long), (8, long + "x"), (9, "a" * 50_000), (10, "  spaces  and\ttabs\n\n "), (11, "<|endoftext|> inside"), (7, "tie of ids"), (12, "password = \"abcdefghijklmnop\" 4111 1111 1111 1111 x@y.zz"),
    ]
    return spark.createDataFrame([(i, t, "h", 1, "bits", True, "sha", "id", 5, 3, "s", None) for i, t in rows], WIDE)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def local(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    from subsetry.llm.bpe import public_path

    return Tokenizer.from_file(public_path("byte_bpe_50k.json"))

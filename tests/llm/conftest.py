import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty texts, ties, repeated rows and columns of clashing names."""
    rows = [
        (1, "Same  text here", "en", "a", 1, "x"),
        (2, "Same text\there", "en", "a", 1, "x"),
        (2, "Same text\there", "en", "a", 1, "x"),
        (3, None, None, None, None, None),
        (4, "", "en", "b", 0, "y"),
        (None, "no id", "fr", "b", 5, "y"),
        (5, "   \n\t ", None, "b", 6, "y"),
        (6, "word " * 60000, "de", "c", 300000, "z"),
        (7, "ü" * 5000 + "   日本語テキスト " + "a1b2" * 3000, "ja", "c", 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").withColumnsRenamed({"source": "source"})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

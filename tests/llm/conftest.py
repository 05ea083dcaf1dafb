import pytest

TYPES = "doc_id long, text string, lang string, source string, score double, `a.b` string, n_tokens long, component_id long, _at long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank, very long, repeated and tied texts; extra columns with clashing names."""
    long_words = " ".join(f"word{i % 977}" for i in range(40_000))
    texts = [None, "", " \n\t ", "a", "A", "é́ ﬁ　​😀 中文字 <|endoftext|> <s>", long_words, "x" * 100_000, "same text here", "same text here", "123 456 !!!"]
    rows = [(i, t, None if i % 4 == 0 else "en", "s", 0.5, "x", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(8, "same text here", "en", "s", 0.5, "x", 1, 2, 3), (None, "same text here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, TYPES)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")

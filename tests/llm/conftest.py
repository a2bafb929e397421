
import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, kept string, shard string"


@pytest.fixture(autouse=True)
def tables_of_stages():
    """The last stage that a test calls by itself keeps its tables for the next one; they go with the test."""
    yield
    import corpus_pipeline as P
    from probitas import stages
    while P._BEFORE:
        stages.release(P._BEFORE.pop())


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table with extra columns whose names clash with those of results."""
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None, "s", None if t is None else len(t), "x", "y", "z", "w") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny and very long texts, ties and repeated rows, characters of all kinds."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    prose = "The quick brown fox jumps over the lazy dog, again and again.\n" * 4
    return [None, "", " \n\t", "x", "Äé 漢字 🙂 \x1c end", prose, prose, prose.upper(), long, long, "a" * 5000,
            "don't 'll <|endoftext|> 123 ½ İ", "one\u00a0two\u3000three", None]

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp int, task string, length string, start string, bad int, host string, piece int, value string, row string, w string"


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (doc_id, text[, lang]), with columns whose names clash with what operators add."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", 1, "x", "x", "x", 1, "x", 1, "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


LONG = "lorem ipsum dolor, sit amet! " * 8000
MESSY = [
    (None, "a text without an id, but with enough words to be one of them all"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Ünïcödé — “quoted” 漢字 \U0001f600 é 1²³ \x1c\x85\xa0x"),
    (5, "one two three four five six seven eight nine ten eleven"),
    (5, "one two three four five six seven eight nine ten eleven"),
    (6, "one two three four five six seven eight nine ten eleven"),
    (7, LONG),
    (8, "a<|endoftext|>b"),
    (9, "x"),
    (10, "tab\tnew\nline\r\nÉé"),
]


@pytest.fixture(scope="session")
def messy(docs):
    return docs(MESSY)


@pytest.fixture(scope="session")
def none(docs):
    return docs([])

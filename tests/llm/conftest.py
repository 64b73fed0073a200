import pytest

#: Every column that an operator makes for itself, to clash with; and one that it doesn't know.
EXTRA = "digest string, fp string, size string, key string, bucket string, copies string, n_rows string, label string, __row string, __id string, __position string, __bucket string, text_hash string, other string"

LONG = "word " * 3000 + "tail " * 50 + "end"

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "the QUICK brown fox jumps over the lazy dog again and again", "en", "b", 10),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, LONG, "en", "a", len(LONG)),
    (6, "É È 漢字 naïve café ß\n\n naïve café", "fr", "c", 5),
    (6, "É È 漢字 naïve café ß\n\n naïve café", "fr", "c", 5),
    (7, "É È 漢字 NAïVE café ß\n\n naïve café", "fr", "c", 5),
    (None, "no id here at all, just words", "en", "b", 3),
    (8, " \t\n\x0b\x0c\r ", "en", None, 7),
    (9, "a\u00a0b \u2028 c\x1cd", "xx", "a", 3),
]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        extra = ("x",) * len(EXTRA.split(","))
        return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}").repartition(3)

    return make


@pytest.fixture(scope="session")
def docs(make_docs):
    return make_docs(ROWS).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("doc_id = -1")

import pytest

SMALL = "/root/testdata/sf0.001"

# Extra columns with names the operators use inside.
EXTRA = "t string, bucket int, n long, rep long, id long, secret_spans string, pii_row string, similar_to_smaller long"
SCHEMA = f"doc_id long, text string, lang string, {EXTRA}"


def odd_rows(*texts, lang="en"):
    """Rows with ids from 0, then a null id, a null text, an empty one and a repeated row."""
    texts = [*texts, None, ""]
    rows = [(i, t, lang, "x", 1, 2, 3, 4, "s", "p", 5) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, texts[0], None, "x", 1, 2, 3, 4, "s", "p", 5)]


@pytest.fixture(scope="session")
def frame(spark):
    def make(*texts, lang="en"):
        return spark.createDataFrame(odd_rows(*texts, lang=lang), SCHEMA)

    return make


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")

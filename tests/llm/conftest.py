import pytest
from pyspark.sql import Row

SMALL = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, mix string, group int"


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts and columns, empty and blank texts, repeated rows and ids, a very long text."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs on", "en", "src1"),
        (1, "the quick brown fox jumps over the lazy dog and runs on", "en", "src1"),
        (2, None, "en", "src1"),
        (3, "", None, "src2"),
        (4, " \t\n ", "de", None),
        (5, "word " * 60_000, "de", "src7"),
        (None, "no id here", "fr", "src9"),
        (None, None, None, None),
        (7, "the quick brown fox jumps over the lazy dog and runs on", "fr", "other"),
        (8, 'é token = "0123456789abcdef0123456789abcdef" ü', "fr", "src19"),
        (9, "x", "en", ""),
    ]
    return [(*row, len(row[1]) if row[1] else None, 5, 0.5, "m", 3) for row in rows]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small_documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture
def labels(spark):
    rows = [Row(doc_id=i, quality=i % 2, toxic=int(i == 1)) for i in range(1, 10)] + [
        Row(doc_id=None, quality=1, toxic=1),
        Row(doc_id=3, quality=None, toxic=None),
    ]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

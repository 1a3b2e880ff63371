import pytest
from pyspark.sql import Row

from strata.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Edge rows: nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    base = " ".join(f"word{i}" for i in range(80))
    rows = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, base + " tail", None, None), (4, None, "en", "s2"), (5, "", "de", "s2"),
        (6, " \n\t ", None, "s2"), (7, long, "en", "s1"), (None, base, "en", "s1"), (None, None, None, None), (8, "one two", "fr", "s3"),
        (9, "é😀 x▁y\x00z", "fr", "s3"), (10, base.upper(), "en", "s3"), (10, base.upper(), "en", "s3"), (11, "a b c d " * 100, "en", "s1"),
    ]
    return llm.createDataFrame(
        [Row(doc_id=a, text=b, lang=c, source=d, n_chars=None if b is None else len(b), key=i, _row="x", id=-1, row=1.5, n=None, size=0)
         for i, (a, b, c, d) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, key int, _row string, id int, row double, n int, size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sample(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sample_rows(sample):
    return [(r.doc_id, r.text) for r in sample.orderBy("doc_id").collect()]

import pytest
from pyspark.sql import DataFrame

#: What every operator must take: null in each column, empty and blank texts, copies, repeated rows, long texts.
LONG = "a long text without an end " * 4000
AWKWARD = [
    (1, None, "en", "s0", 0),
    (2, "", None, "s0", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "One two three four five six seven.", "en", "s0", None),
    (5, "One two three four five six seven.", "de", "s1", 34),
    (6, LONG, "en", "s0", len(LONG)),
    (7, "x" * 100_000, "en", "s0", 100_000),
    (8, "9" * 20_000 + " 1.2.3.4 a@b.cd", "en", "s0", 20_015),
    (4, "One two three four five six seven.", "en", "s0", None),
    (None, "Without an id, but with a text.", "fr", "s2", 31),
    (10, "été à l’œuvre <|endoftext|> ́ 漢字 😀", "fr", "s2", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The checkpoint folder that a cluster would name."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="session")
def awkward(shared) -> DataFrame:
    return shared.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(shared) -> DataFrame:
    return shared.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(shared, sf):
    return shared.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}

import pytest

from starloom.llm.common import read_table, ship_package
from tests.conftest import SMALL


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return read_table(spark, SMALL, "documents").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


#: Null texts and ids, an empty text, blanks only, no letters, a repeated row, one id with two texts, a long text.
ODD_ROWS = [
    (1, None, "en", "a", 7),
    (None, "no id here", "de", None, 7),
    (None, "no id here", "de", None, 8),
    (2, "", None, "a", None),
    (3, " \n\t ", "en", "b", 7),
    (4, "12 34 !!", "en", "b", 7),
    (5, "the same row twice over and over", "en", "a", 7),
    (5, "the same row twice over and over", "en", "a", 7),
    (5, "another text under the same id", "en", "a", 7),
    (6, "word and mark, éß\U0001d538 <|endoftext|> 's it's\n" * 3000, "fr", "b", 7),
]
ODD_DDL = "doc_id long, text string, lang string, source string, `SHARD` int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_DDL).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_DDL)

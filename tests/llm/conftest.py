
import pytest

DATA = "/root/testdata"




@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


#: Nulls, empty and long texts, ties, repeated rows; an extra column that clashes with names inside operators.
ODD = [
    (1, "The same line here.\nAnother line of words", "en", "s", 5, 7), (1, "The same line here.\nAnother line of words", "en", "s", 5, 7), (2, "The same line here.\nAnother line of words", "en", "s", 5, 7), (3, None, None, None, None, None),
    (4, "", "de", "s", 0, 1), (5, "   \n \t", "de", None, 5, 1), (None, "a b c d e f", "fr", "t", 11, 2), (None, None, None, None, None, None), (6, "word " * 60000, "en", "t", 300000, 3), (7, "x" * 30000, "en", "t", 30000, 3), (8, "é\u0001\u0002 🙂 ÀÈ 12", "fr", "t", 9, 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

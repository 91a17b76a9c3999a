import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], DOC)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, one id with two texts, a very long text, other alphabets."""
    long = "lorem ipsum dolor " * 30_000
    rows = [(1, None), (2, ""), (None, "no id here"), (3, "same row"), (3, "same row"), (4, "one text"), (4, "another text"), (5, long), (6, "Ünï ⼈ 😀 \u00a0 mixed\r\n\ttext"), (7, "   ")]
    # columns whose names the operators might use themselves
    return docs(spark, *rows).withColumns({"fp": F.lit(1), "count": F.lit(2), "key": F.lit("x"), "words": F.lit("y"), "label": F.lit(0), "n": F.lit(9)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")

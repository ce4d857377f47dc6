import pytest
from pyspark.sql import functions as F

PROSE = ("The committee met on Tuesday to review the plan for the new library and agreed that the reading room "
         "should open before the winter, although the roof still needs work and the shelves have not arrived yet.")
OTHER = ("Rivers carry sand from the mountains to the sea, where waves sort the grains by size and leave the coarse "
         "ones near the shore while the finest drift out with the tide and settle slowly in deep water.")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, blank and very long texts, repeated rows, rows
    that share a key, odd white space, and columns named like internals."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, PROSE, "en"), (2, PROSE, "en"), (3, PROSE.replace("Tuesday", "Wednesday"), None), (4, OTHER, "en"),
            (4, OTHER, "en"), (5, None, "de"), (6, "", None), (7, " \t\n ", "en"), (None, PROSE, "en"), (None, None, None),
            (8, "one", "en"), (9, "two words", "en"), (10, long, "en"), (11, "x" * 50_000, "en"), (12, "1 2 3", "en"),
            (13, OTHER + "\n" + PROSE, "en"), (13, "another text under the same key", "en"), (14, "ÀÉ ß 的 😀 \x00 end", "fr"),
            (15, "a b c d e f a b c d e f g\n\n\nline\nline\r\nline\n", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("n", "same", "key", "score", "kept", "start", "rank", "text2", "band", "count", "id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all day long", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all day long", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all day long", "en", "a", 1),
    (3, "", "de", "b", 0), (4, None, None, None, None), (5, " \n\t \x0b\x0c\r", "fr", "b", 7),
    (6, LONG, "en", "a", 9), (7, LONG + " end", "en", None, 9), (None, "no id here at all, but some words to look at for once", "en", "c", 3),
    (8, "zwei Wörter", "de", "b", 2), (9, "zwei Wörter", "de", "b", 2), (10, "a\nb\n\na\nb\n", "xx", "a", 1), (11, "naïve café — 東京 ünï", "fr", "a", 4),
    (2, "another text under an id that is taken", "en", "a", 1),
]
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHES = ["n", "d", "r", "h", "uid", "shard", "slot", "label", "node", "score", "predicted", "held_out", "budget", "weight", "full", "left", "cut",
           "before", "tokens", "epoch", "gone", "n_lines", "n_removed", "kept", "stratum", "sequence_id", "offset", "n_entities", "size", "rank"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, 0, None), (None, 1, 1), (6, None, 0), (8, 0, 1), (9, 1, 0), (11, 5, 5)],
                                 "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))

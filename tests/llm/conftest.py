import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("test data not present")
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """Odd documents: nulls, empty, blank, long, repeated rows, a shared id, clashing columns."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "The quick brown fox jumps over the lazy dog again", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0),
            (4, " \n\t ", "fr", "b", 3), (5, long, "en", "b", 1), (6, "same same same " * 30, "en", "b", 1), (7, "same same same " * 30, "en", "b", 1),
            (8, f"alpha beta {passage} gamma delta", "en", "c", 1), (9, f"one {passage} two", "en", "c", 1), (10, "one two", "de", "c", 1),
            (10, "one two", "de", "c", 1), (10, "other text", "de", "c", 1), (None, "no id here", "en", None, 1), (11, "ünïcödé 文字 　 x", "xx", "d", 1),
            (12, "A" * 50_000, "en", "d", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def clash(docs):
    """The same rows with more columns, named as the operators' own."""
    from pyspark.sql import functions as F
    for c in ("n_words", "n_hit", "items", "clean_text", "kept_text", "kept_words", "n_removed", "fp", "tk", "key", "n", "label",
              "block", "_t", "_tk", "_spans", "piece", "n_tokens", "kept", "shard"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs

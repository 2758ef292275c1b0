import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, score double, part int, h long, key string, train boolean"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, repeated ids, clashing column names."""
    long = "\n".join(f"line {i} of a long text with words {i * i} and {i % 7}" for i in range(3000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, long), (4, long), (4, long), (5, same), (6, same), (6, "other text under the same id"),
            (None, same), (None, None), (7, same + " thirteen"), (8, "x"), (9, "a b"), (10, "▁ é 日本語 \u0000 \U0001f600 ### </turn> \\ end"),
            (11, "y" * 50_000), (12, "word " * 40_000), (5, same), (13, "A  B   C\n\n\n\nD"), (14, "\x1c\x85\u2028sep")]
    return spark.createDataFrame([(i, t, None, None, None, "p", None, 1, 2, "k", None) for i, t in rows], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

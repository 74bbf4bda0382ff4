import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "é" * 3000), (7, "word " * 5000), (8, "a\nb\na\nb\n"), (9, "line one has eight words in it now\n" * 3),
    (10, "line one has eight words in it now"), (11, "   odd\u0000spaces"), (12, "x" * 900), (13, "x" * 900), (14, "𝔘𝔫𝔦 code 😀" * 50), (15, "!!! ??? ... ,,,"), (-3, "one two"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, a row that is there twice, and columns with names the operators use."""
    rows = [(i, t, "en", "s", len(t or ""), "clash", 0, None) for i, t in ODD] + [(5, "one two", "en", "s", 7, "clash", 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, fp int, n_lines int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]

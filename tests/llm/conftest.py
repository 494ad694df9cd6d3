from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, row long, words string, score double, text_ string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, columns named like results."""
    from tidewire.llm.common import small_batches

    small_batches(spark)
    long_text = " ".join(f"word{k % 977} and{k % 31}." for k in range(60_000)) + "\nend of the long one."
    texts = [(1, "A plain first text of some words. It has two sentences.\nAnd a line more."), (2, None), (3, ""), (4, " \n\t "), (None, "no id here but words."), (None, None), (5, long_text), (6, "same text twice"), (6, "same text twice"), (7, "same text twice"), (8, "Ünïcödé ñandú 日本語 😀 <|endoftext|> it's\xa0here")]
    return spark.createDataFrame([(k, t, None, None, None, True, 3, 4, "w", 0.5, None) for k, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark, edge):
    return edge.limit(0)

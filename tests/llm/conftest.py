import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, fp bigint, __q string, key string, component_id bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names operators use."""
    prose = "The quick brown fox of the north jumps over a lazy dog and rests in the shade of old trees. "
    rows = [(1, prose * 6), (2, None), (3, ""), (4, " \n\t "), (5, prose * 6), (5, prose * 6), (None, "a null id"), (6, "word " * 60000), (7, "x" * 30000), (8, "é漢😀 \x00 '"), (9, None), (None, None)]
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, "q", "k", 3) for i, t in rows], SCHEMA)

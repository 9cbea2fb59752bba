import pytest

LONG = "word " * 40_000 + "end"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, node string, size string, shard string, tag int, base string"


def documents(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, lang, "src0", len(t or ""), 7, "n", "s", "x", 1, "b") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [
    (1, None, None),
    (2, "", "en"),
    (3, " \n\t", "fr"),
    (4, LONG, "en"),
    (5, "the same text twice over, again and again", "en"),
    (6, "the same text twice over, again and again", "en"),
    (6, "the same text twice over, again and again", "en"),
    (None, "no id here at all, but some words all the same", None),
    (8, "é", "fr"),
    (9, "12345 67890", None),
    (10, "\U0001f600 ünï ß ǅ", "de"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return documents(spark, EDGES).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])

import pytest


@pytest.fixture
def messy(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash
    with those the operators use."""
    long = "one long line of words that goes on and on " * 4000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "s1", "x", 1),
        (2, "alpha beta gamma delta epsilon zeta", None, None, None),
        (2, "alpha beta gamma delta epsilon zeta", None, None, None),
        (None, "alpha beta gamma delta epsilon zeta", "s2", "y", 2),
        (None, None, None, None, None),
        (5, None, "s3", "z", 3),
        (6, "", "s3", "z", 3),
        (7, " \n\t ", "s4", "z", 3),
        (8, long, "s5", "z", 3),
        (9, long + "tail", "s5", "z", 3),
        (10, "\x00\x1f emoji 🎉 ünïcödé ٣", "s6", "", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, row int").selectExpr("*", "kept AS digest", "kept AS label", "kept AS component_id", "row AS n_words", "kept AS ids")


@pytest.fixture
def none(messy):
    return messy.limit(0)

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score double, code long, n_words long, label string, chunk long, part int")
BASE = " ".join(f"word{k}" for k in range(40))
EDIT = BASE.replace("word20", "other")
LONG = " ".join(f"w{k % 7919}x" for k in range(60_000))


@pytest.fixture(scope="session")
def hard_rows():
    """Rows with every hazard: nulls in any column, empty and very long texts,
    ties, repeated rows; the extra columns carry names that operators use."""
    texts = [(1, BASE), (2, BASE), (2, BASE), (3, EDIT), (4, None), (5, ""), (6, " \t\n "),
             (7, "Two words"), (8, "two WORDS"), (9, LONG), (None, BASE), (None, None),
             (10, "Ünïcode 漢字   x\x1cy"), (11, "a\n\nb\n a \nfooter"), (12, "z\nfooter"),
             (13, "footer"), (14, "Licensed under the Apache License, Version 2.0.\nfooter")]
    return [(i, t, "en" if k % 2 else None, None if k % 5 == 0 else "s1", None, 1.5, k, 7, "l", 3, 4)
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

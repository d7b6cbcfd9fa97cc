import pytest
from samples import PROSE, fresh


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join([fresh(9, 30_000), PROSE, "x" * 60_000, "a@b.org +1 (415) 555-0132, 10.0.0.1"])
    texts = [(1, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, "one two"), (8, fresh(8, 60)), (8, fresh(8, 60)), (None, PROSE)]
    rows = [(i, t, None if i == 2 else "en", None, None, "z", 1, None) for i, t in texts]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string, length int, key string"
    )

import pytest


@pytest.fixture(scope="session")
def rows_of():
    """Rows of a frame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with an extra column that clashes with internal names."""
    def make(rows):
        full = [(i, t, "en" if len(r) < 1 else r[0], "s" if len(r) < 2 else r[1], None if t is None else len(t), 1) for i, t, *r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id int")
    return make

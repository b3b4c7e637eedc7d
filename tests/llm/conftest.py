import pytest

from spotframe.session import ship_library

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, bucket string"


@pytest.fixture(scope="session")
def llm(spark):
    """The session with the package shipped to its Python workers."""
    ship_library(spark)
    return spark


@pytest.fixture
def documents(llm):
    """documents rows from (doc_id, text), with extra columns whose names clash with inner ones."""
    def make(rows):
        return llm.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOCS)
    return make


@pytest.fixture
def tables(llm, tmp_path):
    """Writes tables as a test-data folder and returns its path."""
    def make(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make

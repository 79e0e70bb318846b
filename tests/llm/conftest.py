import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        full = [(*r, *["en", "s0"][len(r) - 2 :], 0) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clashing():
    """A frame with further columns whose names the operators use themselves."""

    def add(df):
        names = "n size id key rank score hit items component label x row part list code group shard host path".split()
        return df.withColumns({n: F.lit(f"own {n}") for n in names if n not in df.columns})

    return add

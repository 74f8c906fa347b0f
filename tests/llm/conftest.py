import pytest
from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text[, lang, source]) tuples."""

    def make(rows, extra=False):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            r = (*r, *("en", "s0")[len(r) - 2 :])
            full.append((*r[:4], len(r[1]) if r[1] is not None else None))
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if extra:  # names that an operator might use itself
            for name in ("row_id", "key", "n_tokens", "n_lines", "score", "fp", "n", "part", "shard", "ids", "gone", "pos"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


ODD = [None, "", " ", "\n\n", "a", "word " * 3000, "a\x0bb c", "É é ß 漢字 𝒳", "same text", "same text", (None, "no id"), (7, None)]


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns."""
    return make_docs(ODD, extra=True)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)

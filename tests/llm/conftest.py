import pytest

CLASHING = ("row_id", "body", "carrier", "doc", "key", "kept", "n", "rep", "component", "held_out", "word")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns named as the operators name theirs."""

    def make(pairs, extra=True):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for name in CLASHING:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

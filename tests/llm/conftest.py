import pytest
from pyspark.sql import types as T

from hireframe.llm.common import ship_code


@pytest.fixture(autouse=True, scope="session")
def _code(spark):
    ship_code(spark)


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use inside or return.
CLASH = ["id", "size", "key", "n", "n_removed", "ids", "n_tokens", "_n", "_z", "score", "rank", "tree", "row_before", "_range", "block", "taken"]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, clash=False):
        """Rows (doc_id, text[, source]) as a documents table, optionally with extra columns of clashing names."""
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(data, DOCS)
        if clash:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
        return df
    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty, blank and very long texts, ties and repeated rows, odd code points."""
    long_ = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "  \n\t \n"), (4, "one"), (5, long_, "b"), (6, long_, None), (7, "a b c d e f\n" * 30, "b"),
            (8, "é 🙂 ▁ x\x00y </s> [INST] \\ z"), (8, "é 🙂 ▁ x\x00y </s> [INST] \\ z"), (None, "null id text here and more"), (9, "One  TWO"), (10, "one two", None)]

    def make(clash=False):
        return docs_of(rows, clash)
    return make

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, ties, a very long text, and columns whose names clash with working ones."""
    long = "Lorem " + " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta"), (2, "alpha BETA gamma delta epsilon zeta"), (3, None), (4, ""), (5, "  \t\n"), (6, "alpha beta gamma delta epsilon zeta"), (6, "alpha beta gamma delta epsilon zeta"),
        (7, "one"), (8, "One"), (9, "École été naïve 日本語 😀 it's 123 apache license"), (10, long), (11, long + " tail"), (None, "alpha beta gamma delta epsilon zeta"), (None, None), (12, "x " * 80),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    for name in ("key", "node", "digest", "row", "score", "_base", "fps", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

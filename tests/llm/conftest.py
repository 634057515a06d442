import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a DataFrame with an extra column whose name clashes with ones the operators use inside."""

    def make(rows, schema, partitions=3):
        return spark.createDataFrame([(*r, 1.5) for r in rows], schema + ", score double").repartition(partitions)

    return make

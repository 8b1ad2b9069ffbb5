import pytest

from siftwork.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="8g", shuffle=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column builder over literal rows and return the results in order."""
    def run(rows, schema, build):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + schema)
        return [r.v for r in df.select("_i", build(df).alias("v")).orderBy("_i").collect()]
    return run

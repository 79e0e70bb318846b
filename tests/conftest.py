import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fieldspark.sources.fixture import fixture_tables  # noqa: E402
from verification.compare import duck_connection, local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions="3")
    session.conf.set("spark.sql.maxMetadataStringLength", "100000")  # whole filters in plans
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def tables(spark):
    return fixture_tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    return duck_connection(SF_DIR)


@pytest.fixture
def final_plan():
    """Runs a frame and returns the plan that was executed, after adaptive changes."""

    def run(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    return run

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pressline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="pressline-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def value(spark):
    """Evaluates one column over one row of given values: ``value(expr, a=1, b='x')``."""
    from pyspark.sql import functions as F

    def run(expression, schema=None, **columns):
        if schema:
            df = spark.createDataFrame([tuple(columns.values())], schema)
        elif columns:
            df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
        else:
            df = spark.range(1)
        return df.select(expression.alias("v")).collect()[0]["v"]

    return run

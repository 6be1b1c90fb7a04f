import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column over one row of named values."""
    from pyspark.sql import functions as F

    def run(column, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("_")])
        return row.select(column.alias("v")).first()["v"]

    return run

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture()
def frame(spark):
    """frame("a string, b int", rows) -> DataFrame; dates are given as ISO text."""
    from pyspark.sql import functions as F

    def make(schema, rows, dates=()):
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({d: F.to_date(d) for d in dates})

    return make

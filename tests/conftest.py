import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioscan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        app="tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a column function to a list of argument tuples, in one job."""
    from pyspark.sql import functions as F

    def run(function, cases, types="string"):
        kinds = types.split()
        width = len(cases[0])
        kinds = kinds * width if len(kinds) == 1 else kinds
        schema = "i int, " + ", ".join(f"c{n} {kinds[n]}" for n in range(width))
        df = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], schema)
        result = df.select("i", function(*[F.col(f"c{n}") for n in range(width)]).alias("r"))
        return [row["r"] for row in sorted(result.collect(), key=lambda row: row["i"])]

    return run

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terralane.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture
def points(spark):
    """Make an id, x, y table from a list of pairs."""
    def make(pairs, **extra):
        rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(pairs)]
        return spark.createDataFrame(rows, "id long, x double, y double")
    return make


@pytest.fixture
def boxes(spark):
    from pyspark.sql import functions as F

    from terralane.functions import geometry as G

    def make(rows):
        df = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(rows)],
                                   "id long, minx double, miny double, maxx double, maxy double")
        return df.withColumn("geom", G.box_geometry(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
    return make


@pytest.fixture
def cells(spark):
    """Make an r, c, v table from a nested list or array."""
    def make(grid):
        rows = [(r, c, None if v is None or v != v else float(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
        return spark.createDataFrame(rows, "r int, c int, v double")
    return make

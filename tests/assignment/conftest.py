import pytest

from arterial.grid import LINKS, PAIRS, links, pairs


def grid():
    return links()


@pytest.fixture(scope="session")
def arcs(spark):
    return spark.createDataFrame(grid(), LINKS)


@pytest.fixture(scope="session")
def od(spark):
    return spark.createDataFrame(pairs(500.0), PAIRS)

import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    from hirelens.sources.tables import read_table
    return read_table(spark, sf, "documents").cache()


@pytest.fixture(scope="session")
def labels(spark, sf):
    from hirelens.sources.tables import read_table
    return read_table(spark, sf, "labels").cache()

import pytest

from foliomill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rows(df, *order):
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]

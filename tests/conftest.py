import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of 7 slots, so that every series crosses many block edges."""
    from windrow.functions import timegrid
    from windrow.plans import testbed
    monkeypatch.setattr(timegrid, "SLOTS_PER_BLOCK", 7)
    testbed.forget_landed()
    yield
    testbed.forget_landed()

import pytest


@pytest.fixture(scope="session")
def shuffled():
    """A frame's rows, sorted: what tests compare."""
    return lambda df: sorted(tuple(r) for r in df.collect())

import pytest


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"

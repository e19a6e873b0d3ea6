import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())

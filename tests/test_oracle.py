"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
# At this scale there are 10 accounts, which need one bit less than the SQL spells out.
OTHER_SCALE = {"binary_codes": "/root/testdata/sf0.01"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    sf = OTHER_SCALE.get(name, SF)
    con = check_oracle.connect(sf)
    ok, text, _ = check_oracle.compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns[0] == "BankTransactionId"

import os

import oracle
import pytest

from readroute.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLES:
        oracle.compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_names_agree():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_bases_are_of_the_true_lengths(spark):
    sql = "SELECT barcode, coalesce(is_mapped, false) AS is_mapped, count(*) AS n, count(length) AS n_length, CAST(sum(length) AS BIGINT) AS bases FROM bam_summary GROUP BY 1, 2"
    oracle.compare(spark, registry.QUERIES["bam_bases"], sql, SF)

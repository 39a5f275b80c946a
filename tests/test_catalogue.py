import pytest

from relcheck.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


def test_p_values(spark):
    import math

    for r in QUERIES["mcnemar_p_value"](spark, "/root/testdata/sf0.001").collect():
        assert abs(r.p_value - math.erfc(math.sqrt(r.chi2 / 2))) < 1e-12

import pytest
from conftest import same_rows

import __spark_entry__ as entry
from foretable.plans import catalogue, fixtures

NAMES = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    same_rows(catalogue.queries()[name](spark, sf_dir), duck, catalogue.oracle_sql()[name])


def test_entry_gives_scores(spark):
    rows = entry.entry(spark).collect()
    assert {r.bucket for r in rows} == {"1h", "same_day", "2-3d", "4-7d"}
    assert all(r.mase > 0 for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["dm_test", "bootstrap_ci", "bootstrap_methods", "block_bootstrap"])
def test_inference_queries_run(name, spark, sf_dir):
    rows = catalogue.queries()[name](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert {r.bucket for r in rows} == set(fixtures.DAILY.buckets)
    for r in rows:
        assert 0 <= r.p <= 1 if name == "dm_test" else r.low <= r.mean_diff <= r.high and 0 <= r.p_sign <= 1

import pytest

from twins import same
from vocalith import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql_twin(spark, data, name):
    same(spark, data, catalogue.queries()[name], SQL[name])


def test_only_queries_with_tests_of_their_own_have_no_twin():
    """These two stand in test_diarization."""
    assert set(catalogue.queries()) - set(SQL) == {"recording_clusters", "diarized_regions"}


def test_every_twin_has_a_query():
    assert set(SQL) <= set(catalogue.queries())


def test_flagship(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

import pytest

from subsidia import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(matches, name):
    matches(registry.QUERIES[name], registry.ORACLES[name])


def test_every_query_has_a_schema():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_without_llm():
    """The entry module works whether or not the optional subpackage is there."""
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

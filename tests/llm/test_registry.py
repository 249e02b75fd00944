from engramlake.llm import registry


def test_oracles_are_sql_of_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert all(isinstance(sql, str) and "SELECT" in sql for sql in registry.ORACLES.values())

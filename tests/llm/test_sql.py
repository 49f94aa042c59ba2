"""Corpus queries against their SQL counterparts, on the smallest tables."""

import pytest

from skyloom.llm import queries
from tests.test_queries import SF, duck, ordered  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    theirs = duck.sql(queries.SQL[name])
    assert sorted(theirs.columns) == cols
    assert ordered(tuple(r) for r in df.select(*cols).collect()) == ordered(theirs.select(", ".join(f'"{c}"' for c in cols)).fetchall())

"""Queries with SQL against that SQL, over whole tables."""

import pytest

from assetlens.llm import queries
from oracle import duck, kind, norm

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck(SF).execute(queries.ORACLE_SQL[name])
    names, types = [d[0] for d in cur.description], dict(df.dtypes)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert {c: kind(types[c]) for c in cols} == {d[0]: kind(str(d[1])) for d in cur.description}
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect()) == want

"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

import decimal
import math

import pytest

from scanmill.plans import load

QUERIES, ORACLES = load()


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    if name not in ORACLES:
        return
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert ordered(rows) == ordered(want)

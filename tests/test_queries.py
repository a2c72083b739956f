"""Every registered query outside llm against its SQL twin, at the smallest scale."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from specimen_spark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def tidy(rows):
    return Counter(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", ["k2p_distances", "transversion_distances"])
def test_methods_reach_all_pairs(spark, name):
    assert "species" not in plans.ORACLE_SQL[f"{name}_all"].split("FROM c x JOIN c y")[1]
    assert plans.QUERIES[f"{name}_all"](spark, SF).count() > plans.QUERIES[name](spark, SF).count()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    if name not in plans.ORACLE_SQL:
        assert got.columns and got.count() >= 0
        return
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert tidy(map(tuple, got.select(*columns).collect())) == tidy(want.fetchall())

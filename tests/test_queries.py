import os
import random

import duckdb
import pytest

from lodewright.plans import catalog
from lodewright.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(list(map(value, x))) if isinstance(x, (list, tuple)) else str(x)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = plain(frame.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    wanted = db.sql(ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert rows == plain(wanted.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_bootstrap_seeded_resamples_as_often_as_the_reference(spark):
    values: dict[str, list[float]] = {}
    for r in catalog._values(spark, SF).orderBy("system", "slot").collect():
        values.setdefault(r["system"], []).append(r["value"])
    wanted = {}
    for name, x in values.items():
        draw = random.Random(20260507)
        means = sorted(sum(x[draw.randrange(len(x))] for _ in x) / len(x) for _ in range(10_000))
        wanted[name] = (round(means[250], 4), round(means[9750], 4))
    got = QUERIES["bootstrap_seeded"](spark, SF).collect()
    assert {r["system"]: (r["ci_lo"], r["ci_hi"]) for r in got} == wanted

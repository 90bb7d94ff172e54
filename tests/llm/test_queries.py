import math

import duckdb
import pytest
from helpers import SMALL

from credence.llm import queries


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    frame = want.fetchall()
    order = [[d[0] for d in want.description].index(c) for c in columns]

    def norm(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    got = queries.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(str([norm(x) for x in r]) for r in got) == sorted(str([norm(r[i]) for i in order]) for r in frame)

"""Every query with an oracle against its SQL."""

import duckdb
import pytest

from lodestar.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    frame = registry.QUERIES[name](spark, SF)
    want = db.execute(f"select {', '.join(frame.columns)} from ({registry.ORACLES[name]})").fetchall()
    got = sorted(map(tuple, frame.collect()))
    assert got == sorted(want) and got

"""Rounded results where the digit beyond the last is a tie: the same double from Spark and DuckDB, not only a close one."""

from pathlib import Path

import duckdb
import pytest

from wakeline.plans import ORACLES, QUERIES


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_clipped_scale_at_ties(spark, size):
    con = duckdb.connect()
    for p in Path(f"/root/testdata/{size}").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = dict(con.execute("SELECT event_id, scaled FROM (" + ORACLES["SC14_clipped_scale"] + ")").fetchall())
    got = [(r.event_id, r.scaled) for r in QUERIES["SC14_clipped_scale"](spark, f"/root/testdata/{size}").collect()]
    assert len(got) == len(want)
    assert [(e, x, want[e]) for e, x in got if x != want[e]] == []

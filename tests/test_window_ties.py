"""Percentiles of windows that stand at a threshold: the same rows from Spark and DuckDB, to the last bit."""

import duckdb
import pytest

from wakeline.plans import ORACLES, QUERIES

#: (copy, vessel of sf0.1): with the keys of that copy, the vessel has a window whose 95th percentile a sum in another order puts on the other side.
VESSELS = [(33, 1056), (8, 139), (0, 966), (4, 116), (5, 537), (4, 1090)]


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    folder, s = tmp_path_factory.mktemp("tied"), "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute("CREATE TABLE v (i BIGINT, u BIGINT)")
    con.executemany("INSERT INTO v VALUES (?, ?)", VESSELS)
    con.execute(f"COPY (SELECT e.* REPLACE (event_id + i * 100003 AS event_id, user_id + i * 1501 AS user_id) FROM '{s}/events.parquet' e JOIN v ON user_id = u) TO '{folder}/events.parquet'")
    con.execute(f"COPY (SELECT o.* REPLACE (o_orderkey + i * 150001 AS o_orderkey, o_custkey + i * 1501 AS o_custkey) FROM '{s}/orders.parquet' o JOIN v ON o_custkey = u) TO '{folder}/orders.parquet'")
    for t in ("supplier", "nation"):
        con.execute(f"COPY (FROM '{s}/{t}.parquet') TO '{folder}/{t}.parquet'")
    for t in ("events", "orders", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["AG38_vessel_flags", "J31_label_override", "WN8_episodes"])
def test_threshold_on_a_percentile(spark, tied, name):
    folder, con = tied
    got = QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_fast_window_of_a_confirmed_interval(spark):
    con = duckdb.connect()
    for t in ("events", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.1/{t}.parquet'")
    got = QUERIES["AG49_confirmed_recall"](spark, "/root/testdata/sf0.1").select("truth_id", "exact", "within_day").collect()
    want = con.execute(f"SELECT truth_id, exact, within_day FROM ({ORACLES['AG49_confirmed_recall']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)

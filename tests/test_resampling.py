"""Folds, permutations, precision and reconciliation against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wakeline.operators import reconcile as C
from wakeline.operators import resampling as S
from wakeline.operators.ranges import percentiles


def test_folds_keep_groups_whole_and_balanced(spark):
    rng = random.Random(1)
    rows = [(f"g{g}", int(g % 7 == 0)) for g in range(140) for _ in range(rng.randrange(1, 9))]
    got = S.grouped_folds(spark.createDataFrame(rows, "g string, y int"), "g", "y", 5, 3).collect()
    fold = {}
    for r in got:
        assert fold.setdefault(r.g, r.fold) == r.fold
    assert len(got) == len(rows) and set(fold.values()) == set(range(5))
    positive = Counter(f for g, f in fold.items() if int(g[1:]) % 7 == 0)
    whole = Counter(fold.values())
    assert max(positive.values()) - min(positive.values()) <= 1 and max(whole.values()) - min(whole.values()) <= 2


def test_permuted_column(spark):
    df = spark.createDataFrame([(k, k * 10, "x") for k in range(500)], "k long, v long, s string")
    got = S.permuted(df, "k", "v", 1).orderBy("k").collect()
    assert [r.k for r in got] == list(range(500)) and sorted(r.v for r in got) == [k * 10 for k in range(500)]
    assert sum(r.v == r.k * 10 for r in got) < 20 and got == S.permuted(df, "k", "v", 1).orderBy("k").collect()
    assert got != S.permuted(df, "k", "v", 2).orderBy("k").collect()


def test_average_precision(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(30) / 10) for _ in range(400)]
    got = S.average_precision(spark.createDataFrame(rows, "y int, score double"), "y", "score").first()[0]
    total, hits, seen, want = sum(y for y, _ in rows), 0, 0, 0.0
    for s in sorted({s for _, s in rows}, reverse=True):
        p = sum(y for y, x in rows if x == s)
        hits, seen = hits + p, seen + sum(x == s for _, x in rows)
        want += p / total * hits / seen
    assert got == pytest.approx(want)
    assert S.average_precision(spark.createDataFrame([(0, 1.0)], "y int, score double"), "y", "score").first()[0] is None


def test_weighted_percentiles(spark):
    rng = random.Random(3)
    rows = [("a" if k % 3 else "b", rng.choice([1.0, 2.5, 4.0, 8.0]), rng.randrange(0, 4)) for k in range(60)] + [("c", None, 2)]
    got = {r.g: (r.lo, r.mid, r.hi) for r in percentiles(spark.createDataFrame(rows, "g string, v double, w int").where("w > 0"), ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.95}, weight="w").collect()}
    import numpy as np

    for g in "ab":
        values = [v for h, v, w in rows for _ in range(w) if h == g]
        assert got[g] == pytest.approx(tuple(np.quantile(values, [0.1, 0.5, 0.95])))
    assert set(got) == {"a", "b"}


def test_draws_are_with_replacement(spark):
    tracks = spark.createDataFrame([(f"t{k}",) for k in range(80)], "track_id string")
    got = S.draws(tracks, "track_id", 10, 42).collect()
    per = Counter()
    for r in got:
        per[r.replicate] += r.weight
    assert per == {k: 80 for k in range(10)} and {1, 2, 3} <= {r.weight for r in got}
    assert sorted(got) == sorted(S.draws(tracks.repartition(3), "track_id", 10, 42).collect())


def test_reconciliation_cases(spark):
    rows = [
        ("a", 111111111, 1, 1.0), ("a", 111111111, 1, 3.0), (None, 111111111, None, 2.0),  # joins a, which agrees
        ("b", 222222222, None, 1.0), ("c", 222222222, None, 1.0), (None, 222222222, 5, 9.0),  # two uuids: ambiguous
        (None, 333333333, None, 1.0), (None, 333333333, 7, 2.0),  # no uuid: by MMSI
        (None, None, 8, 1.0), (None, 12, 8, 2.0),  # no valid MMSI: by IMO, not trusted
        ("", None, None, 1.0), (None, None, None, 4.0),  # fingerprints
        ("d", 444444444, None, 1.0), ("d", 555555555, None, 2.0),  # disagrees
        ("e", 666666666, None, 1.0), ("e", 6, None, 2.0),  # an invalid one besides
    ]
    df = spark.createDataFrame(rows, "uuid string, mmsi long, imo long, t double")
    valid = F.coalesce(F.col("mmsi").between(100_000_000, 999_999_999), F.lit(False))
    got = C.reconcile(df, valid, C.fingerprint(F.col("t")), F.struct("t")).collect()
    named = {(r.kind, r.value if r.kind in ("uuid", "mmsi", "imo") else ""): (r.trusted_mmsi, r.n, r.latest.t) for r in got if r.kind != "fallback"}
    assert named == {
        ("uuid", "a"): (111111111, 3, 3.0), ("uuid", "b"): (None, 1, 1.0), ("uuid", "c"): (None, 1, 1.0), ("ambiguous", ""): (None, 1, 9.0),
        ("mmsi", "333333333"): (333333333, 2, 2.0), ("imo", "8"): (None, 2, 2.0), ("uuid", "d"): (None, 2, 2.0), ("uuid", "e"): (None, 2, 2.0),
    }
    assert sum(r.kind == "fallback" for r in got) == 2

"""The path classifier is scored on groups it has not seen."""

import random

import pytest

from wakeline.operators import path_model as M


def test_out_of_fold_scores(spark):
    rng = random.Random(1)
    rows = []
    for g in range(60):
        y = int(g % 4 == 0)
        rows += [(f"v{g}", k, y, rng.gauss(2 * y, 1), rng.gauss(0, 1) if k else None, rng.choice([0.0, float("inf"), 1.0])) for k in range(rng.randrange(2, 7))]
    df = spark.createDataFrame(rows, "v string, k int, y int, a double, b double, c double")
    got = M.out_of_fold_scores(df, ["a", "b", "c"], "y", "v", folds=3).collect()
    fold = {}
    assert len(got) == len(rows) and all(fold.setdefault(r.v, r.fold) == r.fold for r in got) and set(fold.values()) == {0, 1, 2}
    assert all(0 <= r.score <= 1 for r in got)
    pairs = [(p.score > n.score) + 0.5 * (p.score == n.score) for p in got if p.y for n in got if not n.y]
    assert sum(pairs) / len(pairs) > 0.85
    one = M.out_of_fold_scores(df.where("y = 0"), ["a"], "y", "v", folds=3).collect()
    assert one and all(r.score == 0.0 for r in one)


def test_score_is_the_mean_of_both(spark):
    rng = random.Random(2)
    df = M.assembled(spark.createDataFrame([(k % 2, rng.gauss(k % 2, 1)) for k in range(200)], "y int, a double"), ["a"])
    got = M.fit(df, "y")(df)
    assert got.columns == [*df.columns, "score"] and 0.2 < got.agg({"score": "avg"}).first()[0] < 0.8
    assert got.where("y = 1").agg({"score": "avg"}).first()[0] > got.where("y = 0").agg({"score": "avg"}).first()[0] + 0.1
    assert M.fit(df, "y")(df).agg({"score": "sum"}).first()[0] == pytest.approx(got.agg({"score": "sum"}).first()[0])

"""Robustness operators against plain loops."""

import hashlib
import random

import numpy as np
import pytest

from tapeledger.operators import robustness as R


@pytest.fixture(scope="module")
def series():
    rnd = random.Random(6)
    return {k: [round(rnd.gauss(0, 1), 3) for _ in range(n)] for k, n in (("a", 40), ("b", 23), ("c", 3), ("d", 2))} | {"flat": [0.5] * 20}


def frame(spark, series):
    return spark.createDataFrame([(k, i * 10, v) for k, x in series.items() for i, v in enumerate(x)], "k string, t int, r double")


def test_bootstrap_draws_repeat(spark, series):
    got = {(r.k, r.draw): r.sharpe for r in R.bootstrap_sharpe(frame(spark, series).repartition(5), ["k"], "t", "r", 4, 6, 12.0, 3).collect()}
    for k, x in series.items():
        blocks = [x[i:i + 4] for i in range(0, len(x), 4)]
        for draw in range(6):
            picks = [int(hashlib.md5(f"3:{k}:{draw}:{j}".encode()).hexdigest()[:12], 16) % len(blocks) for j in range(len(blocks))]
            values = np.array([v for p in picks for v in blocks[p]])
            spread = values.std(ddof=1) if len(values) > 1 else 0.0
            if spread < 1e-6:
                assert got[k, draw] is None or abs(got[k, draw]) > 1e6
            else:
                assert got[k, draw] == pytest.approx(values.mean() * 12 ** 0.5 / spread, rel=1e-6)


@pytest.mark.parametrize("width,most", [(1, 3), (3, 2), (4, 100)])
def test_best_windows_are_the_greedy_ones(spark, series, width, most):
    got = {}
    for r in R.best_windows(frame(spark, series), ["k"], "t", "r", width, most).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append((r.first_position, r.last_position, pytest.approx(r.total)))
    for k, x in series.items():
        left = sorted(((sum(x[i:i + width]), -i) for i in range(len(x) - width + 1)), reverse=True)
        want = []
        while left and len(want) < most:
            total, i = left[0]
            want.append((1 - i, width - i, total))
            left = [(t, j) for t, j in left if abs(i - j) >= width]
        assert [(a, b) for a, b, _ in want] == [(a, b) for a, b, _ in got.get(k, [])], k


def test_leave_one_out_and_beta(spark):
    parts = [("p", s, t, v) for s, values in {"x": [1.0, 2.0, None], "y": [0.5, None, 4.0]}.items() for t, v in enumerate(values) if v is not None]
    got = {(r.left_out, r.t): r.r for r in R.without_each(spark.createDataFrame(parts, "k string, s string, t int, r double"), ["k"], "s", "t", "r").collect()}
    assert got == {("x", 0): 0.5, ("x", 1): 0.0, ("x", 2): 4.0, ("y", 0): 1.0, ("y", 1): 2.0, ("y", 2): 0.0}
    rnd = random.Random(2)
    m = [rnd.gauss(0, 1) for _ in range(50)]
    rows = [("q", t, 2 * v + 0.1) for t, v in enumerate(m)] + [("still", t, 1.0) for t in range(50)] + [("q", 99, 5.0)]
    beta = {r.k: r for r in R.market_beta(spark.createDataFrame(rows, "k string, t int, r double"), spark.createDataFrame(list(enumerate(m)), "t int, m double"), ["k"], "t", "r", "m").collect()}
    assert beta["q"].beta == pytest.approx(2) and beta["q"].alpha == pytest.approx(0.1) and beta["q"].n == 50
    assert beta["still"].beta == pytest.approx(0) and beta["still"].correlation is None


def test_dropped_windows(spark, series):
    got = {r.k: r for r in R.drop_best_windows(frame(spark, series), ["k"], "t", "r", 3, 2, 12.0).collect()}
    assert got["a"].n == 34 and got["a"].n_removed == 6 and got["d"].n == 2 and got["d"].n_removed == 0 and "c" not in got


def test_stored_tables_are_dropped(spark):
    import os

    from tapeledger.session import cut_lineage, drop_stored

    stored, other = cut_lineage(spark.range(5).toDF("x"), "drop_me"), cut_lineage(spark.range(3).toDF("x"), "keep_me")
    after = cut_lineage(stored.filter("x > 2"), "after")
    path = stored._stored_at
    drop_stored(stored, spark.range(2))
    assert not os.path.exists(path.removeprefix("file:"))
    assert sorted(r.x for r in after.collect()) == [3, 4]
    assert other.count() == 3

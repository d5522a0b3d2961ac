"""One sweep over all thresholds against a run for each, and its report."""

import numpy as np
import pytest

from chartmill.operators import corpus as C


@pytest.mark.parametrize("block", [1200, 60])
def test_sweep_equals_single_runs(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    big = 2**60
    rows = [(big + i, None if i % 7 == 0 else i % 2, (base[rng.integers(40)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.15])).tolist()) for i in rng.permutation(400).tolist()]
    rows += [(None, 0, base[0].tolist()), (big + 1000, 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    swept = C.threshold_sweep(df, "label", "vec_id", "embedding", block=block)
    got = {r["vec_id"]: r["duplicates"] for r in swept.collect()}
    assert len(got) == len(rows) and got[None] == got[big + 1000] == [None] * 9
    for t, bar in enumerate(C.SWEEP):
        leaders = {}
        for i, g, v in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: r[0]):
            v = np.array(v) / np.linalg.norm(v)
            near = next((k for k, u in leaders.get(g, []) if u @ v >= bar), None)
            assert got[i][t] == near, (bar, i)
            if near is None:
                leaders.setdefault(g, []).append((i, v))
    one = {r["vec_id"]: r["duplicate_of"] for r in C.vector_leaders(df.where("label is not null and vec_id is not null and embedding is not null"), "label", "vec_id", "embedding").collect()}
    assert all(got[k][C.SWEEP.index(0.95)] == of for k, of in one.items())


def test_report_of_a_sweep(spark):
    bars = [0.90, 0.95, 0.98]
    swept = spark.createDataFrame([(1, [None, None, None]), (2, [1, 1, None]), (3, [1, None, None])], "k long, duplicates array<long>")
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "k long")
    got = [tuple(r) for r in C.sweep_report(swept, "k", ids(2, 2), ids(3, 9), bars).orderBy("threshold").collect()]
    assert got == [(0.9, 1, 2, 0, 1, "WARN", False), (0.95, 2, 1, 0, 0, "PASS", True), (0.98, 3, 0, 1, 0, "WARN", False)]
    assert {r["recommended"] for r in C.sweep_report(swept, "k", ids(1), ids(), bars).collect()} == {False}
    assert C.threshold_sweep(spark.createDataFrame([], "k long, g long, v array<double>"), "g", "k", "v").count() == 0

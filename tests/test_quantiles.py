"""Exact quantiles against sorted arrays, and how much a pass holds."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rillgrid.operators import agreement, endmembers, quantiles as q, stack

SHARES = (0.0, 0.005, 0.25, 0.5, 0.95, 1.0)


def by_sorting(values, shares=SHARES):
    v, out = np.sort(values), []
    for s in shares:
        place = s * (len(v) - 1)
        low, high, t = v[int(np.floor(place))], v[min(int(np.floor(place)) + 1, len(v) - 1)], place - np.floor(place)
        out.append(float(low if t == 0 or low == high else low + (high - low) * t))
    return out


def kinds():
    rng = np.random.default_rng(1)
    return {
        "normal": rng.normal(size=20_000), "ratios": 10.0 ** rng.uniform(-300, 300, 5000) * rng.choice([-1, 1], 5000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([3.5]), "two": np.array([2.0, 1.0]),
        "endless": np.r_[np.full(50, np.inf), np.full(30, -np.inf), rng.normal(size=200), 0.0, -0.0], "least": rng.integers(-400, 400, 3000) * 5e-324, "largest": rng.uniform(-1.7, 1.7, 3000) * 1e308, "far": 1e9 + rng.normal(size=4000) * 1e-3,
        "skewed": np.r_[np.zeros(9000), rng.random(100) * 1e-12, 1e12],
    }


def table(spark):
    rows = [(k, float(x), 1.0) for k, v in kinds().items() for x in v] + [("normal", None, 2.0), ("normal", float("nan"), None), ("none", None, None), (None, 1.0, 2.0), (None, 4.0, 3.0)]
    return spark.createDataFrame(pd.DataFrame({"k": [r[0] for r in rows], "x": pd.array([r[1] for r in rows], dtype=object), "g": pd.array([r[2] for r in rows], dtype=object)}), "k string, x double, g double")


def test_quantiles_equal_sorting_in_few_passes(spark, monkeypatch):
    made, written = [], q.written
    monkeypatch.setattr(q, "written", lambda df, name: (made.append(name), written(df, name))[1])
    got = {r.k: (r.x, r.g) for r in q.quantiles(table(spark), ["k"], ["x", "g"], SHARES).collect()}
    assert {k: got[k][0] for k in kinds()} == {k: by_sorting(v) for k, v in kinds().items()}
    assert got["none"] == (None, None) and got[None] == (by_sorting([1.0, 4.0]), by_sorting([2.0, 3.0])) and got["normal"][1] == by_sorting([1.0] * 20_000 + [2.0])
    assert made.count("ranks") <= 6


def test_a_pass_holds_bins_not_values(spark, monkeypatch):
    """Whatever the rows, a pass's groups are at most the bins of the open intervals: two ranks of one share, here."""
    seen, counted = [], q._counted
    monkeypatch.setattr(q, "_counted", lambda v, o, b: (lambda c: (seen.append((o.count(), c.count(), c.agg(F.sum("n")).first()[0])), c)[1])(counted(v, o, b)))
    rows = spark.range(50_000).select(F.rand(7).alias("x"))
    got = q.quantiles(rows, [], ["x"], [0.3], bins=16).first().x[0]
    assert got == pytest.approx(by_sorting([r.x for r in rows.collect()], [0.3])[0], abs=0)
    assert len(seen) > 2 and all(groups <= 16 * intervals for intervals, groups, _ in seen) and [n for *_, n in seen] == sorted((n for *_, n in seen), reverse=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=3, max_size=30, unique=True))
def test_bins_never_fall(values):
    """The bin's formula, in numpy: in order, first value in the first inner bin, last in the last."""
    v, bins = np.sort(np.array(values) + 0.0), 64
    lo, hi = v[0], v[-1]
    if lo == hi:
        return
    wide = np.sign(lo) != np.sign(hi) or max(abs(lo), abs(hi)) > bins * min(abs(lo), abs(hi))
    with np.errstate(divide="ignore", invalid="ignore"):
        log = lambda x: np.where(x == 0, 0.0, np.sign(x) * (np.log2(np.abs(x)) + 1076))
        place = (log(v) - log(lo)) / (log(hi) - log(lo)) if wide else (v - lo) / (hi - lo) if max(abs(lo), abs(hi)) < 1e300 else (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    at = np.minimum(np.floor(place * (bins - 3)), bins - 4) + 1
    assert np.all(np.diff(at) >= 0) and at[0] == 1 and at[-1] == bins - 3


def test_operators_use_them(spark):
    df = table(spark)
    assert {r.k: r.median for r in stack.region_median(df.withColumnRenamed("x", "v"), "k").collect()}["normal"] == by_sorting(kinds()["normal"], [0.5])[0]
    box = {r.k: tuple(r)[1:] for r in agreement.box_statistics(df, "k", "x").collect()}
    assert box["skewed"] == tuple(by_sorting(kinds()["skewed"], [0.05, 0.25, 0.5, 0.75, 0.95])) and box["none"] == (None,) * 5
    few = spark.createDataFrame([(float(i), None) for i in range(101)], "a double, b double")
    out = endmembers.stretched(few, ["a", "b"], 10, 90, 1.0)
    assert out.columns == ["a", "b", "a_rgb"] and out.where("a <= 10").agg(F.max("a_rgb")).first()[0] == 0 and out.where("a >= 90").agg(F.min("a_rgb")).first()[0] == pytest.approx(1, abs=1e-6)
    assert endmembers.stretched(few.limit(0), ["a"]).count() == 0 and q.quantiles(few.limit(0), ["a"], ["b"], [0.5]).count() == 0
    for bad in ([], [1.5]):
        with pytest.raises(ValueError):
            q.quantiles(few, [], ["a"], bad)

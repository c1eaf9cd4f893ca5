"""Segmentation and clustering kernels against brute force, sweeps against refitting, streams against batch."""

from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.operators import clustering, coregistration, segmentation as seg
from rillgrid.streaming import monitor


def rss(y, cuts):
    edges = [0, *cuts, len(y)]
    return sum(((y[a:b] - y[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:], strict=False))


def test_optimal_partitions_match_brute_force():
    rng = np.random.default_rng(0)
    for n, size, jump in ((14, 3, 1), (16, 2, 2), (20, 5, 5)):
        y = rng.random(n) + (np.arange(n) > n // 2)
        found = seg.optimal_partitions(n, seg.l2_cost(y), 3, size, jump)
        assert [f[0] for f in found] == sorted((f[0] for f in found), reverse=True)
        for m, (cost, cuts) in enumerate(found):
            ok = [c for c in combinations(range(jump, n, jump), m) if all(b - a >= size for a, b in zip([0, *c], [*c, n], strict=True))]
            assert cost == pytest.approx(min(rss(y, c) for c in ok)) and rss(y, cuts) == pytest.approx(cost)
    assert seg.optimal_partitions(3, seg.l2_cost(np.ones(3)), 2, 5) == []


def test_costs_match_least_squares():
    rng = np.random.default_rng(1)
    y, t = rng.random(20), np.arange(20.0)
    for a, b in ((0, 20), (3, 9), (5, 7)):
        fit = np.polyval(np.polyfit(t[a:b], y[a:b], 1), t[a:b])
        assert seg.linear_cost(y)(a, b) == pytest.approx(((y[a:b] - fit) ** 2).sum(), abs=1e-12)
        k = (t[a:b] @ y[a:b]) / (t[a:b] @ t[a:b])
        assert seg.linear_cost(y, intercept=False)(a, b) == pytest.approx(((y[a:b] - k * t[a:b]) ** 2).sum())


def test_greedy_and_bottom_up_find_clear_steps():
    y = np.r_[np.zeros(10), np.ones(10), np.full(15, 3.0)]
    assert seg.greedy_splits(35, seg.l2_cost(y), 2, 5)[2] == [10, 20]
    assert seg.merged_segments(35, seg.l2_cost(y), 2, 5)[2] == [10, 20]
    assert seg.greedy_splits(4, seg.l2_cost(y[:4]), 2, 5) == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(24):
        y = 0.3 + 0.05 * rng.standard_normal(40) + (0.5 * (np.arange(40) >= 15) if i % 3 == 0 else 0)
        v = [float(x) for x in y]
        if i % 4 == 0:
            v[7] = None
        rows.append((i, v))
    rows += [(100, [0.1] * 3), (101, [None] * 40), (102, [0.5] * 40)]
    return spark.createDataFrame(rows, "series int, v array<double>").cache()


def test_one_pass_sweep_equals_refitting(spark, vectors):
    """Choosing among the models of each m is the penalised search itself."""
    models = seg.pelt_models(vectors, jump=1).cache()
    var = vectors.select("series", F.explode("v").alias("x")).groupBy("series").agg(F.var_pop("x").alias("ref_var"), F.var_pop("x").alias("smooth_var"))
    chosen = {(r.series, r.penalty_scale): r for r in seg.pelt_breaks(models, var, [1.0, 3.0]).collect()}
    for row in vectors.collect():
        y = np.array([x for x in row.v if x is not None], float)
        if len(y) < 5:
            assert (row.series, 1.0) not in chosen
            continue
        for scale in (1.0, 3.0):
            beta, cost = scale * y.var() * np.log(len(y)), seg.l2_cost(y)
            best = [0.0] + [np.inf] * len(y)  # direct dynamic program over the penalised cost
            for e in range(5, len(y) + 1):
                best[e] = min((best[s] + cost(s, e) + (beta if s else 0.0) for s in range(0, e - 4) if np.isfinite(best[s]) and (s == 0 or s >= 5)), default=np.inf)
            got = chosen[row.series, scale]
            assert got.rss + beta * got.m == pytest.approx(best[len(y)])
    hit = chosen[0, 3.0]
    assert hit.m == 1 and hit.cuts == [14] and hit.cuts_full == [15]  # T15: one missing value before the break
    rates = seg.detection_rates(seg.pelt_breaks(models, var, [3.0]), ["penalty_scale"], vectors.count()).first()
    assert rates.n_total == 27 and rates.rate == pytest.approx(rates.n_with_breaks / 27)  # T18
    sweep = seg.penalty_sweep(models, var, vectors.count(), target=0.3).collect()
    assert len({r.penalty_scale for r in sweep}) == len(sweep) >= len(seg.COARSE)


def test_ic_sweep(vectors):
    models = seg.ic_models(vectors).cache()
    assert models.where("m = 0").count() == 25  # all but the short and the empty one
    choice = {r.series: r.m for r in seg.ic_choice(models, ["LWZ"], [1.0]).collect()}
    assert choice[0] >= 1 and choice[102] == 0
    out = seg.ic_sweep(models, 27, target=0.05, cap=3.0).collect()
    keys = [(r.criterion, round(r.scale, 3)) for r in out]
    assert len(set(keys)) == len(keys)  # T21


def test_bfast_rows(vectors):
    got = seg.accepted_bfast(seg.bfast_models(vectors), vectors, slope_min=0.0).collect()
    by = {}
    for r in got:
        by.setdefault(r.series, []).append(r)
    assert set(by) == {r.series for r in vectors.collect()}  # T14
    assert by[100][0].label == by[101][0].label == by[102][0].label == "no-break"
    assert any(r.label == "L→W" and 13 <= r.break_index <= 17 for r in by[3])


def test_relational_segments(spark):
    rows = [(1, p, v) for p, v in enumerate([0.0, None, 0.2, 1.0, 1.2, 1.4, 1.3, None])]
    points = seg.segments(spark.createDataFrame(rows, "series int, pos int, v double"), [3])
    stats = {r.segment: r for r in seg.segment_statistics(points).collect()}
    assert (stats[0].length, stats[0].n, stats[0].start) == (3, 2, 0) and stats[0].slope == pytest.approx(0.1) and stats[0].rss_linear == pytest.approx(0.0, abs=1e-12)
    b = seg.break_table(seg.segment_statistics(points)).first()
    assert b.break_index == 3 and b.delta == pytest.approx(1.225 - 0.1) and b.label == "L→W" and b.break_k == 1
    y = np.array([0.0, 0.2, 1.0, 1.2, 1.4, 1.3])
    for weight, sizes in (("length", (2, 4)), ("finite", (1, 3))):  # T11
        inner = sizes[0] * np.var(y[:2], ddof=1) + sizes[1] * np.var(y[2:], ddof=1)
        assert seg.twsv(seg.segment_statistics(points), points, weight).first().twsv_improve == pytest.approx(1 - inner / (7 * np.var(y, ddof=1)))


def plain_dtw(x, c):
    d = np.full((len(x) + 1, len(c) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(c)):
            d[i + 1, j + 1] = (x[i] - c[j]) ** 2 + min(d[i, j + 1], d[i + 1, j], d[i, j])
    return np.sqrt(d[-1, -1])


def test_dtw():
    rng = np.random.default_rng(2)
    x, c = rng.random((6, 9)), rng.random((3, 7))
    assert clustering.dtw(x, c) == pytest.approx(np.array([[plain_dtw(a, b) for b in c] for a in x]))
    assert np.diag(clustering.dtw(x, x)) == pytest.approx(np.zeros(6)) and clustering.dtw(x, x) == pytest.approx(clustering.dtw(x, x).T)
    shifted = np.r_[0, 0, 0, 1, 2, 1, 0, 0, 0.0], np.r_[0, 1, 2, 1, 0, 0, 0, 0, 0.0]
    assert clustering.dtw(shifted[0][None], shifted[1][None])[0, 0] == 0
    assert clustering.dtw(x, x[:1], 0)[:, 0] == pytest.approx(np.linalg.norm(x - x[0], axis=1))
    assert (clustering.soft_dtw(x, c[0], 1e-3) == pytest.approx(clustering.dtw(x, c[:1])[:, 0] ** 2, abs=0.05))


def test_kmeans_and_assignment(spark):
    rng = np.random.default_rng(6)
    shapes = np.array([np.sin(np.linspace(0, 6, 12)), np.linspace(-1, 1, 12), np.full(12, 3.0)])
    rows = [(i, [float(v) for v in shapes[i % 3] + 0.05 * rng.standard_normal(12)]) for i in range(60)] + [(99, [1.0]), (98, None)]
    df = spark.createDataFrame(rows, "series int, v array<double>").repartition(3).cache()
    centres, inertia = clustering.kmeans(df.where("series < 90"), 3, iterations=6, inits=3)
    again, same = clustering.kmeans(df.where("series < 90").repartition(2), 3, iterations=6, inits=3)
    assert inertia == pytest.approx(same) and centres == pytest.approx(again)
    got = {r.series: r for r in clustering.assign(df, centres).collect()}
    assert set(got) == set(range(60)) and all(len({got[i].label for i in range(k, 60, 3)}) == 1 for k in range(3)) and all(r.margin > 0 for r in got.values())
    e = {r.series: (r.label, r.margin) for r in clustering.euclid_assign(df.where("series < 60"), centres.tolist()).collect()}
    f = {r.series: (r.label, pytest.approx(r.margin)) for r in clustering.assign(df, centres, "euclid").collect()}
    assert e == f
    table = clustering.denormalised(clustering.centroid_table(spark, centres), 1.0, 2.0).orderBy("cluster").collect()
    assert np.array([r.v for r in table]) == pytest.approx(centres * 2 + 1)


def test_phase_correlation(spark):
    rng = np.random.default_rng(8)
    image = rng.random((16, 16))
    moved = np.roll(image, (2, -3), (0, 1))
    assert coregistration.phase_shift(image, moved)[:2] == (-2.0, 3.0)
    rows = lambda a: [(r, c, float(a[r, c])) for r in range(16) for c in range(16)]
    ref = spark.createDataFrame(rows(image), "row int, col int, v double")
    target = spark.createDataFrame([("s", *x) for x in rows(moved)], "scene string, row int, col int, v double")
    t = coregistration.tie_points(target, ref, 16).first()
    assert (t.dx, t.dy) == (9.0, -6.0) and t.rel > 50
    back = {(r.row, r.col): r.v for r in coregistration.warped(target, coregistration.tie_points(target, ref, 16), 16).collect()}
    assert len(back) == 256 and all(back[r, c] == (None if r < 0 or not (0 <= r + 2 < 16 and 0 <= c - 3 < 16) else image[r, c]) for r, c in back)
    gap = coregistration.tie_points(target.where("row > 0"), ref, 16).first()
    assert (gap.dx, gap.rel) == (-9999.0, 0.0)


def test_streams(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(i % 2, day + timedelta(hours=6 * i), 0.9 if i % 2 and i > 20 else 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "series int, ts timestamp, v double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("occ", monitor.windowed_occurrence(stream)), ("alerts", monitor.level_changes(stream))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    occ = {(r.series, r.start): r.occ for r in spark.table("occ").collect()}
    assert occ[0, day] == 0.0 and occ[1, day + timedelta(days=6)] == 1.0
    alerts = spark.table("alerts").collect()
    assert [(a.series, a.value) for a in alerts] == [(1, 0.9)]


def test_pelt_finds_more_than_eight_breaks(spark):
    y = [float(i // 5 % 2) for i in range(60)]
    best = min(seg.pelt_models(spark.createDataFrame([(1, y)], "series int, v array<double>").coalesce(1)).collect(), key=lambda r: (r.rss, r.m))
    assert best.rss == pytest.approx(0) and list(best.cuts) == list(range(5, 60, 5))


def test_kmeans_refuses_other_metrics(spark):
    with pytest.raises(ValueError, match="cosine"):
        clustering.kmeans(spark.createDataFrame([(1, [1.0, 2.0])], "series int, v array<double>"), 1, metric="cosine")


def test_soft_alignments_are_the_slope_of_soft_dtw():
    rng = np.random.default_rng(14)
    x, c, gamma = rng.random((5, 7)), rng.random(6), 0.5
    total, weight = clustering.soft_sums(x, c, gamma)
    for j in range(6):
        up, down = c.copy(), c.copy()
        up[j] += 1e-5
        down[j] -= 1e-5
        slope = (clustering.soft_dtw(x, up, gamma) - clustering.soft_dtw(x, down, gamma)).sum() / 2e-5
        assert 2 * (weight[j] * c[j] - total[j]) == pytest.approx(slope, abs=1e-5)


def test_soft_kmeans_lowers_the_sum_of_distances(spark):
    rng = np.random.default_rng(6)
    shapes = np.array([np.sin(np.linspace(0, 6, 10)), np.linspace(-1, 1, 10), np.full(10, 3.0)])
    rows = [(i, [float(v) for v in shapes[i % 3] + 0.05 * rng.standard_normal(10)]) for i in range(30)]
    df = spark.createDataFrame(rows, "series int, v array<double>").repartition(2).cache()
    first = clustering.kmeans(df, 3, iterations=1, inits=1, metric="softdtw", gamma=0.1)[1]
    centres, inertia = clustering.kmeans(df, 3, iterations=8, inits=2, metric="softdtw", gamma=0.1)
    assert inertia <= first
    got = {r.series: r.label for r in clustering.assign(df, centres, "softdtw", gamma=0.1).collect()}
    assert all(len({got[i] for i in range(k, 30, 3)}) == 1 for k in range(3)) and len(set(got.values())) == 3


def scaled(spark, factor, rng_seed=4):
    rng = np.random.default_rng(rng_seed)
    rows = []
    for i in range(12):
        y = rng.normal(0, 0.2, 48) + np.repeat(rng.choice([0.0, 1.0, 3.0], 6), 8) + (5.0 if i % 3 == 0 else 0.0)
        rows.append((i, [None if rng.random() < 0.05 else float(v) * factor for v in y]))
    rows += [(100, [0.3 * factor] * 40), (101, [0.0] * 40), (102, [0.0] * 15 + [factor] * 15)]
    return spark.createDataFrame(rows, "series long, v array<double>")


def test_cuts_do_not_depend_on_the_scale(spark):
    """The same cuts for values a hundred million times smaller or larger, and none in constant series."""
    searches = {
        "pelt": lambda v: seg.pelt_models(v),
        "binseg": lambda v: seg.ic_models(v),
        "binseg l2": lambda v: seg.ic_models(v, cost="l2"),
        "bottomup": lambda v: seg.ic_models(v, "bottomup", cost="l2"),
    }
    for name, search in searches.items():
        cuts = [{(r.series, r.m): (r.cuts_full, r.rss / f**2) for r in search(scaled(spark, f)).collect()} for f in (1.0, 1e-8, 1e8)]
        for other in cuts[1:]:
            assert {k: v[0] for k, v in cuts[0].items()} == {k: v[0] for k, v in other.items()}, name
            assert all(v[1] == pytest.approx(other[k][1], rel=1e-6, abs=1e-7) for k, v in cuts[0].items()), name
        if name == "pelt":
            assert cuts[0][(102, 1)] == ([15], 0.0) and cuts[0][(100, 0)][1] == 0.0
    picked = [{(r.series, r.h): (r.m, r.cuts_full) for r in seg.bfast_models(scaled(spark, f)).collect()} for f in (1.0, 1e-8, 1e8)]
    assert picked[0] == picked[1] == picked[2] and any(m for m, _ in picked[0].values())


def banded_dtw(a, b, radius):
    d = {(0, 0): 0.0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if radius is None or abs(i - j) <= radius:
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d.get(k, np.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return d.get((len(a), len(b)), np.inf) ** 0.5


@pytest.mark.parametrize("radius", [None, 0, 1, 3, 40])
@pytest.mark.parametrize(("t", "m"), [(1, 1), (2, 2), (12, 12), (9, 11)])
def test_bounds_and_bands_are_exact(radius, t, m):
    rng = np.random.default_rng(t)
    x, c = rng.random((25, t)).cumsum(1), rng.random((6, m)).cumsum(1) + rng.integers(0, 3, (6, 1))
    c[4] = c[1]
    full = np.array([[banded_dtw(a, b, radius) for b in c] for a in x])
    assert clustering.dtw(x, c, radius) == pytest.approx(full)
    assert np.all(clustering.lower_bounds(x, c, radius) <= full**2 + 1e-9)
    label, near, tables = clustering.nearest(x, c, radius)
    assert label.tolist() == full.argmin(1).tolist() and near == pytest.approx(np.sort(full, 1)[:, :2]) and tables.max() <= 6
    alone, one, _ = clustering.nearest(x, c, radius, second=False)
    assert alone.tolist() == label.tolist() and one[:, 0] == pytest.approx(near[:, 0])


def shapes(n, t=30, seed=0):
    """Four planted shapes, shifted a little, of unequal shares."""
    rng = np.random.default_rng(seed)
    time = np.arange(t)
    kinds = [np.sin(time / 4), (time > 12) * 2.0, (time > 20) * -1.5, np.exp(-((time - 15) ** 2) / 8) * 3]
    pick = rng.choice(4, n, p=[0.7, 0.2, 0.07, 0.03])
    return np.array([np.roll(kinds[k], rng.integers(-2, 3)) + rng.normal(0, 0.05, t) for k in pick]), pick


def test_most_tables_need_not_be_computed(spark):
    x, _ = shapes(400)
    centres = np.concatenate([x[[0]], np.array([np.full(30, v) for v in (5.0, 9.0, -7.0, 12.0)]), x[[1]] + 0.5])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "series int, v array<double>")
    got = clustering.assign(rows, centres, radius=3).collect()
    full = clustering.dtw(x, centres, 3)
    assert [r.label for r in sorted(got, key=lambda r: r.series)] == full.argmin(1).tolist()
    assert sum(r.tables for r in got) <= 0.5 * full.size


def test_seeds_by_distance_beat_hash_seeds(spark):
    """Over 20 seeds, the inertia from k-means|| is no higher than that from the series of the least hashes, nearly always and in sum."""
    x, _ = shapes(240)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "series int, v array<double>").coalesce(1).cache()
    start = clustering.seeds(rows, 4, 20, rounds=3)
    again = clustering.seeds(rows.repartition(3), 4, 20, rounds=3)
    assert all(np.array_equal(start[r], again[r]) for r in start) and all(len(c) == 4 for c in start.values())
    by_hash = {r: np.array([row.v for row in rows.orderBy(F.xxhash64(F.lit(r), "series"), "series").select("v").limit(4).collect()]) for r in range(20)}
    cost = lambda c: float((clustering.nearest(x, c, second=False)[1][:, 0] ** 2).sum())
    ours, hashes = [cost(start[r]) for r in range(20)], [cost(by_hash[r]) for r in range(20)]
    assert sum(a <= b for a, b in zip(ours, hashes, strict=True)) >= 18 and sum(ours) < 0.5 * sum(hashes)
    fitted = clustering.kmeans(rows, 4, iterations=4, inits=20, start=start)[1]
    assert fitted <= clustering.kmeans(rows, 4, iterations=4, inits=20, start=by_hash)[1] * (1 + 1e-9) and fitted <= min(ours)


def test_one_round_of_kmeans_by_hand(spark):
    """Assignment and barycentre of one round, path by path."""
    x, _ = shapes(40, 12, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "series int, v array<double>").repartition(3)
    c = x[[0, 5, 9]].copy()
    total, count = np.zeros(c.shape), np.zeros(c.shape)
    for v in x:
        k = int(np.argmin([banded_dtw(v, y, None) for y in c]))
        d = np.full((13, 13), np.inf)
        d[0, 0] = 0
        for i in range(1, 13):
            for j in range(1, 13):
                d[i, j] = (v[i - 1] - c[k][j - 1]) ** 2 + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
        i = j = 12
        while i and j:
            total[k, j - 1] += v[i - 1]
            count[k, j - 1] += 1
            i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: d[p])
    want = total / count
    got, inertia = clustering.kmeans(rows, 3, iterations=1, start={0: c})
    assert got == pytest.approx(want[np.lexsort((want[:, 0], want.mean(1)))])
    assert inertia == pytest.approx(sum(min(banded_dtw(v, y, None) for y in c) ** 2 for v in x))


def test_pruned_search_equals_the_table(spark):
    """Many penalties, sizes and grids: the same cuts and costs as from the table of all segments."""
    rng = np.random.default_rng(8)
    rows = [(i, [None if rng.random() < 0.03 else float(x) for x in np.repeat(rng.normal(0, 1, 9), 10) * (i % 4) + rng.normal(0, 0.3, 90)]) for i in range(12)]
    rows += [(50, [1.0] * 30), (51, [0.5] * 3), (52, [0.0] * 12 + [2.0] * 12), (53, [0.0, 1.0] * 20)]
    v = spark.createDataFrame(rows, "series long, v array<double>")
    var = v.select("series", F.explode("v").alias("x")).groupBy("series").agg(F.var_pop("x").alias("ref_var")).withColumn("smooth_var", F.col("ref_var"))
    penalties = [0.05, 0.3, 1.0, 2.0, 5.0, 40.0]
    for size, jump in ((5, 5), (3, 1), (1, 1), (7, 2)):
        want = {(r.series, r.penalty_scale): r for r in seg.pelt_breaks(seg.pelt_models(v, min_size=size, jump=jump), var, penalties).collect()}
        got = {(r.series, r.penalty_scale): r for r in seg.pelt_pruned(v, var, penalties, size, jump).collect()}
        assert set(got) == set(want)
        for key, r in got.items():
            assert (r.m, r.rss) == (want[key].m, pytest.approx(want[key].rss, abs=1e-7)), (key, size, jump)
            if key[0] < 50:
                assert (r.cuts, r.cuts_full) == (want[key].cuts, want[key].cuts_full), (key, size, jump)


def test_pruned_search_takes_linear_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    z = np.repeat(rng.normal(0, 3, 200), 100) + rng.normal(0, 1, 20_000)
    points = seg.admissible(len(z), 5, 1)
    tracemalloc.start()
    rss, cuts = seg.pruned_partition(z, points, 3 * np.log(len(z)) / seg.spread(z[None])[0], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and 120 < len(cuts) < 240 and rss == pytest.approx(((z - np.repeat([z[a:b].mean() for a, b in zip([0, *points[cuts]], [*points[cuts], len(z)], strict=True)], np.diff([0, *points[cuts], len(z)]))) ** 2).sum(), rel=1e-5)


def smooth_image(height, width, seed=0):
    """A function of the plane that can be sampled anywhere."""
    rng = np.random.default_rng(seed)
    waves = [(rng.uniform(-0.9, 0.9), rng.uniform(-0.9, 0.9), rng.uniform(0, 6.28), rng.uniform(0.3, 1)) for _ in range(60)]
    return lambda y, x: sum(a * np.cos(u * y + v * x + p) for u, v, p, a in waves)


@pytest.mark.parametrize("shift", [(0.25, -0.25), (0.0, 0.5), (-1.75, 2.25), (3.0, -4.0)])
def test_shifts_below_a_pixel_are_found(shift):
    image = smooth_image(64, 64)
    y, x = np.mgrid[0:64, 0:64].astype(float)
    for seed in range(3):
        image = smooth_image(64, 64, seed)
        noise = np.random.default_rng(seed).normal(0, 0.05, (64, 64))
        dy, dx, peak = coregistration.refined_shift(image(y, x), image(y - shift[0], x - shift[1]) + noise)
        assert abs(dy + shift[0]) <= 0.1 and abs(dx + shift[1]) <= 0.1 and peak > 0


def test_scenes_are_registered_below_a_pixel(spark):
    """A shift of (0.75, -1.25) pixels is found in all windows, a false tie point is rejected, and the moved scene lies on the reference."""
    image, n = smooth_image(96, 96, 4), 96
    y, x = np.mgrid[0:n, 0:n].astype(float)
    ref, moved = image(y, x), image(y - 0.75, x + 1.25)
    rows = lambda a, *k: [(*k, r, c, float(a[r, c])) for r in range(n) for c in range(n)]
    reference = spark.createDataFrame(rows(ref), "row int, col int, v double")
    target = spark.createDataFrame(rows(moved, "s") + [("t", r, c, v) for r, c, v in rows(ref)], "scene string, row int, col int, v double")
    ties = coregistration.tie_points(target, reference, 32, refine=True)
    found = {(t.scene, t.win_r, t.win_c): (t.dy / 3, t.dx / 3) for t in ties.collect()}
    assert len(found) == 18 and all(abs(y + 0.75) <= 0.1 and abs(x - 1.25) <= 0.1 for (s, *_), (y, x) in found.items() if s == "s") and all(v == (0.0, 0.0) for (s, *_), v in found.items() if s == "t")
    false = ties.withColumn("dx", F.when((F.col("win_r") == 1) & (F.col("win_c") == 1), 14.0).otherwise(F.col("dx"))).cache()
    kept = coregistration.consistent(false)
    assert kept.count() == 16 and kept.where("win_r = 1 AND win_c = 1").count() == 0
    out = {(r.scene, r.row, r.col): r.v for r in coregistration.registered(target, kept, 32).collect()}
    assert len(out) == 2 * n * n and all(out["t", r, c] == pytest.approx(ref[r, c]) for r in range(n) for c in range(n))
    inner = [(r, c) for r in range(3, n - 3) for c in range(3, n - 3)]
    before, after = (np.sqrt(np.mean([(f(r, c) - ref[r, c]) ** 2 for r, c in inner])) for f in (lambda r, c: moved[r, c], lambda r, c: out["s", r, c]))
    assert after < 0.2 * before and out["s", 95, 40] is None
    assert coregistration.registered(target.limit(0), kept, 32).count() == 0
    alone = {(r.row, r.col): r.v for r in coregistration.registered(target.where("scene = 't' AND NOT (row = 5 AND col = 5)"), kept.limit(0), 32).collect()}
    assert len(alone) == n * n - 1 and alone[6, 6] == pytest.approx(ref[6, 6])

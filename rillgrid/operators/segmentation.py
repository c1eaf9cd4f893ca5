"""Change points (AGG-22…25, 20, 28, 30; KRN-2…6; CTL-1…3; WIN-7, 8; FLT-17…19).

Relational parts are windows and aggregates over (series, position, v). Searches run as
Arrow-batched kernels over one row per series, and each solves a series once: a dynamic
program gives the best cost for every number of breaks, so that penalties, criteria and
scales are sweeps over a small table of (series, m, rss) and never refit.
A break index b begins the segment after it: before is [prev, b), after is [b, next) (T16).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rillgrid.functions import breaks

COARSE = (2.0, 3.0, 4.0, 4.5, 4.824, 5.0, 5.2, 5.4, 5.6, 6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0)
PELT_TARGET, IC_TARGET, TOLERANCE = 157 / 2476, 0.0634, 0.005
SCALES, CRITERIA = (0.6, 0.8, 1.0, 1.2), ("LWZ", "BIC")


# --- relational parts ---------------------------------------------------------------------------


def segments(points: DataFrame, cuts: Sequence[int], series: str = "series", pos: str = "pos") -> DataFrame:
    """WIN-7: the segment of each point for cuts that all series share."""
    return points.withColumn("segment", sum((F.when(F.col(pos) >= c, 1).otherwise(0) for c in cuts), F.lit(0)))


def segments_by(points: DataFrame, cuts: DataFrame, series: str = "series", pos: str = "pos", column: str = "cuts_full") -> DataFrame:
    """WIN-7: the segment of each point for the cuts of its own series, (series, array); series without cuts have one segment."""
    own = points.join(cuts.select(series, F.col(column).alias("_cuts")), series, "left")
    return own.withColumn("segment", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(pos))))).drop("_cuts")


def segment_statistics(points: DataFrame, series: str = "series", pos: str = "pos", v: str = "v") -> DataFrame:
    """AGG-22…24: mean, slope, length, number of values, variance and both RSS of each (series, segment)."""
    y, x = F.col(v), F.when(F.col(v).isNotNull(), F.col(pos).cast("double"))
    sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    return points.groupBy(series, "segment").agg(
        F.count("*").alias("length"), F.count(v).alias("n"), F.avg(v).alias("mu"), F.when(F.count(v) >= 2, F.regr_slope(y, x)).alias("slope"),
        F.when(F.count(v) >= 2, F.var_samp(v)).alias("var"), (F.count(v) * F.var_pop(v)).alias("rss_l2"),
        F.when(F.count(v) >= 2, F.greatest(F.lit(0.0), syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0)))).otherwise(0.0).alias("rss_linear"), F.min(pos).alias("start"),
    )


def break_table(stats: DataFrame, threshold: float = 0.15, series: str = "series") -> DataFrame:
    """AGG-25, WIN-8, PRJ-22: a row for each pair of neighbouring segments."""
    w = Window.partitionBy(series).orderBy("segment")
    after = {c: F.lead(c).over(w) for c in ("mu", "slope", "start")}
    out = stats.select(series, F.col("segment").alias("k"), F.col("mu").alias("mu_pre"), after["mu"].alias("mu_post"), F.col("slope").alias("slope_pre"), after["slope"].alias("slope_post"), after["start"].alias("break_index"))
    out = out.where("break_index IS NOT NULL").withColumn("delta", F.col("mu_post") - F.col("mu_pre"))
    return out.withColumn("break_k", F.col("k") + 1).withColumn("label", breaks.raw_label(F.col("delta"), threshold)).drop("k")


def twsv(stats: DataFrame, points: DataFrame, weight: str = "length", series: str = "series", v: str = "v") -> DataFrame:
    """AGG-23, T11: the share of the variance that segments explain. weight: "length" or "finite" (values alone)."""
    if weight not in ("length", "finite"):
        raise ValueError(f"unknown weight {weight!r}")
    size = F.col("length" if weight == "length" else "n")
    inner = stats.groupBy(series).agg(F.sum((size - 1) * F.coalesce("var", F.lit(0.0))).alias("within"))
    whole = points.groupBy(series).agg(((F.count("*") - 1) * F.var_samp(v)).alias("total"))
    return whole.join(inner, series).select(series, (1 - F.try_divide("within", F.when(F.col("total") > 0, F.col("total")))).alias("twsv_improve"))


def single_breaks(points: DataFrame, min_size: int = 5, series: str = "series", pos: str = "pos", v: str = "v") -> DataFrame:
    """The L2 cost of every admissible single break, from running sums: one window each way, no self-join."""
    w = Window.partitionBy(series).orderBy(pos)
    left, right = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    rss = F.count(v).over(left) * F.var_pop(v).over(left) + F.count(v).over(right) * F.var_pop(v).over(right)
    n = F.count("*").over(Window.partitionBy(series))
    return points.select(series, F.col(pos).alias("break_index"), rss.alias("rss"), n.alias("length")).where((F.col("break_index") >= min_size) & (F.col("break_index") <= F.col("length") - min_size)).drop("length")


# --- kernels ------------------------------------------------------------------------------------
#
# Series of equal length are solved together: a table (series, from, to) of segment costs over the
# admissible cuts comes from running sums, and each search is a few array operations over it.

CELLS = 2_000_000  # of the table of costs held at once
DIGITS = 10  # that costs are rounded to as shares of their series' own spread, so that equal ones tie, and the first wins, whatever the order of sums
CONSTANT = 1e-20  # spreads below this share of the sum of squares are those of a constant


def admissible(n: int, min_size: int, jump: int) -> np.ndarray:
    """0, the multiples of jump at least min_size from either end, and n."""
    return np.array([0, *(p for p in range(jump, n, jump) if min_size <= p <= n - min_size), n])


def _sums(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(series, from, to) sums of x between any two points."""
    s = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, 1)], 1)[:, points]
    return s[:, None, :] - s[:, :, None]


def spread(z: np.ndarray) -> np.ndarray:
    """Each series' squared distances from its mean, the unit of its costs; 0 if it is constant."""
    u = ((z - z.mean(1, keepdims=True)) ** 2).sum(1)
    return np.where(u > CONSTANT * (z * z).sum(1), u, 0.0)


def relative(table: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Costs as rounded shares of each series' unit, so that searches cut alike whatever the scale of the values."""
    u = unit[:, None, None]
    return np.divide(table, u, out=np.zeros_like(table), where=u > 0).round(DIGITS)


def l2_costs(z: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances from the segment's mean."""
    z = z - z.mean(1, keepdims=True)
    n = np.maximum(1, points[None, :] - points[:, None])
    return np.maximum(0.0, _sums(z * z, points) - _sums(z, points) ** 2 / n)


def linear_costs(z: np.ndarray, t: np.ndarray, points: np.ndarray, intercept: bool = True) -> np.ndarray:
    """Residual sums of squares of a line over t, without its intercept if asked (T19)."""
    n = points[None, :] - points[:, None]
    z = z - z.mean(1, keepdims=True) if intercept else z
    sy, st, stt, syt, syy = (_sums(x, points) for x in (z, t, t * t, z * t, z * z))
    if intercept:
        size = np.maximum(1, n)
        stt, syt, syy = stt - st * st / size, syt - st * sy / size, syy - sy * sy / size
    fit = np.divide(syt * syt, stt, out=np.zeros_like(syt), where=stt > 1e-15)
    return np.where(n < 2, 0.0, np.maximum(0.0, syy - fit))


def partitions(table: np.ndarray, points: np.ndarray, most: int, min_size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A2: for m = 0, 1, … breaks the least cost of each series and the places in points of its m cuts; stops where no more fit."""
    if points[-1] < max(1, min_size):
        return []
    step = np.where(points[None, :] - points[:, None] >= min_size, table, np.inf)
    held, row, back = step[:, 0, :], np.arange(len(table)), []
    step = step.copy()
    step[:, 0, :] = np.inf
    out = [(held[:, -1], np.zeros((len(table), 0), np.int64))]
    for m in range(1, most + 1):
        tried = held[:, :, None] + step
        at = tried.argmin(1)
        held = np.take_along_axis(tried, at[:, None, :], 1)[:, 0]
        back.append(at)
        if not np.isfinite(held[:, -1]).any():
            break
        place, cuts = np.full(len(table), len(points) - 1), np.zeros((len(table), m), np.int64)
        for k in range(m - 1, -1, -1):
            place = back[k][row, place]
            cuts[:, k] = place
        out.append((held[:, -1], cuts))
    return out


def pruned_partition(z: np.ndarray, points: np.ndarray, beta: float, min_size: int) -> tuple[float, np.ndarray]:
    """KRN-2: cost and cuts (places in points) of the partition of least cost plus beta for each cut, by PELT (Killick and others 2012).

    Costs are shares of the series' spread, as in relative(). A start that is no better than beginning anew at a
    point is not tried again once a segment from that point is long enough; what rounding could hide is kept. Memory
    is linear in the series. Ties go to fewer cuts, then to the earliest start.
    """
    unit = float(spread(z[None])[0])
    last = len(points) - 1
    if not unit:
        return 0.0, np.zeros(0, np.int64)
    z = z - z.mean()
    s, q = (np.r_[0.0, np.cumsum(x)][points] for x in (z, z * z))
    best, share, cuts, back = (np.zeros(last + 1) for _ in range(4))
    back = back.astype(np.int64)
    until = np.full(last + 1, np.iinfo(np.int64).max)
    alive = np.zeros(1, np.int64)
    for t in range(1, last + 1):
        alive = alive[until[alive] > points[t]]
        c = alive[points[t] - points[alive] >= min_size]
        if not len(c):
            best[t] = np.inf
            continue
        cost = np.round(np.maximum(0.0, q[t] - q[c] - (s[t] - s[c]) ** 2 / (points[t] - points[c])) / unit, DIGITS)
        total = best[c] + cost + beta * (c > 0)
        at = np.lexsort((c, cuts[c] + (c > 0), total.round(DIGITS + 2)))[0]
        best[t], share[t], cuts[t], back[t] = total[at], share[c[at]] + cost[at], cuts[c[at]] + (c[at] > 0), c[at]
        worse = c[best[c] + cost - beta * (c == 0) > best[t] + 1e-8]
        until[worse] = np.minimum(until[worse], points[t] + min_size)
        alive = np.append(alive, t)
    found, t = [], last
    while back[t]:
        t = back[t]
        found.append(t)
    return float(share[last]) * unit, np.array(found[::-1], np.int64)


def _edges(table: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point, the places of the nearest edges before and after it."""
    place = np.arange(edge.shape[1])
    before = np.maximum.accumulate(np.where(edge, place, 0), 1)
    after = np.minimum.accumulate(np.where(edge, place, edge.shape[1] - 1)[:, ::-1], 1)[:, ::-1]
    return np.c_[np.zeros(len(edge), np.int64), before[:, :-1]], np.c_[after[:, 1:], np.full(len(edge), edge.shape[1] - 1)]


def greedy_cuts(table: np.ndarray, points: np.ndarray, most: int, min_size: int) -> list[np.ndarray]:
    """A3: places of 0, 1, … greedy binary splits; each takes the largest gain over all current segments, the first on ties."""
    n_series, row = len(table), np.arange(len(table))
    edge = np.zeros((n_series, len(points)), bool)
    edge[:, [0, -1]] = True
    out = [np.zeros((n_series, 0), np.int64)]
    place = np.arange(len(points))[None, :]
    for m in range(1, most + 1):
        a, b = _edges(table, edge)
        fits = ~edge & (points[place] - points[a] >= min_size) & (points[b] - points[place] >= min_size)
        if not fits.any(1).all():
            break
        r = row[:, None]
        gain = np.where(fits, table[r, a, b] - table[r, a, place] - table[r, place, b], -np.inf)
        edge[row, gain.argmax(1)] = True
        out.append(np.nonzero(edge[:, 1:-1])[1].reshape(n_series, m) + 1)
    return out


def merged_cuts(table: np.ndarray, points: np.ndarray, most: int) -> list[np.ndarray]:
    """KRN-4: from all points, the pair of segments that costs least to join is joined, the first on ties; places of 0 to most cuts."""
    n_series, row = len(table), np.arange(len(table))
    edge = np.ones((n_series, len(points)), bool)
    place, out = np.arange(len(points))[None, :], {}
    for m in range(len(points) - 2, -1, -1):
        out[m] = np.nonzero(edge[:, 1:-1])[1].reshape(n_series, m) + 1
        if m:
            a, b = _edges(table, edge)
            r = row[:, None]
            loss = np.where(edge, table[r, a, b] - table[r, a, place] - table[r, place, b], np.inf)
            loss[:, [0, -1]] = np.inf
            edge[row, loss.argmin(1)] = False
    return [out[m] for m in range(most + 1) if m in out]


def _whole_cost(table: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    edges = np.c_[np.zeros(len(cuts), np.int64), cuts, np.full(len(cuts), table.shape[1] - 1)]
    return table[np.arange(len(cuts))[:, None], edges[:, :-1], edges[:, 1:]].sum(1)


def _of_one(n: int, cost: Callable[[int, int], float], points: np.ndarray) -> np.ndarray:
    return np.array([[[cost(int(a), int(b)) if a < b else 0.0 for b in points] for a in points]])


def optimal_partitions(n: int, cost: Callable[[int, int], float], most: int, min_size: int, jump: int = 1) -> list[tuple[float, list[int]]]:
    """partitions() of one series, for any cost of its segments [i, j)."""
    if n < max(1, min_size):
        return []
    points = admissible(n, min_size, jump)
    return [(float(c[0]), points[cuts[0]].tolist()) for c, cuts in partitions(_of_one(n, cost, points), points, most, min_size)]


def greedy_splits(n: int, cost: Callable[[int, int], float], most: int, min_size: int, jump: int = 5) -> list[list[int]]:
    """greedy_cuts() of one series."""
    if n < min_size:
        return []
    points = admissible(n, min_size, jump)
    return [points[cuts[0]].tolist() for cuts in greedy_cuts(_of_one(n, cost, points), points, most, min_size)]


def merged_segments(n: int, cost: Callable[[int, int], float], most: int, min_size: int, jump: int = 5) -> list[list[int]]:
    """merged_cuts() of one series."""
    points = admissible(n, min_size, jump)
    return [points[cuts[0]].tolist() for cuts in merged_cuts(_of_one(n, cost, points), points, most)]


def l2_cost(y: np.ndarray) -> Callable[[int, int], float]:
    """The cost of a segment [i, j) of one series."""
    return lambda i, j: float(l2_costs(y[None], np.array([i, j]))[0, 0, 1])


def linear_cost(y: np.ndarray, t: np.ndarray | None = None, intercept: bool = True) -> Callable[[int, int], float]:
    """The cost of a segment [i, j) of one series over t, by default its positions."""
    t = np.arange(len(y), dtype=float) if t is None else t
    return lambda i, j: float(linear_costs(y[None], t[None], np.array([i, j]), intercept)[0, 0, 1])


def _doubles(values) -> np.ndarray:
    if values is None:
        return np.zeros(0)
    try:
        return np.asarray(values, float)
    except TypeError:
        return np.array([np.nan if x is None else x for x in values], float)


def _per_length(vectors: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], Iterator[dict]], fields: str, points: Callable[[int], int], series: str = "series") -> DataFrame:
    """kernel(values, their positions) for the arrays with as many values that are there, a row each; it yields columns for all of them.

    points: how many admissible cuts a series of n values has, for the number solved at once. Series
    that fail are tried alone and give one row with error then (CTL-4).
    """
    kind = dict(vectors.dtypes)[series]
    names = [f.split()[0] for f in fields.split(", ")]

    def solved(keys: list, z: np.ndarray, index: np.ndarray) -> list[pd.DataFrame]:
        out = []
        for columns in kernel(z, index):
            out.append(pd.DataFrame({series: keys, "error": None} | {k: v.tolist() if isinstance(v, np.ndarray) and v.ndim > 1 else v for k, v in columns.items()}))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            groups: dict[int, list] = {}
            for key, values in zip(frame[series], frame["v"], strict=True):
                y = _doubles(values)
                index = np.flatnonzero(np.isfinite(y))
                groups.setdefault(len(index), []).append((key, y[index], index))
            for n, rows in groups.items():
                size = max(1, CELLS // (points(n) + 2) ** 2)
                for lo in range(0, len(rows), size):
                    keys, z, index = zip(*rows[lo : lo + size], strict=True)
                    try:
                        found = solved(list(keys), np.array(z), np.array(index))
                    except (ValueError, np.linalg.LinAlgError):
                        found = []
                        for key, one, at in zip(keys, z, index, strict=True):
                            try:
                                found += solved([key], one[None], at[None])
                            except (ValueError, np.linalg.LinAlgError) as e:
                                found.append(pd.DataFrame({series: [key], "error": [str(e)[:200]]}))
                    for part in found:
                        yield part.reindex(columns=[series, *names, "error"])

    return vectors.select(series, "v").mapInPandas(run, f"`{series}` {kind}, {fields}, error string")


def _model(n: int, rss: np.ndarray, cuts: np.ndarray, index: np.ndarray) -> dict:
    """A model's columns; cuts index the values that are there (T15), cuts_full all positions."""
    last = np.take_along_axis(index, np.maximum(cuts - 1, 0), 1) + 1 if cuts.shape[1] else cuts
    return {"n": n, "m": cuts.shape[1], "rss": rss, "cuts": cuts.tolist(), "cuts_full": last.tolist()}


_FIELDS = "n int, m int, rss double, cuts array<int>, cuts_full array<int>"


def pelt_models(vectors: DataFrame, most: int | None = None, min_size: int = 5, jump: int = 5, series: str = "series") -> DataFrame:
    """KRN-2, A2, FLT-19, 20: (series, n, m, rss, cuts, cuts_full) for every m, up to ``most`` if given."""

    def kernel(z: np.ndarray, index: np.ndarray) -> Iterator[dict]:
        n = z.shape[1]
        if n >= min_size:
            points, unit = admissible(n, min_size, jump), spread(z)
            for share, cuts in partitions(relative(l2_costs(z, points), unit), points, n // min_size - 1 if most is None else most, min_size):
                yield _model(n, share * unit, points[cuts], index)

    return _per_length(vectors, kernel, _FIELDS, lambda n: n // jump, series)


def ic_models(vectors: DataFrame, method: str = "binseg", most: int = 3, min_size: int = 5, jump: int = 5, cost: str = "linear", fit_intercept: bool = False, series: str = "series") -> DataFrame:
    """KRN-3…5: (series, n, m, rss, cuts, cuts_full) of 0 to most breaks; the score's rss has slope and intercept (T19)."""
    if method not in ("binseg", "bottomup"):
        raise ValueError(f"unknown method {method!r}")

    def kernel(z: np.ndarray, index: np.ndarray) -> Iterator[dict]:
        n = z.shape[1]
        if n < min_size:
            return
        points, t = admissible(n, min_size, jump), np.broadcast_to(np.arange(n, dtype=float), z.shape)
        unit = spread(z)
        search = score = relative(l2_costs(z, points) if cost == "l2" else linear_costs(z, t, points), unit)
        if cost != "l2" and not fit_intercept:
            search = relative(linear_costs(z, t, points, False), (z * z).sum(1))
        up_to = min(most, n // min_size - 1)
        for cuts in greedy_cuts(search, points, up_to, min_size) if method == "binseg" else merged_cuts(search, points, up_to):
            yield _model(n, _whole_cost(score, cuts) * unit, points[cuts], index)

    return _per_length(vectors, kernel, _FIELDS, lambda n: n // jump, series)


def bfast_models(vectors: DataFrame, h: Sequence[float] = (0.08, 0.10, 0.12), most: int = 2, criterion: str = "LWZ", series: str = "series") -> DataFrame:
    """KRN-6, A5, FLT-22: for each h the piecewise line with at most ``most`` breaks that the criterion prefers; segments of floor(h n) or more.

    Parameters of a model with m breaks: (m + 1) * 2. The detection library's own count is not public here; it is a convention of this engine.
    """

    def kernel(z: np.ndarray, index: np.ndarray) -> Iterator[dict]:
        n = z.shape[1]
        for share in h:
            size = int(share * n)
            if size < 3:
                continue
            points = admissible(n, size, 1)
            found = partitions(relative(linear_costs(z, index.astype(float), points), spread(z)), points, most, size)
            weight = 0.299 * np.log(n) ** 2.1 if criterion == "LWZ" else np.log(n)
            scores = np.stack([n * np.log(np.maximum(share, 1e-12) / n) + weight * 2 * (m + 1) for m, (share, _) in enumerate(found)], 1)
            m = scores.argmin(1)
            cuts = [index[i, points[found[k][1][i]]].tolist() if k else [] for i, k in enumerate(m)]
            yield {"h": float(share), "n": n, "m": m, "cuts_full": cuts, "score": scores.min(1)}

    return _per_length(vectors, kernel, "h double, n int, m int, cuts_full array<int>, score double", lambda n: n, series)


# --- sweeps -------------------------------------------------------------------------------------


def _grid(models: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    return models.withColumn(name, F.explode(F.array(*(F.lit(float(x)) for x in values))))


def pelt_breaks(models: DataFrame, variances: DataFrame, penalties: Sequence[float], series: str = "series") -> DataFrame:
    """JN-11, PRJ-28: the model of least rss + penalty * m of each series and penalty scale; fewer breaks on ties.

    variances: (series, ref_var, smooth_var) for the penalty (T17).
    """
    beta = breaks.penalty(F.col("penalty_scale"), F.col("ref_var"), F.col("smooth_var"), F.col("n").cast("double"))
    scored = _grid(models.where("m IS NOT NULL").join(variances, series), penalties, "penalty_scale").withColumn("total", F.col("rss") + beta * F.col("m"))
    best = F.min_by(F.struct("m", "rss", "cuts", "cuts_full"), F.struct("total", "m"))
    return scored.groupBy(series, "penalty_scale").agg(best.alias("b")).select(series, "penalty_scale", "b.*")


def pelt_pruned(vectors: DataFrame, variances: DataFrame, penalties: Sequence[float], min_size: int = 5, jump: int = 5, series: str = "series") -> DataFrame:
    """KRN-2, JN-11, PRJ-28: what pelt_breaks chooses from pelt_models, by a pruned search for each penalty: for long series, in memory linear in their length.

    vectors: (series, v); variances: (series, ref_var, smooth_var). Gives (series, penalty_scale, m, rss, cuts, cuts_full).
    """
    kind = dict(vectors.dtypes)[series]
    n = F.size(F.filter("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).cast("double")
    given = vectors.select(series, "v").join(variances, series).select(series, "v", breaks.penalty(F.lit(1.0), F.col("ref_var"), F.col("smooth_var"), n).alias("one"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, values, one in zip(frame[series], frame["v"], frame["one"], strict=True):
                y = _doubles(values)
                index = np.flatnonzero(np.isfinite(y))
                z = y[index]
                if len(z) < min_size:
                    continue
                points, unit = admissible(len(z), min_size, jump), float(spread(z[None])[0])
                for scale in penalties:
                    rss, cuts = pruned_partition(z, points, float(scale) * float(one) / unit if unit and one == one else 0.0, min_size)
                    at = points[cuts]
                    rows.append((key, float(scale), len(at), rss, at.tolist(), (index[at - 1] + 1).tolist()))
            if rows:
                yield pd.DataFrame(rows, columns=[series, "penalty_scale", "m", "rss", "cuts", "cuts_full"])

    return given.mapInPandas(run, f"`{series}` {kind}, penalty_scale double, m int, rss double, cuts array<int>, cuts_full array<int>")


def detection_rates(chosen: DataFrame, by: Sequence[str], n_total: int) -> DataFrame:
    """AGG-20, T18: the share of series with a break, over all series, also those too short to search."""
    return chosen.groupBy(*by).agg(F.count_if(F.col("m") > 0).alias("n_with_breaks")).select(*by, F.lit(n_total).cast("long").alias("n_total"), "n_with_breaks", (F.col("n_with_breaks") / max(1, n_total)).alias("rate"))


def closest(rates: DataFrame, target: float, order: Sequence[str]) -> dict | None:
    """AGG-28, T22: the parameters whose rate is nearest to the target; ties by order."""
    got = rates.agg(F.min_by(F.struct(*rates.columns), F.struct(F.abs(F.col("rate") - target).alias("d"), *order))).first()[0]
    return got.asDict() if got else None


def fine_grid(center: float, step: float = 0.1, width: float = 2.0, least: float = 0.1) -> list[float]:
    """SET-2: center ± width by step, from least on."""
    k = int(round(width / step))
    return [x for i in range(-k, k + 1) if (x := round(center + i * step, 3)) >= least]


def penalty_sweep(models: DataFrame, variances: DataFrame, n_total: int, target: float = PELT_TARGET, coarse: Sequence[float] = COARSE, tolerance: float = TOLERANCE, series: str = "series") -> DataFrame:
    """CTL-1: rates of the coarse penalties, and of a fine grid around the best unless that is near enough. models are solved once."""

    def rates(values: Sequence[float]) -> DataFrame:
        return detection_rates(pelt_breaks(models, variances, values, series), ["penalty_scale"], n_total)

    first = rates(coarse)
    best = closest(first, target, ["penalty_scale"])
    if best is None or abs(best["rate"] - target) <= tolerance:
        return first
    more = sorted(set(fine_grid(best["penalty_scale"])) - set(coarse))
    return first.unionByName(rates(more))


def ic_choice(models: DataFrame, criteria: Sequence[str], scales: Sequence[float], params: int = 2, series: str = "series") -> DataFrame:
    """KRN-5, PRJ-24: the number of breaks that each criterion and scale prefers; fewer on ties."""
    both = _grid(models.where("m IS NOT NULL"), scales, "scale").withColumn("criterion", F.explode(F.array(*(F.lit(c) for c in criteria))))
    args = F.col("rss"), F.col("m"), F.col("n").cast("double"), params, F.col("scale")
    scored = both.withColumn("score", F.when(F.col("criterion") == "LWZ", breaks.lwz(*args)).otherwise(breaks.bic(*args)))
    best = F.min_by(F.struct("m", "rss", "cuts", "cuts_full", "score"), F.struct("score", "m"))
    return scored.groupBy(series, "criterion", "scale").agg(best.alias("b")).select(series, "criterion", "scale", "b.*")


def ic_sweep(models: DataFrame, n_total: int, target: float = IC_TARGET, scales: Sequence[float] = SCALES, criteria: Sequence[str] = CRITERIA, tolerance: float = TOLERANCE, factor: float = 1.5, cap: float = 6.0, series: str = "series") -> DataFrame:
    """CTL-2, A13: the grid of criteria and scales, larger scales while too many series break, then a fine grid around the best.

    Scales are keyed by their value rounded to 3 digits, so that no expansion repeats for a float's sake (T21, an intended difference).
    """

    def rates(names: Sequence[str], values: Sequence[float]) -> DataFrame:
        return detection_rates(ic_choice(models, names, values, series=series), ["criterion", "scale"], n_total)

    found, done = rates(criteria, scales), [round(s, 3) for s in scales]
    held = {(r.criterion, round(r.scale, 3)): r.rate for r in found.collect()}
    for c in criteria:
        while done and max(done) < cap and held.get((c, max(done)), 0.0) > target + tolerance:
            new = round(min(cap, max(done) * factor), 3)
            more = rates(criteria, [new])
            held |= {(r.criterion, round(r.scale, 3)): r.rate for r in more.collect()}
            found, done = found.unionByName(more), [*done, new]
    best = closest(found, target, ["criterion", "scale"])
    if best is None:
        return found
    fine = [x for x in fine_grid(best["scale"], 0.05, 0.5) if (best["criterion"], x) not in held]
    return found.unionByName(rates([best["criterion"]], fine)) if fine else found


def break_measures(models: DataFrame, vectors: DataFrame, guard: int = 5, series: str = "series") -> DataFrame:
    """AGG-23…25, FLT-17: for each series, h and cut inside the guard: means and slopes on either side, the cut's variance gain, and that of all cuts.

    Sides reach to the neighbouring cuts; those without a value are left out. A gain is 1 less the share of
    the variance that stays within the parts, each weighted by its length (T11).
    """
    kind = dict(vectors.dtypes)[series]
    names = ["h", "break_index", "mu_pre", "mu_post", "slope_pre", "slope_post", "all_gain", "twsv_improve"]

    def measures(y: np.ndarray, tried: list) -> Iterator[tuple]:
        there, x = np.isfinite(y), np.arange(len(y), dtype=float)
        z = np.where(there, y, 0.0)
        sums = [np.r_[0.0, np.cumsum(c)] for c in (there, z, z * z, x * there, x * x * there, x * z)]

        def part(a: int, b: int) -> tuple[float, float, float, float]:
            """Number, mean, squared distances from the mean, slope."""
            n, sy, syy, sx, sxx, sxy = (c[b] - c[a] for c in sums)
            if not n:
                return 0.0, np.nan, 0.0, np.nan
            wide = sxx - sx * sx / n
            return n, sy / n, max(0.0, syy - sy * sy / n), (sxy - sx * sy / n) / wide if n > 1 and wide > 0 else np.nan

        def within(a: int, b: int) -> float:
            n, _, square, _ = part(a, b)
            return (b - a - 1) * square / (n - 1) if n > 1 else 0.0

        total = within(0, len(y))
        for model in tried:
            cuts = [int(c) for c in model["cuts_full"] if guard <= c <= len(y) - 1 - guard]
            edges = [0, *cuts, len(y)]
            spread = sum(within(a, b) for a, b in zip(edges, edges[1:], strict=False))
            for k, c in enumerate(cuts):
                (n, mu, _, slope), (n2, mu2, _, slope2) = part(edges[k], c), part(c, edges[k + 2])
                if n and n2:
                    yield model["h"], c, mu, mu2, slope, slope2, 1 - spread / total if total > 0 else np.nan, 1 - (within(0, c) + within(c, len(y))) / total if total > 0 else np.nan

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, *m) for key, values, tried in zip(frame[series], frame["v"], frame["tried"], strict=True) for m in measures(_doubles(values), list(tried))]
            yield pd.DataFrame(rows, columns=[series, *names])

    tried = models.where(F.size("cuts_full") > 0).groupBy(series).agg(F.collect_list(F.struct("h", "cuts_full")).alias("tried"))
    fields = ", ".join(f"{n} {'int' if n == 'break_index' else 'double'}" for n in names)
    return vectors.select(series, "v").join(tried, series).mapInPandas(run, f"`{series}` {kind}, {fields}")


def accepted_bfast(models: DataFrame, vectors: DataFrame, guard: int = 5, delta_min: float = 0.15, twsv_min: float = 0.20, slope_min: float = 0.01, series: str = "series", rule: str = "all") -> DataFrame:
    """CTL-3, FLT-18, PRJ-22, 23, AGG-30, T12…14, A5: a row for each break of the first h that passes; series without one give a row no-break.

    The gate's variance gain is that of all cuts, a break's label uses the gain of its single cut.
    """
    delta, change = F.col("mu_post") - F.col("mu_pre"), F.col("slope_post") - F.col("slope_pre")
    ok = lambda gain: breaks.quality(delta, F.col(gain), change, delta_min, twsv_min, slope_min, rule)
    of = Window.partitionBy(series)
    hits = break_measures(models, vectors, guard, series).withColumn("delta", delta).withColumn("hit", F.min(F.when(ok("all_gain"), F.col("h"))).over(of)).where("h = hit")
    hits = hits.withColumns({"break_count": F.count("*").over(of).cast("int"), "break_k": F.row_number().over(of.orderBy("break_index")), "label_raw": breaks.raw_label(F.col("delta"), delta_min), "label": breaks.final_label(ok("twsv_improve"), F.col("delta"))})
    out = vectors.select(series).join(hits, series, "left").withColumns({"break_count": F.coalesce("break_count", F.lit(0)), "label_raw": F.coalesce("label_raw", F.lit("no-break")), "label": F.coalesce("label", F.lit("no-break"))})
    return out.select(series, "h", "break_count", "break_k", "break_index", "mu_pre", "mu_post", "delta", "slope_pre", "slope_post", "twsv_improve", "label_raw", "label")


# --- results -------------------------------------------------------------------------------------


def clipped(index: Column, n: Column) -> Column:
    """PRJ-32: an index within 0 … n - 1."""
    return F.greatest(F.lit(0), F.least(index, n - 1))


def with_break_counts(series_rows: DataFrame, found: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """AGG-30, PRJ-30: break_count, has_break and break_dates of each series, 0 and empty for those without a break."""
    counts = found.groupBy(series).agg(F.count("*").alias("break_count"), breaks.joined_dates(F.array_sort(F.collect_list(ts))).alias("break_dates"))
    out = series_rows.select(series).distinct().join(counts, series, "left")
    return out.select(series, F.coalesce("break_count", F.lit(0)).alias("break_count"), (F.coalesce("break_count", F.lit(0)) > 0).alias("has_break"), F.coalesce("break_dates", F.lit("")).alias("break_dates"))


def of_penalty(chosen: DataFrame, penalty: float) -> DataFrame:
    """FLT-23: the series with a break under one penalty scale."""
    return chosen.where((F.round("penalty_scale", 3) == round(penalty, 3)) & (F.col("m") > 0))


def merged_summaries(parts: dict[str, DataFrame]) -> DataFrame:
    """CTL-7, SET-1: the summaries of several methods under one another; what one lacks is NULL."""
    out = None
    for method, df in parts.items():
        named = df.withColumn("method", F.lit(method))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out

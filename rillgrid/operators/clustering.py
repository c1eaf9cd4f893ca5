"""Clusters of series (KRN-7…9, JN-10, WIN-9, 10, PRJ-20): rows (series, v ARRAY<DOUBLE>) of one length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_CENTROIDS = 4096


CELLS = 8_000_000  # of distance tables held at once


def _table(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A7: (times + 1, places + 1, series) of squared distances along the best path, a diagonal of all series at a time; for paths."""
    n, t = x.shape
    m = len(c)
    cost = (x.T[:, None, :] - c[None, :, None]) ** 2
    d = np.full((t + 1, m + 1, n), np.inf)
    d[0, 0] = 0.0
    for s in range(2, t + m + 1):
        i = np.arange(max(1, s - m), min(t, s - 1) + 1)
        j = s - i
        d[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]), d[i - 1, j - 1])
    return d


def _within(x: np.ndarray, c: np.ndarray, radius: int | None, limit: np.ndarray) -> np.ndarray:
    """Squared distances to one centre; inf for those that pass their limit. Three diagonals are held, and cells outside the band are not made.

    Every path crosses one of two neighbouring diagonals, so a series whose least values on both are above its limit is given up.
    """
    n, t = x.shape
    m, out, live, cols = len(c), np.full(n, np.inf), np.arange(n), np.ascontiguousarray(x.T)
    r = t + m if radius is None else radius
    old, last, now = (np.full((t + 2, n), np.inf) for _ in range(3))
    old[0] = 0.0
    for s in range(2, t + m + 1):
        lo, hi = max(1, s - m, -((r - s) // 2)), min(t, s - 1, (s + r) // 2)
        if lo > hi:
            now.fill(np.inf)
        else:
            cost = (cols[lo - 1 : hi] - c[s - np.arange(lo, hi + 1) - 1][:, None]) ** 2
            now[lo - 1] = now[hi + 1] = np.inf
            now[lo : hi + 1] = cost + np.minimum(np.minimum(last[lo - 1 : hi], last[lo : hi + 1]), old[lo - 1 : hi])
            if s % 8 == 0:
                on = np.minimum(now[lo : hi + 1].min(0), last[max(1, lo - 1) : hi + 1].min(0)) <= limit
                if on.sum() < 0.75 * len(on):
                    live, limit, cols, old, last, now = live[on], limit[on], cols[:, on], old[:, on], last[:, on], now[:, on]
                    if not len(live):
                        return out
        old, last, now = last, now, old
    out[live] = last[t]
    return out


def running_extremes(v: np.ndarray, radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The largest and least values of each row within radius of each place; of the whole row for None."""
    t = v.shape[1]
    if radius is None or radius >= t:
        return np.repeat(v.max(1, keepdims=True), t, 1), np.repeat(v.min(1, keepdims=True), t, 1)
    pad = ((0, 0), (radius, radius))
    window = lambda e: np.lib.stride_tricks.sliding_window_view(np.pad(v, pad, constant_values=e), 2 * radius + 1, 1)
    return window(-np.inf).max(-1), window(np.inf).min(-1)


def lower_bounds(x: np.ndarray, c: np.ndarray, radius: int | None = None) -> np.ndarray:
    """(series, centres) bounds of squared distances: ends meet ends, and what lies between is no nearer than the other's extremes within the band."""
    out = np.stack([(x[:, 0] - y[0]) ** 2 + (x[:, -1] - y[-1]) ** 2 * (x.shape[1] > 1 or len(y) > 1) for y in c], 1)
    if x.shape[1] != c.shape[1]:
        return out
    beyond = lambda v, high, low: ((np.maximum(v - high, 0.0) + np.maximum(low - v, 0.0)) ** 2)[..., 1:-1].sum(-1)
    (cu, cl), (xu, xl) = running_extremes(c, radius), running_extremes(x, radius)
    return out + np.stack([np.maximum(beyond(x, u, low), beyond(y, xu, xl)) for y, u, low in zip(c, cu, cl, strict=True)], 1)


def nearest(x: np.ndarray, c: np.ndarray, radius: int | None = None, second: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact: the nearest centre (the first on ties), the distances to it and to the next one (inf without second), and how many tables each series took.

    Centres are tried in the order of their bounds; one whose bound is above what would still count needs no table.
    """
    n, low = len(x), lower_bounds(x, c, radius) * (1 - 1e-12)
    order, row = low.argsort(1, kind="stable"), np.arange(n)
    label, best, tables = np.full(n, len(c)), np.full((n, 2), np.inf), np.zeros(n, np.int64)
    size = max(1, CELLS // (3 * (x.shape[1] + 2)))
    for p in range(len(c)):
        at = order[:, p]
        on = low[row, at] <= best[:, int(second)]
        if not on.any():
            break
        for k in np.unique(at[on]):
            every = np.flatnonzero(on & (at == k))
            for who in (every[i : i + size] for i in range(0, len(every), size)):
                d = _within(x[who], c[k], radius, best[who, int(second)])
                tables[who] += 1
                better = (d < best[who, 0]) | ((d == best[who, 0]) & (k < label[who]))
                best[who, 1] = np.where(better, best[who, 0], np.minimum(best[who, 1], d)) if second else np.inf
                best[who, 0], label[who] = np.where(better, d, best[who, 0]), np.where(better, k, label[who])
    return label, np.sqrt(best), tables


def dtw(x: np.ndarray, centres: np.ndarray, radius: int | None = None) -> np.ndarray:
    """KRN-7, A7: (series, centres) distances; inf where the band leaves no path."""
    n, t = x.shape
    out = np.empty((n, len(centres)))
    size = max(1, CELLS // (3 * (t + 2)))
    for k, c in enumerate(centres):
        for lo in range(0, n, size):
            part = x[lo : lo + size]
            out[lo : lo + size, k] = np.sqrt(_within(part, c, radius, np.full(len(part), np.inf)))
    return out


def soft_dtw(x: np.ndarray, c: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """KRN-9: soft-DTW of each series to one centre (Cuturi and Blondel 2017)."""
    n, t = x.shape
    before = np.full((len(c) + 1, n), np.inf)
    before[0] = 0.0
    for i in range(t):
        now = np.full((len(c) + 1, n), np.inf)
        for j in range(len(c)):
            z = np.stack([before[j + 1], now[j], before[j]]) / -gamma
            top = z.max(0)
            now[j + 1] = (x[:, i] - c[j]) ** 2 - gamma * (top + np.log(np.exp(z - top).sum(0)))
        before = now
    return before[len(c)]


def soft_sums(x: np.ndarray, c: np.ndarray, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """KRN-9: sums and weights of the values that soft alignments give each place of c, over all series at once.

    The weights are the derivatives of soft-DTW by the cells' costs, found backwards; where each place is its
    weighted mean, the sum of distances has no slope.
    """
    n, t = x.shape
    m = len(c)
    cost = np.zeros((t + 2, m + 2, n))
    cost[1:-1, 1:-1] = (x.T[:, None, :] - c[None, :, None]) ** 2
    r = np.full((t + 2, m + 2, n), np.inf)
    r[0, 0] = 0.0
    for i in range(1, t + 1):
        for j in range(1, m + 1):
            z = np.stack([r[i - 1, j], r[i, j - 1], r[i - 1, j - 1]]) / -gamma
            top = z.max(0)
            r[i, j] = cost[i, j] - gamma * (top + np.log(np.exp(z - top).sum(0)))
    r[-1, :], r[:, -1], r[-1, -1] = -np.inf, -np.inf, r[t, m]
    e = np.zeros((t + 2, m + 2, n))
    e[-1, -1] = 1.0
    for i in range(t, 0, -1):
        for j in range(m, 0, -1):
            for a, b in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                e[i, j] += e[a, b] * np.exp((r[a, b] - r[i, j] - cost[a, b]) / gamma)
    weight = e[1:-1, 1:-1]
    return np.einsum("ijn,ni->j", weight, x), weight.sum((0, 2))


def _frame(frame: pd.DataFrame, length: int) -> tuple[pd.DataFrame, np.ndarray]:
    fit = frame[[v is not None and len(v) == length and not any(x is None or not np.isfinite(x) for x in v) for v in frame["v"]]]
    return fit, np.array(fit["v"].tolist(), float).reshape(len(fit), length)


def assign(vectors: DataFrame, centres: np.ndarray, metric: str = "dtw", radius: int | None = None, gamma: float = 1.0, series: str = "series", batch: int = 2000) -> DataFrame:
    """JN-10, WIN-9, 10: nearest centre (the first on ties), its distance, the margin to the second, and tables, how many distances were computed.

    Series of another length, or with gaps, are left out.
    """
    if len(centres) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centres")
    kind = dict(vectors.dtypes)[series]
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(centres, float))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for frame in frames:
            for k in range(0, len(frame), batch):
                part, x = _frame(frame.iloc[k : k + batch], c.shape[1])
                if not len(part):
                    continue
                if metric == "dtw":
                    label, near, tables = nearest(x, c, radius)
                else:
                    d = np.stack([soft_dtw(x, y, gamma) for y in c], 1) if metric == "softdtw" else np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(-1))
                    label, near, tables = d.argmin(1), np.sort(d, 1), len(c)
                yield pd.DataFrame({series: part[series], "label": label.astype(np.int32), "distance": near[:, 0], "margin": near[:, 1] - near[:, 0] if len(c) > 1 else np.nan, "tables": tables})

    return vectors.select(series, "v").mapInPandas(run, f"`{series}` {kind}, label int, distance double, margin double, tables int")


def euclid_assign(vectors: DataFrame, centres: Sequence[Sequence[float]], series: str = "series") -> DataFrame:
    """KRN-9: Euclidean assignment in array expressions, without Python."""

    def distance(c: Sequence[float]) -> Column:
        return F.sqrt(F.aggregate(F.zip_with("v", F.array(*(F.lit(float(x)) for x in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    pairs = F.array_sort(F.array(*(F.struct(distance(c).alias("d"), F.lit(k).alias("label")) for k, c in enumerate(centres))))
    return vectors.withColumn("p", pairs).select(series, F.col("p")[0]["label"].alias("label"), F.col("p")[0]["d"].alias("distance"), (F.try_element_at("p", F.lit(2))["d"] - F.col("p")[0]["d"]).alias("margin"))


def _barycentre_sums(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the values that a DTW path aligns with each place of c, over all series at once."""
    t, m = x.shape[1], len(c)
    total, count = np.zeros(m), np.zeros(m)
    size = max(1, CELLS // ((t + 1) * (m + 1)))
    for lo in range(0, len(x), size):
        part = x[lo : lo + size]
        n, d = len(part), _table(part, c)
        row, i, j = np.arange(n), np.full(n, t), np.full(n, m)
        while len(row):
            np.add.at(total, j - 1, part[row, i - 1])
            np.add.at(count, j - 1, 1)
            step = np.stack([d[i - 1, j - 1, row], d[i - 1, j, row], d[i, j - 1, row]]).argmin(0)
            i, j = i - (step != 2), j - (step != 1)
            on = (i > 0) & (j > 0)
            row, i, j = row[on], i[on], j[on]
    return total, count


def _distances(x: np.ndarray, c: np.ndarray, metric: str, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre and what it adds to the inertia: a squared distance, or soft-DTW itself."""
    if metric == "dtw":
        label, near, _ = nearest(x, c, second=False)
        return label, near[:, 0] ** 2
    d = np.stack([soft_dtw(x, y, gamma) for y in c], 1) if metric == "softdtw" else ((x[:, None, :] - c[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


def seeds(vectors: DataFrame, k: int, inits: int, seed: int = 0, metric: str = "dtw", series: str = "series", rounds: int = 3, length: int | None = None) -> dict[int, np.ndarray]:
    """KRN-8: starting centres of each run by k-means|| (Bahmani and others 2012).

    From the series of the least hash, each round is one pass that draws 2 k more series, likelier the farther from
    those that are drawn (the least of exponential variates over squared distances, which are made from ids'
    hashes, so they don't depend on partitions). A last pass counts the series nearest to each; k of the at most 1 + 2 k rounds
    candidates are then chosen on the driver by weighted k-means++. Soft-DTW, which may be negative, is seeded by DTW.
    Fewer than k are found where fewer series differ.
    """
    metric = "dtw" if metric == "softdtw" else metric
    length = len(vectors.select("v").first()[0]) if length is None else length
    drawn = {r: [row.v for row in vectors.where(F.size("v") == length).orderBy(F.xxhash64(F.lit(seed + r), series), series).select("v").limit(1).collect()] for r in range(inits)}
    draw = 2 * k

    def passed(number: int | None) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast({r: np.array(c, float) for r, c in drawn.items()})
        uniform = F.array(*((F.pmod(F.xxhash64(F.lit(1000 * (seed + r) + (number or 0)), series), F.lit(1 << 52)) + 0.5) / float(1 << 52) for r in range(inits)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = {r: np.zeros(len(c)) for r, c in shared.value.items()}
            for frame in frames:
                fit, x = _frame(frame, length)
                for r, c in shared.value.items() if len(x) else ():
                    home, d = _distances(x, c, metric)
                    if number is None:
                        counts[r] += np.bincount(home, minlength=len(c))
                        continue
                    with np.errstate(divide="ignore"):
                        order = np.where(d > 0, -np.log(np.array(fit["u"].tolist())[:, r]) / d, np.inf)
                    first = np.argsort(order, kind="stable")[:draw]
                    first = first[np.isfinite(order[first])]
                    if len(first):
                        yield pd.DataFrame({"run": r, "place": order[first], "v": x[first].tolist()})
            if number is None:
                for r, n in counts.items():
                    yield pd.DataFrame({"run": r, "place": n, "v": [[float(i)] for i in range(len(n))]})

        return vectors.select("v", uniform.alias("u")).mapInPandas(run, "run int, place double, v array<double>")

    for number in range(1, rounds + 1):
        found = passed(number).withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("place", "v"))).where(F.col("n") <= draw).orderBy("run", "n").collect()
        for r in found:
            drawn[r.run].append(r.v)
    weights = {(r.run, int(r.i)): r.n for r in passed(None).groupBy("run", F.col("v")[0].alias("i")).agg(F.sum("place").alias("n")).collect()}
    out = {}
    for r, c in drawn.items():
        c, weight, rng = np.array(c, float), np.array([weights.get((r, i), 0.0) for i in range(len(c))]), np.random.default_rng(seed + r)
        chosen = [int(rng.choice(len(c), p=weight / weight.sum()))]
        near = _distances(c, c[chosen], metric)[1]
        while len(chosen) < min(k, len(c)):
            share = weight * near
            share[chosen] = 0.0
            share = share if share.sum() else np.where(np.isin(np.arange(len(c)), chosen), 0.0, 1.0)
            # Of a few tries, the one that leaves the least sum.
            tries = rng.choice(len(c), min(2 + int(np.log(k)), int((share > 0).sum())), replace=False, p=share / share.sum())
            left = [np.minimum(near, _distances(c, c[[i]], metric)[1]) for i in tries]
            best = int(np.argmin([weight @ d for d in left]))
            chosen.append(int(tries[best]))
            near = left[best]
        out[r] = c[chosen]
    return out


def kmeans(vectors: DataFrame, k: int = 4, iterations: int = 50, inits: int = 3, seed: int = 0, metric: str = "dtw", tolerance: float = 1e-6, series: str = "series", gamma: float = 1.0, start: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """KRN-8, 9: (centres in the order of their means, inertia) of the best of ``inits`` runs, from start or else from seeds().

    Each round is one pass for all runs that have not settled: tasks add up (run, cluster, place, sum, count), a
    small aggregate joins them; series never move. An empty cluster takes the farthest series. Give vectors that are written or cached.
    """
    if metric not in ("dtw", "euclid", "softdtw"):
        raise ValueError(f"k-means has no metric {metric}")
    first = vectors.select("v").first()
    if first is None:
        raise ValueError("no series to cluster")
    length = len(first[0])
    centres = {r: np.array(c, float) for r, c in (start or seeds(vectors, k, inits, seed, metric, series, length=length)).items()}
    inertia, open_ = dict.fromkeys(centres, np.inf), list(centres)
    for _ in range(iterations):
        shared = vectors.sparkSession.sparkContext.broadcast({r: centres[r] for r in open_})

        def step(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = {r: {"total": np.zeros(c.shape), "count": np.zeros(c.shape), "inertia": np.zeros(len(c)), "size": np.zeros(len(c)), "far": (-np.inf, None)} for r, c in shared.value.items()}
            for frame in frames:
                _, x = _frame(frame, length)
                for r, c in shared.value.items() if len(x) else ():
                    h = held[r]
                    home, near = _distances(x, c, metric, gamma)
                    for j in range(len(c)):
                        own = x[home == j]
                        if len(own):
                            s, n = _barycentre_sums(own, c[j]) if metric == "dtw" else soft_sums(own, c[j], gamma) if metric == "softdtw" else (own.sum(0), np.full(length, float(len(own))))
                            h["total"][j] += s
                            h["count"][j] += n
                    h["inertia"] += np.bincount(home, near, len(c))
                    h["size"] += np.bincount(home, minlength=len(c))
                    if near.max() > h["far"][0]:
                        h["far"] = (float(near.max()), x[near.argmax()].tolist())
            for r, h in held.items():
                # A row for each place, and one at -1 for inertia, size and the farthest series.
                for j in range(len(h["size"])):
                    yield pd.DataFrame({"run": r, "cluster": j, "place": range(-1, length), "total": [h["inertia"][j], *h["total"][j]], "count": [h["size"][j], *h["count"][j]], "far": h["far"][0], "farthest": [h["far"][1], *[None] * length]})

        parts = vectors.select("v").mapInPandas(step, "run int, cluster int, place int, total double, count double, far double, farthest array<double>")
        rows = parts.groupBy("run", "cluster", "place").agg(F.sum("total").alias("total"), F.sum("count").alias("count"), F.max(F.when(F.col("farthest").isNotNull(), F.struct("far", "farthest"))).alias("f")).collect()
        now, size, farthest = dict.fromkeys(open_, 0.0), {}, {}
        for r in sorted((r for r in rows if r.place < 0), key=lambda r: (r.run, r.cluster)):
            now[r.run] += float(r.total)
            size[r.run, r.cluster], farthest[r.run, r.cluster] = r["count"], r.f.farthest if r.f else None
        for r in rows:
            if r.place >= 0 and size[r.run, r.cluster] and r["count"] > 0:
                centres[r.run][r.cluster][r.place] = r.total / r["count"]
        for (run_, j), n in size.items():
            if not n and farthest[run_, j]:
                centres[run_][j] = farthest[run_, j]
        open_ = [r for r in open_ if not abs(inertia[r] - now[r]) <= tolerance * max(1.0, abs(now[r]))]
        inertia |= now
        if not open_:
            break
    best = min(centres, key=lambda r: (inertia[r], r))
    c = centres[best]
    return c[np.lexsort((c[:, 0], c.mean(1)))], inertia[best]


def centroid_table(spark, centres: np.ndarray) -> DataFrame:
    """SRC-15: the model as rows (cluster, v), to be written and read back."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, v array<double>")


def denormalised(centroids: DataFrame, mean: float, deviation: float) -> DataFrame:
    """PRJ-20, T28: with the global mean and deviation."""
    return centroids.withColumn("v", F.transform("v", lambda x: x * deviation + mean))

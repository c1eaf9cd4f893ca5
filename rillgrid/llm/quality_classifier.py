"""Quality classifier: support vectors on Naive Bayes features (operator 5).

A text's features are indicators of hashed n-grams: 1 to 3 bytes, and 1 to 3 word
shapes (a shape says whether a word repeats the one before, is upper case, holds a
symbol or digit, ends with a stop, and about how long it is). Log-count ratios
between the classes come from all training rows: tasks add up counts, one small
shuffle adds the tasks. Indicators scaled by them, at unit length, train a linear
hinge-loss model by dual coordinate descent on the driver, on at most ``sample``
training rows, half of each class, those of the smallest hashes of their ids; a logistic
curve fitted to its margins, weighted to all rows' class shares, gives the score.

Only text enters a score. Null and empty texts have no feature and get the score of the
intercept. Ids with several labels count with the smallest; null labels or ids teach
nothing. Repeated rows count as often as they occur. Without training rows of both
classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rillgrid.llm import tokens as tk
from rillgrid.llm.scratch import written

WIDTH = 1 << 17
SAMPLE = 6000
BLOCKS = 64
BROADCAST_LABELS = 500_000
_CLASS = np.zeros(256, np.int64)  # 1 lower, 2 upper, 4 digit, 8 symbol
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 4
_CLASS[[ord(c) for c in "#*$%&|<>!=+/\\{}[]~^_@"]] = 8
_CLASS[0x80:] = 1


def _hashed(code: np.ndarray, salt: int) -> np.ndarray:
    return (tk.mix(code.astype(np.uint64), salt) >> np.uint64(64 - 17)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text."""
    n = len(data)
    one = data.astype(np.int64)
    two = np.r_[one[:-1] * 256 + one[1:], np.zeros(min(n, 1), np.int64)]
    three = np.r_[two[:-1] * 256 + one[1:], np.zeros(min(n, 1), np.int64)] if n else two
    three[: max(0, n - 2)] = one[: max(0, n - 2)] * 65536 + one[1 : max(1, n - 1)] * 256 + one[2:] if n > 2 else 0
    b1, b2, b3 = _hashed(one, 11), _hashed(two, 12), _hashed(three, 13)
    w = tk.words(data, offsets, lower=False)
    bits = np.zeros(len(w.hash), np.int64)
    if len(bits):
        kind = _CLASS[data]
        for k in (1, 2, 4, 8):
            total = np.r_[0, np.cumsum(kind == k)]
            bits |= np.where(total[w.end] > total[w.start], k, 0)
        bits |= np.where(np.r_[False, (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])], 16, 0)
        bits |= np.where(np.isin(data[w.end - 1], [46, 33, 63]), 32, 0)
        bits += 64 * np.digitize(w.end - w.start, [3, 6, 10, 20])
    s1, s2, s3 = (_hashed(x, 20 + i) for i, x in enumerate((bits, np.r_[bits[:-1] * 1024 + bits[1:], bits[:1]] if len(bits) else bits, np.r_[(bits[:-2] * 1024 + bits[1:-1]) * 1024 + bits[2:], bits[:2]] if len(bits) > 1 else bits)))
    first = np.searchsorted(w.text, np.arange(len(offsets)))
    flag = np.zeros(WIDTH, bool)
    for i in range(len(offsets) - 1):
        a, b, u, v = offsets[i], offsets[i + 1], first[i], first[i + 1]
        for part in (b1[a:b], b2[a : max(a, b - 1)], b3[a : max(a, b - 2)], s1[u:v], s2[u : max(u, v - 1)], s3[u : max(u, v - 2)]):
            flag[part] = True
        found = np.flatnonzero(flag)
        flag[found] = False
        yield found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros((2, WIDTH), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy()
        for lo, _, d, o in tk.chunks(*tk.column(batch, "text")):
            for i, f in enumerate(features(d, o)):
                total[label[lo + i], f] += 1
                rows[label[lo + i]] += 1
    if rows.any():
        step = WIDTH // BLOCKS
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([rows.astype(np.int64).tobytes()] * BLOCKS, pa.binary()), pa.array([total[:, b * step : (b + 1) * step].tobytes() for b in range(BLOCKS)], pa.binary())], names=["block", "n", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for b, n, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = held.setdefault(b, [np.zeros(2, np.int64), np.zeros(2 * WIDTH // BLOCKS, np.int64)])
            x[0] += np.frombuffer(n, np.int64)
            x[1] += np.frombuffer(c, np.int64)
    for b, (n, c) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["block", "n", "counts"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, d, o in tk.chunks(*tk.column(batch, "text")):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([f.astype(np.int32).tobytes() for f in features(d, o)], pa.binary())], names=["label", "order", "found"])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: float = 1.0, epochs: int = 15, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-loss linear support vector machine, by dual coordinate descent over the box [0, cost]."""
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                most = max(most, abs(step))
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if most < 1e-4:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the weighted logistic curve through the margins, a little shrunk."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-12
        g = np.array([r @ margin + 1e-3 * a, r.sum()])
        m = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _scores(shared, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, square, bias, a, b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for _, _, d, o in tk.chunks(*tk.column(batch, "text")):
                for f in features(d, o):
                    length = np.sqrt(square[f].sum())
                    out.append((weight[f].sum() / length if length else 0.0) + bias)
            score = 1 / (1 + np.exp(-np.clip(a * np.array(out) + b, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_name, "held_out", "score", "predicted"])

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple:
    """What _scores needs, from rows (id, label 0 or 1, text)."""
    rows = labelled.select("id", F.col("label").cast("int").alias("label"), F.xxhash64(F.lit(5), "id").alias("order"), "text")
    parts = rows.mapInArrow(_counts, "block int, n binary, counts binary").repartition(BLOCKS, "block").mapInArrow(_added, "block int, n binary, counts binary").collect()
    count = np.zeros((2, WIDTH))
    n = np.zeros(2)
    for r in parts:
        step = WIDTH // BLOCKS
        count[:, r.block * step : (r.block + 1) * step] = np.frombuffer(r.counts, np.int64).reshape(2, step)
        n = np.frombuffer(r.n, np.int64).astype(float)
    if not n.all():
        share = n[1] / n.sum() if n.sum() else 0.5
        return np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (700.0 if share == 1 else -700.0 if n.sum() else 0.0)
    rate = (count + 1) / (n[:, None] + 2)
    ratio = np.log(rate[1] / rate[0])
    # Ids up to a hash are drawn, with their text of the least hash: a repeated id teaches the margin once, so that its rows cannot pass the bound.
    ids = rows.select("id", "label", "order").distinct()
    cuts = [ids.where(F.col("label") == k).orderBy("order").limit(sample // 2).agg(F.max("order")).first()[0] for k in (0, 1)]
    chosen = rows.where(f"(label = 0 AND order <= {cuts[0]}) OR (label = 1 AND order <= {cuts[1]})").groupBy("id", "label", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    drawn = chosen.mapInArrow(_sampled, "label int, order long, found binary").orderBy("order", "label", "found").limit(sample + 2).collect()
    found = [np.frombuffer(r.found, np.int32).astype(np.int64) for r in drawn]
    values = [(lambda v: v / (np.sqrt(v @ v) or 1.0))(ratio[f]) for f in found]
    y = np.array([r.label for r in drawn])
    w, bias = dual_descent(found, values, np.where(y == 1, 1.0, -1.0), WIDTH)
    margin = np.array([w[f] @ v + bias for f, v in zip(found, values, strict=True)])
    weight = n[y] / np.bincount(y, minlength=2)[y]
    a, b = logistic(margin, y, weight / weight.mean())
    return w * ratio, ratio * ratio, bias, a, b


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs; labels of rows where held_out is true teach nothing."""
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias(id_col), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    taught = written(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~F.coalesce(held_out, F.lit(False))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")), "labels")
    small = F.broadcast(taught) if taught.count() <= BROADCAST_LABELS else taught
    labelled = base.select(F.col(id_col).alias("id"), "text").join(small, "id")
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled, sample))
    return base.mapInArrow(_scores(model, id_col), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")

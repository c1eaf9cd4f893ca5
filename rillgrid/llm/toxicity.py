"""Toxicity: a linear classifier of character n-grams, scaled by Naive Bayes log-count ratios (operator 11).

A text's features are the distinct hashed n-grams of 3 to 6 of its characters (code points,
A-Z as a-z, each white space as a space). The log-count ratios count at most ``counted`` training
ids, half of each class, those of the smallest hashes: a list of bounded size is broadcast and no
text is shuffled for it, however many labels there are. Tasks add up what they see and one small
shuffle adds the tasks. Features scaled by the ratios train a linear model by dual coordinate
descent on the driver, on the first ``sample`` of those ids. A ratio below ``least``
counts as none: a long text has nearly every common n-gram, and what tells nothing would drown
what does. A logistic curve through the margins, weighted to all rows' class shares, gives the score.

Only text enters a score. Null and empty texts have no feature and get the intercept's score.
Ids with several labels count with the largest; null labels or ids teach nothing. Repeated rows
count as often as they occur. Without training rows of both classes every score is the share
of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rillgrid.llm import tokens as tk
from rillgrid.llm.quality_classifier import dual_descent, logistic
from rillgrid.llm.scratch import small, written

BITS = 18
WIDTH = 1 << BITS
SIZES = (3, 4, 5, 6)
COUNTED, SAMPLE = 60_000, 4000
LEAST = 1.0
BLOCKS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, A-Z lower-cased and white space as a space, and where each text begins among them."""
    data = tk.LOWER[np.where(tk.SPACES[data], 0x20, data)]
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), begins[offsets]


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text."""
    chars, at = _characters(data, offsets)
    with np.errstate(over="ignore"):
        code, grams = chars.astype(np.uint64) + np.uint64(1), []
        rolled = code
        for size in range(2, max(SIZES) + 1):
            rolled = rolled[:-1] * _STEP + code[size - 1 :] if len(rolled) > 1 else rolled[:0]
            if size in SIZES:
                grams.append((size, (tk.mix(rolled, size) >> np.uint64(64 - BITS)).astype(np.int32)))
    flag = np.zeros(WIDTH, bool)
    for a, b in zip(at[:-1], at[1:], strict=True):
        parts = [g[a : max(a, b - size + 1)] for size, g in grams]
        if b - a < 4000:
            yield np.unique(np.concatenate(parts))
            continue
        for part in parts:
            flag[part] = True
        found = np.flatnonzero(flag).astype(np.int32)
        flag[found] = False
        yield found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of features that this task has seen: its numbers and their counts in both classes."""
    total, rows = np.zeros((2, WIDTH), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy()
        for lo, _, d, o in tk.chunks(*tk.column(batch, "text")):
            for i, f in enumerate(features(d, o)):
                total[label[lo + i], f] += 1
                rows[label[lo + i]] += 1
    if not rows.any():
        return
    for block, part in enumerate(np.split(total, BLOCKS, 1)):
        seen = np.flatnonzero(part.any(0)).astype(np.int32)
        n = rows if block == 0 else 0 * rows
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary()), pa.array([part[:, seen].tobytes()], pa.binary())], names=["block", "n", "seen", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for block, n, seen, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = held.setdefault(block, [np.zeros(2, np.int64), np.zeros((2, WIDTH // BLOCKS), np.int64)])
            x[0] += np.frombuffer(n, np.int64)
            at = np.frombuffer(seen, np.int32)
            x[1][:, at] += np.frombuffer(counts, np.int64).reshape(2, len(at))
    for block, (n, counts) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["block", "n", "counts"])


def _drawn(shared):
    """Label and the features whose ratio counts, of each chosen row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, d, o in tk.chunks(*tk.column(batch, "text")):
                found = [f[shared.value[f] != 0].tobytes() for f in features(d, o)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(found, pa.binary())], names=["label", "order", "found"])

    return run


def ratios(counts: np.ndarray, n: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Log-count ratios of the classes, smoothed by one row; 0 where they are nearer to 0 than least."""
    rate = (counts + 1) / (n[:, None] + 2)
    ratio = np.log(rate[1] / rate[0])
    return np.where(np.abs(ratio) < least, 0.0, ratio)


def drawn(labels: DataFrame, ids: DataFrame, counted: int = COUNTED, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, order, margin): the ids whose texts teach, at most counted; margin: those that train the margin. And how many ids each class has in all."""
    known = written(labels.join(ids.select("id").where("id IS NOT NULL").distinct(), "id", "left_semi").withColumn("order", F.xxhash64(F.lit(11), "id")), "labels")
    n = np.array(known.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first(), float)
    first = lambda k, most: known.where(F.col("label") == k).orderBy("order", "id").limit(max(1, most // 2))
    taught = first(0, counted).withColumn("margin", F.lit(False)).unionByName(first(1, counted).withColumn("margin", F.lit(False)))
    margin = first(0, sample).unionByName(first(1, sample)).withColumn("margin", F.lit(True))
    return written(taught.unionByName(margin).groupBy("id", "label", "order").agg(F.max("margin").alias("margin")), "drawn"), n


def fit(texts: DataFrame, taught: DataFrame, n: np.ndarray, sample: int = SAMPLE, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Weights and squared ratios by feature, intercept, slope and shift of the curve, from texts (id, text) and what drawn() gives."""
    rows = texts.join(small(taught), "id").select("id", "label", "order", "margin", "text")
    parts = rows.select("text", "label").mapInArrow(_counts, "block int, n binary, seen binary, counts binary").repartition(BLOCKS, "block").mapInArrow(_added, "block int, n binary, counts binary").collect()
    count, seen = np.zeros((2, WIDTH)), np.zeros(2)
    for r in parts:
        count[:, r.block * WIDTH // BLOCKS : (r.block + 1) * WIDTH // BLOCKS] = np.frombuffer(r.counts, np.int64).reshape(2, -1)
        seen += np.frombuffer(r.n, np.int64)
    if not n.all():
        share = n[1] / n.sum() if n.sum() else 0.5
        return np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (700.0 if share else -700.0)
    ratio = ratios(count, seen, least)
    shared = texts.sparkSession.sparkContext.broadcast(ratio)
    # Of a repeated id, one text teaches the margin, so that rows cannot pass the bound.
    chosen = rows.where("margin").groupBy("id", "label", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    drawn = chosen.select("id", "label", "order", "text").mapInArrow(_drawn(shared), "label int, order long, found binary").orderBy("order", "label", "found").limit(sample + 2).collect()
    found = [np.frombuffer(r.found, np.int32) for r in drawn]
    values = [(lambda v: v / (np.sqrt(v @ v) or 1.0))(ratio[f]) for f in found]
    y = np.array([r.label for r in drawn])
    w, bias = dual_descent(found, values, np.where(y == 1, 1.0, -1.0), WIDTH)
    margin = np.array([w[f] @ v + bias for f, v in zip(found, values, strict=True)])
    weight = n[y] / np.bincount(y, minlength=2)[y]
    a, b = logistic(margin, y, weight / weight.mean())
    return w * ratio, ratio * ratio, bias, a, b


def _scores(shared, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, square, bias, a, b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            margin = []
            for _, _, d, o in tk.chunks(*tk.column(batch, "text")):
                for f in features(d, o):
                    length = np.sqrt(square[f].sum())
                    margin.append((weight[f].sum() / length if length else 0.0) + bias)
            score = 1 / (1 + np.exp(-np.clip(a * np.array(margin) + b, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_name, "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", counted: int = COUNTED, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs; labels of rows where held_out is true teach nothing."""
    kind = dict(docs.dtypes)[id_col]
    out = F.coalesce(held_out, F.lit(False))
    base = docs.select(F.col(id_col).alias(id_col), out.alias("held_out"), F.col(text_col).alias("text"))
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~out).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = base.select(F.col(id_col).alias("id"), "text")
    taught, n = drawn(given, texts, counted, sample)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, taught, n, sample, least))
    return base.mapInArrow(_scores(model, id_col), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")

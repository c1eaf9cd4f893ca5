"""Sampling (SMP-1…4, JN-9, 12)."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillgrid.functions import keys

MOST_TAKEN = 2_000_000  # pixels of a spaced sample, strata times quota


def priority(seed: int, *columns: str) -> Column:
    """A hash order in place of a random generator's: the same on every machine and engine (an intended difference)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def uniform(rows: DataFrame, most: int = 200, seed: int = 42, key: Sequence[str] = ("row", "col")) -> DataFrame:
    """SMP-1: at most ``most`` rows without replacement: a top-k, no full sort."""
    return rows.orderBy(priority(seed, *key), *key).limit(most)


def strata(pixels: DataFrame, height: int, width: int, ny: int = 3, nx: int = 5, occ: str = "occ") -> DataFrame:
    """SMP-2, PRJ-26, 27: pixels with occ_bin and cell_id; those outside all bins go."""
    out = pixels.withColumn("occ_bin", keys.occurrence_bin(F.col(occ))).withColumn("cell_id", keys.grid_cell(F.col("row"), F.col("col"), height, width, ny, nx))
    return out.where(F.col("occ_bin").isNotNull() & ~F.contains(F.col("cell_id"), F.lit("null")))


def shuffled(candidates: DataFrame, seed: int = 42, stratum: Sequence[str] = ("occ_bin", "cell_id"), key: Sequence[str] = ("row", "col")) -> DataFrame:
    """SMP-2: candidates with their place k, from 1, in the hash order of their stratum."""
    return candidates.withColumn("k", F.row_number().over(Window.partitionBy(*stratum).orderBy(priority(seed, *key), *key)))


def summary(candidates: DataFrame, sampled: DataFrame, bins: Sequence[str], ny: int = 3, nx: int = 5) -> DataFrame:
    """SMP-4, JN-9: candidates and sampled of every stratum, also the empty ones. The strata are a literal list."""
    spark = candidates.sparkSession
    every = spark.createDataFrame([(b, f"y{y}x{x}") for b in bins for y in range(1, ny + 1) for x in range(1, nx + 1)], "occ_bin string, cell_id string")
    on = ["occ_bin", "cell_id"]
    a, b = candidates.groupBy(*on).agg(F.count("*").alias("candidates")), sampled.groupBy(*on).agg(F.count("*").alias("sampled"))
    return every.join(a, on, "left").join(b, on, "left").select(*on, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates", "sampled")))


def spaced(candidates: DataFrame, distance: int = 3, quota: int = 120, seed: int = 42, stratum: Sequence[str] = ("occ_bin", "cell_id"), ahead: int = 4) -> DataFrame:
    """SMP-3, JN-12, T38: at most quota pixels of each stratum, no two within distance (inclusive) over all strata, by round robin.

    In each round each stratum, in order, that is below its quota takes the first pixel of its hash order that
    no taken one blocks; rounds end when none takes any. A stratum at its quota takes no more, so it
    blocks no others. Taken pixels number strata times quota at most, whatever the candidates, so their order is
    decided on the driver; Spark finds what it decides on: the next ahead * quota pixels of
    each stratum that has none left, after those seen and outside what is blocked by then. That is a
    distributed top-k, which keeps as many rows for each stratum in a task.
    """
    key = ["row", "col"]
    kinds = dict(candidates.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*key, *stratum))
    ranked = _cut(candidates.where("row IS NOT NULL AND col IS NOT NULL").select(*key, *stratum, priority(seed, *key).alias("p")).dropDuplicates(key))
    reach = range(-distance, distance + 1)
    disk = [(a, b) for a in reach for b in reach if a * a + b * b <= distance * distance]
    heads: dict[tuple, deque] = {}
    last, more, blocked, taken = {}, {}, set(), []

    def fetch(empty: list[tuple] | None) -> None:
        rows = ranked
        if empty is not None:
            seen = rows.sparkSession.createDataFrame([(*s, *last[s]) for s in empty], ", ".join(f"`_{c}` {kinds[c]}" for c in stratum) + ", _p string, _row long, _col long")
            same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in stratum))
            rows = rows.join(F.broadcast(seen), same).where(F.struct("p", F.col("row").cast("long"), F.col("col").cast("long")) > F.struct("_p", "_row", "_col"))
            gone = rows.sparkSession.createDataFrame(sorted(blocked), "row long, col long")  # pixels around taken ones
            rows = rows.join(gone, key, "left_anti")
        n = F.row_number().over(Window.partitionBy(*stratum).orderBy("p", *key))
        found = rows.withColumn("n", n).where(F.col("n") <= ahead * quota).select(*stratum, "p", *key, "n").orderBy(*stratum, "n").collect()
        for s in empty or ():
            more[s] = False
        for r in found:
            s = tuple(r[: len(stratum)])
            heads.setdefault(s, deque()).append((r.row, r.col))
            last[s], more[s] = (r.p, r.row, r.col), r.n == ahead * quota

    fetch(None)
    order = sorted(heads, key=lambda s: tuple((x is not None, x) for x in s))
    if len(order) * quota > MOST_TAKEN:
        raise ValueError(f"{len(order)} strata of {quota} pixels are more than {MOST_TAKEN}")
    counts, moved = dict.fromkeys(order, 0), True
    while moved:
        moved = False
        for s in order:
            while counts[s] < quota:
                if not heads[s]:
                    if not more[s]:
                        break
                    fetch([x for x in order if not heads[x] and more[x] and counts[x] < quota])
                    continue
                r, c = heads[s].popleft()  # blocked once is blocked for good
                if (r, c) not in blocked:
                    taken.append((r, c, *s))
                    blocked.update((r + a, c + b) for a, b in disk)
                    counts[s] += 1
                    moved = True
                    break
    return candidates.sparkSession.createDataFrame(taken, schema)


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that the session names."""
    from rillgrid.plans.session import checkpoint

    return checkpoint(df)

"""Mixing sources to target weights (operator 9).

Targets: sources in code point order, null last, weigh ``weights`` in turn and share the total
size; a target stops at ``most`` times its source's size and what is over is shared again by weight
among the others. A source's target is met by whole passes over its documents and, for the rest, by
a random subset: documents in the order of a seeded hash until the next one would pass the rest, then,
``ROUNDS`` - 1 times, further ones of those that still fit. The cut in that order is found by descending
a tree of hash ranges on sums alone.

Draws are then dealt to output shards, one for ``SHARD_WORDS`` words and ``shards`` at least. Each source
has an exact quota of blocks (draws in equal parts of its permuted order); sources of less than a block
share blocks. A splitting tree halves the shards, a multivariate hypergeometric draw giving the left half's
quota of each source, down to single shards. A shard takes its quota of each source's permuted blocks,
disjoint from all others', and orders its rows by a second hash.

Sources may be many: what is known of each stays in tables. The driver sees sums, and the quotas of
the sources that fill a block: at most ``SPLIT`` a shard.

Null texts have size 0 and are never taken; null ids and repeated rows are drawn like
others, by the hash of all their columns. Ties of the hash and size share a fate. Empty tables
and tables without a word give zero targets. Reruns agree for equal rows and seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rillgrid.llm import tokens as tk
from rillgrid.llm.scratch import BROADCAST_BYTES, room, small, written

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
FAN, SPACE = 4096, 1 << 48  # a document's place is a hash of 48 bits; each level of the descent tells 12 more apart
ROUNDS = 3
SHARDS, SHARD_WORDS, SPLIT = 64, 100_000_000, 32  # output shards at least; words of a shard at most, about; blocks that a shard draws


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns, and the number of words of the last one."""
    for batch in batches:
        data, offsets = tk.column(batch, batch.schema.names[-1])
        count = np.zeros(batch.num_rows, np.int64)
        for lo, hi, d, o in tk.chunks(data, offsets):
            solid = ~tk.SPACES[d]
            begins = solid & ~np.r_[False, solid[:-1]]
            at = o[:-1][o[1:] > o[:-1]]
            begins[at] = solid[at]
            count[lo:hi] = np.diff(np.r_[0, np.cumsum(begins)][o])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count)], names=[*batch.schema.names, "size"])


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank (from 0) by code points, null last: a distributed sort, of which the driver sees a count for each partition."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("source").isNull(), F.col("source")
    placed = written(sources.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in counts], np.r_[0, np.cumsum([n for _, n in counts])][:-1].tolist(), strict=True))
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return placed.withColumn("rank", offsets[part.cast("int" if before else "long")] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def with_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with rank and target, written.

    A source is full once its share by weight passes ``most`` times its size. Full ones give back what they
    do not need, which raises the share of the others, so fullness only spreads: each round sums the
    full ones under the last share until their number stays.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(ranked(sizes).withColumn("weight", weight).withColumn("full", most * F.col("source_size")), "sources")
    some = table.where("source_size > 0")
    all_ = some.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    share, closed = (all_.words / all_.weight if all_.weight else 0.0), 0
    while True:
        x = some.where(F.col("full") < F.lit(share) * F.col("weight")).agg(F.count("*").alias("n"), F.coalesce(F.sum("full"), F.lit(0.0)).alias("full"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
        if x.n == closed:
            break
        share, closed = (all_.words - x.full) / (all_.weight - x.weight), x.n
    return table.withColumn("target", F.when(F.col("source_size") > 0, F.least("full", F.lit(share) * F.col("weight"))).otherwise(0.0)).drop("weight", "full")


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = 0) -> list[np.ndarray]:
    """For each source, the shard of each of its blocks in turn: exact in each source, and shards equal to a block. quotas: blocks of each source."""
    quotas = np.asarray(quotas, np.int64)
    found: list[list[np.ndarray]] = [[] for _ in quotas]

    def split(low: int, high: int, which: np.ndarray, have: np.ndarray) -> None:
        if high - low == 1:
            for k, n in zip(which, have, strict=True):
                found[k].append(np.full(n, low, np.int32))
            return
        mid = (low + high) // 2
        n = int(have.sum())
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, n * (mid - low) // (high - low), method="marginals")
        for a, b, part in ((low, mid, left), (mid, high, have - left)):
            some = part > 0
            if some.any():
                split(a, b, which[some], part[some])

    some = np.flatnonzero(quotas)
    if len(some):
        split(0, shards, some, quotas[some])
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in found]


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 0, shards: int = SHARDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(a row for each row: id, source, place (its hash), size; a row for each source; the shards of the blocks of each stratum; number of shards).

    A row is taken ``passes`` times, and once more if it lies in the subset that the cuts bound.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _place(docs, seed).alias("place"), F.col(text_col).alias("text"))
    sized = written(rows.mapInArrow(_sizes, f"id {kind}, source string, place long, text string, size long").drop("text"), "sizes")
    table = with_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    table = table.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    table = _cut(sized, written(table, "passes"))
    words = table.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    shards = max(shards, math.ceil(words / shard_words))
    block = max(1.0, words / (shards * SPLIT))
    table = table.withColumn("blocks", F.round(F.col("source_size") / block).cast("int")).withColumn("stratum", F.when(F.col("blocks") > 0, F.col("rank")).otherwise(-1))
    table = written(table, "plan")
    strata = [tuple(r) for r in table.where("stratum >= 0").select("rank", "blocks", (F.col("passes") + (F.col("cut1") > 0).cast("int")).alias("draws")).orderBy("rank").collect()]
    pooled = table.where("stratum < 0").agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    strata.append((-1, max(1, round(pooled / block)), 1))
    deals = []
    for k, shard in enumerate(splitting_tree(np.array([b * d for _, b, d in strata]), shards, seed)):
        deals.append((strata[k][0], strata[k][1], shard[np.random.default_rng([seed, k]).permutation(len(shard))].tolist()))
    return sized, table.drop("blocks"), spark.createDataFrame(deals, "stratum long, blocks int, deal array<int>"), shards


def _extra() -> Column:
    """Whether a row is in the subset that fills its source's rest."""
    within = [F.col("place") < F.col("cut1")]
    for k in range(2, ROUNDS + 1):
        within.append((F.col("place") >= F.col(f"cut{k - 1}")) & (F.col("place") < F.col(f"cut{k}")) & (F.col("size") <= F.col(f"fits{k}")))
    out = within[0]
    for x in within[1:]:
        out = out | x
    return out


def _shards(rows: DataFrame, sources: DataFrame, deals: DataFrame) -> DataFrame:
    """rows with the columns of their source and shards: where their draws go to, one for each time that they are taken."""
    named = sources.withColumnRenamed("source", "named")
    joined = rows.join(small(named), F.col("source").eqNullSafe(F.col("named")), "left").join(F.broadcast(deals), "stratum", "left")
    joined = joined.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + _extra().cast("int")).otherwise(0))
    own = f"CAST(p * blocks + least(blocks - 1, floor(place * double(blocks) / CASE WHEN p < passes THEN {SPACE}L ELSE cut{ROUNDS} END)) AS INT)"
    pooled = f"CAST(pmod(xxhash64(place, p), blocks) AS INT)"
    return joined.withColumn("shards", F.expr(f"CASE WHEN copies > 0 THEN transform(sequence(0, copies - 1), p -> deal[CASE WHEN stratum < 0 THEN {pooled} ELSE {own} END]) ELSE CAST(array() AS array<int>) END"))


def _place(docs: DataFrame, seed: int) -> Column:
    columns = [F.to_json(F.struct(f"`{c}`")) if "map<" in k or "variant" in k else F.col(f"`{c}`") for c, k in docs.dtypes]
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(SPACE))


def _cut(sized: DataFrame, table: DataFrame) -> DataFrame:
    """table with cut1, cut2, ... (places) and fits2, ... (sizes): what bounds the subset of each source's documents."""
    state = table.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("need")).where("need > 0").withColumn("low", F.lit(0).cast("long"))
    for k in range(1, ROUNDS + 1):
        state = written(_descended(sized.where("size > 0"), state.withColumn("fits", F.floor("need")) if k > 1 else state.withColumn("fits", F.lit((1 << 62)).cast("long")), k == ROUNDS), f"cut{k}")
        found = state.select(F.col("source").alias("named"), F.col("low").alias(f"cut{k}"), *([F.col("fits").alias(f"fits{k}")] if k > 1 else []))
        table = table.join(small(found), F.col("source").eqNullSafe(F.col("named")), "left").drop("named").fillna(0, [f"cut{k}", *([f"fits{k}"] if k > 1 else [])])
        state = state.drop("fits")
    return table


def _descended(sized: DataFrame, state: DataFrame, last: bool) -> DataFrame:
    """state (source, need, low, fits) with low at the place up to which documents of at most fits words, from the old low on, fill need, and with what is left of need.

    A tree of place ranges is descended on sums: a level finds the first of ``FAN`` ranges in which the sum passes
    need. At the last document, the last round takes it if that comes nearer.
    """
    width, begin = SPACE, F.lit(0).cast("long")
    by_source = Window.partitionBy("named").orderBy("bin")
    open_, done = state.withColumn("begin", begin), None
    while width > 1:
        width //= FAN
        at = open_.withColumnRenamed("source", "named")
        if not (size := room(at)):
            break
        inside = sized.join(F.broadcast(at) if size <= BROADCAST_BYTES else at, F.col("source").eqNullSafe(F.col("named"))).where(f"place >= low AND size <= fits AND place >= begin AND place < begin + {width * FAN}")
        bins = inside.groupBy("named", "begin", F.expr(f"(place - begin) div {width}").alias("bin")).agg(F.sum("size").alias("size"), F.count_distinct("place").alias("n"), F.any_value("need").alias("need"))
        # FAN rows of a source at most stand in this window, however large the source is
        passed = F.col("upto") > F.col("need")
        crossing = bins.withColumn("upto", F.sum("size").over(by_source)).groupBy("named").agg(F.sum("size").alias("all"), F.min_by(F.when(passed, F.struct("bin", "size", "upto", "n")), F.when(passed, F.col("bin"))).alias("x"))
        next_ = at.join(crossing.withColumnRenamed("named", "source"), F.col("named").eqNullSafe(F.col("source")), "left").drop("source").withColumnRenamed("named", "source")
        left = F.col("need") - (F.col("x.upto") - F.col("x.size"))
        start = F.col("begin") + F.col("x.bin") * width
        deeper = (F.col("x.n") > 1) & F.lit(width > 1)
        next_ = written(next_.withColumn("deeper", F.coalesce(deeper, F.lit(False))), "level")
        open_ = next_.where("deeper").select("source", left.alias("need"), "low", "fits", start.alias("begin"))
        nearer = (F.col("x.size") - left < left) if last else F.lit(False)
        ended = next_.where("NOT deeper").select(
            "source",
            F.when(F.col("x").isNull(), F.col("need") - F.coalesce("all", F.lit(0))).when(nearer, left - F.col("x.size")).otherwise(left).alias("need"),
            F.when(F.col("x").isNull(), F.lit(SPACE)).when(nearer, start + width).otherwise(F.greatest("low", start)).alias("low"), "fits",
        )
        done = ended if done is None else done.unionByName(ended)
    return done if done is not None else state


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 0, shards: int = SHARDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with its columns, each row as often as it is taken, dealt to the shards and shuffled in each."""
    _, sources, deals, shards = plan(docs, id_col, text_col, source_col, weights, most, seed, shards, shard_words)
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {k}" for n, (_, k) in zip(names, docs.dtypes, strict=True))
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col(source_col).cast("string").alias("source"), _place(docs, seed).alias("place"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_sizes, f"{kinds}, source string, place long, text string, size long").drop("text")
    drawn = _shards(rows, sources, deals).select(*names, "place", F.posexplode("shards").alias("pass", "shard"))
    order = F.xxhash64(F.lit(seed), "place", "pass")
    return drawn.repartitionById(shards, "shard").sortWithinPartitions("shard", order).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """id_col, size, source_size, target, taken and shards for each row: the words that the mix takes of it, repeats counted, and where they go."""
    sized, sources, deals, _ = plan(docs, id_col, text_col, source_col, **options)
    return _shards(sized, sources, deals).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "shards")

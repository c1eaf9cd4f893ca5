"""Language-model scoring with a log-frequency Bloom filter (operator 1).

Training counts words and word pairs of all training texts: tasks tally them as
sorted 64-bit hashes, one shuffle adds the tallies of a hash block, and each
block becomes a piece of the filter. A count is kept as its quantised logarithm
q: the pairs (n-gram, 1) to (n-gram, q) are members. A block
is added up by a task of its own. The filter is broadcast, and a count is read back by probing
levels until one is missing. Smoothing is
Bayesian: P(w|v) = (c(v w) + k P(w)) / (c(v) + k), P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
Exact word counts, for the base score, travel with the filter.

A broadcast never exceeds ``broadcast_mb``: the pair filter and word counts are
dealt to as many passes over the texts as that takes. The filter of single words,
which every pass needs, travels with each while it stays within a quarter of that;
beyond, it is dealt to passes of its own, which write a level for each token beside
the text. Both ways read the same counts.

Words are runs ``[^\\x20\\x09-\\x0D]+`` lower-cased A-Z, and each text ends with an
end token. Null and empty texts hold that token alone. A null id is training
text. Repeated rows count, and are scored, as often as they occur; an empty
table gives an empty result, and with no training rows all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillgrid.llm import tokens as tk
from rillgrid.llm.scratch import release, scope, written

END, BEGIN = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0xB361B361B361B361)
HASHES, BITS = 6, 12
BLOCK_BYTES = 16 << 20  # of text, about, whose n-grams one task of the reduce side adds up
FLUSH = 1_500_000  # tokens that a task tallies before it sends them on


def _bounds(base: float) -> np.ndarray:
    """The smallest count of each level: distinct integers, base times apart."""
    out, x = [], 1.0
    while x < 2.0**62:
        if not out or round(x) > out[-1]:
            out.append(round(x))
        x = max(x * base, x + 0.5)
    return np.array(out, np.float64)


WORD_LEVELS, PAIR_LEVELS = _bounds(1.2), _bounds(1.5)


def _middle(levels: np.ndarray) -> np.ndarray:
    """The count that stands for each level, 0 for none."""
    return np.r_[0.0, (levels[:-1] + levels[1:] - 1) / 2, levels[-1]]


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with the ends, the token before each, and the number of tokens of each text."""
    w = tk.words(data, offsets)
    count = np.bincount(w.text, minlength=len(offsets) - 1) + 1
    last = np.cumsum(count) - 1
    token = np.full(int(count.sum()), END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner] = w.hash
    before = np.r_[BEGIN, token[:-1]]
    before[last[:-1] + 1] = BEGIN
    return token, before, count


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tk.mix(before * np.uint64(0x9E3779B97F4A7C15) + token, 5)


def _tallies(blocks: int, keys: list[int]):
    """Map side: for each hash block, the tallies of words and of pairs, under a key of the block's own partition."""

    def rows(kept: list) -> pa.RecordBatch:
        sides = []
        for k in range(2):
            key, count = tk.tallied(np.concatenate([x[k] for x in kept]))
            cut = np.searchsorted(tk.blocks_of(key, blocks), np.arange(blocks + 1))
            count = np.minimum(count, 2**32 - 1).astype(np.uint32)
            sides += [[v[cut[b] : cut[b + 1]].tobytes() for b in range(blocks)] for v in (key, count)]
        return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), *(pa.array(x, pa.binary()) for x in sides), pa.array(keys, pa.int32())], names=["block", "k1", "c1", "k2", "c2", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for _, _, d, o in tk.chunks(*tk.column(batch, "text")):
                token, before, _ = sequence(d, o)
                kept.append((token, pairs(before, token)))
                n += len(token)
                if n >= FLUSH:
                    yield rows(kept)
                    kept, n = [], 0
        if kept:
            yield rows(kept)

    return run


def members(keys: np.ndarray, counts: np.ndarray, levels: np.ndarray, bits: int) -> tuple[bytes, int]:
    """The bit array that holds (key, 1) to (key, q(count)), and its number of bits, whole words of 64."""
    q = np.searchsorted(levels, counts, "right")
    size = max(64, int(q.sum()) * bits + 63 & ~63)
    flags = np.zeros(size, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        for word, x in _places(keys[q >= level], level, np.uint64(size // 64)):
            for i in range(HASHES // 2):
                flags[(word * np.uint64(64) + ((x >> np.uint64(6 * i)) & np.uint64(63))).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes(), size


def _places(keys: np.ndarray, level: int, words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Twice: one of so many words of 64 bits, and a number of which each 6 low bits name a bit in it. Half of the hashes meet in a word, so that a probe reads two words."""
    x = tk.mix(keys, level)
    yield ((x >> np.uint64(32)) * words) >> np.uint64(32), x
    with np.errstate(over="ignore"):
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    yield ((y >> np.uint64(32)) * words) >> np.uint64(32), y >> np.uint64(13)


def _merged(bits: int):
    """Reduce side: one row for each block, with its filters and exact word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                held.setdefault(batch.column(0)[i].as_py(), []).append([np.frombuffer(batch.column(c)[i].as_py(), (np.uint64, np.uint32)[c % 2 == 0]) for c in range(1, 5)])
        for block, parts in held.items():
            k1, c1 = tk.tallied(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            k2, c2 = tk.tallied(np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]))
            (f1, m1), (f2, m2) = members(k1, c1, WORD_LEVELS, bits), members(k2, c2, PAIR_LEVELS, bits)
            values = [block, len(k1), int(c1.sum()), len(k2), m1, m2, f1, f2, k1.tobytes(), c1.tobytes()]
            yield pa.RecordBatch.from_pylist([dict(zip(_MODEL.names, values, strict=True))], _MODEL)

    return run


_MODEL = pa.schema([("block", pa.int32()), ("n_words", pa.int64()), ("total", pa.int64()), ("n_pairs", pa.int64()), ("word_bits", pa.int64()), ("pair_bits", pa.int64()), ("word_filter", pa.binary()), ("pair_filter", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_MODEL_DDL = "block int, n_words long, total long, n_pairs long, word_bits long, pair_bits long, word_filter binary, pair_filter binary, words binary, counts binary"


class Filter:
    """Bit arrays of consecutive hash blocks. Reads the quantised count of a key; keys of other blocks count 0."""

    def __init__(self, blocks: int, levels: np.ndarray, room: int):
        """room: bytes of all blocks together."""
        self.blocks, self.levels = blocks, levels
        self.size, self.base, self.used = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64), 0
        self.bits, self.value = np.zeros(max(1, room // 8 + blocks), np.uint64), _middle(levels)

    def add(self, block: int, size: int, data: bytes) -> None:
        part = np.frombuffer(data, np.uint64)
        self.size[block], self.base[block] = size // 64, self.used
        self.bits[self.used : self.used + len(part)] = part
        self.used += len(part)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return self.value[self.levels_of(keys)]

    def levels_of(self, keys: np.ndarray) -> np.ndarray:
        block = tk.blocks_of(keys, self.blocks)
        level = np.zeros(len(keys), np.int64)
        at = np.flatnonzero(self.size[block])
        keys, size, base = keys[at], self.size[block[at]], self.base[block[at]]
        j = 0
        while len(at) and j < len(self.levels):
            j += 1
            alive = np.ones(len(at), bool)
            for word, x in _places(keys, j, size):
                v = self.bits[(word + base).astype(np.int64)]
                for i in range(HASHES // 2):
                    alive &= ((v >> ((x >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1)).astype(bool)
            at, keys, size, base = at[alive], keys[alive], size[alive], base[alive]
            level[at] = j
        return level


def _leveller(shared):
    """Writes beside each text a byte for each token: its word's level, as far as the words' blocks are in the filter or were in an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        for batch in batches:
            known, ends = tk.column(batch, "levels")
            for lo, hi, d, o in tk.chunks(*tk.column(batch, "text"), 2 * tk.CHUNK):
                token, _, count = sequence(d, o)
                word, code = np.unique(token, return_inverse=True)
                level = one.levels_of(word).astype(np.uint8)[code]
                if len(known):
                    level = np.maximum(level, known[ends[lo] : ends[hi]])
                bounds = np.r_[0, np.cumsum(count)].astype(np.int32)
                levels = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(bounds), pa.py_buffer(level)])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(4)), levels], names=["id", "held_out", "key", "text", "levels"])

    return run


def _scorer(model, smoothing: float, id_type):
    """Scores texts against one part of the model: tokens whose pair, for the base score whose word, lies in its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        one, two = m["one"], m["two"]
        low, high, blocks = m["low"], m["high"], m["blocks"]
        scale, middle = m["total"] + 0.5 * (m["n_words"] + 1), _middle(WORD_LEVELS)
        for batch in batches:
            levels, ends = (None, None) if one else tk.column(batch, "levels")
            for lo, hi, d, o in tk.chunks(*tk.column(batch, "text"), 2 * tk.CHUNK):
                token, before, count = sequence(d, o)
                text = np.repeat(np.arange(hi - lo), count)
                word, code = np.unique(token, return_inverse=True)
                at = np.minimum(np.searchsorted(m["words"], word), max(0, len(m["words"]) - 1))
                exact = np.where(m["words"][at] == word, m["counts"][at], 0) if len(m["words"]) else np.zeros(len(word), np.int64)
                block = tk.blocks_of(word, blocks)
                here = ((block >= low) & (block < high))[code]
                base = np.bincount(text, weights=np.where(here, np.log10((exact + 0.5) / scale)[code], 0), minlength=hi - lo)
                known = np.bincount(text, weights=here & (exact > 0)[code], minlength=hi - lo).astype(np.int64)
                rough = one.counts(word)[code] if one else middle[levels[ends[lo] : ends[hi]]]
                context = np.where(before == BEGIN, m["texts"], np.r_[0.0, rough[:-1]])
                pair = pairs(before, token)
                place = tk.blocks_of(pair, blocks)
                mine = np.flatnonzero((place >= low) & (place < high))
                pair, of = np.unique(pair[mine], return_inverse=True)
                rough, context = rough[mine], context[mine]
                together = np.minimum(two.counts(pair)[of], np.minimum(context, rough))
                p = (together + smoothing * ((rough + 0.5) / scale)) / (context + smoothing)
                score = np.bincount(text[mine], weights=np.log10(p), minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(count.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)], names=["id", "held_out", "key", "n_tokens", "n_known", "base_score", "score"])

    return run


def fit(docs: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The model of all rows as a written table, a row for each hash block; bits: of the filter for each member."""
    texts = docs.select(F.col(text_col).alias("text"))
    room = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 << max(6, (room // BLOCK_BYTES).bit_length())
    summed = texts.mapInArrow(_tallies(blocks, partition_keys(docs.sparkSession, blocks)), "block int, k1 binary, c1 binary, k2 binary, c2 binary, key int")
    return written(summed.repartition(blocks, "key").mapInArrow(_merged(bits), _MODEL_DDL), f"model{blocks}")


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """An integer for each of n partitions that hashing sends there, so that no task gets several blocks."""
    found: dict[int, int] = {}
    begin = 0
    while len(found) < n:
        k = F.col("id").cast("int")
        rows = spark.range(begin, begin + 16 * n).groupBy(F.pmod(F.hash(k), F.lit(n)).alias("part")).agg(F.min(k).alias("key")).collect()
        found = {r.part: r.key for r in rows} | found
        begin += 16 * n
    return [found[i] for i in range(n)]


def _word_filter(model: DataFrame, low: int, high: int, blocks: int) -> Filter:
    """The single words of the blocks from low to high; a block at a time on the driver."""
    part = model.where(f"block >= {low} AND block < {high}")
    one = Filter(blocks, WORD_LEVELS, (part.agg(F.sum("word_bits")).first()[0] or 0) // 8)
    for r in part.select("block", "word_bits", "word_filter").toLocalIterator():
        one.add(r.block, r.word_bits, r.word_filter)
    return one


def _levelled(rows: DataFrame, model: DataFrame, blocks: int, passes: int) -> DataFrame:
    """rows with the levels of their tokens, from as many parts of the word filter; a pass's table goes when the next is written."""
    out, held = rows.withColumn("levels", F.lit(b"")), []
    for i in range(passes):
        shared = rows.sparkSession.sparkContext.broadcast(_word_filter(model, i * blocks // passes, (i + 1) * blocks // passes, blocks))
        with scope() as made:
            out = written(out.mapInArrow(_leveller(shared), out.schema), "levels")
        shared.destroy()
        release(held)
        held = made
    return out


def _part(model: DataFrame, one: Filter | None, low: int, high: int, blocks: int) -> dict:
    """The blocks from low to high for a broadcast, filled in place so that the driver holds them once."""
    part = model.where(f"block >= {low} AND block < {high}")
    room = part.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pair_bits", "n_words"))).first()
    two = Filter(blocks, PAIR_LEVELS, room.pair_bits // 8)
    words, counts, n = np.zeros(room.n_words, np.uint64), np.zeros(room.n_words, np.int64), 0
    for r in part.select("block", "pair_bits", "pair_filter", "words", "counts").orderBy("block").toLocalIterator():
        two.add(r.block, r.pair_bits, r.pair_filter)
        k = np.frombuffer(r.words, np.uint64)
        words[n : n + len(k)], counts[n : n + len(k)] = k, np.frombuffer(r.counts, np.int64)
        n += len(k)
    return {"one": one, "two": two, "low": low, "high": high, "blocks": blocks, "words": words, "counts": counts}


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", smoothing: float = 50.0, broadcast_mb: float = 128, bits: int = BITS) -> DataFrame:
    """Scores all rows with a model of those where held_out is not true: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = rows.where("NOT held_out")
    model = fit(training, bits=bits)
    sums = model.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "total", "word_bits", "pair_bits")), F.count("*").alias("blocks")).first()
    blocks = max(1, sums.blocks)
    total, n_words = sums.total, sums.n_words
    texts = training.count()
    limit = int(broadcast_mb * (1 << 20))
    heavy, room = sums.pair_bits // 8 + 16 * n_words, limit - limit // 4
    if sums.word_bits // 8 <= limit // 4:
        one = _word_filter(model, 0, blocks, blocks)
    else:
        one, rows = None, _levelled(rows, model, blocks, min(blocks, -(-(sums.word_bits // 8) // room)))
    passes = min(blocks, -(-heavy // room) or 1)
    schema = f"id {kind}, held_out boolean, key long, n_tokens long, n_known long, base_score double, score double"
    found = []
    for i in range(passes):
        low, high = i * blocks // passes, (i + 1) * blocks // passes
        shared = spark.sparkContext.broadcast(_part(model, one, low, high, blocks) | {"total": total, "n_words": n_words, "texts": float(texts)})
        scored = rows.mapInArrow(_scorer(shared, smoothing, kind), schema)
        if passes == 1:
            out = scored
        else:
            found.append(written(scored, "scores"))
            shared.destroy()
        del shared, scored
    if passes > 1:
        union = found[0].withColumn("pass", F.lit(0))
        for i, x in enumerate(found[1:], 1):
            union = union.unionByName(x.withColumn("pass", F.lit(i)))
        same = union.groupBy("id", "held_out", "key").agg((F.count("*") / passes).cast("int").alias("copies"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("n_known", "base_score", "score")))
        each = same.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        out = each.select("id", "held_out", "n_tokens", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), *((F.col(c) / F.col("copies")).alias(c) for c in ("base_score", "score")))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")

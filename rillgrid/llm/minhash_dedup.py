"""Near-duplicates by circulant MinHash, banding and exact Jaccard (operator 4).

A text's set holds its distinct ``width``-word shingles (words lower-cased A-Z;
fewer words: the whole sequence as one; none: empty, linked with nothing). One
permutation, sigma, scatters a shingle over Z_2^32; a second one, pi, shifted
circularly by k gives coordinate k: min over the set of pi(sigma(x) + k).
32 bands of 4 coordinates miss a link at 0.75 with probability 5e-6.

Nothing is capped. Equal sets collapse into one class before banding. In each
bucket all members are first compared with one leader (linear in the bucket);
the links confirmed so are closed into components. After that a member is compared
only with members of other components, and members of a bucket's largest component
never with each other, so a bucket of near copies never emits its pairs. Jaccard
distance is a metric: distances to the leader rule out pairs, and so do low bits of
the coordinates (a pair at 0.75 falls below the limit once in 10^7). Members of an
unsettled bucket of more than ``LARGE`` are dealt anew by 96 bands of 7 coordinates,
which texts that merely share a passage seldom survive. A band makes a row only where
another member may hold it too, as counters of hashed bands tell (none is lost; of two bands
in one slot both stay). There the join itself compares the shingles, so that near misses of
a large group become no rows. A link is confirmed on full sets.

Rows with a null id are linked with nothing: their class and component are null, and they are kept.
Null and empty texts have no set. Repeated rows of one id get the same result. Where an id's rows
differ in text, the one of the least (set size, set hash) stands for the id in links; the others have
their own n_shingles, and the class of an equal set or else of the id. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rillgrid.llm import components, tokens as tk
from rillgrid.llm.scratch import KEYS_BYTES, bounded, small, written

BANDS, ROWS, WIDTH = 32, 4, 5
LARGE = 64  # members of an unsettled bucket that is dealt anew
FINE_BANDS, FINE_ROWS, FINE = 96, 7, 1024
SLOTS, BLOCKS = 1 << 24, 64  # counters of the finer bands, added up in blocks: a bit each, 2 MB, when shared
EQUAL = ["n_shingles", "h1", "h2"]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after another, n + 1 offsets)."""
    n = len(offsets) - 1
    w = tk.words(data, offsets)
    count = np.bincount(w.text, minlength=n)
    first = np.r_[0, np.cumsum(count)]
    with np.errstate(over="ignore"):
        if (m := len(w.hash) - width + 1) > 0:
            s = w.hash[:m].copy()
            for k in range(1, width):
                s = s * _ODD + w.hash[k : k + m]
            whole = w.text[:m] == w.text[width - 1 :]
            s, own = tk.mix(s[whole], width), w.text[:m][whole]
        else:
            s, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < width))
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] = extra[has] * _ODD + w.hash[first[short[has]] + k]
        extra = tk.mix(extra, 99)
    bounds = np.searchsorted(own, np.arange(n + 1))
    at = {int(t): e for t, e in zip(short, extra, strict=True)}
    parts, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        part = np.array([at[i]], np.uint64) if i in at else np.unique(s[bounds[i] : bounds[i + 1]])
        sizes[i] = len(part)
        parts.append(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(sizes)]


def _digest(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two hashes of each set; equal sets alone agree in all three."""
    size = np.diff(at)
    some = np.flatnonzero(size)
    h1, h2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    if len(some):
        with np.errstate(over="ignore"):
            h1[some] = np.add.reduceat(tk.mix(sets, 1), at[:-1][some])
            h2[some] = np.bitwise_xor.reduceat(tk.mix(sets, 2), at[:-1][some])
    return size, h1.view(np.int64), h2.view(np.int64)


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, of Z_2^32."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: np.ndarray, offsets: np.ndarray, coordinates: int, shift: int = 0) -> np.ndarray:
    """(texts, coordinates) of 32 bits, of the shifts from shift on. Texts without a set must be left out."""
    sigma = (tk.mix(sets, 7) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, coordinates), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(coordinates):
            out[:, k] = np.minimum.reduceat(_pi(sigma + np.uint32(shift + k)), offsets[:-1])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) of 64 bits, each with its band's number mixed in."""
    with np.errstate(over="ignore"):
        key = np.zeros((len(signature), bands), np.uint64)
        parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
        for r in range(rows):
            key = tk.mix(key * _ODD + parts[:, :, r] + np.uint64(r))
        return tk.mix(key + np.arange(bands, dtype=np.uint64)[None, :] * _ODD)


def packed(signature: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each coordinate, packed into longs: a row for each text."""
    per = 64 // bits
    parts = (signature & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(signature), -1, per)
    return np.bitwise_or.reduce(parts << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=2)


def lists_of(some: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list of longs for each place: the next row of values where some is true, else empty."""
    ends = np.r_[0, np.cumsum(some * values.shape[1])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel().view(np.int64)))


def _unlike(longs: int, bits: int, coordinates: int, share: float) -> str:
    """SQL: whether the packed bits la and lb of two texts agree too seldom for a similarity of share (5.3 standard deviations)."""
    agree = share + (1 - share) / 2**bits
    most = coordinates - int(coordinates * agree - 5.3 * (coordinates * agree * (1 - agree)) ** 0.5)
    spots = sum(1 << (i * bits) for i in range(64 // bits))
    mask = spots - (1 << 64) if spots >> 63 else spots

    def differ(i: int) -> str:
        x = f"(la[{i}] ^ lb[{i}])"
        return f"bit_count({x})" if bits == 1 else f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & {mask}L)"

    return f"({' + '.join(differ(i) for i in range(longs))}) > {most}"


def _fine(width: int):
    """For texts of unsettled large buckets: band keys and low bits of many more coordinates, and half of each shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, d, o in tk.chunks(*tk.column(batch, "text"), tk.CHUNK // 4):
                sets, at = shingles(d, o, width)
                some = np.diff(at) > 0
                keys, low = np.zeros((0, FINE_BANDS), np.uint64), np.zeros((0, FINE // 64), np.uint64)
                if some.any():
                    signature = signatures(sets, np.r_[at[:-1][some], len(sets)], FINE, 1 << 20)
                    keys, low = band_keys(signature[:, : FINE_BANDS * FINE_ROWS], FINE_BANDS, FINE_ROWS), packed(signature, 1)
                half = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((sets >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x) for x in _digest(sets, at)), lists_of(some, keys), lists_of(some, low), half], names=["id", *EQUAL, "bands", "low", "half"])
        pa.default_memory_pool().release_unused()

    return run


def _slots(batch: pa.RecordBatch) -> np.ndarray:
    return tk.blocks_of(batch.column(batch.schema.get_field_index("bands")).flatten().to_numpy().view(np.uint64), SLOTS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of slots: those that this task has seen, and whether once (1) or more often (2)."""
    total = np.zeros(SLOTS, np.uint8)
    for batch in batches:
        slot, n = np.unique(_slots(batch), return_counts=True)
        total[slot] = np.minimum(total[slot] + n, 2)
    for block, part in enumerate(np.split(total, BLOCKS)):
        if len(seen := np.flatnonzero(part).astype(np.int32)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([part[seen].tobytes()], pa.binary())], names=["block", "seen", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each slot of a block: whether it was seen more than once in all."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, seen, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total, slot = held.setdefault(block, np.zeros(SLOTS // BLOCKS, np.uint8)), np.frombuffer(seen, np.int32)
            total[slot] = np.minimum(total[slot] + np.frombuffer(counts, np.uint8), 2)
    for block, total in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], names=["block", "bits"])


def _met(shared):
    """id and those of its bands whose slot was seen more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, slot = batch.column(1), _slots(batch)
            kept = (shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
            at = bands.offsets.to_numpy() - bands.offsets[0].as_py()
            ends = np.r_[0, np.cumsum(kept, dtype=np.int64)][at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), bands.flatten().filter(pa.array(kept.astype(bool))))], names=["id", "bands"])

    return run


def _meeting(texts: DataFrame) -> DataFrame:
    """(id, bands) of texts (id, bands), without the bands that no other text can hold: the driver reads one bit for each slot."""
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in texts.select("bands").mapInArrow(_counts, "block int, seen binary, counts binary").repartition(BLOCKS, "block").mapInArrow(_added, "block int, bits binary").collect():
        bits[r.block * (SLOTS // BLOCKS // 8) :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    return texts.mapInArrow(_met(shared), f"id {dict(texts.dtypes)['id']}, bands array<long>")


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, d, o in tk.chunks(*tk.column(batch, "text")):
                sets, at = shingles(d, o, width)
                size, h1, h2 = _digest(sets, at)
                some = np.flatnonzero(size)
                keys, low = np.zeros((0, bands), np.uint64), np.zeros((0, bands * rows // 16), np.uint64)
                if len(some):
                    starts = at[:-1][some]
                    signature = signatures(sets, np.r_[starts, len(sets)], bands * rows)
                    keys, low = band_keys(signature, bands, rows), packed(signature, 4)
                lists, lows = lists_of(size > 0, keys), lists_of(size > 0, low)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(h1), pa.array(h2), lists, lows], names=["id", "n_shingles", "h1", "h2", "bands", "low"])
        pa.default_memory_pool().release_unused()

    return run


def _sets(width: int):
    """id, digest and shingles of each text, and what columns come after id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, d, o in tk.chunks(*tk.column(batch, "text")):
                sets, at = shingles(d, o, width)
                values = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(sets.view(np.uint8) if len(sets) else np.zeros(1, np.uint8))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x) for x in _digest(sets, at)), values.cast(pa.binary()), *(c.slice(lo, hi - lo) for c in batch.columns[2:])], names=["id", *EQUAL, "members", *batch.schema.names[2:]])
        pa.default_memory_pool().release_unused()

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, and their intersection and union, from the sets of both."""
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        both, union = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        last, left = None, None
        for i in range(len(a)):
            key = a[i].as_py()
            if key != last:
                last, left = key, np.frombuffer(x[i].as_buffer(), np.uint64)
            right = np.frombuffer(y[i].as_buffer(), np.uint64)
            place = np.searchsorted(left, right)
            both[i] = np.count_nonzero(left[np.minimum(place, len(left) - 1)] == right)
            union[i] = len(left) + len(right) - both[i]
        yield pa.RecordBatch.from_arrays([a, b, pa.array(both), pa.array(union)], names=["a", "b", "both", "union"])
    pa.default_memory_pool().release_unused()  # the worker lives on and does other tasks


def _standing(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """One row of each id, of a text with a set. again: (id, s) of ids with several such rows, s the digest of the text that stands for the id; None without any. Only those ids' rows are shuffled."""
    rows = rows.where("n_shingles > 0")
    if again is None:
        return rows
    same = " AND ".join(f"s.{c} = {c}" for c in EQUAL)
    return rows.join(small(again), "id", "left_anti").unionByName(rows.join(small(again), "id").where(same).drop("s").dropDuplicates(["id"]))


def _distances(pairs: DataFrame, docs: DataFrame, again: DataFrame | None, width: int, name: str) -> DataFrame:
    """Written (a, b, both, union) of the pairs (a, b): sets are made only for texts that stand in a pair."""
    pairs = written(pairs, f"{name}-pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    named = docs.join(small(ids, KEYS_BYTES), "id", "left_semi")
    rows = written(named.mapInArrow(_sets(width), f"id {dict(docs.dtypes)['id']}, n_shingles long, h1 long, h2 long, members binary"), f"{name}-sets")
    sets = _standing(rows, again).select("id", "members")
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
    kind = dict(docs.dtypes)["id"]
    return written(joined.mapInArrow(_confirm, f"a {kind}, b {kind}, both long, `union` long"), f"{name}-found")


def _led(buckets: DataFrame, docs: DataFrame, again: DataFrame | None, width: int) -> DataFrame:
    """Written (a, b, both, union) of each leader a in buckets (id, leader) and member b. A member's leaders, one for each band at most, go with its text, so that sets meet in one shuffle."""
    kind = dict(docs.dtypes)["id"]
    met = written(buckets.groupBy("id").agg(F.collect_set(F.when(F.col("leader") != F.col("id"), F.col("leader"))).alias("leaders"), F.max(F.col("leader") == F.col("id")).alias("leads")), "led-pairs")
    named = docs.join(small(met, KEYS_BYTES), "id").select("id", "text", "leaders", "leads")
    rows = written(named.mapInArrow(_sets(width), f"id {kind}, n_shingles long, h1 long, h2 long, members binary, leaders array<{kind}>, leads boolean"), "led-sets")
    sets = _standing(rows, again)
    joined = sets.select(F.explode("leaders").alias("a"), F.col("id").alias("b"), F.col("members").alias("y")).join(sets.where("leads").select(F.col("id").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
    return written(joined.mapInArrow(_confirm, f"a {kind}, b {kind}, both long, `union` long"), "led-found")


def _unsettled(placed: DataFrame, name: str) -> DataFrame:
    """(band, members, major) of the buckets whose members lie in several components; major holds the most."""
    held = placed.groupBy("band", "c").agg(F.count("*").alias("n"))
    return written(held.groupBy("band").agg(F.sum("n").alias("members"), F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("major")).where("parts > 1").drop("parts"), name)


def _across(members: DataFrame, near: str, extra: str = "far") -> DataFrame:
    """(a, b), a < b, of one bucket and different components, where near holds. One of each pair is outside its bucket's largest component."""
    left = members.where("c != major").select("band", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("far").alias("fa"), F.col("low").alias("la"), F.col(extra).alias("ha"))
    right = members.select("band", F.col("id").alias("y"), F.col("c").alias("cy"), F.col("major").alias("m"), F.col("far").alias("fb"), F.col("low").alias("lb"), F.col(extra).alias("hb"))
    found = left.join(right, "band").where(f"cx != cy AND (cy = m OR x < y) AND {near}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@bounded
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (75, 100), width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id_col, n_shingles, class_id (smallest id with an equal set), component_id, kept: a row for each row.

    similarity: the least Jaccard similarity as a fraction of integers. Links hold between texts with
    ``den * intersection >= num * union``; component_id is the smallest id reachable over them.
    """
    num, den = similarity
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = written(source.mapInArrow(_sketch(width, bands, rows), f"id {kind}, n_shingles long, h1 long, h2 long, bands array<long>, low array<long>"), "sketches")
    known = sketches.where("n_shingles > 0 AND id IS NOT NULL")
    digest = F.struct(*EQUAL)
    again = written(known.groupBy("id").agg(F.min(digest).alias("s"), F.count("*").alias("rows")).where("rows > 1").select("id", "s"), "again")
    again = None if again.isEmpty() else again
    one = _standing(known, again)
    # Bands go with their class: one shuffle of them at any size, and no join that moves them again.
    classes = written(one.groupBy(*EQUAL).agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    copied = classes.where("copies > 1").select(*EQUAL, "class_id")
    member = sketches.join(copied, EQUAL, "left").withColumn("class_id", F.when(F.col("id").isNotNull(), F.col("class_id")))
    # Dealt by band once, for a bucket's leader and for its members.
    spread = classes.select(F.col("class_id").alias("id"), F.explode("bands").alias("band")).repartition("band")
    # One leader for all buckets of a group, so that its members are compared once, not once for each band.
    shared = spread.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1").drop("members")
    buckets = written(spread.join(shared, "band"), "buckets")
    led = _led(buckets, source, again, width)
    link = F.col("both") * den >= F.col("union") * num
    first = components.smallest_reachable(led.where(link).select("a", "b"))
    # What a leader has not settled: members of a bucket that lie in different components.
    far = (1 - F.col("both") / F.col("union")).alias("far")
    in_one = first.select("id", F.col("component").alias("c"))
    placed = written(
        buckets.join(small(led).select(F.col("a").alias("leader"), F.col("b").alias("id"), far), ["leader", "id"], "left").where("id != leader")
        .join(small(in_one), "id", "left").select("band", "id", F.coalesce("c", "id").alias("c"), "far"),
        "placed",
    )
    open_ = written(placed.join(small(_unsettled(placed, "mixed")), "band"), "open")
    of_open = written(open_.groupBy("id").agg(F.first("c").alias("c"), F.max(F.col("members") <= LARGE).alias("few"), F.max(F.col("members") > LARGE).alias("many")), "open-ids")
    lows = one.join(small(of_open.where("few").select("id")), "id", "left_semi").select("id", "low")
    few = written(open_.where(f"members <= {LARGE}").join(lows, "id"), "few")
    near = f"NOT {_unlike(bands * rows // 16, 4, bands * rows, num / den)} AND abs(fa - fb) <= {1 - num / den + 1e-9}"
    rest = _across(few, near)
    many = written(of_open.where("many").select("id", "c"), "many")
    if not many.isEmpty():
        chosen = source.join(small(many.select("id"), KEYS_BYTES), "id", "left_semi")
        fine = written(chosen.mapInArrow(_fine(width), f"id {kind}, n_shingles long, h1 long, h2 long, bands array<long>, low array<long>, half array<int>"), "fine")
        fine = _standing(fine, again).select("id", "bands", "low", "half")
        dealt = written(small(many).join(_meeting(fine.select("id", "bands")), "id").select("id", "c", F.explode("bands").alias("band")), "dealt")
        left = written(dealt.join(small(_unsettled(dealt, "fine-mixed")), "band"), "fine-open").join(fine.select("id", "low", "half"), "id")
        alike = f"size(array_intersect(ha, hb)) * {num + den} >= {num} * (size(ha) + size(hb)) - {num + den}"  # one collision of halves is allowed for
        far_rest = _across(left.withColumn("far", F.lit(0.0)), f"NOT {_unlike(FINE // 64, 1, FINE, num / den)} AND {alike}", "half")
        rest = rest.unionByName(far_rest)
    late = _distances(rest.distinct(), source, again, width, "late")
    links = first.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(late.where(link).select("a", "b"))
    final = components.smallest_reachable(links).where("id != component")
    return (
        member.select("id", "n_shingles", F.coalesce("class_id", "id").alias("class_id"))
        .join(final.select(F.col("id").alias("class_id"), F.col("component")), "class_id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, with all of its columns: the one of the smallest id. Rows without id stay."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)

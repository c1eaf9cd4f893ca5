"""Fill-in-middle transformation over an index of distinct texts (operator 13).

Where the code points of a text begin is an increasing list of byte places, kept as Elias-Fano:
the upper parts as unary gaps in a bit string, the lower bits packed; 2 bits a character and
those of the lower parts. The k-th place is a select in the bit string. The index holds one such
list for each distinct text that documents share, in a table of the shared folder.

Texts are grouped by (SHA-256, bytes); the group's text itself is in the index, and a document
takes a list only if its text equals the group's. Documents join their group's list and cut at
its selected places. A text that no other document has is its own group: it needs no row of the
index, and its list is made where the document is read. Whether a text may be shared is told by
a bitmap of 2^26 hashes with a bit for each repeated digest, at most 8 MB, which grows no further:
a bit that two digests share sends an unshared text through the index, with the same result.

Nulls: a null text is empty, a null id is seeded as an empty one. Repeated rows give repeated
results. Empty texts are plain. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rillgrid.llm.scratch import written

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100: seeds from which a text stays plain, and below which the suffix goes first
SLOTS = 1 << 26
BITMAP = 32768  # bits of one row of the bitmap
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


# --- Elias-Fano lists -----------------------------------------------------------------------------


def encode(places: np.ndarray, universe: int) -> bytes:
    """An increasing list of places below universe: number, lower bits' width, lower bits, upper bits."""
    n = len(places)
    width = max(0, (universe // n).bit_length() - 1) if n else 0
    low = (places[:, None] >> np.arange(width)) & 1
    high = np.zeros(n + (universe >> width) + 1, np.uint8)
    high[(places >> width) + np.arange(n)] = 1
    return np.array([n, width], np.int64).tobytes() + np.packbits(low.astype(np.uint8), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def length(held: bytes) -> int:
    return int(np.frombuffer(held, np.int64, 1)[0])


def select(held: bytes, ks: list[int]) -> list[int]:
    """The places of some numbers, from 0."""
    n, width = np.frombuffer(held, np.int64, 2).tolist()
    low_bytes = (n * width + 7) // 8
    high = np.frombuffer(held, np.uint8, offset=16 + low_bytes)
    before = np.cumsum(_ONES[high])
    out = []
    for k in ks:
        byte = int(np.searchsorted(before, k + 1))
        rest = k - (int(before[byte - 1]) if byte else 0)
        bit = [b for b in range(8) if high[byte] >> b & 1][rest]
        low = 0
        for b in range(width):
            at = k * width + b
            low |= (held[16 + at // 8] >> at % 8 & 1) << b
        out.append((8 * byte + bit - k) << width | low)
    return out


def boundaries(text: bytes) -> bytes:
    """The list of the places at which code points of UTF-8 text begin."""
    data = np.frombuffer(text, np.uint8)
    return encode(np.flatnonzero((data & 0xC0) != 0x80), len(data))


# --- cuts -----------------------------------------------------------------------------------------


def seeds(id_: Column, seed: int = 1) -> Column:
    """Four unsigned integers from the SHA-256 of seed:id."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def transformed(text: bytes, held: bytes, h: list[int]) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, output."""
    n = length(held)
    if not text or h[2] % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    inner = iter(select(held, [k for k in (low, high) if k < n]))
    a, b = (next(inner) if k < n else len(text) for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM_BELOW:
        return "spm", low, high - low, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", low, high - low, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restored(output: bytes, form: str) -> bytes:
    """The text, from output and form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, end = output.index(second), output.index(MIDDLE)
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


# --- on tables ------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text as bytes, digest, slot of the bitmap."""
    digest = F.concat(F.unhex(F.sha2("text", 256)), F.unhex(F.lpad(F.hex(F.octet_length("text").cast("long")), 8, "0")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.withColumn("digest", digest).withColumn("slot", F.xxhash64("digest").bitwiseAND(SLOTS - 1))


def _shared_slots(keyed: DataFrame) -> DataFrame:
    """bucket, bits: the slots of the digests that several rows have, at most SLOTS bits in rows of BITMAP; written, so that it is made once."""
    repeated = keyed.select("digest", "slot").groupBy("digest", "slot").agg(F.count("*").alias("n")).where("n > 1")
    return written(repeated.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")), "shared")


def _with_flag(keyed: DataFrame, slots: DataFrame) -> DataFrame:
    """keyed with maybe: whether the digest's bit is set. The broadcast is bounded by SLOTS / 8 bytes."""
    joined = keyed.join(F.broadcast(slots), F.bitmap_bucket_number("slot") == F.col("bucket"), "left")
    bit = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(slot) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bitmap_bit_position(slot) % 8 as int))")
    return joined.withColumn("maybe", F.coalesce(bit != 0, F.lit(False))).select("id", "text", "digest", "maybe")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, texts = batch.columns
        yield pa.RecordBatch.from_arrays([digests, texts, pa.array([boundaries(t.as_py()) for t in texts], pa.binary())], names=["digest", "same", "held"])


def index(maybe: DataFrame) -> DataFrame:
    """digest, same (the group's text), held (its list): a row for each digest, written to the shared folder."""
    texts = maybe.groupBy("digest").agg(F.min("text").alias("text"))
    return written(texts.mapInArrow(_listed, "digest binary, same binary, held binary"), "boundaries")


def _cuts(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, drawn, lists = batch.columns
            rows = []
            for text, h, held in zip(texts, drawn.to_pylist(), lists, strict=True):
                text, held = text.as_py(), held.as_py()
                held = boundaries(text) if held is None else held
                form, prefix, middle, output = transformed(text, held, h)
                rows.append((length(held), form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_name, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return run


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, drawn, lists = batch.columns
        made = [transformed(t := text.as_py(), boundaries(t) if not held.is_valid else held.as_py(), h) for text, h, held in zip(texts, drawn.to_pylist(), lists, strict=True)]
        yield pa.RecordBatch.from_arrays([ids, pa.array([m[0] for m in made], pa.string()), pa.array([m[3].decode() for m in made], pa.string())], names=["id", "form", "output"])


def _prepared(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """id, text, h, held of every document; held is null where the text is its document's alone, or only shares its digest."""
    keyed = _keyed(docs, id_col, text_col)
    flagged = _with_flag(keyed, _shared_slots(keyed))
    lone = flagged.where("NOT maybe").select("id", "text", seeds(F.col("id"), seed).alias("h"), F.lit(None).cast("binary").alias("held"))
    shared = flagged.where("maybe").select("id", "text", "digest")
    found = shared.join(index(shared), "digest", "left")
    return lone.unionByName(found.select("id", "text", seeds(F.col("id"), seed).alias("h"), F.when(F.col("text") == F.col("same"), F.col("held")).alias("held")))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """id_col, form and output of every document: the texts that a model is trained on."""
    kind = dict(docs.dtypes)[id_col]
    return _prepared(docs, id_col, text_col, seed).mapInArrow(_outputs, f"id {kind}, form string, output string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars and the hashes of each document's output and of the text rebuilt from it."""
    kind = dict(docs.dtypes)[id_col]
    return _prepared(docs, id_col, text_col, seed).mapInArrow(_cuts(id_col), f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")

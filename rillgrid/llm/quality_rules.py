"""Quality rules by suffix-array repetition (operator 6).

Words of a text are the runs ``[^\\x20\\x09-\\x0D]+``, compared as written. A
suffix array over them (prefix doubling over many texts at once; a text's number
leads each key, so no match crosses texts) gives the longest common prefixes of
neighbouring suffixes. A suffix's larger neighbour prefix is the longest repeat
that starts there: every LCP interval of at least ``min_repeat`` words is a
maximal repeated substring, and its occurrences are the spans united. A text goes
if the spans cover more than ``max_covered`` of its words or one repeat is longer
than ``max_longest`` words, besides the base rules of length and 3-word windows. The
limit of the spans lies below that of the windows, so a text of which a third is
a few long repeats goes by the method alone.

Null and empty texts have no word and fail the length rule. Repeated rows and
ties get equal results, an empty table gives an empty one. Columns that a caller
has under other names pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillgrid.llm import tokens as tk

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
DEFAULTS = {"min_words": 50, "max_window_share": 50, "min_repeat": 5, "max_covered": 0.3, "max_longest": 100}
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_STARTS = np.ones(256, bool)  # bytes that begin a code point
_STARTS[0x80:0xC0] = False


def suffix_repeats(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it on that its text holds at another place too.

    code: a number for each word, equal where words are; text: its text's number, ascending.
    """
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64)
    stop = np.searchsorted(text, text, "right")
    key = text * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.empty(n, np.int64)
    rank[order] = first[group]
    several = np.diff(np.r_[first, n])[group] > 1
    active, levels, step = order[several], [rank], 1
    while len(active):
        ahead = active + step
        inside = ahead < stop[active]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        key = rank[active] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key, old = active[by], key[by], rank[active[by]]
        place = np.arange(len(active))
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        outer = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        rank = rank.copy()
        rank[active] = old + first[group] - outer
        levels.append(rank)
        active = active[np.diff(np.r_[first, len(active)])[group] > 1]
        step *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    pair = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])
    a, b = array[pair], array[pair + 1]
    common = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < stop[a]) & (y < stop[b])
        same = ok & (levels[k][np.where(ok, x, 0)] == levels[k][np.where(ok, y, 0)])
        common += same * (1 << k)
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, a, common)
    np.maximum.at(reach, b, common)
    return reach


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the union of the spans [at, at + length) covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def measure(data: np.ndarray, offsets: np.ndarray, rules: dict) -> dict[str, np.ndarray]:
    """The measures of some whole texts, given as bytes and offsets."""
    n = len(offsets) - 1
    w = tk.words(data, offsets, lower=False)
    _, code = np.unique(w.hash, return_inverse=True)
    reach = suffix_repeats(code, w.text)
    places = len(reach)
    def per(flags):
        return np.bincount(w.text, weights=flags, minlength=n).astype(np.int64)
    three = np.flatnonzero(reach >= 3)
    far = np.flatnonzero(reach >= rules["min_repeat"])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.text, reach)
    sums = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offsets])
    raw = data.tobytes()
    out = {
        "n_words": np.bincount(w.text, minlength=n).astype(np.int64),
        "word_chars": sums(_STARTS[data] & ~tk.SPACES[data]),
        "n_symbols": sums(_SYMBOLS[data]),
        "n_dup_lines": np.array([_dup_lines(raw[offsets[i] : offsets[i + 1]]) for i in range(n)], np.int64),
        "n_repeat_words": per(covered(three, np.full(len(three), 3), places)),
        "n_covered_words": per(covered(far, reach[far], places)),
        "longest_repeat": longest,
    }
    few = out["n_words"] < rules["min_words"]
    out["base_failed"] = few | (100 * out["n_repeat_words"] > rules["max_window_share"] * out["n_words"])
    spread = out["n_covered_words"] > rules["max_covered"] * out["n_words"]
    out["kept"] = ~(out["base_failed"] | spread | (longest > rules["max_longest"]))
    return out


def _measured(batch: pa.RecordBatch, text_col: str, rules: dict) -> dict[str, np.ndarray]:
    data, offsets = tk.column(batch, text_col)
    parts = [measure(d, o, rules) for _, _, d, o in tk.chunks(data, offsets)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """id_col and FIELDS for every row: counts of the base rules, the repetition measures and the verdict."""
    rules = DEFAULTS | rules
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _measured(batch, text_col, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in found.values())], names=[id_col, *found])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")


def keep_good(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The rows whose text passes, with all of their columns."""
    rules = DEFAULTS | rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_measured(batch, text_col, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)

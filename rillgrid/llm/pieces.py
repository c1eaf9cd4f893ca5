"""SentencePiece encoding and decoding by shared-prefix Viterbi (operator 2).

A vocabulary file gives pieces and scores; nothing is trained. A text gets a mark in
front and spaces become marks. For a unigram file the segmentation of the largest score
sum is found. For a BPE file, whose ids are those of merging by score, the forward state
of a prefix is the last piece of its encoding instead of a score: a piece may follow if
merging both alone leaves them as they are, and exactly one does, so one forward pass
gives the ids that merging gives. No piece holds a mark after
another character (checked on loading), so a text falls into marked words, a run
of marks and the characters up to the next, that are solved apart; for a BPE file so is the punctuation at a word's end
that no piece joins to what is before. The distinct words
of some texts are sorted, which makes neighbours share prefixes: a walk along them is a
depth-first walk of their trie, and the forward scores of the common prefix stay. Ties
go to the longer last piece. A character that no piece begins with becomes its bytes'
pieces, or the unknown piece without those; the mark's own character in a text
does too, so that decoding an encoded text always gives the text again.

Null and empty texts have no pieces; null decodes to the empty text. Texts of any length
are whole: memory follows the longest text. Repeated rows give equal results, empty tables
empty ones. Words already solved are kept for later batches of a task, ``CACHE`` at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rillgrid.llm import tokens as tk

MARK = "▁"
OWN = " " + MARK  # in words these stand for other characters
CACHE = 400_000
FORBIDDEN = -1e30


class Vocabulary:
    """Pieces by text, their scores, the byte pieces and how ids decode."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], special: Sequence[bool], byte_ids: Sequence[int] | None, unknown: int = 0, merges: bool = False):
        self.ids = {p: i for i, (p, s) in enumerate(zip(pieces, special, strict=True)) if not s}
        self.scores = [float(x) for x in scores]
        self.merges, self.apart = merges, {}
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}  # of pieces, by their last two characters
        self.byte_ids, self.unknown = list(byte_ids) if byte_ids else None, unknown
        self.penalty = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces that cross a word's end, as {crossing[0]!r}, are not supported")
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # neighbours inside a piece
        used = set("".join(self.ids))
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in used)
        self.words = re.compile(f"[{alone}]| +[^ {alone}]*|[^ {alone}]+" if alone else " +[^ ]*|[^ ]+")
        raw = [p.replace(MARK, " ").encode() if not s else b"" for p, s in zip(pieces, special, strict=True)]
        for value, i in enumerate(self.byte_ids or ()):
            raw[i] = bytes([value])
        self.at = np.r_[0, np.cumsum(np.array([len(x) for x in raw], np.int64))]
        self.at_or_none = np.r_[self.at, self.at[-1]]  # one more id, of no characters
        self.bytes = np.frombuffer(b"".join(raw) or b"\0", np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file, on the driver."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kind = proto.trainer_spec.model_type
        if kind not in (proto.trainer_spec.UNIGRAM, proto.trainer_spec.BPE):
            raise ValueError("only unigram and BPE files have pieces that this operator can find")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i in n if model.is_byte(i)}
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in n]
        return cls([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], special, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None, model.unk_id(), kind == proto.trainer_spec.BPE)

    def merged(self, form: str) -> list[str]:
        """form by merging, the best-scored neighbours first, the left ones on ties."""
        parts = list(form)
        while True:
            top, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (top is None or self.scores[i] > top):
                    top, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, piece: str, before: str) -> bool:
        """Whether merging leaves piece as it is after before ('' for a text's begin or an unknown character)."""
        known = self.apart.get((before, piece))
        if known is None:
            if len(self.apart) > 4 * CACHE:
                self.apart.clear()
            known = self.apart[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def cut(self, word: str) -> int:
        """Where the punctuation at word's end begins, if no piece joins it to what is before; else 0. Merging never crosses that place, so both sides have the ids that they have alone."""
        at = len(word.rstrip(punctuation))
        return at if self.merges and 0 < at < len(word) and word[at - 1] not in OWN and word[at - 1 : at + 1] not in self.joined else 0

    def solve(self, words: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each of the sorted distinct words, spaces for marks."""
        if self.merges:
            yield from self._solve_merges(words)
            return
        states: list = [(0.0, 0, "")]  # of each prefix: score, begin of the last piece, the piece
        last = ""
        for word in words:
            n, most, keep = len(word), min(len(word), len(last)), 0
            while keep < most and word[keep] == last[keep]:
                keep += 1
            del states[keep + 1 :]
            form = word.replace(MARK, "\0").replace(" ", MARK)
            for end in range(keep + 1, n + 1):
                states.append(self._best_score(form, end, states))
            last, out, end = word, [], n
            while end:
                _, start, piece = states[end]
                out.extend((self.ids[piece],) if piece else self._unknown(word[end - 1]))
                end = start
            yield out[::-1]

    def _unknown(self, character: str) -> list[int]:
        """The ids of a character that no piece begins with, the last first."""
        return [self.byte_ids[b] for b in reversed(character.encode())] if self.byte_ids else [self.unknown]

    def _solve_merges(self, words: Sequence[str]) -> Iterator[list[int]]:
        """The same by merging. Most of the time goes here, so the step over a character stands in the loop."""
        ids, apart, lengths = self.ids, self.apart, self.lengths.get
        pieces = [""]  # of each prefix: its last piece, empty for an unknown character
        last, kept = "", 0
        for word in words:
            n, most, keep = len(word), min(len(word), kept), 0
            while keep < most and word[keep] == last[keep]:
                keep += 1
            del pieces[keep + 1 :]
            form = word.replace(MARK, "\0").replace(" ", MARK) if MARK in word else word.replace(" ", MARK)
            for end in range(keep + 1, n + 1):
                for size in lengths(form[end - 2 : end], ()) if end > 1 else ():
                    if size <= end and (piece := form[end - size : end]) in ids:
                        before = pieces[end - size]
                        follows = apart.get((before, piece))
                        if follows or follows is None and self.may_follow(piece, before):
                            break
                else:
                    piece = self._last_character(form[:end], pieces[end - 1])
                pieces.append(piece)
            last, kept, out, end = word, n, [], n
            while end:
                if piece := pieces[end]:
                    out.append(ids[piece])
                    end -= len(piece)
                else:
                    out.extend(self._unknown(word[end - 1]))
                    end -= 1
            out.reverse()
            yield out

    def _best_score(self, form: str, end: int, states: list) -> tuple:
        """The best last piece of the prefix up to end; no piece for an unknown character."""
        ids, scores = self.ids, self.scores
        top, start_at, last = FORBIDDEN, end - 1, ""
        for size in (*self.lengths.get(form[max(0, end - 2) : end], ()), 1):
            start = end - size
            piece = form[start:end] if start >= 0 else None
            i = ids.get(piece)
            if i is not None and states[start][0] + scores[i] > top:
                top, start_at, last = states[start][0] + scores[i], start, piece
        if form[end - 1] not in ids and states[end - 1][0] + self.penalty > top:
            return states[end - 1][0] + self.penalty, end - 1, ""
        return top, start_at, last

    def _last_character(self, prefix: str, before: str) -> str:
        """The last piece of a prefix, after before, that ends with no piece of several characters; empty for an unknown character."""
        piece = prefix[-1]
        if piece not in self.ids:
            return ""
        return piece if self.may_follow(piece, before) else self.merged(prefix)[-1]  # a piece that no two others make stood in the way: by the definition


class Encoder:
    """Encodes texts, keeping solved words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; n + 1 offsets)."""
        if len(self.number) > CACHE:
            self.clear()
        find = self.vocabulary.words.findall
        split = [find(" " + t) if t else [] for t in texts]
        number = self.number
        new = set(chain.from_iterable(split)).difference(number)
        if new:
            cut = self.vocabulary.cut
            halves = {w: (w[:at], w[at:]) for w in new if (at := cut(w))}
            whole = sorted(new.difference(halves).union(chain.from_iterable(halves.values())).difference(number))
            solved = list(self.vocabulary.solve(whole))
            self._add(whole, np.fromiter(chain.from_iterable(solved), np.int32), np.array([len(s) for s in solved], np.int64))
            codes = np.fromiter(map(number.__getitem__, chain.from_iterable(halves.values())), np.int64)
            flat, length = gathered(self.flat, self.at, codes)
            self._add(list(halves), flat, length.reshape(-1, 2).sum(1))
        codes = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        flat, length = gathered(self.flat, self.at, codes)
        per_text = np.r_[0, np.cumsum(np.array([len(ws) for ws in split], np.int64))]
        return flat, np.r_[0, np.cumsum(length)][per_text]

    def _add(self, words: Sequence[str], ids: np.ndarray, length: np.ndarray) -> None:
        """Words and their ids, one after another."""
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.flat, self.at = np.r_[self.flat, ids], np.r_[self.at, self.at[-1] + np.cumsum(length)]


def gathered(flat: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at[c] : at[c + 1]] of all codes in turn, and their lengths."""
    length = at[codes + 1] - at[codes]
    shift = np.repeat(at[codes] - np.r_[0, np.cumsum(length)[:-1]] if len(codes) else codes, length)
    return flat[shift + np.arange(len(shift))], length


def decode(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): the pieces' bytes, without the space that encoding put in front."""
    data, length = gathered(vocabulary.bytes, vocabulary.at_or_none, ids.astype(np.int64))
    ends = np.r_[0, np.cumsum(length)][offsets]
    has = (ends[1:] > ends[:-1]) & (data[np.minimum(ends[:-1], max(0, len(data) - 1))] == 32 if len(data) else False)
    keep = np.ones(len(data), bool)
    keep[ends[:-1][has]] = False
    return data[keep], ends - np.r_[0, np.cumsum(has)]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids, n_pieces and round_trip (whether decoding the ids gives the text again) for each row."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for lo, hi, d, o in tk.chunks(*tk.column(batch, "text")):
                ids, at = encoder.encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                back, ends = decode(shared.value, ids, at)
                same = np.diff(ends) == np.diff(o)
                if not (same.all() and np.array_equal(back, d)):
                    same = np.array([back[ends[i] : ends[i + 1]].tobytes() == d[o[i] : o[i + 1]].tobytes() for i in range(hi - lo)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(np.diff(at)), pa.array(same)], names=["id", "ids", "n_pieces", "round_trip"])
        pa.default_memory_pool().release_unused()  # the worker lives on and does other tasks

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_pieces long, round_trip boolean").withColumnRenamed("id", id_col)


def decode_table(rows: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text for each row of ids. Ids that are null or that no piece has give no characters; nor do control pieces."""
    kind = dict(rows.dtypes)[id_col]
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            data, ends = decode(shared.value, np.where((ids >= 0) & (ids < len(shared.value.at) - 1), ids, len(shared.value.at) - 1), at)
            texts = [data[ends[i] : ends[i + 1]].tobytes().decode("utf-8", "replace") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)

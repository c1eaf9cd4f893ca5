"""Conversation structure repair by cost layers (operator 12).

A damaged conversation is a word over nine letters, one for each row: must be deleted (blank
or duplicate), or truncated or not with a role of initial s, u, a or another. The grammar
(s?(ua)+)? has four states. For every row and each increasing cost, a bitset holds the states
from which the rest can be made legal within that cost. The costs of the four states never lie
further apart than 12 (two insertions lead anywhere, and a system turn that stands too late
costs a deletion), so the layers of a row fit one word of 64 bits above a base cost: a long
conversation takes memory in proportion to its rows, not to rows times cost. The first layer
in which the start state is set is the cost. A walk from the start that takes the least letter
whose successor is set in the layer that remains gives the least of the cheapest audits.

Two shuffles. The first moves no text: identical rows meet as one with their number, and the
first turn of each (role, text) is an aggregate joined back, so neither copies nor a common
text gather in a task. The second sends each conversation's rows in order through one task
behind their audit; they are hashed as they pass (a SHA-256 has no parallel form) and not held.

Nulls: a role or text is one space, a null turn comes first and has no place in gaps, rows
with a null id are one conversation with a null id. Empty roles have no initial, cannot be
kept, and their pairs are illegal. Rows of one turn are ordered by role and the SHA-256 of
their text, so repeated rows stand together. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rillgrid.llm.scratch import written

START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after a system, user or assistant turn
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LAYERS = 16  # costs above a row's base that its word has room for; at least 13 are needed
SOLID = r"[^\x20\x09-\x0D]"
LEGAL = ("su", "ua", "au")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# --- cost layers ----------------------------------------------------------------------------------


def _layers(costs: list[int]) -> tuple[int, int]:
    """The least of the states' costs, and the word with bit 4 * d + q set where state q needs at most d more than it."""
    base = min(costs)
    return base, sum(1 << (4 * d + q) for q, c in enumerate(costs) for d in range(c - base, LAYERS))


def _cost(word: int, state: int) -> int:
    """The first layer of a word in which the state is set."""
    return next(d for d in range(LAYERS) if word >> (4 * d + state) & 1)


def _target(state: int) -> int:
    """Where a turn that is inserted or given a new role leads: an assistant turn after a user turn, else a user turn."""
    return ASSISTANT if state == USER else USER


def _inserted(costs: list[int]) -> list[int]:
    """Costs where turns may also be inserted before the rows that follow."""
    both = [*costs]
    for q in (USER, ASSISTANT, USER, START, SYSTEM):
        both[q] = min(both[q], INSERT + both[_target(q)])
    return both


@cache
def ended() -> tuple[int, int]:
    """Base and word behind the last row: nothing, or an assistant turn, may be the end."""
    far = 4 * INSERT
    return _layers(_inserted([0, far, far, 0]))


@cache
def before(letter: str, word: int) -> tuple[int, int]:
    """How much the base grows, and the word, in front of a row: x must go, s u a o are initials, capitals are truncated."""
    after = [_cost(word, q) for q in range(4)]
    costs = [DELETE + c for c in after]
    if letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        for q in range(4):
            costs[q] = min(costs[q], REROLE + more + after[_target(q)])
            to = MOVES.get(letter.lower(), {}).get(q)
            if to is not None:
                costs[q] = min(costs[q], more + after[to])
    return _layers(_inserted(costs))


@cache
def _step(letter: str, state: int, here: int, after: int, grown: int) -> tuple[str, int]:
    """The edit that comes first in ASCII order among those on a cheapest way, and the state that it leads to."""
    left = _cost(here, state) + grown
    if letter and left == DELETE + _cost(after, state):
        return "D", state
    if left == INSERT + _cost(here, _target(state)) + grown:
        return "I", _target(state)
    more = TRUNCATED if letter.isupper() else 0
    to = MOVES.get(letter.lower(), {}).get(state)
    if to is not None and left == more + _cost(after, to):
        return "K", to
    return "R", _target(state)


def repair(letters: str) -> tuple[int, str]:
    """Cost and least audit of a conversation that is given by its rows' letters."""
    base, word = ended()
    words, grown, total = np.empty(len(letters) + 1, np.uint64), np.empty(len(letters) + 1, np.int8), base
    words[-1], grown[-1] = word, 0
    for i in range(len(letters) - 1, -1, -1):
        more, word = before(letters[i], word)
        words[i], grown[i] = word, more
        total += more
    cost, i, state, audit = total + _cost(word, START), 0, START, []
    while i < len(letters) or _cost(int(words[i]), state):
        last = i == len(letters)
        edit, state = _step("" if last else letters[i], state, int(words[i]), 0 if last else int(words[i + 1]), int(grown[i]))
        audit.append(edit)
        i += edit != "I"
    return cost, "".join(audit)


# --- on tables ------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0, 1 or 2) of every row, by the crc32 of its id and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    out = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def lettered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, initial, fault (blank, truncated or neither), later (its role and text came in an earlier turn), copies: one row for all identical ones.

    Rows without copies remain as one without turn and role, so that their conversation is not lost.
    """
    blank = ~F.regexp_like("text", F.lit(SOLID))
    last = F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*\z", 1)
    there = F.col("copies") > 0
    flat = rows.select("conv_id", *(F.when(there, x).alias(n) for n, x in (("turn", F.col("turn")), ("role", F.col("role")), ("digest", F.sha2("text", 256)), ("fault", F.when(blank, "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")))), "copies")
    one = flat.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    order = lambda: F.struct(F.col("turn").isNotNull(), "turn")  # noqa: E731  nulls first
    first = one.where("fault <> 'blank'").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order()).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.when(F.col("fault") != "blank", F.col("digest")) == F.col("d"))
    return one.join(first, same, "left").select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "fault", F.coalesce(order() > F.col("first"), F.lit(False)).alias("later"), "copies")


def _ordered(rows: DataFrame, *first: Column) -> DataFrame:
    """A conversation's rows in one task and in order; first: what sorts before the turn."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest")


class _Told:
    """Counts and letters of one conversation while its rows pass."""

    def __init__(self) -> None:
        self.letters, self.turns, self.low, self.high, self.last = bytearray(), 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial, fault, later, copies) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.last = initial
        known = initial if initial in ("s", "u", "a") else "o"
        if fault == "blank":
            self.blank += copies
            self.letters += b"x" * copies
            return
        self.duplicate += copies - (not later)
        self.truncated += fault == "truncated" and not later
        self.letters += (b"x" if later else (known.upper() if fault else known).encode()) + b"x" * (copies - 1)

    def row(self, conv) -> tuple:
        cost, audit = repair(self.letters.decode())
        return conv, self.high - self.low + 1 - self.turns if self.turns else 0, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _by_conversation(batches: Iterator[pa.RecordBatch], new, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Feeds rows, sorted by their first column, to an object made for each conversation; yields the rows that they end with."""
    held, key, out = None, None, []
    for batch in batches:
        for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or conv != key:
                if held is not None:
                    out.append(held.row(key))
                held, key = new(), conv
            held.add(*rest)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out = []
    if held is not None:
        out.append(held.row(key))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, the counts, cost and audit of each conversation of lettered rows."""
    kind = dict(rows.dtypes)["conv_id"]
    fields = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
            yield from _by_conversation(_chained(batch, batches), _Told, schema)

    return _ordered(rows).select("conv_id", "turn", "initial", "fault", "later", "copies").mapInArrow(run, fields)


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class _Repaired:
    """The hash of one conversation's repaired rows while they pass behind their audit."""

    def __init__(self) -> None:
        self.hash, self.state, self.at, self.any, self.told = hashlib.sha256(), START, 0, False, None

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _made(self) -> str:
        self.state = _target(self.state)
        return "user" if self.state == USER else "assistant"

    def _inserts(self) -> None:
        while self.at < len(self.told[-1]) and self.told[-1][self.at] == "I":
            self._put(self._made(), "")
            self.at += 1

    def add(self, told, role, text, copies) -> None:
        if told is not None:
            self.told = tuple(told.values())
            return
        for _ in range(copies):
            self._inserts()
            edit = self.told[-1][self.at]
            self.at += 1
            if edit == "R":
                self._put(self._made(), text)
            elif edit == "K":
                self.state = MOVES[role[0]][self.state]
                self._put(role, text)

    def row(self, conv) -> tuple:
        self._inserts()
        return conv, *self.told, self.hash.hexdigest()


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """told with repaired_sha256, the hash of the rows that its audits make of damaged rows."""
    kind = dict(rows.dtypes)["conv_id"]
    names = [*COUNTS, "audit"]
    head = told.select("conv_id", F.struct(*names).alias("told"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    body = rows.where("copies > 0").select("conv_id", F.lit(None).cast(head.schema["told"].dataType).alias("told"), "turn", "role", F.sha2("text", 256).alias("digest"), "text", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            yield from _by_conversation(_chained(batch, batches), _Repaired, schema)

    fields = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return _ordered(head.unionByName(body), F.col("told").isNull()).select("conv_id", "told", "role", "text", "copies").mapInArrow(run, fields)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after its damage."""
    rows = damaged(conversations)
    return repaired(rows, written(audits(lettered(rows)), "audits"))

"""Toxicity, conversation repair and fill-in-middle against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rillgrid.llm import conversations, fill_middle, toxicity

# --- conversation repair --------------------------------------------------------------------------


def cheapest(letters):
    """Cost and least audit by a search over (cost, audit): every edit of every row, no layers."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(letters) and state in ("", "a"):
            return cost, audit
        moves = []
        if i < len(letters):
            x, more = letters[i].lower(), 5 * letters[i].isupper()
            moves.append((2, "D", i + 1, state))
            if x != "x":
                if state + x in ("s", "u", "su", "ua", "au"):
                    moves.append((more, "K", i + 1, x))
                moves.append((1 + more, "R", i + 1, "a" if state == "u" else "u"))
        moves.append((5, "I", i, "a" if state == "u" else "u"))
        for c, e, j, s in moves:
            heappush(heap, (cost + c, audit + e, j, s))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="xsuaoSUAO", max_size=14))
def test_layers_find_the_cheapest_and_least_audit(letters):
    assert conversations.repair(letters) == cheapest(letters)


def test_layers_have_room_and_long_conversations_are_linear():
    seen, todo = set(), [conversations.ended()[1]]
    while todo:
        word = todo.pop()
        if word not in seen:
            seen.add(word)
            assert max(conversations._cost(word, q) for q in range(4)) <= 12
            todo += [conversations.before(x, word)[1] for x in "xsuaoSUAO"]
    cost, audit = conversations.repair("suaxU" * 40_000)
    assert len(audit) >= 200_000 and cost > 0


def by_hand(rows):
    """The contract, row by row."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in held.items():
        after = []
        for turn, role, text in own:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, letters, faults = set(), "", defaultdict(int)
        for _, role, text in after:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            x = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else x.upper() if fault else x
        turns = {t for t, _, _ in after if t is not None}
        cost, audit = cheapest(letters)
        rest, state, said = iter(after), "", []
        for e in audit:
            made = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[made]
            role, text = (None, "") if e == "I" else next(rest)[1:]
            if e != "D":
                said.append(f"{role if e == 'K' else name}:{text}")
                state = role[:1] if e == "K" else made
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(5)
    said = ["Yes.", "No!", "half a", "", None, "  \n", "Über 中文 ", "end. \t", "long " * 3000 + "?", "\U0001f600."]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "tool", None, "", "USER"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2], rng.choice(said)) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, "user", "a.") for t in range(4)] + rows[:20] + [(99, t, "user", "same.") for t in range(300)] + [(98, None, None, None), (97, 5, "user", "one only")]
    rows += next([(c, 0, "user", "gone.")] for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows


def test_conversations_by_hand(spark):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "c", 1, "d") for r in rows], "conv_id long, turn long, role string, text string, copies string, first int, digest string")
    got = conversations.repair_damaged(table).collect()
    want = by_hand(rows)
    assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want
    assert any(not w[6] for w in want.values())
    assert conversations.repair_damaged(table.limit(0)).count() == 0


# --- fill in the middle ---------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 900), max_size=60))
def test_lists_give_their_places(gaps):
    places = np.cumsum(np.array(gaps, np.int64)) - 1
    universe = int(places[-1]) + 7 if len(places) else 0
    held = fill_middle.encode(places, universe)
    assert fill_middle.length(held) == len(places) and fill_middle.select(held, list(range(len(places)))) == places.tolist()
    assert len(held) <= 16 + 2 + (2 * len(places) + len(places) * max(0, (universe // max(1, len(places))).bit_length()) + 16) // 8


def middle_by_hand(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def test_middles_by_hand(spark, odd, none):
    more = spark.createDataFrame([(100 + i, t, None, None, 0, None, None, None, None) for i, t in enumerate(["<P", "a<S>b", ">" * 9, "<<<MMM", "é" * 5000, "x", "\u0000y", *["copy 中 <"] * 300])], odd.schema)
    rows = odd.unionByName(more).withColumns({n: F.lit(1) for n in ("slot", "digest", "held", "h", "form", "n", "bucket")})
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in fill_middle.digests(rows).collect()), key=key)
    assert got == sorted((middle_by_hand(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    texts = {(r.doc_id, r.form, hashlib.sha256(r.output.encode()).hexdigest()) for r in fill_middle.fill_in_middle(rows).collect()}
    assert texts == {(r[0], r[2], r[5]) for r in got}
    assert fill_middle.digests(none).count() == 0


def test_a_list_serves_only_its_own_text(spark, monkeypatch):
    """Digests that collide, and slots that do: lists go to documents whose text is the group's, the others make their own."""
    monkeypatch.setattr(fill_middle, "SLOTS", 2)
    rows = [(i, t) for i, t in enumerate(["äöü" * 20, "abcdef" * 20, "äöü" * 20, "xyz"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(middle_by_hand(*r) for r in rows)
    assert sorted(tuple(r) for r in fill_middle.digests(docs).collect()) == want
    same = fill_middle._keyed
    monkeypatch.setattr(fill_middle, "_keyed", lambda *a: same(*a).withColumn("digest", F.lit(b"one")))
    assert sorted(tuple(r) for r in fill_middle.digests(docs).collect()) == want


def test_shared_texts_are_listed_once(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3 if i < 50 else i}") for i in range(200)], "doc_id long, text string")
    keyed = fill_middle._keyed(docs, "doc_id", "text")
    slots = fill_middle._shared_slots(keyed)
    shared = fill_middle._with_flag(keyed, slots).where("maybe")
    assert fill_middle.index(shared).count() == 3 and shared.count() == 50


# --- toxicity -------------------------------------------------------------------------------------


def grams(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "")
    return {text[i : i + n] for n in toxicity.SIZES for i in range(len(text) - n + 1)}


@cache
def number(gram):
    data = gram.encode()
    return next(int(f[-1]) if len(f) == 1 else None for f in toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))) if len(gram) == min(toxicity.SIZES) else None


def test_features_are_the_distinct_character_ngrams():
    texts = ["Ab\tcÄ", "", "xy", "ab cÄ", "é\U0001f600中a", "the the the", "zz" * 3000]
    data = [t.encode() for t in texts]
    found = list(toxicity.features(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])]))
    assert [len(f) for f in found] == [len(grams(t)) for t in texts]
    assert found[0].tolist() == found[3].tolist() and all(np.all(np.diff(f) > 0) for f in found)
    for text, f in zip(texts, found, strict=True):
        assert {number(g) for g in grams(text) if len(g) == min(toxicity.SIZES)} <= set(f.tolist())


WORDS = ["the", "house", "river", "stone", "walks", "green", "over", "paper", "light", "winter"]


def labelled(spark, n=500):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(rng.choice([5, 40, 900] if i % 10 == 0 else [10, 60]))]
        if toxic:
            for _ in range(1 + len(words) // 12):
                words[rng.randrange(len(words))] = rng.choice(["Vilething", "VILETHINGS!", "uglymuck", "uglymucker"])
        rows.append((i, " ".join(words), None, "s", 0, None, None, None, None))
        if i % 5:
            labels.append((i, int(toxic)))
    rows += [(1000, None, None, None, 0, None, None, None, None), (None, "no id vilething", None, None, 0, None, None, None, None), (1001, "", None, None, 0, None, None, None, None), rows[1]]
    labels += [(3, None), (None, 1), (5, 7), (8, 1), (8, 0), (8, 1), (77777, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, score long, held_out int, place int"), spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("vilething"))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = toxicity.score(docs, labels, held).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    unseen = [r for r in out if r.doc_id is not None and r.doc_id < 500 and (r.held_out or r.doc_id % 5 == 0)]
    assert len(unseen) > 100 and sum(r.predicted == (r.doc_id % 4 == 0) for r in unseen) >= 0.98 * len(unseen)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1000].score == by_id[1001].score < 0.5 < by_id[None].score and not by_id[None].held_out
    # Labels of held-out rows teach nothing; nor do other columns.
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.score(docs.withColumn("source", F.lit("x")), flipped, held).collect()} == {(r.doc_id, r.score) for r in out}


def test_ratios_by_hand(spark):
    docs, labels = labelled(spark, 80)
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label")), "doc_id").select(F.col("doc_id").alias("id"), "label", "text")
    held = rows.collect()
    taught, total = toxicity.drawn(rows.select("id", "label").distinct(), rows)
    assert total.tolist() == [sum(r.label == k for r in {(x.id, x.label): x for x in held}.values()) for k in (0, 1)]
    weight, square, *_ = toxicity.fit(rows.select("id", "text"), taught, total)
    n = [sum(r.label == k for r in held) for k in (0, 1)]
    for gram in ("vil", "the", "ugl", "hou"):
        count = [sum(r.label == k and gram in grams(r.text) for r in held) for k in (0, 1)]
        ratio = np.log((count[1] + 1) / (n[1] + 2)) - np.log((count[0] + 1) / (n[0] + 2))
        assert square[number(gram)] == pytest.approx(ratio**2 if abs(ratio) >= toxicity.LEAST else 0.0)


def test_what_teaches_is_bounded(spark):
    docs, labels = labelled(spark, 200)
    given = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label"))
    taught, n = toxicity.drawn(given, docs.select(F.col("doc_id").alias("id")), 40, 12)
    assert n.sum() == given.join(docs, F.col("id") == F.col("doc_id"), "left_semi").count()
    assert sorted(map(tuple, taught.groupBy("label", "margin").count().collect())) == [(0, False, 14), (0, True, 6), (1, False, 14), (1, True, 6)]
    out = toxicity.score(docs, labels, F.lit(False), counted=40, sample=12).where("doc_id < 200").collect()
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in out) > 0.9 * len(out)


def test_toxicity_without_both_classes(spark, none):
    docs, labels = labelled(spark, 30)
    held = F.lit(False)
    assert {round(r.score, 6) for r in toxicity.score(docs, labels.limit(0), held).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score(docs, labels.where("toxic = 0"), held).collect()} == {0}
    assert {r.predicted for r in toxicity.score(docs, labels.where("toxic = 1"), held).collect()} == {1}
    assert toxicity.score(none, labels, held).count() == 0

"""Operators on documents against brute force, with nulls, empty and very long texts, ties, repeated rows and empty tables."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rillgrid.llm import components, language_model, line_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, scratch, tokens as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return [bytes(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85 aAbBzé中", max_size=30)), max_size=6))
def test_words_match_the_pattern(texts):
    batch = pa.record_batch({"t": pa.array(texts, pa.string())})
    data, offsets = tk.column(batch, "t")
    w = tk.words(data, offsets)
    got = [(int(i), bytes(tk.LOWER[data[s:e]])) for i, s, e in zip(w.text, w.start, w.end, strict=True)]
    expected = [(i, x) for i, t in enumerate(texts) for x in lowered(t)]
    assert got == expected
    assert len(set(w.hash.tolist())) == len({x for _, x in expected})


def brute_sets(text):
    w = lowered(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: brute_sets(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_class(rows):
    first = {}
    for i, t in rows:
        s = frozenset(brute_sets(t))
        if i is not None and s:
            first[s] = min(i, first.get(s, i))
    return first


def check_near(df):
    expected = brute_components(texts_of(df))
    got = minhash_dedup.near_duplicates(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*expected[r.doc_id], expected[r.doc_id][1] == r.doc_id)
        else:
            assert r.kept and r.class_id is None and r.component_id is None


def test_rows_without_id_and_ids_of_several_texts(spark):
    """A copy without an id gets no class; of an id's texts one stands for it, on every run."""
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (2, text), (None, text), (7, text), (7, other), (8, other), (9, "one"), (9, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((str(r.doc_id), r.n_shingles, str(r.class_id), str(r.component_id)) for r in minhash_dedup.near_duplicates(x).collect()) for x in (df, df.orderBy(F.desc("doc_id"), F.desc("text")).coalesce(1))]
    assert got[0] == got[1]
    by = {(i, n): (c, k) for i, n, c, k in got[0]}
    assert by["None", 36] == ("None", "None") and by["2", 36] == ("1", "1") and by["7", 36] == ("1", "1") and by["8", 56] == ("8", "8")


def test_recall_of_the_finer_bands(spark, monkeypatch):
    """Planted links of similarity 0.75 to 0.8 among near misses, all dealt by the finer bands."""
    monkeypatch.setattr(minhash_dedup, "LARGE", 2)
    rng = np.random.default_rng(21)
    common = [f"c{i}" for i in range(110)]
    rows = []
    for i in range(150):
        w = common + [f"o{rng.integers(10**9)}" for _ in range(45)]
        near = list(w)
        near[-4] = f"n{rng.integers(10**9)}"
        for at in (20, 45, 75):
            near[at] = f"n{rng.integers(10**9)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
    expected = brute_components(rows)
    assert sum(expected[2 * i + 1][1] != 2 * i + 1 for i in range(150)) == 150
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in expected.items()}


def test_near_duplicates_odd(odd, none):
    check_near(odd)
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Chains of edits and texts that share most words: buckets stay unsettled, and the finer bands must find the links."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            w[at] = f"e{rng.integers(10**9)}"
        rows.append((i, " ".join(w)))
    shared = [f"s{i}" for i in range(70)]
    rows += [(100 + i, " ".join(shared + [f"u{rng.integers(10**9)}" for _ in range(60)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash_dedup, "LARGE", 2)
    check_near(df)


def test_near_copies_meet_one_leader(spark, monkeypatch):
    """Each of a group's members is compared with its leader, not with one for each band; batches of the session stay as they were."""
    tables = {}

    def kept(df, name):
        tables[name] = scratch.written(df, name)
        return tables[name]

    monkeypatch.setattr(minhash_dedup, "written", kept)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"e{i}"] + base[i + 1 :])) for i in range(30)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert tables["led-pairs"].count() <= 3 * len(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_finer_bands_make_rows_only_where_they_meet(spark, monkeypatch):
    """Texts that share a passage, with links among them: a finer band of one text alone is not dealt, no link is lost."""
    tables = {}

    def kept(df, name):
        tables[name] = scratch.written(df, name)
        return tables[name]

    monkeypatch.setattr(minhash_dedup, "written", kept)
    monkeypatch.setattr(minhash_dedup, "LARGE", 2)
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join(passage + [f"o{rng.integers(10**9)}" for _ in range(60)])) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" p30 ", f" n{i} ", 1)) for i in range(0, 60, 6)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))
    dealt, many = tables["dealt"].groupBy("band").count(), tables["many"].count()
    lone = dealt.where("count = 1").count()
    assert many >= 40 and tables["dealt"].count() < 48 * many and lone <= 10  # two bands in one slot both stay
    assert dealt.where("count > 1").count() == tables["fine"].join(tables["many"], "id").select(F.explode("bands").alias("band")).groupBy("band").count().where("count > 1").count() > 0


def test_bands_of_several_tasks_are_counted_together():
    def task(*lists):
        return pa.record_batch({"id": pa.array(range(len(lists)), pa.int64()), "bands": pa.array(lists, pa.list_(pa.int64()))})

    one, other = task([1 << 50, 2 << 50], [], [-1]), task([2 << 50, 3 << 50], [-2, 5 << 50, 5 << 50])
    counted = [b for t in (one, other, task()) for b in minhash_dedup._counts(iter([t]))]
    bits = np.zeros(minhash_dedup.SLOTS // 8, np.uint8)
    for batch in minhash_dedup._added(iter(counted)):
        for block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = block * len(bits) // minhash_dedup.BLOCKS
            bits[at : at + len(part)] = np.frombuffer(part, np.uint8)

    class Shared:
        value = bits

    got = [b.column(1).to_pylist() for t in (one, other, other.slice(1)) for b in minhash_dedup._met(Shared)(iter([t]))]
    assert got == [[[2 << 50], [], [-1]], [[2 << 50], [-2, 5 << 50, 5 << 50]], [[-2, 5 << 50, 5 << 50]]]  # -1 and -2 stand in one slot


@pytest.mark.parametrize("empty", [None, " ", ""])
def test_an_empty_row_beside_a_text_of_one_id(spark, empty):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30 ", "x ")
    rows = [(1, empty), (1, text), (2, near), (2, empty), (3, near + " y"), (3, near + " y")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == len(rows) and all(r.component_id == 1 for r in got if r.n_shingles)
    assert sorted((r.doc_id, r.n_shingles) for r in got) == [(1, 0), (1, 56), (2, 0), (2, 56), (3, 57), (3, 57)]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components.smallest_reachable(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(60)}
    assert components.smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_are_stars_settle_in_one_shuffle(spark, monkeypatch):
    """Repeated links and loops too; two stars with a common leaf take one round more, a random graph what it needs."""
    made = []

    def kept(df, name):
        made.append(name)
        return scratch.written(df, name)

    def found(links, kind="long"):
        made.clear()
        return {r.id: r.component for r in components.smallest_reachable(spark.createDataFrame(links, f"a {kind}, b {kind}")).collect()}

    monkeypatch.setattr(components, "written", kept)
    stars = [(3, i) for i in range(10, 30)] + [(i, 5) for i in range(40, 50)]
    assert found(stars + stars + [(7, 7), (None, 3)]) == {i: 3 for i in (3, *range(10, 30))} | {i: 5 for i in (5, *range(40, 50))}
    assert made == ["links", "low"]
    assert found([*stars, (29, 5)]) == {i: 3 for i in (3, 5, *range(10, 30), *range(40, 50))}
    assert made.count("low") <= 3
    rng = np.random.default_rng(4)
    links = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 200, (150, 2)).tolist()]
    least = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found(links, "string") == least


def test_sets_meet_their_leaders_in_one_shuffle(spark, monkeypatch):
    """A member's leaders go with its set: each pair of a bucket's leader and a member is compared once, and no list of ids is dealt out besides."""
    tables = {}

    def kept(df, name):
        tables[name] = scratch.written(df, name)
        return tables[name]

    monkeypatch.setattr(minhash_dedup, "written", kept)
    base = [[f"w{i}x{g}" for i in range(90)] for g in range(4)]
    rows = [(100 * g + i, " ".join(base[g][:i] + [f"e{i}"] + base[g][i + 1 :])) for g in range(4) for i in range(9)]
    rows += [(1000 + g, " ".join(base[g][:45] + base[(g + 1) % 4][:45])) for g in range(4)] + [rows[5], (3000, rows[20][1])]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = sorted(tuple(r) for r in tables["led-found"].select("a", "b").collect())
    assert pairs == sorted(tuple(r) for r in tables["buckets"].where("id != leader").select("leader", "id").distinct().collect())
    assert not {"shared", "led-ids"} & set(tables) and "late-ids" in tables


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=24), min_size=1, max_size=4))
def test_suffix_repeats_match_brute_force(texts):
    flat = np.array([c for t in texts for c in t], np.int64)
    of = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
    expected = []
    for t in texts:
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                if j != i:
                    k = 0
                    while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                        k += 1
                    best = max(best, k)
            expected.append(best)
    assert quality_rules.suffix_repeats(flat, of).tolist() == expected


def brute_rules(text):
    w = words(text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality_rules_odd(odd, none):
    got = quality_rules.score_texts(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in texts_of(odd):
        for r in by[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t)
            assert not (r.base_failed and r.kept)
    assert quality_rules.score_texts(none).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)


def brute_covered(text, least=5):
    """Words in runs of at least so many that the text holds twice or more, and the longest such run."""
    w, marked, longest = words(text), set(), 0
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        longest = max(longest, best)
        if best >= least:
            marked |= set(range(i, i + best))
    return len(marked), longest


def test_quality_rules_drop_by_the_method_alone(spark):
    """Texts that the base rules keep: long repeats over more than 30 % of the words, or one of more than 100 words."""
    rng = np.random.default_rng(6)
    w = [f"w{i}" for i in range(3000)]
    rows = [(0, " ".join(w[:60] + w[100:120] * 2)), (1, " ".join(w[:90] + w[100:110] * 2)), (2, " ".join(w[:2000] + w[2100:2220] + w[2300:2400] + w[2100:2220]))]
    rows += [(10 + i, " ".join(w[x] for x in np.r_[rng.integers(0, 500, 60), np.tile(rng.integers(0, 500, n), 2)])) for i, n in enumerate(range(3, 33, 3))]
    got = {r.doc_id: r for r in quality_rules.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_covered_words, r.longest_repeat) == brute_covered(t)
        assert r.kept == (not r.base_failed and r.n_covered_words <= 0.3 * r.n_words and r.longest_repeat <= 100)
    assert not got[0].base_failed and not got[0].kept and got[1].kept and not got[2].base_failed and not got[2].kept


def test_quality_rules_reject_long_repeats(spark):
    unique = [f"w{i}" for i in range(400)]
    block = [f"b{i}" for i in range(260)]
    rows = [(0, " ".join(unique)), (1, " ".join(unique + block + unique[:100] + block)), (2, " ".join(unique[:45] * 2))]
    got = {r.doc_id: r for r in quality_rules.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].kept and not got[1].kept and not got[2].kept
    assert got[1].longest_repeat == 260 and got[2].n_covered_words == 90


def brute_lines(rows, least):
    def trim(x):
        return x.strip(" \t\r")

    sites, first = {}, {}
    for i, t, s in rows:
        for line in {trim(x) for x in (t or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(s)
            if i is not None:
                first[line] = min(i, first.get(line, i))
    bad = {x for x, s in sites.items() if len(s) >= least}
    return {(i, s, t if t is None else "\n".join(x for x in t.split("\n") if trim(x) not in bad or first.get(trim(x)) == i)) for i, t, s in rows}


@pytest.mark.parametrize("least", [3, 10])
def test_line_dedup(spark, least):
    rows = []
    for i in range(200):
        text = ["Follow us\r" if i % 2 else "  Follow us", f"text {i}", "", "rare" if i < least - 1 else f"own {i}", "edge" if i < least else "x"]
        rows.append((i, "\n".join(text), f"s{i % 40}" if i % 50 else None))
    rows += [(None, "Follow us\nkeep", "s1"), (310, "Follow us", "\0null"), (311, "Follow us", ""), (300, None, "s2"), (301, "", "s3"), (302, "Follow us", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit(1)).withColumn("line", F.lit("x"))
    out = line_dedup.remove_boilerplate(df, min_sites=least)
    assert out.columns == df.columns
    assert {(r.doc_id, r.source, r.text) for r in out.collect()} == brute_lines(rows, least)


def test_line_dedup_beyond_a_broadcast_and_without_ids(spark, monkeypatch):
    """Joins that shuffle give what broadcasts give; rows with a null id lose all boilerplate, wherever their text sends them."""
    rows = [(k if k % 3 else None, f"common line\nown {k}" if k % 5 else "common line", f"s{k % 15}") for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sent = sorted(map(str, line_dedup.remove_boilerplate(df).collect()))
    monkeypatch.setattr(line_dedup, "small", lambda df: df)
    shuffled = line_dedup.remove_boilerplate(df)
    assert sorted(map(str, shuffled.collect())) == sent
    assert {r.text for r in shuffled.collect() if r.doc_id is None and r.text is not None} == {f"own {k}" for k in range(0, 90, 3) if k % 5} | {""}
    assert [r.text for r in shuffled.where("text LIKE 'common line%'").collect()] == ["common line\nown 1"]


def test_shards_have_a_task_each(spark):
    df = spark.createDataFrame([(k, "word " * (1 + k % 7), f"s{k % 4}") for k in range(400)], "doc_id long, text string, source string")
    _, sources, deals, shards = mixing.plan(df, shards=24)
    held = mixing.mix(df, shards=24).groupBy(F.spark_partition_id().alias("p")).count().collect()
    dealt = mixing.taken(df, shards=24).select(F.explode("shards").alias("p")).groupBy("p").count().collect()
    assert shards == 24 and {r.p: r["count"] for r in held} == {r.p: r["count"] for r in dealt} and len(held) > 20


def test_line_dedup_empty_and_repeated(odd, none):
    assert line_dedup.remove_boilerplate(none).count() == 0
    assert line_dedup.remove_boilerplate(odd).count() == odd.count()


def brute_lm(rows):
    counts, tokens = Counter(), []
    for i, t in rows:
        w = [*lowered(t), "end"]
        held = i is not None and crc32(str(i).encode()) % 5 == 1
        tokens.append((i, held, w))
        if not held:
            counts.update(w)
    return counts, tokens


@pytest.mark.parametrize("broadcast_mb", [64, 0])
def test_language_model(odd, none, broadcast_mb, monkeypatch):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    counts, tokens = brute_lm(texts_of(odd))
    N, V = sum(counts.values()), len(counts)
    if not broadcast_mb:  # no room, so that the model takes several passes and the word filter folds
        monkeypatch.setattr(language_model, "BITS", 12_000)
    got = language_model.score(odd, held, broadcast_mb=broadcast_mb or 1).collect()
    key = lambda r: (str(r[0]), r[2], r[3])
    expected = sorted(((i, h, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.5) / (N + 0.5 * (V + 1))) for x in w)) for i, h, w in tokens), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in got), key=key)
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g[:4] == e[:4] and g[4] == pytest.approx(e[4]) and g[5] < 0 and g[6] == N
    assert language_model.score(none, held).count() == 0


@pytest.mark.parametrize("passes", [1, 3])
def test_scores_match_brute_force(spark, passes):
    """With a filter so sparse that nothing is a false member, scores are those of the smoothed, quantised counts."""
    rng = np.random.default_rng(12)
    docs = [(i, " ".join(f"w{min(x, 40)}" for x in rng.geometric(0.15, rng.integers(0, 60)))) for i in range(300)] + [(400, "W1 w2 new w1"), (401, ""), (402, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score(df, F.col("doc_id") % 7 == 3, broadcast_mb=1024 if passes == 1 else 0.5, bits=4000).collect()}
    one, two, begins = Counter(), Counter(), 0
    sent = {i: [*lowered(t), "end"] for i, t in docs}
    for i, w in sent.items():
        if i % 7 != 3:
            one.update(w)
            two.update(zip(["begin", *w], w, strict=False))
            begins += 1
    N, V = sum(one.values()), len(one)

    def quantised(count, levels):
        q = int(np.searchsorted(levels, count, "right"))
        return 0.0 if not q else levels[-1] if q == len(levels) else (levels[q - 1] + levels[q] - 1) / 2

    for i, w in sent.items():
        total = 0.0
        for v, x in zip(["begin", *w], w, strict=False):
            word = quantised(one[x], language_model.WORD_LEVELS)
            context = begins if v == "begin" else quantised(one[v], language_model.WORD_LEVELS)
            both = min(quantised(two[v, x], language_model.PAIR_LEVELS), context, word)
            total += math.log10((both + 50 * (word + 0.5) / (N + 0.5 * (V + 1))) / (context + 50))
        assert got[i].score == pytest.approx(total)


def test_word_filter_beyond_its_share_scores_alike(spark, tmp_path):
    """300,000 words need 0.45 MB: within the quarter of 128 MB, beyond that of 1 MB."""
    rng = np.random.default_rng(4)
    rare = rng.permutation(300_000).reshape(1500, 200)
    rows = [(i, " ".join(f"w{x}" for x in np.r_[r, rng.integers(0, 50, 40)])) for i, r in enumerate(rare)] + [(5000, " ".join(f"new{x}" for x in range(500))), (5001, None), (None, "w1 w2"), (3, "w1 w2"), (3, "w1 w2")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")  # a file's size is known, so the model has few blocks
    held = F.col("doc_id") >= 5000
    key = lambda r: (str(r.doc_id), r.n_tokens)
    one, many = (sorted(language_model.score(df, held, broadcast_mb=mb).collect(), key=key) for mb in (128, 1))
    assert len(one) == len(many) == len(rows)
    for a, b in zip(one, many, strict=True):
        assert key(a) == key(b) and (a.held_out, a.n_known) == (b.held_out, b.n_known)
        assert (a.base_score, a.score) == (pytest.approx(b.base_score), pytest.approx(b.score))


def test_levels_from_several_parts_equal_those_from_one(spark, tmp_path):
    rows = [(i, False, i, " ".join(f"w{(i * j) % 97}" for j in range(i % 30))) for i in range(200)]
    spark.createDataFrame(rows, "id long, held_out boolean, key long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    model = language_model.fit(df)
    one, many = ({r.id: bytes(r.levels) for r in language_model._levelled(df, model, model.count(), n).collect()} for n in (1, 3))
    assert one == many and all(len(one[i]) == i % 30 + 1 and min(one[i]) > 0 for i in one)


def test_filter_reads_counts_back():
    keys = tk.mix(np.arange(5000, dtype=np.uint64))
    counts = np.r_[np.ones(4000, np.int64), np.arange(1, 1001)]
    data, size = language_model.members(keys, counts, language_model.WORD_LEVELS, language_model.BITS)
    f = language_model.Filter(1, language_model.WORD_LEVELS, len(data))
    f.add(0, size, data)
    got = f.counts(keys)
    assert (got >= 1).all() and np.mean(np.abs(got - counts) <= 0.2 * counts + 1) > 0.98
    assert np.mean(f.counts(tk.mix(np.arange(10_000, 40_000, dtype=np.uint64))) > 0) < 0.02


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    order = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), [x for x in order if sizes[x]]
    while open_:
        share = left / sum(weight[x] for x in open_)
        over = {x for x in open_ if share * weight[x] > most * sizes[x]}
        for x in over or open_:
            out[x] = most * sizes[x] if over else share * weight[x]
            left -= out[x]
        open_ = [x for x in open_ if x not in over] if over else []
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 500, "c": 0}, {"a": 0}, {}, {"é": 3, "z": 10**6, "Z": 5, "\U0001f600": 70, "\uffff": 9}, {f"s{i}": i * i * (i % 5 > 0) for i in range(300)}])
def test_targets_match_brute_force(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in mixing.with_targets(df).collect()}
    want = brute_targets(sizes)
    assert {x: r.target for x, r in got.items()} == {x: pytest.approx(t, rel=1e-9) for x, t in want.items()}
    assert [x for x, _ in sorted(((x, r["rank"]) for x, r in got.items()), key=lambda t: t[1])] == list(want)


def test_splitting_tree_is_exact():
    quotas = np.array([5, 0, 64, 1000, 7])
    deal = mixing.splitting_tree(quotas, 13, 1)
    per = np.array([np.bincount(x, minlength=13) for x in deal])
    assert [len(x) for x in deal] == quotas.tolist() and np.ptp(per.sum(0)) <= 1
    assert all((x == y).all() for x, y in zip(deal, mixing.splitting_tree(quotas, 13, 1), strict=True))
    # the left half's quota of a source is hypergeometric: its mean over seeds is its share
    left = [np.sum(mixing.splitting_tree(np.array([30, 70]), 2, seed)[0] == 0) for seed in range(400)]
    assert abs(np.mean(left) - 15) < 0.5 and np.var(left) == pytest.approx(50 * 0.3 * 0.7 * 50 / 99, rel=0.25)


def test_mixing(spark, odd, none):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 6}" if i % 13 else None) for i in range(3000)] + [(5000, None, "s0"), (None, "a b c", "s1"), (5001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("cut", F.lit(1)).withColumn("shards", F.lit("x"))
    plan = {r.doc_id: r for r in mixing.taken(df).collect()}
    per = Counter()
    for i, t, s in rows:
        r = plan[i]
        assert r.size == len(words(t)) and r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size and len(r.shards) * r.size == r.taken
        per[s] += r.taken
    for i, _, s in rows:
        assert abs(per[s] - plan[i].target) <= 2
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    assert counts == Counter({i: r.taken // r.size for i, r in plan.items() if r.taken})
    assert mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.taken(odd).count() == odd.count()
    many = spark.createDataFrame([(i, "w " * (1 + i % 3), f"site{i}") for i in range(5000)] + [(9000 + i, "w " * 500, "large") for i in range(10)], "doc_id long, text string, source string")
    rows = mixing.taken(many, shards=8).collect()  # sources of less than a block share blocks
    assert len(rows) == 5010 and {s for r in rows for s in r.shards} == set(range(8)) and all(r.taken == len(r.shards) * r.size for r in rows)
    assert [(r.doc_id, r.taken) for r in sorted(rows)] == [(r.doc_id, r.taken) for r in sorted(mixing.taken(many.repartition(3), shards=8).collect())]
    assert len({s for r in mixing.taken(many, shards=2, shard_words=1000).collect() for s in r.shards}) > 8


def test_a_large_document_does_not_stop_the_fill(spark):
    """The hash order meets a document that does not fit; smaller ones behind it fill what is left."""
    rows = [(i, "w " * (700 if i % 10 == 0 else 3), "a") for i in range(200)] + [(1000 + i, "w " * 9, "b") for i in range(2000)]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    per = Counter()
    for r in got:
        per[r.doc_id < 1000] += r.taken
    target = {r.doc_id < 1000: r.target for r in got}
    assert all(abs(per[x] - target[x]) <= 9 for x in target)


def test_quality_classifier(spark, odd, none):
    rng = np.random.default_rng(2)
    good = [" ".join(f"word{rng.integers(50)}" for _ in range(60)) for _ in range(120)]
    bad = [" ".join(f"WORD{rng.integers(50)}!!" for _ in range(60)) if i % 2 else " ".join(["spam"] * 60) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = quality_classifier.score(docs, labels, held).collect()
    assert len(got) == 180 and np.mean([r.predicted == int(r.doc_id < 120) for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality_classifier.score(odd, labels, held).count() == odd.count()
    assert quality_classifier.score(none, labels, held).count() == 0
    alone = quality_classifier.score(docs, labels.where("quality = 1"), held).collect()
    assert {r.predicted for r in alone} == {1}
    assert {round(r.score, 6) for r in quality_classifier.score(docs, labels.limit(0), held).collect()} == {0.5}


def brute_model(train, cost=1.0, smooth=1.0):
    """Log-count ratios from all rows, and the minimum of the hinge loss over them by projected gradient on the dual."""
    n = {k: sum(y == k for _, y in train) for k in (0, 1)}
    count = {k: Counter(f for x, y in train if y == k for f in x) for k in (0, 1)}
    ratio = lambda f: math.log(((count[1][f] + smooth) / (n[1] + 2)) / ((count[0][f] + smooth) / (n[0] + 2)))
    names = sorted({f for x, _ in train for f in x})
    X = np.zeros((len(train), len(names) + 1))
    for i, (x, _) in enumerate(train):
        v = np.array([ratio(f) if f in x else 0.0 for f in names])
        X[i] = np.r_[v / (np.linalg.norm(v) or 1.0), 1.0]
    y = np.array([1.0 if k else -1.0 for _, k in train])
    Q = (X * y[:, None]) @ (X * y[:, None]).T
    a, step = np.zeros(len(train)), 1 / np.linalg.norm(Q, 2)
    for _ in range(200_000):
        a = np.clip(a + step * (1 - Q @ a), 0, cost)
    w = X.T @ (a * y)
    return {f: ratio(f) for f in names}, dict(zip(names, w, strict=False)), w[-1], X @ w


def test_classifier_matches_brute_force(spark, monkeypatch):
    """Counts, ratios, margins and calibration of the fitted model against a plain solver on the same features."""
    rng = np.random.default_rng(31)
    texts = [" ".join(rng.choice(["ab", "cd", "ef!", "GH", "x1"], rng.integers(1, 5), p=[0.5, 0.2, 0.1, 0.1, 0.1] if i % 3 else [0.1, 0.2, 0.4, 0.2, 0.1])) for i in range(40)]
    label = [int(i % 3 > 0) for i in range(40)]
    rows = spark.createDataFrame([(i, k, t) for i, (t, k) in enumerate(zip(texts, label, strict=True))], "id long, label int, text string")
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    found = [set(f.tolist()) for f in quality_classifier.features(data, at)]
    ratio, weight, bias, margin = brute_model(list(zip(found, label, strict=True)))
    descend = quality_classifier.dual_descent
    monkeypatch.setattr(quality_classifier, "dual_descent", lambda *x: descend(*x, epochs=20_000))
    w, square, b, slope, shift = quality_classifier.fit(rows)
    assert {f: square[f] for f in ratio} == {f: pytest.approx(r * r) for f, r in ratio.items()}
    got = [sum(w[f] for f in x) / math.sqrt(sum(square[f] for f in x)) + b for x in found]
    assert got == pytest.approx(margin.tolist(), abs=2e-3)
    loss = lambda a, c: sum(math.log1p(math.exp(-(1 if k else -1) * (a * m + c))) for m, k in zip(margin, label, strict=True)) + 5e-4 * a * a
    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 1e-3 for da in (-0.2, 0, 0.2) for db in (-0.2, 0, 0.2))


def test_repeated_ids_keep_the_sample_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i % 40 if i >= 400 else 3, f"text {i % 7} of {i % 2}") for i in range(800)], "doc_id long, text string")
    assert quality_classifier.score(docs, labels, F.lit(False), sample=4).count() == 800


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in odd_rows()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    got = Counter(r.doc_id for r in docs.collect())
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, tuple(r.ids)) for r in again.collect() if r.doc_id is not None) == sorted((r.doc_id, tuple(r.ids)) for r in docs.collect() if r.doc_id is not None)
    assert got and {1, 2, 3, 5, 6, 7, 8, 9}.isdisjoint(got) and docs.where("NOT round_trip").count() == 0


def odd_rows():
    from tests.llm.conftest import odd_documents

    return odd_documents()


@pytest.mark.parametrize(("given", "held"), [("10000", "500"), ("0", "500"), ("-1", "500"), ("200", "200")])
def test_pipeline_bounds_batches(spark, given, held):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, given)
        corpus_pipeline._bounded(spark)
        assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before)

"""Pieces, pages, urls and vectors against libraries and brute force."""

import re
from functools import cache
from html import unescape
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rillgrid.llm import html_text, mtree, pieces, queries, url_filter

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", None, " ", "  two  spaces ", "the\n\nthe \t x\r\n", "Über weiß 中文 \U0001f600", "a▁b", "   ", "The quick brown fox, 1234!", "ab" * 4000, "don't stop;\r}\r"]


@cache
def loaded():
    return pieces.Vocabulary.load(queries.PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    return loaded()


def encoded(vocabulary, texts):
    ids, at = pieces.Encoder(vocabulary).encode(texts)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))], ids, at


def test_pieces_equal_the_library(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    plain = [t for t in TEXTS if t and "▁" not in t]
    assert encoded(vocabulary, plain)[0] == [library.encode(t) for t in plain]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abthe \n▁é中,.\U0001f600", max_size=40)), max_size=5))
def test_pieces_round_trip(texts):
    v = loaded()
    _, ids, at = encoded(v, texts)
    data, ends = pieces.decode(v, ids, at)
    assert [data[ends[i] : ends[i + 1]].tobytes().decode() for i in range(len(texts))] == [t or "" for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=9), min_size=1, max_size=8, unique=True))
def test_unigram_viterbi_is_optimal(words):
    table = {"a": -1.0, "b": -1.5, "ab": -2.2, "ba": -2.6, "aba": -3.0, "bb": -2.0, "aabb": -3.9}
    v = pieces.Vocabulary(["<unk>", *table], [0.0, *table.values()], [True] + [False] * len(table), None)

    def best(word):
        if not word:
            return 0.0
        options = [table[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in table]
        if word[0] not in table:
            options.append(v.penalty + best(word[1:]))
        return max(options)

    for word, ids in zip(sorted(words), v.solve(sorted(words)), strict=True):
        assert sum(v.scores[i] if i else v.penalty for i in ids) == pytest.approx(best(word))


def test_punctuation_at_an_end_is_solved_once(vocabulary, monkeypatch):
    """Words that differ in it alone share their solution; the ids are the library's, joined or not."""
    solved, solve = [], pieces.Vocabulary.solve
    monkeypatch.setattr(pieces.Vocabulary, "solve", lambda self, words: solve(self, solved.extend(words) or words))
    tails = ["", "%%%", "&&&", ".%%%", ".", ",", "...", ").", "'", "$$", "***", "?!", "_", '"', ".,;"]
    words = ["réenoi", "Éier", "oulechaux", "don't", "a.b", "(x", "日本", "12", "x12", "\U0001f600", "é", "", "\x00", "e.g"]
    texts = [f"{w}{t} {w}{t}" for w in words for t in tails] + ["%%%", " %%%", "  ..", "a %%% b", ""]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    assert encoded(vocabulary, texts)[0] == [library.encode(t) for t in texts]
    assert len([w for w in solved if w.startswith(" oulechaux")]) < len(tails) / 2 and len(solved) == len(set(solved))


def test_pieces_refuse_crossing_pieces():
    with pytest.raises(ValueError, match="cross"):
        pieces.Vocabulary(["a▁b"], [0.0], [False], None)


def test_pieces_on_tables(spark, odd, none, vocabulary):
    out = pieces.encode(odd, vocabulary)
    rows = out.collect()
    assert len(rows) == odd.count() and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert {r.doc_id: r.text for r in pieces.decode_table(out, vocabulary).collect()} == {i: t or "" for i, t in texts.items()}
    assert pieces.encode(none, vocabulary).count() == 0 and pieces.decode_table(out.limit(0), vocabulary).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode_table(nulls, vocabulary).first().text == ""
    the = vocabulary.ids["▁the"]
    odd_ids = spark.createDataFrame([(1, [None, the, 10**6, -5, the]), (2, [None]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode_table(odd_ids, vocabulary).collect()} == {1: "the the", 2: "", 3: ""}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><div class="ad box">Buy this now</div>
<div id="cookie-notice">We use cookies on this page for many reasons.</div>
<article><header><h1>Title &amp; more</h1></header><p>First  paragraph with <b>bold</b>&nbsp;text<br>and a break.<p>Short.</p><form><input><p>Mail me</p></form>
<aside>Side words</aside><div class="comments"><p>Nice article, I liked it very much indeed!</p></div><p>Last one.</article>
<div class="sidebar"><p>Other things to read on this site today.</p></div><footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph with bold text and a break.\nShort.\nLast one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><nav><a>x</a></nav></html>") == ""
    assert html_text.main_text("just text") == "just text"
    links = "".join(f"<li><a href='/{i}'>l{i}</a></li>" for i in range(30))
    body = "".join(f"<p>{'Words of a real paragraph go here. ' * 6}</p>" for _ in range(5))
    got = html_text.main_text(f"<body><div><ul>{links}</ul></div><div>{body}</div></body>")
    assert got.count("\n") == 4 and "l3" not in got
    assert len(html_text.main_text(f"<article><p>{'x' * 500_000}</p></article>")) == 500_000


NEUTRAL = """<body><div class="a1"><ul>{links}</ul></div><div class="a2"><h1>A title of some words</h1><p>{p}</p><p>Short one.</p>
<div class="entry-header"><p class="social">{p}</p></div><p>Energy <math><mi>E</mi></math> is <button>pressed</button></p><p>{p}</p></div>
<div class="a3"><div>More</div><div>Terms</div><div>Imprint</div></div></body>"""


def test_ratios_select_the_region():
    """No article, no telling names: ratios, their smoothing and the clusters decide, and the threshold is felt."""
    words = "Words of a real paragraph go here. " * 6
    page = NEUTRAL.format(links="".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12)), p=words)
    p = words.strip()
    want = f"A title of some words\n{p}\nShort one.\n{p}\nEnergy E is pressed\n{p}"
    assert html_text.main_text(page) == want
    assert html_text.main_text(page.replace("a2", "entry-header")) == want
    assert "link 3" in html_text.main_text(page, cut=-1e9) and "Imprint" in html_text.main_text(page, cut=-1e9)
    assert html_text.main_text(page, cut=3.0) != want
    inside = f"<article><div class='entry-header'><h1>Title</h1></div><p class='social'>{words}</p><p>{words}</p><div class='ad'>Buy now</div></article>"
    assert html_text.main_text(inside) == f"Title\n{p}\n{p}"
    # a hint can be overruled: the article is a teaser, the text stands beside it
    teaser = f"<body><div><p>{words}</p><p>{words}</p><p>{words}</p></div><article><p>Teaser</p></article></body>"
    assert html_text.main_text(teaser).count(p) == 3


def test_smoothing_decides_between_regions():
    """Teasers among links are lines of high ratio between low ones: smoothing along the tree lowers them, the article's neighbours hold each other up."""
    p = "Words of a real paragraph go here. " * 3
    text = "<div>" + f"<p>{p}</p>" * 4 + "</div>"
    teasers = "<div>" + "".join(f"<p><a href='/{i}'>A link of words {i}</a></p><p>A teaser that says some words of what is told on the page behind</p>" for i in range(12)) + "</div>"
    want = "\n".join([p.strip()] * 4)
    assert html_text.main_text(f"<body>{teasers}{text}</body>") == want
    assert "teaser" in html_text.main_text(f"<body>{teasers}{text}</body>", sigma=0.05)
    assert html_text.main_text(f"<body>{teasers}{text}</body>", cut=-1.0) != want
    far = html_text.smoothed(np.array([0.0, 3.0, 0.0]), 1.0, np.array([0.0, 1.0, 3.0]))
    assert far[2] == pytest.approx(3 * np.exp(-2) / (1 + np.exp(-2) + np.exp(-4.5)))


def test_lists_of_links_in_an_article_stay():
    p = "Words of a real paragraph go here. " * 6
    items = "".join(f"<li><a href='/{i}'>Source {i}</a></li>" for i in range(3))
    want = f"{p.strip()}\nSource 0\nSource 1\nSource 2\n{p.strip()}"
    for tag in ("article", "main", "div"):
        assert html_text.main_text(f"<body><nav><a href='/'>Home</a></nav><{tag}><p>{p}</p><ul>{items}</ul><p>{p}</p></{tag}></body>") == want
    flat = f"<body><ul>{items}</ul><p>{p}</p><p>{p}</p></body>"  # no region but the page: a menu
    assert html_text.main_text(flat) == f"{p.strip()}\n{p.strip()}"


def test_inner_region_keeps_the_heading():
    p = "Words of a real paragraph go here. " * 6
    inside = f"<div><div><h1>Title</h1></div><div><p>{p}</p><p>{p}</p><p>{p}</p></div></div>"
    page = f"<body><div>An advert says this in words.</div>{inside}<div>Someone owns the rights to this page.</div></body>"
    assert html_text.main_text(page) == "Title\n" + "\n".join([p.strip()] * 3)


def test_two_means_and_smoothing():
    assert html_text.two_means(np.array([1.0, 1.0])) == (1.0, 1.0)
    assert html_text.two_means(np.array([0.0, 1.0, 9.0, 10.0])) == (0.5, 9.5)
    assert html_text.smoothed(np.array([0.0, 3.0, 0.0]), 1.0)[1] == pytest.approx(3 / (1 + 2 * np.exp(-0.5)))


def test_extract_without_articles_and_names(spark):
    """The pages of the tables, with article tags or class names taken away, give the same texts, but for a few articles of a line."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    no_names = lambda html: re.sub(r' class="[^"]*"', "", html)
    no_article = lambda html: re.sub(r"(</?)article>", r"\1div>", html)
    for change in (no_names, no_article, lambda html: no_names(no_article(html))):
        assert np.mean([html_text.main_text(change(r.html)) == html_text.main_text(r.html) for r in rows]) >= 0.95


def test_extract_with_neutral_containers(spark):
    """Every telling element a div, every name gone: ratios and regions alone."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    neutral = lambda html: re.sub(r' (?:class|id|role)="[^"]*"', "", re.sub(r"(</?)(?:nav|aside|footer|header|form|article|main|section)\b", r"\1div", html))
    assert np.mean([html_text.main_text(neutral(r.html)) == html_text.main_text(r.html) for r in rows]) >= 0.95


def test_extract_matches_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?p>|</?h1>", article)]
        want[r.page_id] = "\n".join(x for x in blocks if x)
    odd = pages.unionByName(spark.createDataFrame([(-1, None, None), (-2, "u", "")], pages.schema)).withColumn("text", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(odd).collect()}
    assert got == {i: (t, len(t)) for i, t in (want | {-1: "", -2: ""}).items()}
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://WWW.Example.com/en/1?a=/x", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://a.example.com/en", "a.example.com", "/en", "com/", "allow"), ("x://net/es/1#f", "net", "/es/1", "net/es/", "block"), ("http://b.com", "b.com", "", None, None),
        ("http://xcom/", "xcom", "/", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("http://a.org?x=http://b.com/en/", "a.org", "", None, None),
    ],
)
def test_url_parts_and_rules(url, host, path, rule, verdict):
    assert url_filter.parts(url) == (host, path)
    assert url_filter.Given(url_filter.RULES).match(host, path) == ((rule, verdict) if rule else None)


def brute_rules(baskets, verdicts, support, confidence, count):
    """All token sets that imply a verdict, less those of which a part implies it as surely."""
    n = len(baskets)
    sets = {frozenset(c) for b in baskets for k in range(1, len(b) + 1) for c in combinations(sorted(b), k)}
    found = {}
    for x in sets:
        met = [v for b, v in zip(baskets, verdicts, strict=True) if x <= b]
        for v in ("allow", "block"):
            both = met.count(v)
            if both >= max(count, support * n) and both / len(met) >= confidence:
                found[x, v] = both / len(met)
    return {k: c for k, c in found.items() if not any(y < k[0] and v == k[1] and d >= c for (y, v), d in found.items())}


@pytest.mark.parametrize(("support", "count"), [(0.05, 1), (0.01, 6)])
def test_learned_rules_match_brute_force(spark, support, count):
    rng = np.random.default_rng(9)
    baskets = [{f"t{x}" for x in rng.integers(0, 6, rng.integers(1, 12))} for _ in range(120)]
    verdicts = ["block" if {"t1", "t2", "t3", "t4"} <= b or rng.random() < 0.03 else "allow" for b in baskets]
    df = spark.createDataFrame([(sorted(b), v) for b, v in zip(baskets, verdicts, strict=True)], "tokens array<string>, verdict string")
    got = {(t, v): c for t, v, c, _ in url_filter.learn(df, support, 0.8, count)}
    want = brute_rules(baskets, verdicts, support, 0.8, count)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(len(t) > 3 for t, _ in got) or count > 1


def test_long_schemes_are_told_apart():
    one, two = (url_filter.basket(u, *url_filter.parts(u)) for u in ("abcdefghijklmnopq://x.com/", "abcdefghijklmnopr://x.com/"))
    assert "p:post-9999" in url_filter.basket("", "x.com", "/post-1234") and "p:post-99999999" in url_filter.basket("", "x.com", "/post-20240101")
    assert one != two and not any(t.startswith("scheme:") for t in url_filter.basket("x" * 100, "", ""))


def test_url_filter(spark):
    rows = [(i, f"http://s{i % 50}.example.{'com' if i % 2 else 'net'}/{('en', 'fr', 'de')[i % 3]}/{i}") for i in range(600)]
    rows += [(1000 + i, f"http://s{i % 50}.example.org/{('en', 'fr', 'de')[i % 3]}/{i}") for i in range(90)] + [(2000, None), (2001, ""), (2001, ""), (2002, "x" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", F.lit(0)).withColumn("rule", F.lit("x"))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    labelled = {i: url_filter.Given(url_filter.RULES).match(*url_filter.parts(u)) for i, u in rows}
    for i, u in rows:
        assert (got[i].host, got[i].path) == url_filter.parts(u)
        assert (got[i].rule, got[i].verdict) == labelled[i] if labelled[i] else got[i].rule is None
    # brute force: tokens that always came with block, often enough, block the rest
    tokens = {i: set(url_filter.basket(u, *url_filter.parts(u))) for i, u in rows}
    known = [i for i in labelled if labelled[i]]
    for t in ("p:en",):
        met = [labelled[i][1] for i in known if t in tokens[i]]
        assert len(met) > 0.01 * len(known) and np.mean([x == "block" for x in met]) > 0.9
    assert all(got[i].verdict == "block" for i in range(1000, 1090) if "p:en" in tokens[i])
    assert got[2000].verdict == got[2001].verdict == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0
    none = url_filter.judge(pages, rules=[]).collect()
    assert {r.verdict for r in none} == {"allow"}


def brute_top(ids, vectors, is_query, k):
    out = []
    for q in np.flatnonzero(is_query):
        score = vectors @ vectors[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out += [(ids[q], n + 1, ids[j], score[j]) for n, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize(("n", "spread"), [(400, 2), (900, 40), (3, 5)])
def test_top_k(spark, monkeypatch, n, spread):
    """Few distinct values give many ties and equal vectors; small trees and pages give deep searches."""
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(n)
    whole = rng.integers(-spread, spread, (n, 6))
    rows = [(i * 5, [float(x) / 256 for x in v], 0) for i, v in enumerate(whole)]
    bad = [(None, rows[0][1], 0), (7, None, 0), (11, [None] * 6, 0), (12, [float("nan")] * 6, 0), (13, [float("inf")] * 6, 0), (14, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, query_mb=0.0005).collect())
    assert got == brute_top(np.arange(n) * 5, whole, np.arange(n) * 5 % 50 == 0, 5)
    assert mtree.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("ids", [[50, 50, 51, 52, 53, 54, 55], [50] * 9 + [51] * 3 + [52] * 9 + [60], [0] * 8 + [50, 51, 52]])
def test_top_k_of_repeated_rows(spark, ids):
    """Equal vectors: a query's own rows take no place, repeated rows of others take one each."""
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "vec_id long, embedding array<double>").repartition(1)
    got = sorted((r["rank"], r.vec_id) for r in mtree.top_k(df, F.col("vec_id") == 50).collect())
    assert got == list(enumerate([i for i in ids if i != 50][:5], 1))


@pytest.mark.parametrize(("power", "dimensions"), [(27, 1024), (30, 64), (52, 6), (200, 3), (600, 2)])
def test_top_k_of_large_components(spark, power, dimensions):
    """Products far beyond 2^53 and 2^63 rank as whole numbers do; close ones differ in their last bits."""
    rng = np.random.default_rng(power)
    n = 300 if dimensions < 1000 else 60
    high = 2.0**power - np.floor(rng.random((n, dimensions)) * 4) * 2.0 ** max(0, power - 50)
    vectors = high * rng.choice([-1.0, 1.0], (n, 1))
    vectors[n // 2 : n // 2 + 10] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, scale=1).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, n, 50):
        exact = sorted(((-sum(int(x) * int(y) for x, y in zip(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q))[:5]
        assert got[q] == {k: (i, min(2**63 - 1, -s)) for k, (s, i) in enumerate(exact, 1)}


def test_repeated_query_ids_ask_with_the_smallest_vector(spark):
    df = spark.createDataFrame([(50, [3.0, 0.0]), (50, [0.0, 1.0]), (51, [1.0, 0.0]), (52, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in mtree.top_k(df, F.col("vec_id") == 50, scale=1).orderBy("rank").collect()] == [(52, 1), (51, 0)]


def test_tree_search_prunes(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (20, 8))
    vectors = np.unique(np.concatenate([c + rng.integers(-20, 20, (100, 8)) for c in centres]), axis=0)
    tree = mtree.build(vectors, [np.array([i]) for i in range(len(vectors))])
    count = [0]
    for q in range(0, len(vectors), 100):
        best = []
        mtree.search(tree, vectors[q], q, 5, best, count)
        scores = vectors @ vectors[q]
        order = [j for j in np.lexsort((np.arange(len(vectors)), -scores)) if j != q][:5]
        assert sorted(best, reverse=True) == [(int(scores[j]), -j) for j in order]
    assert count[0] < 0.5 * len(vectors) * len(range(0, len(vectors), 100))

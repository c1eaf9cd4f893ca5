"""URL filters by association rules (operator 8).

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end (A-Z
lower-cased), its path what follows up to ``?``, ``#`` or the end; null urls and those
without ``://`` have neither. Given rules (host, path) label urls: a rule fits its host and
all subdomains where the path starts with the rule's, the longest rule wins.

For urls that no rule fits, rules are learned: urls that one fits are baskets of tokens
(host labels, host suffixes of two labels or more, path segments, query keys, the scheme) plus
their label, FP-growth mines the frequent combinations, and combinations that imply a
label with ``min_confidence`` and ``min_support``, and at least ``min_count`` urls, stay, however
many tokens they have, unless a part of them implies it as surely. An inverted index from a
rule's rarest token finds the rules that a url can meet; the surest decides, then the better
supported, then the longer, then block. A url that meets none is allowed. Frequent tokens number
at most mean basket size / support, whatever the number of urls; rules reach the driver one at a
time, shorter ones first, and only those that stay are held and broadcast.

Empty tables give empty results; repeated rows and ties are judged alike; other columns
pass through ``allowed`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from rillgrid.llm.scratch import written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT = 0.01, 0.9, 5
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LABELS = {"\x00allow": "allow", "\x00block": "block"}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = re.search(r"[/?#]", rest)
    host, rest = (rest[: at.start()], rest[at.start() :]) if at else (rest, "")
    return host.translate(_UPPER), re.split(r"[?#]", rest, maxsplit=1)[0]


class Given:
    """The given rules, by host."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append(("/" + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        best, at = None, 0
        while host and at >= 0:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


def basket(url: str | None, host: str, path: str) -> list[str]:
    """The distinct tokens of a url. Digits count by their number, so that ids form no token of their own."""
    labels = host.split(".") if host else []
    out = {f"h:{x}" for x in labels} | {"s:" + ".".join(labels[k:]) for k in range(len(labels) - 1)}
    out |= {"p:" + re.sub(r"\d+", lambda m: "9" * len(m[0]), x) for x in path.split("/") if x}
    query = re.search(r"\?([^#]*)", url or "")
    out |= {"q:" + x.partition("=")[0] for x in query[1].split("&") if x} if query else set()
    scheme, found, _ = (url or "").partition("://")
    return sorted(out | ({"scheme:" + scheme} if found else set()))


def _parsed(rules: Sequence[tuple[str, str]], url_col: str, id_type: str):
    given = Given(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule, verdict = given.match(host, path) or (None, None)
                rows.append((host, path, rule, verdict, basket(url, host, path)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "host", "path", "rule", "verdict", "tokens"])

    return run


def learn(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> list[tuple[frozenset[str], str, float, float]]:
    """(tokens, verdict, confidence, support) from rows (tokens, verdict), the surest first."""
    label = F.concat(F.lit("\x00"), "verdict")
    baskets = written(labelled.select(F.array_append("tokens", label).alias("items")), "baskets")
    n = baskets.count()
    if n < min_count:
        return []
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(baskets)
    implied = model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].isin(*_LABELS) & ~F.exists("antecedent", lambda t: t.isin(*_LABELS)))
    ordered = implied.select(F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("label"), "confidence", "support").orderBy(F.size("tokens"), "tokens", "label")
    kept: list[tuple[frozenset[str], str, float, float]] = []
    by_token: dict[str, list[int]] = {}
    for r in ordered.toLocalIterator():
        tokens, verdict = frozenset(r.tokens), _LABELS[r.label]
        if any(kept[i][0] < tokens and kept[i][1] == verdict and kept[i][2] >= r.confidence for t in tokens for i in by_token.get(t, ())):
            continue
        by_token.setdefault(min(tokens), []).append(len(kept))  # a part of a larger set lies under one of its tokens
        kept.append((tokens, verdict, r.confidence, r.support))
    return sorted(kept, key=lambda r: (-r[2], -r[3], -len(r[0]), r[1] != "block", sorted(r[0])))


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, index = shared.value
        for batch in batches:
            verdicts, learned = [], []
            for given, tokens in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                hit = None
                if given is None:
                    have = set(tokens)
                    hit = min((i for t in tokens for i in index.get(t, ()) if rules[i][0] <= have), default=None)
                verdicts.append(given or (rules[hit][1] if hit is not None else "allow"))
                learned.append(" ".join(sorted(rules[hit][0])) if hit is not None else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(verdicts, pa.string()), pa.array(learned, pa.string())], names=["id", "host", "path", "rule", "verdict", "learned_rule"])

    return run


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """id_col, host, path, rule, verdict and learned_rule (the tokens that decided, if no given rule did) for each row."""
    kind = dict(pages.dtypes)[id_col]
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(_parsed(rules, url_col, kind), f"id {kind}, host string, path string, rule string, verdict string, tokens array<string>")
    learned = learn(parsed.where("verdict IS NOT NULL").select("tokens", "verdict"), min_support, min_confidence, min_count)
    often: dict[str, int] = {}
    for tokens, *_ in learned:
        for t in tokens:
            often[t] = often.get(t, 0) + 1
    index: dict[str, list[int]] = {}
    for i, (tokens, *_) in enumerate(learned):
        index.setdefault(min(tokens, key=lambda t: (often[t], t)), []).append(i)
    shared = pages.sparkSession.sparkContext.broadcast((learned, index))
    return parsed.mapInArrow(_judged(shared), f"id {kind}, host string, path string, rule string, verdict string, learned_rule string").withColumnRenamed("id", id_col)

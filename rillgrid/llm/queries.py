"""Queries over whole tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillgrid.llm import conversations, fill_middle, html_text, language_model, line_dedup, minhash_dedup, mixing, mtree, pieces, quality_classifier, quality_rules, toxicity, url_filter

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int, rest: int = 1) -> Column:
    """Whether a document is held out: crc32 of its id as text leaves rest on division by n."""
    return F.crc32(F.col("doc_id").cast("string")) % n == rest


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"), _fold(5))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), pieces.Vocabulary.load(PIECES))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _fold(3))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_texts(_table(spark, sf_dir, "documents")).drop("longest_repeat")  # what of it counts is in kept


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _fold(5, 0))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_OP3 = """
WITH lines AS (
  SELECT DISTINCT doc_id, coalesce(source, chr(1)) AS source, trim(x, chr(32) || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents)
), boiler AS (
  SELECT line, min(doc_id) AS first_id FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), hit AS (
  SELECT doc_id, list(line) AS gone FROM lines JOIN boiler USING (line) WHERE doc_id <> first_id GROUP BY doc_id
)
SELECT d.doc_id, d.source,
  CASE WHEN gone IS NULL THEN text ELSE
    array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, trim(x, chr(32) || chr(9) || chr(13)))), chr(10)) END AS text
FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id
"""

_WORD = r"[^\x20\x09-\x0D]"

# Shingle sets, pairs that share a shingle, exact links, and all that is reachable over them.
_OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM w
), s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE i = 1 OR i + 4 <= n
), n AS (
  SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b, common = x.n AND common = y.n AS same FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
), e AS (
  SELECT a AS doc_id, min(b) AS equal_id FROM link WHERE same GROUP BY a
)
SELECT doc_id, n.n AS n_shingles, least(doc_id, equal_id) AS class_id, component_id, doc_id = component_id AS kept
FROM n JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""

# A word is covered by a repeat of k words or more just if a window of k words around it stands in the text twice.
_OP6 = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{_WORD}+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w
), q AS (
  SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g3, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g5
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, unnest(list(i)) AS i, 3 AS k FROM q WHERE g3 IS NOT NULL GROUP BY doc_id, g3 HAVING count(*) > 1
  UNION ALL SELECT doc_id, unnest(list(i)), 5 FROM q WHERE g5 IS NOT NULL GROUP BY doc_id, g5 HAVING count(*) > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + j.range) FILTER (k = 3) AS three, count(DISTINCT i + j.range) FILTER (k = 5) AS five FROM g, range(5) j WHERE j.range < k GROUP BY doc_id
), long AS (
  SELECT doc_id FROM (SELECT doc_id, w, unnest(range(1, len(w) - 99)) AS i FROM w JOIN c USING (doc_id) WHERE five > 100) GROUP BY doc_id, array_to_string(w[i : i + 100], ' ') HAVING count(*) > 1
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(three, 0) AS n_repeat_words, coalesce(five, 0) AS n_covered_words
  FROM w LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_covered_words, base_failed,
  NOT (base_failed OR n_covered_words > 0.3 * n_words OR doc_id IN (SELECT doc_id FROM long)) AS kept
FROM b
"""

_OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

# crc: the CRC-32 of an ASCII text, eight shifts after each character. path: for each state the cheapest, then least, edits of the first i rows.
_OP12 = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), g AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(key, ''), lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) % 20 AS kind FROM c
), e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE kind <> 0
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, NOT regexp_matches(text, '{_WORD}') AS blank, substr(role, 1, 1) AS ini FROM e
), d AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM f
), r AS (
  SELECT *, NOT blank AND NOT duplicate AND regexp_extract(text, '({_WORD})[\\x20\\x09-\\x0D]*\\z', 1) NOT IN ('.', '!', '?') AS truncated FROM d
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id
), edit(q, t, a, ini) AS (
  VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'), (0, 2, 'R', ''), (1, 2, 'R', ''), (3, 2, 'R', ''), (2, 3, 'R', '')
), ins(q, t, c, a, o) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
), path AS (
  SELECT conv_id, 0 AS i, 0 AS q, 0 AS c, '' AS a, []::VARCHAR[] AS o FROM ids
  UNION ALL SELECT conv_id, i, q, c, a, o FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY c, a) AS k FROM (
      SELECT p.conv_id, p.i + 1 AS i, edit.t AS q, p.c + ins.c + CASE edit.a WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN truncated AND edit.a <> 'D' THEN 5 ELSE 0 END AS c, p.a || ins.a || edit.a AS a,
        list_concat(list_concat(p.o, ins.o), CASE edit.a WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE edit.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END) AS o
      FROM path p JOIN ins ON ins.q = p.q JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
        JOIN edit ON edit.q = ins.t AND (edit.a = 'D' OR NOT (blank OR duplicate) AND (edit.a = 'R' OR edit.ini = r.ini)))) WHERE k = 1
), last AS (
  SELECT p.conv_id, p.c + ins.c AS cost, p.a || ins.a AS audit, list_concat(p.o, ins.o) AS o FROM path p LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM p.conv_id JOIN ins ON ins.q = p.q
  WHERE p.i = coalesce(told.n, 0) AND ins.t IN (0, 3) QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost, audit) = 1
)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(o, chr(10))) AS repaired_sha256
FROM last LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM last.conv_id
"""

_OP13 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, text, length(text) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM t
), p AS (
  SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), o AS (
  SELECT *, '<P>' || substr(text, 1, a) AS pre, '<S>' || substr(text, b + 1) AS suf, '<M>' || substr(text, a + 1, b - a) AS mid FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""


def oracle_sql() -> dict[str, str]:
    """Only where SQL gives the same rows; tests/llm compares the others with brute force."""
    return {"op3_line_dedup": _OP3, "op4_minhash_dedup": _OP4, "op6_quality_rules": _OP6, "op10_exact_topk": _OP10, "op12_conversation_repair": _OP12, "op13_fill_in_middle": _OP13}

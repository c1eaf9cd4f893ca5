"""SQL for the change-point queries: the searches spelled out over every admissible partition of every series.

The test view has 30 days, so cuts at multiples of 5 leave at most 32 partitions of a series, and two
breaks anywhere some 300; SQL can list them all, independently of the dynamic programs that it checks.
Costs are shares of their series' spread (or sum of squares) rounded to 10 digits on both sides, so that ties are ties.
"""

from __future__ import annotations

from rillgrid.operators.segmentation import COARSE, CRITERIA, IC_TARGET, PELT_TARGET, SCALES, TOLERANCE

MEDIANS = "med AS (SELECT series, ts, median(v) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v, v AS raw FROM obs)"

# f: the values that are there, numbered by i; ps: running sums before each k, with t the numbers or, for BFAST, the days
BASE = f""", {MEDIANS},
x AS (SELECT series, ts, v, raw, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos FROM med),
f AS (SELECT series, v, v - avg(v) OVER (PARTITION BY series) AS vc, pos, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM x WHERE v IS NOT NULL),
ps AS (SELECT series, n, 0 AS k, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q, 0.0::DOUBLE AS t, 0.0::DOUBLE AS tt, 0.0::DOUBLE AS st, 0.0::DOUBLE AS rq, 0.0::DOUBLE AS rst FROM f GROUP BY series, n
  UNION ALL SELECT series, n, i + 1, sum(vc) OVER w, sum(vc * vc) OVER w, sum(CAST($t AS DOUBLE)) OVER w, sum(CAST($t * $t AS DOUBLE)) OVER w, sum(vc * $t) OVER w, sum(v * v) OVER w, sum(v * $t) OVER w FROM f WINDOW w AS (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT * FROM ps WHERE k = 0 OR k = n OR ($points)),
d AS (SELECT a.series, a.n, a.k AS i, b.k AS j, b.k - a.k AS c, b.s - a.s AS s, b.q - a.q AS q, b.t - a.t AS t, b.tt - a.tt AS tt, b.st - a.st AS st, b.rq - a.rq AS rq, b.rst - a.rst AS rst FROM pt a JOIN pt b ON a.series = b.series AND a.k < b.k),
unit AS (SELECT series, CASE WHEN q > 1e-20 * rq THEN q END AS u, nullif(rq, 0) AS r FROM ps WHERE k = n),
cost AS (SELECT d.series, n, i, j, coalesce(u, 0) AS u, coalesce(round(greatest(0, q - s * s / c) / u, 10), 0) AS l2,
  coalesce(round(CASE WHEN c < 2 THEN 0 ELSE greatest(0, rq - CASE WHEN tt > 1e-15 THEN rst * rst / tt ELSE 0 END) END / r, 10), 0) AS plain,
  coalesce(round(CASE WHEN c < 2 THEN 0 ELSE greatest(0, q - s * s / c - CASE WHEN tt - t * t / c > 1e-15 THEN (st - t * s / c) * (st - t * s / c) / (tt - t * t / c) ELSE 0 END) END / u, 10), 0) AS line FROM d JOIN unit ON unit.series = d.series)"""


def base(t: str, points: str) -> str:
    return BASE.replace("$t", t).replace("$points", points)


FIVES = base("i", "k % 5 = 0 AND k >= 5 AND k <= n - 5")

PATHS = """, path AS (SELECT DISTINCT series, n, 0 AS p, -1 AS m, 0.0::DOUBLE AS rss, []::BIGINT[] AS cuts FROM f WHERE n >= 5
  UNION ALL SELECT path.series, path.n, c.j, path.m + 1, path.rss + c.l2, CASE WHEN c.j < path.n THEN list_append(path.cuts, c.j) ELSE path.cuts END FROM path JOIN cost c ON c.series = path.series AND c.i = path.p WHERE path.p < path.n),
model AS (SELECT path.series, n, m, rss * coalesce(u, 0) AS rss, cuts FROM path JOIN unit ON unit.series = path.series WHERE p = n QUALIFY row_number() OVER (PARTITION BY path.series, m ORDER BY path.rss, list_reverse(cuts)) = 1),
var AS (SELECT series, var_pop(raw) AS r, var_pop(v) AS sm FROM x GROUP BY series)"""


def _picked(name: str, penalties: str) -> str:
    return f""", {name} AS (SELECT series, n, ps, m, rss, cuts FROM (SELECT model.series, n, ps, m, rss, cuts, rss + ps * CASE WHEN r > 0 THEN r ELSE sm END * ln(n) * m AS total FROM model JOIN var ON model.series = var.series, {penalties})
  QUALIFY row_number() OVER (PARTITION BY series, ps ORDER BY total, m) = 1)"""


def _rates(name: str, of: str) -> str:
    return f", {name} AS (SELECT ps AS penalty_scale, (SELECT count(DISTINCT series) FROM obs) AS n_total, count(*) FILTER (m > 0) AS n_with_breaks, count(*) FILTER (m > 0) / (SELECT count(DISTINCT series) FROM obs) AS rate FROM {of} GROUP BY ps)"


_COARSE = "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in COARSE) + ")"
SWEEP = (
    _picked("coarse", f"{_COARSE} p(ps)") + _rates("first", "coarse")
    + f", best AS (SELECT penalty_scale AS b, abs(rate - {PELT_TARGET!r}) AS d FROM first ORDER BY d, b LIMIT 1)"
    + f", fine AS (SELECT DISTINCT round(b + k.range * 0.1::DOUBLE, 3) AS ps FROM best, range(-20, 21) k WHERE d > {TOLERANCE} AND round(b + k.range * 0.1::DOUBLE, 3) >= 0.1 AND round(b + k.range * 0.1::DOUBLE, 3) NOT IN (SELECT * FROM {_COARSE} p(ps)))"
    + _picked("finer", "fine") + _rates("second", "finer") + ", swept AS (SELECT * FROM first UNION ALL SELECT * FROM second)"
)

# A long series by the plain recurrence over all earlier points, no candidate left out; f: least cost so far, as shares of the spread
LONG = """WITH RECURSIVE y AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS ts, round(avg(l_discount), 9) AS v FROM lineitem GROUP BY 1, 2),
x AS (SELECT series, v - avg(v) OVER w AS c, row_number() OVER (PARTITION BY series ORDER BY ts) AS k, count(*) OVER w AS n, var_pop(v) OVER w AS var FROM y WINDOW w AS (PARTITION BY series)),
ps AS (SELECT series, k, n, var, sum(c) OVER o AS s, sum(c * c) OVER o AS q FROM x WINDOW o AS (PARTITION BY series ORDER BY k ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT series, n, max(var) AS var, list_prepend(0, list(k ORDER BY k)) AS k, list_prepend(0.0, list(s ORDER BY k)) AS s, list_prepend(0.0, list(q ORDER BY k)) AS q FROM ps WHERE k = n OR (k % 5 = 0 AND k <= n - 5) GROUP BY series, n),
g AS (SELECT series, n, k, s, q, q[-1] AS u, ps, ps * var * ln(n) / q[-1] AS beta FROM pts, (VALUES (0.5::DOUBLE), (2.0)) p(ps) WHERE n >= 5 AND q[-1] > 0),
walk AS (SELECT series, ps, 1 AS t, [0.0::DOUBLE] AS f, [0] AS m, [1] AS back FROM g
  UNION ALL SELECT series, ps, t + 1, list_append(f, b.total), list_append(m, b.m), list_append(back, b.i) FROM (
    SELECT w.*, list_min(list_transform(list_filter(range(1, t + 1), lambda i: k[t + 1] - k[i] >= 5), lambda i: {'r': round(f[i] + round(greatest(0, q[t + 1] - q[i] - (s[t + 1] - s[i]) * (s[t + 1] - s[i]) / (k[t + 1] - k[i])) / u, 10) + CASE WHEN i > 1 THEN beta ELSE 0 END, 12),
      'm': w.m[i] + CASE WHEN i > 1 THEN 1 ELSE 0 END, 'i': CAST(i AS INTEGER), 'total': f[i] + round(greatest(0, q[t + 1] - q[i] - (s[t + 1] - s[i]) * (s[t + 1] - s[i]) / (k[t + 1] - k[i])) / u, 10) + CASE WHEN i > 1 THEN beta ELSE 0 END})) AS b
    FROM walk w JOIN g ON g.series = w.series AND g.ps = w.ps WHERE t < len(k))),
ended AS (SELECT w.series, w.ps, g.k, w.back, w.m[t] AS m, (w.f[t] - g.beta * w.m[t]) * g.u AS rss, t FROM walk w JOIN g ON g.series = w.series AND g.ps = w.ps WHERE t = len(g.k)),
trace AS (SELECT series, ps, k, back, m, rss, back[t] AS i FROM ended UNION ALL SELECT series, ps, k, back, m, rss, back[i] FROM trace WHERE i > 1)
SELECT series, ps AS penalty_scale, m, round(rss, 9) AS rss, CAST(CASE WHEN i > 1 THEN k[i] END AS INTEGER) AS break_index FROM trace WHERE i > 1 OR m = 0"""

PELT_SWEEP = FIVES + PATHS + SWEEP + " SELECT * FROM swept"
PELT_BREAKS = FIVES + PATHS + _picked("chosen", "(VALUES (2.0::DOUBLE)) p(ps)") + """, e AS (SELECT series, ps, m, rss, unnest(CASE WHEN m = 0 THEN [NULL] ELSE cuts END) AS c FROM chosen)
SELECT e.series, ps AS penalty_scale, m, round(rss, 9) AS rss, CAST(f.pos + 1 AS INTEGER) AS break_index FROM e LEFT JOIN f ON f.series = e.series AND f.i = e.c - 1"""
PELT_CHOSEN = FIVES + PATHS + SWEEP + f""", nearest AS (SELECT penalty_scale AS b FROM swept ORDER BY abs(rate - {PELT_TARGET!r}), penalty_scale LIMIT 1)""" + _picked("chosen", "(SELECT b AS ps FROM nearest)") + """
SELECT chosen.series, ps AS penalty_scale, m, CAST(greatest(0, least(f.pos + 1, chosen.n - 1)) AS INTEGER) AS break_index FROM (SELECT series, n, ps, m, unnest(cuts) AS c FROM chosen WHERE m > 0) chosen JOIN f ON f.series = chosen.series AND f.i = chosen.c - 1"""

SPLITS = """, gs AS (SELECT DISTINCT series, n, 0 AS m, [0, n] AS edges FROM f WHERE n >= 5
  UNION ALL SELECT series, n, m, edges FROM (
    SELECT gs.series, gs.n, gs.m + 1 AS m, list_sort(list_append(gs.edges, pt.k)) AS edges, row_number() OVER (PARTITION BY gs.series ORDER BY w.plain - u.plain - v.plain DESC, pt.k) AS o
    FROM gs JOIN pt ON pt.series = gs.series AND NOT list_contains(gs.edges, pt.k)
    JOIN cost u ON u.series = gs.series AND u.j = pt.k AND u.i = list_max(list_filter(gs.edges, lambda e: e < pt.k))
    JOIN cost v ON v.series = gs.series AND v.i = pt.k AND v.j = list_min(list_filter(gs.edges, lambda e: e > pt.k))
    JOIN cost w ON w.series = gs.series AND w.i = u.i AND w.j = v.j
    WHERE gs.m < least(3, gs.n // 5 - 1)) WHERE o = 1),
pieces AS (SELECT series, n, m, edges, unnest(edges[:-2]) AS i, unnest(edges[2:]) AS j FROM gs),
model AS (SELECT p.series, p.n, p.m, sum(c.line) * max(c.u) AS rss FROM pieces p JOIN cost c ON c.series = p.series AND c.i = p.i AND c.j = p.j GROUP BY p.series, p.n, p.m)"""


def _choice(name: str, grid: str) -> str:
    return f""", {name} AS (SELECT series, criterion, scale, m FROM (SELECT series, criterion, scale, m, n * ln(greatest(rss, 1e-12) / n) + CASE WHEN criterion = 'LWZ' THEN scale * 0.299 * pow(ln(n), 2.1) * (m + 1) * 2 ELSE scale * (m + 1) * 2 * ln(n) END AS score FROM model, {grid})
  QUALIFY row_number() OVER (PARTITION BY series, criterion, scale ORDER BY score, m) = 1)"""


def _ic_rates(name: str, of: str) -> str:
    return f", {name} AS (SELECT criterion, scale, (SELECT count(DISTINCT series) FROM obs) AS n_total, count(*) FILTER (m > 0) AS n_with_breaks, count(*) FILTER (m > 0) / (SELECT count(DISTINCT series) FROM obs) AS rate FROM {of} GROUP BY criterion, scale)"


def _scales() -> list[float]:
    out = list(SCALES)
    while max(out) < 6.0:
        out.append(round(min(6.0, max(out) * 1.5), 3))
    return out


_ALL = _scales()
_TOP = len(SCALES) - 1
# step: how far the scales grow, first for LWZ, then from there for BIC; each while too many series have a break
BINSEG_SWEEP = FIVES + SPLITS + _choice("every", "(VALUES " + ", ".join(f"({k}, {x}::DOUBLE)" for k, x in enumerate(_ALL)) + ") s(step, scale), (VALUES ('LWZ'), ('BIC')) c(criterion)") + _ic_rates("rates", "every") + f""",
steps AS (SELECT rates.*, step FROM rates JOIN (VALUES {", ".join(f"({k}, {x}::DOUBLE)" for k, x in enumerate(_ALL))}) s(step, scale) USING (scale)),
one AS (SELECT coalesce(min(step), {len(_ALL) - 1}) AS k FROM steps WHERE criterion = '{CRITERIA[0]}' AND step >= {_TOP} AND NOT rate > {IC_TARGET} + {TOLERANCE}),
two AS (SELECT coalesce(min(step), {len(_ALL) - 1}) AS k FROM steps, one WHERE criterion = '{CRITERIA[1]}' AND step >= one.k AND NOT rate > {IC_TARGET} + {TOLERANCE}),
found AS (SELECT steps.* FROM steps, two WHERE step <= two.k),
best AS (SELECT criterion AS bc, scale AS bs FROM found ORDER BY abs(rate - {IC_TARGET}), criterion, scale LIMIT 1),
fine AS (SELECT DISTINCT bc AS criterion, round(bs + k.range * 0.05::DOUBLE, 3) AS scale FROM best, range(-10, 11) k WHERE round(bs + k.range * 0.05::DOUBLE, 3) >= 0.1 AND round(bs + k.range * 0.05::DOUBLE, 3) NOT IN (SELECT round(scale, 3) FROM found WHERE criterion = bc))""" + _choice("finer", "fine") + _ic_rates("more", "finer") + " SELECT criterion, scale, n_total, n_with_breaks, rate FROM found UNION ALL SELECT criterion, scale, n_total, n_with_breaks, rate FROM more"

JOINS = """, gs AS (SELECT series, n, list(k ORDER BY k) AS edges FROM pt WHERE n >= 5 GROUP BY series, n
  UNION ALL SELECT series, n, edges FROM (
    SELECT gs.series, gs.n, list_filter(gs.edges, lambda e: e <> pt.k) AS edges, row_number() OVER (PARTITION BY gs.series ORDER BY w.l2 - u.l2 - v.l2, pt.k) AS o
    FROM gs JOIN pt ON pt.series = gs.series AND list_contains(gs.edges, pt.k) AND pt.k > 0 AND pt.k < gs.n
    JOIN cost u ON u.series = gs.series AND u.j = pt.k AND u.i = list_max(list_filter(gs.edges, lambda e: e < pt.k))
    JOIN cost v ON v.series = gs.series AND v.i = pt.k AND v.j = list_min(list_filter(gs.edges, lambda e: e > pt.k))
    JOIN cost w ON w.series = gs.series AND w.i = u.i AND w.j = v.j) WHERE o = 1),
pieces AS (SELECT series, n, edges, unnest(edges[:-2]) AS i, unnest(edges[2:]) AS j FROM gs),
model AS (SELECT p.series, p.n, p.edges, sum(c.l2) * max(c.u) AS rss FROM pieces p JOIN cost c ON c.series = p.series AND c.i = p.i AND c.j = p.j GROUP BY p.series, p.n, p.edges)"""
BOTTOMUP = FIVES + JOINS + """ SELECT series, CAST(n AS INTEGER) AS n, CAST(len(edges) - 2 AS INTEGER) AS m, round(rss, 9) AS rss, array_to_string(edges[2:-2], ',') AS cuts FROM model WHERE len(edges) - 2 <= least(3, n // 5 - 1)"""

# BFAST: every pair of cuts of each h, then the measures of the cuts inside the guard
_BFAST = base("pos", "true").replace("WITH ", "") + """, hs AS (SELECT DISTINCT f.series, f.n, h, CAST(floor(h * f.n) AS INTEGER) AS size FROM f, (VALUES (0.08::DOUBLE), (0.10), (0.12)) v(h) WHERE floor(h * f.n) >= 3),
part AS (
  SELECT hs.series, hs.n, h, 0 AS m, a.line AS rss, []::BIGINT[] AS cuts FROM hs JOIN cost a ON a.series = hs.series AND a.i = 0 AND a.j = hs.n
  UNION ALL SELECT hs.series, hs.n, h, 1, a.line + b.line, [a.j] FROM hs JOIN cost a ON a.series = hs.series AND a.i = 0 AND a.j >= size JOIN cost b ON b.series = hs.series AND b.i = a.j AND b.j = hs.n AND b.j - b.i >= size
  UNION ALL SELECT hs.series, hs.n, h, 2, a.line + b.line + c.line, [a.j, b.j] FROM hs JOIN cost a ON a.series = hs.series AND a.i = 0 AND a.j >= size JOIN cost b ON b.series = hs.series AND b.i = a.j AND b.j - b.i >= size JOIN cost c ON c.series = hs.series AND c.i = b.j AND c.j = hs.n AND c.j - c.i >= size),
least_ AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY series, h, m ORDER BY rss, list_reverse(cuts)) = 1),
pick AS (SELECT series, n, h, m, cuts FROM least_ QUALIFY row_number() OVER (PARTITION BY series, h ORDER BY n * ln(greatest(rss, 1e-12) / n) + 0.299 * pow(ln(n), 2.1) * 2 * (m + 1), m) = 1),
days AS (SELECT count(DISTINCT ts) AS T FROM obs),
cut AS (SELECT c.series, h, CAST(f.pos AS BIGINT) AS c FROM (SELECT series, h, unnest(cuts) AS i FROM pick) c JOIN f ON f.series = c.series AND f.i = c.i, days WHERE f.pos >= 5 AND f.pos <= T - 6),
side AS (SELECT series, h, c, lag(c, 1, 0) OVER w AS a, lead(c, 1, T) OVER w AS b, T FROM cut, days WINDOW w AS (PARTITION BY series, h ORDER BY c)),
meas AS (SELECT s.series, s.h, s.c, s.T,
  avg(x.v) FILTER (pos >= a AND pos < c) AS mu_pre, avg(x.v) FILTER (pos >= c AND pos < b) AS mu_post,
  CASE WHEN count(x.v) FILTER (pos >= a AND pos < c) > 1 THEN regr_slope(x.v, pos) FILTER (pos >= a AND pos < c) END AS slope_pre, CASE WHEN count(x.v) FILTER (pos >= c AND pos < b) > 1 THEN regr_slope(x.v, pos) FILTER (pos >= c AND pos < b) END AS slope_post,
  (T - 1) * var_samp(x.v) AS total,
  (c - 1) * coalesce(var_samp(x.v) FILTER (pos < c), 0) + (T - c - 1) * coalesce(var_samp(x.v) FILTER (pos >= c), 0) AS own,
  (c - a - 1) * coalesce(var_samp(x.v) FILTER (pos >= a AND pos < c), 0) AS before_, (b - c - 1) * coalesce(var_samp(x.v) FILTER (pos >= c AND pos < b), 0) AS after_, b
  FROM side s JOIN x ON x.series = s.series GROUP BY s.series, s.h, s.c, s.a, s.b, s.T),
gain AS (SELECT *, mu_post - mu_pre AS delta, slope_post - slope_pre AS turn, CASE WHEN total > 0 THEN 1 - own / total END AS one,
  CASE WHEN total > 0 THEN 1 - (sum(before_) OVER (PARTITION BY series, h) + sum(CASE WHEN b = T THEN after_ ELSE 0 END) OVER (PARTITION BY series, h)) / total END AS whole FROM meas),
known AS (SELECT *, coalesce(abs(delta) >= 0.10 AND abs(turn) >= 0.001 AND whole >= 0.10, false) AS gate, coalesce(abs(delta) >= 0.10 AND abs(turn) >= 0.001 AND one >= 0.10, false) AS passes FROM gain WHERE mu_pre IS NOT NULL AND mu_post IS NOT NULL),
hit AS (SELECT k.* FROM known k JOIN (SELECT series, min(h) AS h FROM known WHERE gate GROUP BY series) g ON g.series = k.series AND g.h = k.h),
rows_ AS (SELECT s.series, h, CASE WHEN h IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY s.series) END AS break_count, CASE WHEN h IS NOT NULL THEN row_number() OVER (PARTITION BY s.series ORDER BY c) END AS break_k, c AS break_index,
  mu_pre, mu_post, delta, slope_pre, slope_post, one AS twsv_improve, CASE WHEN h IS NULL THEN 'no-break' WHEN delta >= 0.10 THEN 'L→W' WHEN delta <= -0.10 THEN 'W→L' ELSE 'weak/unclear' END AS label_raw,
  CASE WHEN h IS NULL THEN 'no-break' WHEN NOT passes THEN 'weak/unclear' WHEN delta > 0 THEN 'L→W' ELSE 'W→L' END AS label FROM (SELECT DISTINCT series FROM obs) s LEFT JOIN hit ON hit.series = s.series)"""
BFAST = _BFAST + " SELECT series, h, CAST(break_count AS INTEGER) AS break_count, CAST(break_k AS INTEGER) AS break_k, CAST(break_index AS INTEGER) AS break_index, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("mu_pre", "mu_post", "delta", "slope_pre", "slope_post", "twsv_improve")) + ", label_raw, label FROM rows_"
LABELS = _BFAST + " SELECT label, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM rows_), 2) AS pct FROM rows_ GROUP BY label"


def recursive(sql: str) -> str:
    """sql whose first WITH allows its tables to name themselves."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)

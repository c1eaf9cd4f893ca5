"""Exact top-k inner products by best-first search of M-trees (operator 10).

Vectors are integers: floor(scale * x), held as doubles, which hold them exactly. An inner product
becomes a metric by one more coordinate, sqrt(M^2 - |v|^2) with M the longest vector of a tree: the
squared distance to a query (coordinate 0 there) is |q|^2 + M^2 - 2 q.v, so the nearest are the
largest products. Each task bulk-loads trees of at most ``TREE`` vectors, paged: a node holds its
children's pivots, covering radii and distances to its own pivot. A search pops the node of the best
bound; the distances to the parent rule out children before any distance is computed (triangle
inequality), radii rule out the rest. Bounds keep a margin, so that no tie is lost. Products below
2^53 are exact in doubles; where a tree and a query could pass that, doubles only choose the rows
whose products are then added up in whole numbers of any size.

The queries are searched in blocks of about ``QUERY_MB``: a block is broadcast, each task searches its
trees, and a window over the few best rows of each task gives the result. Equal vectors are one entry
of a tree; of their sorted ids at most k rows of each and 2k in all are kept: without a query's own, k
others are left if there were.

Vectors that are null, or hold null or non-finite components (before or after scaling), and rows
without an id take no part. Rows with a query's id are its own row and no candidate; a query id with
several vectors asks with the smallest of them. Vectors of another length than the query's are not
compared with it; empty vectors have product 0. Scores beyond 64 bits rank exactly and are returned as
the nearest long. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rillgrid.llm.scratch import written

TREE, PAGE, FANOUT, QUERY_MB = 8192, 256, 16, 16
EXACT, HUGE = 2.0**53, 2.0**480  # sums of products below the first are exact in doubles; beyond the second no distance is taken
LONG = (1 << 63) - 1


def largest(vectors: np.ndarray) -> float:
    return float(np.abs(vectors).max(initial=0.0))


def product(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product in whole numbers of any size."""
    return sum(int(x) * int(y) for x, y in zip(a, b, strict=True))


def build(vectors: np.ndarray, ids: list[np.ndarray], seed: int = 0) -> dict:
    """An M-tree over distinct whole-numbered vectors (doubles); ids: the ids of each."""
    vectors = vectors.astype(np.float64)
    most = largest(vectors)
    if most >= HUGE:  # a single page, no distances
        return {"nodes": [{"rows": np.arange(len(vectors)), "to_parent": np.zeros(len(vectors)), "page": vectors}], "ids": ids, "top": 0.0, "most": most}
    if vectors.shape[1] * most**2 < EXACT:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        top, rest = float(norms.max()), norms.max() - norms
    else:
        exact = [product(v, v) for v in vectors]
        top, rest = float(max(exact)), np.array([float(max(exact) - x) for x in exact])
    points = np.c_[vectors, np.sqrt(rest)]
    rng = np.random.default_rng(seed)
    nodes: list[dict] = []

    def load(rows: np.ndarray, pivot: np.ndarray | None) -> int:
        at = len(nodes)
        nodes.append({})
        near = np.linalg.norm(points[rows] - pivot, axis=1) if pivot is not None else np.zeros(len(rows))
        if len(rows) <= PAGE:
            by = np.argsort(near, kind="stable")
            nodes[at] = {"rows": rows[by], "to_parent": near[by]}
            return at
        chosen, gap = [int(rng.integers(len(rows)))], None
        while len(chosen) < FANOUT:  # far apart
            d = np.linalg.norm(points[rows] - points[rows[chosen[-1]]], axis=1)
            gap = d if gap is None else np.minimum(gap, d)
            if gap.max() == 0:
                break
            chosen.append(int(gap.argmax()))
        centre = points[rows[chosen]]
        d = np.stack([np.linalg.norm(points[rows] - c, axis=1) for c in centre])
        home = d.argmin(0)
        used = [c for c in range(len(centre)) if (home == c).any()]
        if len(used) == 1:  # nothing tells these rows apart
            by = np.argsort(near, kind="stable")
            nodes[at] = {"rows": rows[by], "to_parent": near[by]}
            return at
        kids = [load(rows[home == c], centre[c]) for c in used]
        nodes[at] = {"pivots": centre[used], "radii": np.array([d[c][home == c].max() for c in used]), "to_parent": np.linalg.norm(centre[used] - pivot, axis=1) if pivot is not None else None, "kids": kids}
        return at

    load(np.arange(len(vectors)), None)
    for node in nodes:
        if "rows" in node:
            node["page"] = vectors[node["rows"]]
    return {"nodes": nodes, "ids": ids, "top": top, "most": most}


def search(tree: dict, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]], count: list[int] | None = None) -> None:
    """Adds to best, a heap of (product, -id) of at most k entries, what the tree has that is better."""
    nodes, ids, query = tree["nodes"], tree["ids"], query.astype(np.float64)
    most = largest(query)
    bound = len(query) * most * tree["most"]  # of any product
    exact, blind = bound < EXACT, not bound < HUGE**2 or most >= HUGE or tree["most"] >= HUGE
    const = 0.0 if blind else float(query @ query) + tree["top"]
    margin = 1e-9 * (const + 1) + 1e-6
    slack = 0.0 if exact else 1e-12 * bound  # how far a product in doubles may be off
    q = np.r_[query, 0.0]

    def reach() -> float:
        """The distance beyond which nothing can enter."""
        return np.inf if blind or len(best) < k else np.sqrt(max(0.0, const - 2.0 * float(best[0][0]) + margin))

    heap = [(0.0, 0, -1.0)]  # bound, node, distance of the query to the node's pivot
    while heap:
        low, at, far = heapq.heappop(heap)
        limit = reach()
        if low > limit:
            break
        node = nodes[at]
        if "rows" in node:
            rows, page = node["rows"], node["page"]
            if far >= 0 and limit < np.inf:
                lo, hi = np.searchsorted(node["to_parent"], far - limit), np.searchsorted(node["to_parent"], far + limit, "right")
                rows, page = rows[lo:hi], page[lo:hi]
            if count is not None:
                count[0] += len(rows)
            products = page @ query if not blind else None
            for i in range(len(rows)) if blind or len(best) < k else np.flatnonzero(products >= float(best[0][0]) - slack):
                score = int(products[i]) if exact else product(page[i], query)
                for one in ids[rows[i]]:
                    entry = (score, -int(one))
                    if one == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
            continue
        kids = np.arange(len(node["kids"]))
        if far >= 0 and limit < np.inf:
            kids = kids[np.abs(far - node["to_parent"]) - node["radii"] <= limit]
        if count is not None:
            count[0] += len(kids)
        for c, d in zip(kids, np.linalg.norm(node["pivots"][kids] - q, axis=1), strict=True):
            if (low := max(0.0, d - node["radii"][c] - margin ** 0.5 * 1e-3)) <= limit:
                heapq.heappush(heap, (low, node["kids"][c], float(d)))


def whole(lists: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x) of all components, offsets) of an array of lists."""
    at = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
    return np.floor(values * float(scale)) + 0.0, at - at[0]


def _builder(k: int, scale: int):
    def trees(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        by = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids)
        vectors, ids = vectors[by], ids[by]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)]
        again = np.arange(len(ids))
        nth = again - np.maximum.accumulate(np.where(new | np.r_[True, ids[1:] != ids[:-1]], again, 0))
        first = np.flatnonzero(new)
        groups = [g[n < k][: 2 * k] for g, n in zip(np.split(ids, first[1:]), np.split(nth, first[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([vectors.shape[1]], pa.int32()), pa.array([pickle.dumps(build(vectors[first], groups), 5)], pa.binary())], names=["length", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            flat, at = whole(batch.column(1), scale)
            length, ids = np.diff(at), batch.column(0).to_numpy()
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                parts = held.setdefault(int(n), [])
                parts.append((ids[mine], flat[at[mine][:, None] + np.arange(n)[None, :]]))
                if sum(len(p[0]) for p in parts) >= TREE:
                    all_ids, all_ = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    full = len(all_ids) // TREE * TREE
                    for lo in range(0, full, TREE):
                        yield trees(all_ids[lo : lo + TREE], all_[lo : lo + TREE])
                    held[int(n)] = [(all_ids[full:], all_[full:])] if full < len(all_ids) else []
        for parts in held.values():
            if parts:
                yield trees(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    return run


def ordered(score: int) -> str | None:
    """A text that sorts as the score does, for scores that no long can hold."""
    if -LONG <= score < LONG:
        return None
    digits = f"{len(str(abs(score))):06d}{abs(score)}"
    return "1" + digits if score > 0 else "0" + "".join(chr(105 - ord(c)) for c in digits) + ":"


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flat, at = shared.value
        best: list[list] = [[] for _ in ids]
        length = np.diff(at)
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = pickle.loads(blob.as_py())
                for i in np.flatnonzero(length == n):
                    search(tree, flat[at[i] : at[i + 1]], int(ids[i]), k, best[i])
        rows = [(int(own), -i, max(-LONG - 1, min(LONG, s)), ordered(s)) for own, found in zip(ids, best, strict=True) for s, i in found]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array([r[3] for r in rows], pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, vector (doubles, not scaled) of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * float(scale)) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fit).select(F.col(id_col).cast("long").alias("id"), x.alias("vector"))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, query_mb: float = QUERY_MB) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer products, ties to the smaller id."""
    spark = rows.sparkSession
    trees = written(usable(rows, id_col, vector_col, scale).mapInArrow(_builder(k, scale), "length int, tree binary"), "trees")
    asked = written(usable(rows.where(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    room = asked.agg(F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0)).alias("bytes")).first().bytes
    blocks = max(1, int(-(-room // (query_mb * (1 << 20)))))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        lists = part.column("vector").combine_chunks()
        shared = spark.sparkContext.broadcast((part.column("id").to_numpy(), *(whole(lists, scale) if len(lists) else (np.zeros(0), np.zeros(1, np.int64)))))
        hits = written(trees.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score long, beyond string"), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

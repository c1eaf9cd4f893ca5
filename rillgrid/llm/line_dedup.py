"""Cross-site boilerplate lines by distinct-site spread (operator 3), in DataFrame functions only.

A line is a ``\\n``-separated part of a text, trimmed of spaces, tabs and returns;
blank lines are no lines. Each line's hash keeps a HyperLogLog sketch of the sites it
was seen on; sketches merge map-side and again after the shuffle, so a line that a
third of all texts hold costs each task one small sketch. Lines whose estimate lies
near the threshold get an exact count of distinct sites. A line on ``min_sites`` sites
or more is boilerplate: it stays in the document of the smallest id that holds it, so
that nothing is lost from the corpus, and goes from all others.

Documents stay, even when no line is left (empty text). Null texts stay null, null
sites count as one site of their own, documents with a null id lose each boilerplate
line. Rows that repeat an id are one document. An empty table gives an empty one;
other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillgrid.llm.scratch import small, written

MIN_SITES = 10
SKETCH_BITS = 6  # 64 registers: a standard error of 13 %
BAND = 0.5  # estimates within this share of the threshold are counted exactly
NO_ID_PARTS = 64  # rows with a null id meet what they lose in so many parts


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    split = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("")).alias("site"), F.explode(F.array_distinct(F.transform(F.split(F.col(text_col), "\n", -1), _trimmed))).alias("line"))
    return split.where("line != ''").select("id", "site", F.xxhash64("line").alias("line"))


def spread(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The boilerplate lines, written: line (hash), sites (exact or, far above the threshold, estimated), n_docs, first_id."""
    lines = _lines(docs, id_col, text_col, site_col)
    seen = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.count("*").alias("n_docs"), F.min("id").alias("first_id"))
    likely = written(
        seen.where(f"n_docs >= {int(min_sites)}").withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= min_sites * (1 - BAND)).drop("sketch"), "likely-lines"
    )
    near = likely.where(F.col("sites") <= min_sites * (1 + BAND)).select("line")
    exact = lines.join(small(near), "line", "left_semi").groupBy("line", "site").agg(F.lit(1)).groupBy("line").agg(F.count("*").alias("exact"))
    return written(likely.join(exact, "line", "left").withColumn("sites", F.coalesce("exact", "sites")).drop("exact").where(F.col("sites") >= min_sites), "boilerplate")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the same columns and rows; text_col without lines that are boilerplate and first seen in another document."""
    found = spread(docs, id_col, text_col, site_col, min_sites)
    hits = _lines(docs, id_col, text_col, site_col).join(small(found.select("line", "first_id")), "line").where("NOT (id <=> first_id)")
    drops = written(hits.groupBy("id").agg(F.collect_set("line").alias("lines")), "line-drops")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    id_, text = F.col(names[id_col]), F.col(names[text_col])
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col("lines"), F.xxhash64(_trimmed(x)))), "\n")
    # One plan at every size: texts and what goes from them grow alike, so both are shuffled by id; rows without one go by a hash of the text.
    parts = F.when(F.col("id").isNull(), F.sequence(F.lit(0), F.lit(NO_ID_PARTS - 1))).otherwise(F.array(F.lit(0)))
    part = F.when(id_.isNull(), F.pmod(F.xxhash64(text), F.lit(NO_ID_PARTS))).otherwise(0).cast("int")
    sent = drops.select(F.col("id").alias("drop_id"), F.explode(parts).alias("part"), "lines")
    joined = plain.hint("merge").join(sent, id_.eqNullSafe(F.col("drop_id")) & (part == F.col("part")), "left")
    return joined.select(*(F.when(F.col("lines").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(n).alias(c) for c, n in names.items()))

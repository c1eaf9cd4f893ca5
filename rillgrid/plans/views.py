"""The shared test tables seen as pixels, series, spectra and tie points; in Spark, and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillgrid.operators import stack

WIDTH = 15  # columns of the pixel grid that user ids are laid out on
BANDS = tuple(f"b{i}" for i in range(1, 9))
#: Some queries stand for several: all that is needed of a view is what its columns' names say.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, row, col, ts, v of the days that have values: a user's median, scaled to [0, 1]."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("ts"), "value")
    v = events.groupBy("user_id", "ts").agg(F.least(F.percentile("value", 0.5) / 40, F.lit(1.0)).alias("v"))
    return v.select(F.col("user_id").alias("series"), F.expr(f"user_id div {WIDTH}").alias("row"), (F.col("user_id") % WIDTH).alias("col"), "ts", "v")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily on the dense grid of series and days."""
    return stack.dense(daily(spark, sf_dir), ["series", "row", "col"])


def days(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").select(F.count_distinct(F.to_date("ts"))).first()[0]


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel, label, b1 … b8."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pixel"), "label", *(F.abs(F.col("embedding")[i].cast("double")).alias(b) for i, b in enumerate(BANDS)))


def tiepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, dx, dy, rel."""
    lost = F.col("l_linenumber") == 7
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scene"), *(F.when(lost, -9999.0).otherwise(x).alias(n) for n, x in (("dx", F.col("l_discount") * 100 - 5), ("dy", F.col("l_tax") * 100 - 4))), F.col("l_quantity").alias("rel"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, ts, v: a longer stack, of supplier and month."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series"), F.trunc(F.to_date("l_shipdate"), "month").alias("ts"), "l_discount")
    return rows.groupBy("series", "ts").agg((F.round(F.avg("l_discount"), 9) * 10).alias("v"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel (order), ts, label (priority's first digit), w, b, v: three fractions of line items' values."""
    x = table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_suppkey") % 97).alias("pixel"), F.col("l_linenumber").alias("ts"), F.col("l_tax").alias("w"), F.col("l_discount").alias("b"), (F.col("l_quantity") / 500).alias("v"))


SQL = {
    "daily": f"""daily AS (
  SELECT user_id AS series, user_id // {WIDTH} AS row, user_id % {WIDTH} AS col, CAST(ts AS DATE) AS ts, least(median(value) / 40, 1.0) AS v
  FROM events GROUP BY user_id, CAST(ts AS DATE))""",
    "obs": """obs AS (
  SELECT s.series, s.row, s.col, d.ts, x.v
  FROM (SELECT DISTINCT series, row, col FROM daily) s CROSS JOIN (SELECT DISTINCT ts FROM daily) d
  LEFT JOIN daily x ON x.series = s.series AND x.ts = d.ts)""",
    "spectra": "spectra AS (SELECT vec_id AS pixel, label, " + ", ".join(f"abs(CAST(embedding[{i}] AS DOUBLE)) AS b{i}" for i in range(1, 9)) + " FROM embeddings)",
    "indexed": "indexed AS (SELECT *, (b8 - b6) / (b8 + b6 + 1e-6) AS ndvi, (b4 - b8) / (b4 + b8 + 1e-6) AS ndwi FROM spectra)",
    "tiepoints": """tiepoints AS (
  SELECT l_suppkey AS scene, CASE WHEN l_linenumber = 7 THEN -9999.0 ELSE l_discount * 100 - 5 END AS dx,
    CASE WHEN l_linenumber = 7 THEN -9999.0 ELSE l_tax * 100 - 4 END AS dy, l_quantity AS rel FROM lineitem)""",
    "monthly": """monthly AS (
  SELECT l_suppkey AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, round(avg(l_discount), 9) * 10 AS v FROM lineitem GROUP BY 1, 2)""",
    "components": """components AS (
  SELECT l_suppkey % 97 AS pixel, l_linenumber AS ts, l_tax AS w, l_discount AS b, l_quantity / 500 AS v FROM lineitem)""",
}


def with_views(names: str, body: str) -> str:
    """body behind the views it names."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body

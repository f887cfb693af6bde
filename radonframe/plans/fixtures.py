"""How the driver's tables stand for the roles of imaging data, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import digitize
from ..operators import algebra, events

SCANNER = events.Scanner(2, 2, 1, 1, 2, 2, 6, 1, 4.0, 5.0, 0.0, 0.0, 9.0, 11.0, 60.0)
DETECTORS = SCANNER.per_ring * SCANNER.rings
TOF_BINS, TOF_LOW, TOF_HIGH = 10, 5.0, 255.0
WINDOWS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.matrix(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_quantity"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("i"))
    return rows.agg(F.sum("l_extendedprice").alias("g"), F.sum("l_tax").alias("s"))


def ones(h: DataFrame) -> DataFrame:
    return h.select("j").distinct().withColumn("value", F.lit(1.0))


H_SQL = """
h AS (SELECT l_orderkey AS i, l_suppkey AS j, sum(l_quantity) AS h FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_orderkey AS i, sum(l_extendedprice) AS g, sum(l_tax) AS s FROM lineitem GROUP BY 1),
f0 AS (SELECT DISTINCT j, CAST(1 AS DOUBLE) AS value FROM h)"""


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, x, y, z, value): 4 x 4 x 4 volumes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("n", "v"))
    return rows.select("vec_id", F.expr("n div 16").cast("int").alias("x"), F.expr("(n div 4) % 4").cast("int").alias("y"), (F.col("n") % 4).alias("z"), F.col("v").cast("double").alias("value"))


VOLUMES_SQL = """
vol AS (SELECT vec_id, CAST(n // 16 AS INTEGER) AS x, CAST((n // 4) % 4 AS INTEGER) AS y, CAST(n % 4 AS INTEGER) AS z, CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS n FROM embeddings))"""


def listmode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, detector_1, detector_2, tof)."""
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(
        "event_id",
        F.pmod("user_id", F.lit(DETECTORS)).cast("int").alias("detector_1"),
        F.pmod(F.coalesce(k, F.lit(0)) * 7 + F.col("event_id"), F.lit(DETECTORS)).cast("int").alias("detector_2"),
        digitize(F.col("value"), TOF_LOW, TOF_HIGH, TOF_BINS).alias("tof"),
    )


LISTMODE_SQL = f"""
lm AS (SELECT event_id, CAST(user_id % {DETECTORS} AS INTEGER) AS detector_1,
    CAST((coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) * 7 + event_id) % {DETECTORS} AS INTEGER) AS detector_2,
    CAST(CASE WHEN value < {TOF_LOW} THEN -1 WHEN value >= {TOF_HIGH} THEN {TOF_BINS} ELSE floor((value - {TOF_LOW}) * {TOF_BINS} / ({TOF_HIGH} - {TOF_LOW})) END AS INTEGER) AS tof
  FROM events)"""

CELLS_SQL = f"""
o AS (SELECT *, detector_1 % {SCANNER.per_ring} AS p1, detector_2 % {SCANNER.per_ring} AS p2, detector_1 // {SCANNER.per_ring} AS q1, detector_2 // {SCANNER.per_ring} AS q2 FROM lm),
w AS (SELECT *, p1 < p2 AS swap, greatest(p1, p2) AS c1, least(p1, p2) AS c2, CASE WHEN p1 < p2 THEN q2 ELSE q1 END AS r1, CASE WHEN p1 < p2 THEN q1 ELSE q2 END AS r2 FROM o),
m AS (SELECT *, (c1 + 22) % 24 AS m1, (c2 + 22) % 24 AS m2, abs(r1 - r2) AS dr FROM w),
ab AS (SELECT *, least(m1, m2) AS lo, greatest(m1, m2) AS hi, least(m1, m2) + greatest(m1, m2) AS su FROM m),
rad AS (SELECT *, floor(CASE WHEN lo = hi THEN CASE WHEN su >= 36 OR su < 12 THEN -12 ELSE 12 END
    WHEN su >= 36 OR su < 12 THEN (hi - lo - 1) / 2 - (24 - (hi - lo + 1)) / 2 ELSE (24 - (hi - lo + 1)) / 2 - (hi - lo - 1) / 2 END) AS depth FROM ab),
cells AS (SELECT *, CAST(floor(CASE WHEN su < 12 THEN (2 * lo + 24 + depth) / 2 WHEN su >= 36 THEN (2 * lo - 24 + depth) / 2 ELSE (2 * lo - depth) / 2 END) AS INTEGER) AS a,
    CAST(floor(depth + 25 / 2) AS INTEGER) AS r,
    CAST(CASE WHEN dr = 0 THEN r1 WHEN r1 < r2 THEN 4 + (dr - 1) * (8 - dr) + r1 ELSE 4 + (dr - 1) * (8 - dr) + 4 - 2 * dr + r1 END AS INTEGER) AS p,
    CASE WHEN swap THEN {TOF_BINS} - 1 - tof ELSE tof END AS bin FROM rad)"""


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window, a, r, z, value): event types as energy windows, days as angles, users as pixels."""
    rows = table(spark, sf_dir, "events")
    cell = [F.dayofmonth("ts").alias("a"), F.pmod("user_id", F.lit(16)).cast("int").alias("r"), F.pmod(F.floor(F.col("user_id") / 16), F.lit(4)).cast("int").alias("z")]
    return rows.groupBy(F.col("event_type").alias("window"), *cell).agg(F.sum("value").alias("value"))


WINDOWS_SQL = """
c AS (SELECT event_type AS "window", CAST(day(ts) AS INTEGER) AS a, CAST(user_id % 16 AS INTEGER) AS r, CAST((user_id // 16) % 4 AS INTEGER) AS z, sum(value) AS value
  FROM events GROUP BY 1, 2, 3, 4)"""

"""Places: neighbours within a distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.near import chord, near_pairs, on_globe
from strandline.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    hdd = table(spark, d, "maneuver_segments").where(F.abs("lat").between(1, 90) & F.abs("lng").between(1, 180))
    hdd = near_pairs(hdd, "segment_id", on_globe(F.col("lat"), F.col("lng")), chord(30.0))
    flat = table(spark, d, "nuscenes_segments").where("not (midpoint_x = 0 and midpoint_y = 0)")
    flat = near_pairs(flat, "segment_id", [F.col("midpoint_x"), F.col("midpoint_y")], 30.0)
    return hdd.select(F.lit("hdd").alias("dataset"), "id_a", "id_b").unionByName(flat.select(F.lit("nuscenes").alias("dataset"), "id_a", "id_b"))


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
WITH h AS (SELECT DISTINCT segment_id, lat, lng FROM maneuver_segments
           WHERE abs(lat) BETWEEN 1 AND 90 AND abs(lng) BETWEEN 1 AND 180),
n AS (SELECT DISTINCT segment_id, midpoint_x AS x, midpoint_y AS y FROM nuscenes_segments
      WHERE isfinite(midpoint_x) AND isfinite(midpoint_y) AND NOT (midpoint_x = 0 AND midpoint_y = 0))
SELECT DISTINCT 'hdd' AS dataset, a.segment_id AS id_a, b.segment_id AS id_b
FROM h a JOIN h b ON a.lat BETWEEN b.lat - 0.0003 AND b.lat + 0.0003
WHERE a.segment_id < b.segment_id
  AND 2 * 6371000.0 * asin(sqrt(pow(sin(radians(a.lat - b.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lng - b.lng) / 2), 2))) <= 30
UNION ALL
SELECT DISTINCT 'nuscenes', a.segment_id, b.segment_id
FROM n a JOIN n b ON a.x BETWEEN b.x - 30 AND b.x + 30
WHERE a.segment_id < b.segment_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 900""",
}

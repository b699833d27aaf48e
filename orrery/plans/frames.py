"""Frame sequences, rendered from the events table: a user is a source, its events in order are the frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans.registry import table

CLASSES = {"click": "detail", "view": "detail", "purchase": "appraisal", "signup": "list", "error": "non_extractable"}

FRAMES_SQL = """frames AS (SELECT user_id AS source, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i,
 CASE event_type WHEN 'click' THEN 'detail' WHEN 'view' THEN 'detail' WHEN 'purchase' THEN 'appraisal' WHEN 'signup' THEN 'list' ELSE 'non_extractable' END AS cls,
 event_type, value, ts, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cls = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in CLASSES.items()], F.lit("non_extractable"))
    i = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("source"), "event_id", i.alias("i"), cls.alias("cls"), "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))

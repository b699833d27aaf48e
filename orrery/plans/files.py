"""Lifecycle of files and sequences that end, over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import lifecycle
from orrery.plans.registry import query, table
from orrery.streaming import sequences


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each user, events by their type."""
    kind = "event_type"
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id % 50 AS string) AS source_file", "user_id AS frame_index", "event_id AS at",
        f"CASE WHEN {kind} IN ('view', 'click') THEN 'processed' WHEN {kind} = 'purchase' THEN 'deleted' WHEN {kind} = 'signup' THEN 'skipped' ELSE 'retained' END AS action",
        f"CASE WHEN {kind} = 'view' THEN 'extracted' WHEN {kind} = 'signup' AND user_id % 2 = 0 THEN 'list:already_absent' ELSE {kind} END AS reason",
    )


@query("""WITH e AS (SELECT user_id%50 AS s, event_id AS t, CASE event_type WHEN 'view' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('view','purchase')), r AS (SELECT s, sum(d) OVER (PARTITION BY s ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS held FROM e)
SELECT s::VARCHAR AS source_file, greatest(0, max(held))::BIGINT AS peak, greatest(0, max(held))>10 AS exceeded FROM r GROUP BY s""")
def q_file_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.peaks(_events(spark, sf_dir), 10)


@query("""WITH e AS (SELECT user_id%50 AS s, user_id AS f, event_id AS t, CASE WHEN event_type='view' THEN 'held' WHEN event_type='click' THEN 'protected' WHEN event_type='purchase' THEN 'released' WHEN event_type='signup' AND user_id%2=0 THEN 'released' WHEN event_type='error' THEN 'retained' END AS st FROM events)
SELECT s::VARCHAR AS source_file, f AS frame_index, arg_max(st, t) AS state, max(t) AS at FROM e WHERE st IS NOT NULL GROUP BY s, f""")
def q_file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.states(_events(spark, sf_dir)).select("source_file", "frame_index", "state", "at")


# Frames of 40 sources in the order of time; pauses over an hour end a sequence.
@query("""WITH e AS (SELECT user_id%40 AS s, epoch_ms(ts) AS tm, event_id AS i, CASE event_type WHEN 'view' THEN 'detail' WHEN 'click' THEN 'appraisal' WHEN 'purchase' THEN 'appraisal' ELSE 'list' END AS k, event_id%9=0 AS split, event_id%7=0 AS goes FROM events),
m AS (SELECT *, k<>'list' AS c, k<>'list' AND split AS a, k<>'list' AND NOT split AND goes AS b FROM e), n AS (SELECT *, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY s ORDER BY tm, i)),
l AS (SELECT *, coalesce(max(CASE WHEN a THEN r END) OVER w > coalesce(max(CASE WHEN NOT a AND NOT b THEN r END) OVER w, 0), false) AS moving FROM n WINDOW w AS (PARTITION BY s ORDER BY r)),
g AS (SELECT *, c AND NOT moving AS mem, CASE WHEN c AND NOT moving AND coalesce(lag(c AND NOT moving) OVER w AND lag(k) OVER w = k AND tm-lag(tm) OVER w <= 3600000, false) THEN 0 ELSE 1 END AS st FROM l WINDOW w AS (PARTITION BY s ORDER BY r)),
q AS (SELECT *, sum(st) OVER (PARTITION BY s ORDER BY r) AS run FROM g)
SELECT s::VARCHAR AS source_file, k AS raw_classification, arg_min(i, r) AS first_index, arg_max(i, r) AS last_index, count(*)::BIGINT AS frames FROM q WHERE mem GROUP BY s, run, k""")
def q_closed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").selectExpr(
        "cast(user_id % 40 AS string) AS source_file", "ts", "event_id AS frame_index", "CASE event_type WHEN 'view' THEN 'detail' WHEN 'click' THEN 'appraisal' WHEN 'purchase' THEN 'appraisal' ELSE 'list' END AS raw_classification",
        "true AS stable_detail_signal", "event_id % 9 = 0 AS hp_area_card_split_signal", "false AS horizontal_swipe_signal", "0.0D AS previous_frame_delta", "if(event_id % 7 = 0, 0.05D, 0.0D) AS future_frame_delta_3",
    )
    return sequences.closed(frames, "ts", 3_600_000).drop("frame_indexes").select("source_file", "raw_classification", "first_index", "last_index", F.col("frames"))

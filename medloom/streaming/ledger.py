"""Daily logs and feedback counts as streams, under the rules of the batch jobs.

Whether a daily entry is taken follows from its own day and write date alone, as in the batch, so the
order of arrival does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.longitudinal import routine_score


def daily_scores(entries: DataFrame, backfill: int = fv.BACKFILL_DAYS, release: int | None = None) -> DataFrame:
    """(user_id, day, score) of the last accepted write per user and day; run in update mode.

    ``entries``: user_id, day, written_at, id, dinacharya map. A write for a day ahead of it or more than
    ``backfill`` days back is refused. State is one row per user and day. With ``release`` the state of
    days that lie that many days behind the newest day seen is let go; an entry that arrives even later
    is then left out, so it should exceed ``backfill`` by the longest delay of delivery.
    """
    written, day = F.to_date("written_at"), F.to_date("day")
    inside = entries.where((day <= written) & (day >= F.date_sub(written, backfill)))
    timed = inside.withColumn("day_start", F.to_timestamp(day)).withColumn("score", routine_score(F.col("dinacharya")))
    if release is not None:
        timed = timed.withWatermark("day_start", f"{release} days")
    return timed.groupBy("user_id", F.window("day_start", "1 day").alias("w")).agg(
        F.max_by("score", F.struct("written_at", "id")).alias("score")).select("user_id", F.to_date("w.start").alias("day"), "score")


def feedback_cells(cases: DataFrame) -> DataFrame:
    """(condition_id, symptom, present, asked) of a stream of confirmed cases; additive, update mode.

    ``cases``: condition_id and answers map. State is one row per condition and symptom.
    """
    long = cases.select("condition_id", F.explode("answers").alias("symptom", "present"))
    return long.groupBy("condition_id", "symptom").agg(F.sum(F.col("present").cast("long")).alias("present"), F.count(F.lit(1)).alias("asked"))

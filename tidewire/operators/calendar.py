"""Reminders of scheduled events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes ahead and how they are said.
LEADS = ((1440, "TOMORROW"), (60, "IN 1 HOUR"), (15, "IN 15 MINUTES"))
#: A reminder is due within so many minutes of its lead.
WITHIN = 3


def due_reminders(events: DataFrame, fired: DataFrame, now: Column) -> DataFrame:
    """Reminders of (id, name, scheduled_at) due at ``now`` and not in ``fired`` (key); the longest lead of an event wins.

    Each event meets the three leads as an array, so nothing is joined but the keys fired.
    """
    leads = F.array(*(F.struct(F.lit(m).alias("minutes"), F.lit(t).alias("words")) for m, t in LEADS))
    rows = events.withColumn("lead", F.explode(leads))
    until = (F.unix_millis(F.col("scheduled_at").cast("timestamp")) - F.unix_millis(now.cast("timestamp"))) / 60000.0
    rows = rows.withColumn("until", until).where((F.col("until") >= 0) & (F.abs(F.col("until") - F.col("lead.minutes")) <= WITHIN))
    rows = rows.withColumn("key", F.concat_ws(":", "id", "lead.minutes")).join(fired.select("key"), "key", "left_anti")
    best = rows.groupBy("id").agg(F.max_by(F.struct("key", "name", "lead", "scheduled_at"), "lead.minutes").alias("r"))
    return best.select(
        "id", "r.key", F.col("r.lead.minutes").alias("lead_minutes"),
        F.concat_ws(" ", F.upper("r.name"), "r.lead.words").alias("headline"), "r.scheduled_at",
    )

"""Queries over the event stream's windows, as batches; tests run the same functions as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import arrivals
from .fixtures import table
from .registry import query


@query("x_event_windows", "select event_type, time_bucket(interval '1 hour', ts) as start, count(*) n, round(sum(value),4) total from events group by 1,2")
def event_windows(spark, sf):
    e = table(spark, sf, "events")
    return arrivals.tumbling(e, "ts", "1 hour", "10 minutes", ["event_type"], "value").select("event_type", "start", "n", F.round("total", 4).alias("total"))

"""Streaming plans; each drains its source and returns what reached the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.feeds import drain, event_stream
from .base import Tables, plan


@plan("sm08_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t: Tables):
    s = event_stream(t.spark, t.sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drain(s.select("user_id", "event_type"))


@plan("sm12_replay_idempotence", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def replay(t: Tables):
    return drain(event_stream(t.spark, t.sf_dir).where("event_type = 'purchase'").select("event_id", "value"))


@plan("sm09_stream_sessions")
def stream_sessions(t: Tables):
    s = event_stream(t.spark, t.sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return drain(s.select("user_id", F.col("session_window.start").alias("opened"), "n"))


@plan("sm10_stateful_incidents")
def stateful_incidents(t: Tables):
    from ..streaming.state import incident_stream

    return drain(incident_stream(event_stream(t.spark, t.sf_dir)))

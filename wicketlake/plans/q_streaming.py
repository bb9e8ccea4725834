"""Registered streaming queries (T rows): the stream is run to completion
with ``availableNow`` and its result table is compared with batch SQL."""

from __future__ import annotations

from wicketlake.plans.registry import query
from wicketlake.streaming import live as T
from wicketlake.streaming import state as S


@query("t1_event_append", "SELECT * FROM live")
def _t1(t):
    return T.append_events(t.spark, T.live_stream(t.spark, t.sf_dir))


@query("t2_latest_events", "SELECT * FROM live ORDER BY event_id DESC LIMIT 12")
def _t2(t):
    return T.latest_events(t.spark, T.live_stream(t.spark, t.sf_dir))


STATE_SQL = """
SELECT match_id, CAST(sum(runs_scored + extras) AS BIGINT) AS runs, count(*) AS balls,
  sum(runs_scored + extras) / greatest(count(*) / 6, 0.1) AS current_rr,
  sum(runs_scored + extras) / greatest(count(*) / 6, 0.1) * 20 AS projected_total FROM live GROUP BY 1"""


@query("t3_match_state", STATE_SQL)
def _t3(t):
    return T.match_state(t.spark, T.live_stream(t.spark, t.sf_dir))


@query("t3_timed_match_state", STATE_SQL)
def _t3_timed(t):
    return S.timed_match_state(t.spark, T.live_stream(t.spark, t.sf_dir))


@query("t4_milestones", """
SELECT match_id, batsman, runs, milestone FROM
  (SELECT match_id, batsman, CAST(sum(runs_scored) AS BIGINT) AS runs FROM live GROUP BY 1, 2) s,
  (VALUES (50), (100)) m(milestone) WHERE runs >= milestone""")
def _t4(t):
    return T.milestones(t.spark, T.live_stream(t.spark, t.sf_dir))


FIRED_SQL = """
SELECT match_id, batsman, milestone FROM
  (SELECT match_id, batsman, sum(runs_scored) AS runs FROM live GROUP BY 1, 2) s,
  (VALUES (50), (100)) m(milestone) WHERE runs >= milestone"""


@query("t4_timed_milestones", FIRED_SQL)
def _t4_timed(t):
    return S.timed_milestones(t.spark, T.live_stream(t.spark, t.sf_dir))


@query("t4_fired_milestones", FIRED_SQL)
def _t4_fired(t):
    return T.fired_milestones(t.spark, T.live_stream(t.spark, t.sf_dir))


@query("t5_state_with_baseline", f"""
WITH s AS ({STATE_SQL}),
b AS (SELECT avg(t) / 20 AS venue_avg_rr FROM (SELECT match_id, sum(total_runs) AS t FROM deliveries WHERE inning = 1 GROUP BY 1) x)
SELECT s.*, venue_avg_rr, greatest(5, least(95, projected_total / greatest(venue_avg_rr * 20, 1) * 50 + 25)) AS win_prob FROM s, b""")
def _t5(t):
    return T.state_with_baseline(t.spark, T.live_stream(t.spark, t.sf_dir), t.deliveries)

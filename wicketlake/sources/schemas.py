"""Typed layer schemas (S12): one StructType per table, applied with an
explicit cast at the layer boundary (no inference, no drift)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D, B, DT = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


CLEAN_MATCHES = _struct(("match_id", S), ("match_date", DT), ("venue", S), ("team1", S), ("team2", S),
                        ("toss_winner", S), ("toss_decision", S), ("winner", S), ("win_by_runs", I),
                        ("win_by_wickets", I), ("player_of_match", S), ("is_day_night", B),
                        ("tournament_phase", S), ("gender", S))
CLEAN_DELIVERIES = _struct(("match_id", S), ("inning", I), ("over_num", I), ("ball_num", I), ("batting_team", S),
                           ("bowling_team", S), ("batsman", S), ("non_striker", S), ("bowler", S),
                           ("batsman_runs", I), ("extra_runs", I), ("total_runs", I), ("is_wicket", B),
                           ("dismissal_kind", S), ("player_dismissed", S))
CLEAN_PLAYERS = _struct(("player_id", S), ("player_name", S), ("country", S), ("role", S), ("matches", L),
                        ("runs", L), ("batting_avg", D), ("strike_rate", D), ("hundreds", L), ("fifties", L),
                        ("wickets", L), ("bowling_avg", D), ("economy", D), ("gender", S),
                        ("last_played_date", DT), ("is_active", B))
CLEAN_VENUES = _struct(("stadium_name", S), ("city", S), ("country", S), ("pitch_type", S))
LIVE_BALL_EVENTS = _struct(("event_id", L), ("ts", T.TimestampType()), ("match_id", S), ("batsman", S),
                           ("runs_scored", I), ("is_wicket", B), ("extras", I))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types; a missing
    column becomes a typed null."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)

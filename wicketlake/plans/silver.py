"""Silver jobs (B1 to B4, B10): typed, cleaned match, delivery, player and
venue tables. Each is a lazy DataFrame function; writing is the caller's
choice (``wicketlake.sources.sinks``)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.functions import expressions as E
from wicketlake.operators.keys import dense_index
from wicketlake.operators.quantiles import exact_quantiles
from wicketlake.sources.raw import normalise_columns

AUDIT_COLUMNS = ("_ingested_at",)

MATCH_COLUMNS = ["match_id", "match_date", "venue", "city", "team1", "team2", "toss_winner",
                 "toss_decision", "winner", "win_by_runs", "win_by_wickets", "player_of_match",
                 "is_day_night", "tournament_phase", "gender"]


def _dedup(df: DataFrame) -> DataFrame:
    """Exact duplicates, ignoring audit columns (trap 17)."""
    cols = [c for c in df.columns if c not in AUDIT_COLUMNS]
    return df.dropDuplicates(cols)


def transform_matches(raw: DataFrame) -> DataFrame:
    """B1: matches job. Keeps the source match id (trap 1)."""
    df = _dedup(normalise_columns(raw))
    if "match_date" not in df.columns:
        df = df.withColumn("match_date", E.parse_date("date") if "date" in df.columns
                           else F.lit(None).cast("date"))
    margin = F.col("margin") if "margin" in df.columns else F.lit("0")
    runs, wkts = E.margin_number(margin)
    stage = F.col("stage") if "stage" in df.columns else F.lit("")
    df = df.withColumns({
        "win_by_runs": runs,
        "win_by_wickets": wkts,
        "winner": F.coalesce(E.blank_to_null("winner"), F.lit("No Result")),
        "player_of_match": F.lit("Unknown"),
        "toss_decision": F.coalesce(F.col("toss_decision"), F.lit("bat")),
        "tournament_phase": E.tournament_phase(stage),
        "is_day_night": F.lit(False),
    })
    return df.select(*[c for c in MATCH_COLUMNS if c in df.columns])


def transform_deliveries(raw: DataFrame) -> DataFrame:
    """B2: deliveries job over the raw (all-text) ball file columns."""
    df = _dedup(normalise_columns(raw))
    over, ball = E.over_and_ball("ball")
    runs = E.safe_int("runs_off_bat")
    extras = E.safe_int("extras")
    kind = F.coalesce(F.col("wicket_type"), F.lit("not_out"))
    return df.select(
        F.col("match_id"),
        E.safe_int("innings").cast("int").alias("inning"),
        over.alias("over_num"),
        ball.alias("ball_num"),
        "batting_team", "bowling_team",
        F.coalesce(F.col("striker"), F.lit("Unknown")).alias("batsman"),
        F.col("non_striker"),
        F.coalesce(F.col("bowler"), F.lit("Unknown")).alias("bowler"),
        runs.cast("int").alias("batsman_runs"),
        extras.cast("int").alias("extra_runs"),
        (runs + extras).cast("int").alias("total_runs"),
        E.wicket_flag("player_dismissed", "wicket_type").alias("is_wicket"),
        kind.alias("dismissal_kind"),
        E.blank_to_null("player_dismissed").alias("player_dismissed"),
    )


def outlier_report(df: DataFrame, column: str) -> DataFrame:
    """A10: IQR outlier count (rows are kept); one row. The quartiles are
    exact, by distributed selection."""
    q1, q3 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    x = F.col(column)
    if q1 is None:
        return df.agg(F.lit(None).cast("double").alias("q1"), F.lit(None).cast("double").alias("q3"),
                      F.lit(0).cast("long").alias("outliers"), F.count("*").alias("rows"))
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return df.agg(F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.count_if((x < lo) | (x > hi)).alias("outliers"),
                  F.count("*").alias("rows"))


def match_cards(deliveries: DataFrame, *within: str) -> DataFrame:
    """One row per match and player, batting and bowling together, from one
    pass: every ball counts once for its batter and once for its bowler.
    Players, the gold fact and team selection roll up from here. Rows that are
    dealt by the columns ``within`` are not moved again.

    The teams are keys of the sums, not minima beside them: with a minimum of
    texts Spark sorts all sides of all balls before it adds up, with numbers
    alone it hashes them. The few rows of a card are merged afterwards."""
    bats, r, out = F.col("s.bats"), F.col("s.r"), F.col("s.out")
    side = F.explode(F.array(
        F.struct(F.col("batsman").alias("player_name"), F.lit(True).alias("bats"), F.col("batting_team").alias("team"),
                 F.col("batsman_runs").alias("r"), (F.col("player_dismissed") == F.col("batsman")).alias("out")),
        F.struct(F.col("bowler").alias("player_name"), F.lit(False).alias("bats"), F.col("bowling_team").alias("team"),
                 F.col("total_runs").alias("r"), F.col("is_wicket").alias("out"))))
    sides = deliveries.select(*within, "match_id", side.alias("s")).groupBy(
        *within, "match_id", F.col("s.player_name").alias("player_name"),
        F.when(bats, F.col("s.team")).alias("bat_team"), F.when(~bats, F.col("s.team")).alias("bowl_team"))
    return merged_cards(sides.agg(
        F.sum(F.when(bats, r)).alias("runs_scored"), F.count_if(bats).alias("balls_faced"),
        F.count_if(bats & (r == 4)).alias("fours"), F.count_if(bats & (r == 6)).alias("sixes"),
        F.count_if(bats & out).alias("outs"), F.count_if(~bats & out).alias("wickets_taken"),
        F.sum(F.when(~bats, r)).alias("runs_conceded"), F.count_if(~bats).alias("balls_bowled")), *within)


def merged_cards(cards: DataFrame, *within: str) -> DataFrame:
    """Partial cards of the same match and player added up."""
    sums = [c for c in cards.columns if c not in ("match_id", "player_name", "bat_team", "bowl_team", *within)]
    return cards.groupBy(*within, "match_id", "player_name").agg(
        F.min("bat_team").alias("bat_team"), F.min("bowl_team").alias("bowl_team"), *[F.sum(c).alias(c) for c in sums])


def players_from_cards(cards: DataFrame, matches: DataFrame, as_of: _dt.date | None = None,
                       active_months: int = 36) -> DataFrame:
    """B3 + B10: player table built from the balls themselves (trap 9).

    One row per player name: careers (A8, J2) rolled up from the cards, role
    (P14), dense id (W1), gender and last played date from the matches (J12,
    A52), and the activity flag (F8) against an explicit as-of date (trap 19;
    default: the latest match date).
    """
    scored = F.col("runs_scored")
    joined = (cards.join(matches.select("match_id", "match_date", "gender"), "match_id", "left")
              .groupBy("player_name").agg(
                  F.min("bat_team").alias("bat_team"), F.min("bowl_team").alias("bowl_team"), F.sum(scored).alias("runs"),
                  F.sum("balls_faced").alias("balls_faced"), F.sum("outs").alias("outs"),
                  F.count_if(scored >= 100).alias("hundreds"), F.count_if((scored >= 50) & (scored < 100)).alias("fifties"),
                  F.sum("wickets_taken").alias("wickets"), F.sum("runs_conceded").alias("runs_conceded"),
                  F.sum("balls_bowled").alias("balls_bowled"), F.count("match_id").alias("matches"),
                  F.max("match_date").alias("last_played_date"), F.max("gender").alias("gender")))
    runs = F.coalesce(F.col("runs"), F.lit(0))
    wickets = F.coalesce(F.col("wickets"), F.lit(0))
    balls = F.coalesce(F.col("balls_faced"), F.lit(0))
    bowled = F.coalesce(F.col("balls_bowled"), F.lit(0))
    conceded = F.coalesce(F.col("runs_conceded"), F.lit(0))
    out = joined.select(
        "player_name",
        F.coalesce("bat_team", "bowl_team").alias("country"),
        E.infer_role(wickets, runs).alias("role"),
        F.coalesce(F.col("matches"), F.lit(0)).alias("matches"),
        runs.alias("runs"),
        (runs / F.greatest(F.coalesce(F.col("outs"), F.lit(0)), F.lit(1))).alias("batting_avg"),
        F.when(balls > 0, runs / balls * 100).otherwise(F.lit(0.0)).alias("strike_rate"),
        F.coalesce(F.col("hundreds"), F.lit(0)).alias("hundreds"),
        F.coalesce(F.col("fifties"), F.lit(0)).alias("fifties"),
        wickets.alias("wickets"),
        F.when(wickets > 0, conceded / wickets).otherwise(F.lit(0.0)).alias("bowling_avg"),
        F.when(bowled > 0, conceded / (bowled / 6)).otherwise(F.lit(0.0)).alias("economy"),
        F.coalesce(F.col("gender"), F.lit("male")).alias("gender"),
        "last_played_date",
    )
    if as_of is None:
        # The as-of date is one scalar, a one-row aggregate.
        out = out.withColumn("_as_of", matches.agg(F.max("match_date")).scalar())
    else:
        out = out.withColumn("_as_of", F.lit(as_of))
    out = out.withColumn("is_active", F.coalesce(
        E.within_months("last_played_date", F.col("_as_of"), active_months), F.lit(False))).drop("_as_of")
    out = dense_index(out, ["player_name"], "_n")
    return out.withColumn("player_id", E.padded_id("P", F.col("_n"), 5)).drop("_n")


def transform_venues(raw: DataFrame) -> DataFrame:
    """Venues job: dedup, rename, defaults, constant pitch type."""
    df = _dedup(normalise_columns(raw))
    if "venue_name" in df.columns:
        df = df.withColumnRenamed("venue_name", "stadium_name")
    for c, default in (("stadium_name", "Unknown Venue"), ("city", "Unknown"), ("country", "Unknown")):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default))
    return df.select("stadium_name", "city", "country", F.lit("Balanced").alias("pitch_type"))

"""Aggregations (A1 to A57) over deliveries and matches.

Reference pages answer these for one selected team, venue or pair; here each
is one job for every team (or pair, venue) at once, with the selection as an
optional filter (P1). All conditional measures of one grain are computed in a
single aggregate pass, and every aggregate is partial (map-side combined), so
a team holding a large share of the balls still ships one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.functions import expressions as E
from wicketlake.operators import topk



def _i(c: Column) -> Column:
    return c.cast("int")


def _maybe(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def teams_long(matches: DataFrame) -> DataFrame:
    """(match, team) rows: both sides of every fixture (U2 via explode)."""
    return matches.select("*", F.explode(F.array("team1", "team2")).alias("team"))


# ------------------------------------------------------------------ A1, A2
def batting_cards(d: DataFrame) -> DataFrame:
    """A1: runs, balls, fours, sixes per (match, batter, team)."""
    return d.groupBy("match_id", F.col("batsman").alias("player_name"), F.col("batting_team").alias("team")).agg(
        F.sum(F.col("batsman_runs")).alias("runs_scored"), F.count("*").alias("balls_faced"),
        F.count_if(F.col("batsman_runs") == 4).alias("fours"), F.count_if(F.col("batsman_runs") == 6).alias("sixes"))


def bowling_cards(d: DataFrame) -> DataFrame:
    """A2: wickets (every dismissal, trap 7), runs conceded, balls per
    (match, bowler, team); overs = balls / 6, economy = runs / overs."""
    g = d.groupBy("match_id", F.col("bowler").alias("player_name"), F.col("bowling_team").alias("team")).agg(
        F.count_if(F.col("is_wicket")).alias("wickets_taken"), F.sum(F.col("total_runs")).alias("runs_conceded"),
        F.count("*").alias("balls_bowled"))
    return g.withColumns({
        "overs_bowled": F.col("balls_bowled") / 6,
        "economy_rate": F.col("runs_conceded") / (F.col("balls_bowled") / 6),
    })


# ------------------------------------------------------------------ A3 - A7
def team_batting(d: DataFrame) -> DataFrame:
    """A3: per batting team means and boundary rates."""
    return d.groupBy(F.col("batting_team").alias("team")).agg(
        F.avg(F.col("batsman_runs")).alias("avg_runs_per_ball"), F.avg(F.col("total_runs")).alias("avg_total_runs"),
        F.avg(_i(F.col("batsman_runs") == 6)).alias("six_rate"), F.avg(_i(F.col("batsman_runs") == 4)).alias("four_rate"))


def team_bowling(d: DataFrame) -> DataFrame:
    """A4: per bowling team wicket and run means."""
    return d.groupBy(F.col("bowling_team").alias("team")).agg(
        F.avg(_i(F.col("is_wicket"))).alias("avg_wickets_per_ball"), F.avg(F.col("total_runs")).alias("avg_economy"))


def team_phase_rates(d: DataFrame, pp_last: int = E.POWERPLAY_LAST_OVER,
                     death_first: int = E.DEATH_FIRST_OVER) -> DataFrame:
    """A5: powerplay and death run rate (batting side), death wicket rate
    (bowling side), each a conditional mean in one pass per side."""
    bat = d.groupBy(F.col("batting_team").alias("team")).agg(
        F.avg(F.when(F.col("over_num") <= pp_last, F.col("total_runs"))).alias("pp_run_rate"),
        F.avg(F.when(F.col("over_num") >= death_first, F.col("total_runs"))).alias("death_run_rate"))
    bowl = d.groupBy(F.col("bowling_team").alias("team")).agg(
        F.avg(F.when(F.col("over_num") >= death_first, _i(F.col("is_wicket")))).alias("death_wicket_rate"))
    return bat.join(bowl, "team", "full")


def team_win_rates(matches: DataFrame) -> DataFrame:
    """Wins, matches over both team columns, win rate; a team without a
    win gets 0.5 (the reference's left-join default)."""
    wins = matches.groupBy(F.col("winner").alias("team")).agg(F.count("*").alias("total_wins"))
    played = teams_long(matches).groupBy("team").agg(F.count("*").alias("total_matches"))
    out = played.join(wins, "team", "left")
    rate = F.col("total_wins") / F.when(F.col("total_matches") == 0, 1).otherwise(F.col("total_matches"))
    return out.withColumn("win_rate", F.coalesce(rate, F.lit(0.5)))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls of numeric columns with the column median (exact
    ``median``, on a frame of one row per team): one row with all medians,
    joined once."""
    med = df.agg(*[F.median(c).alias(f"_median_{c}") for c in columns])
    filled = df.crossJoin(med).withColumns({c: F.coalesce(F.col(c), F.col(f"_median_{c}")) for c in columns})
    return filled.drop(*[f"_median_{c}" for c in columns])


def team_cards(d: DataFrame, matches: DataFrame, pp_last: int = E.POWERPLAY_LAST_OVER,
               death_first: int = E.DEATH_FIRST_OVER) -> DataFrame:
    """Sums and counts per team that A3 to A6 are ratios of, in one aggregate:
    every ball counts for its batting and its bowling team, every match for
    its two teams and its winner, and all are summed map-side before the only
    shuffle, which carries one row per team and task."""
    def row(team: str, kind: str, r, t, w, o):
        return F.struct(F.col(team).alias("team"), F.lit(kind).alias("kind"), r.alias("r"), t.alias("t"), w.alias("w"), o.alias("o"))

    no = F.lit(None).cast("int")
    wicket = _i(F.col("is_wicket"))
    total, over = F.col("total_runs").cast("int"), F.col("over_num").cast("int")
    balls = d.select(F.explode(F.array(
        row("batting_team", "bat", F.col("batsman_runs").cast("int"), total, wicket, over),
        row("bowling_team", "bowl", no, total, wicket, over))).alias("x"))
    games = matches.select(F.explode(F.array(
        row("team1", "played", no, no, no, no), row("team2", "played", no, no, no, no), row("winner", "won", no, no, no, no))).alias("x"))
    x = balls.unionByName(games).select("x.*")
    bat, bowl = F.col("kind") == "bat", F.col("kind") == "bowl"
    pp, death = F.col("o") <= pp_last, F.col("o") >= death_first

    def total_of(condition, column: str):
        return F.sum(F.when(condition, F.col(column)))

    return x.groupBy("team").agg(
        F.count_if(bat).alias("bat_balls"), total_of(bat, "r").alias("bat_runs"), total_of(bat, "t").alias("bat_total"),
        F.count_if(bat & (F.col("r") == 6)).alias("sixes"), F.count_if(bat & (F.col("r") == 4)).alias("fours"),
        F.count_if(bat & pp).alias("pp_balls"), total_of(bat & pp, "t").alias("pp_runs"),
        F.count_if(bat & death).alias("death_balls"), total_of(bat & death, "t").alias("death_runs"),
        F.count_if(bowl).alias("bowl_balls"), total_of(bowl, "w").alias("wickets"), total_of(bowl, "t").alias("conceded"),
        F.count_if(bowl & death).alias("death_bowled"), total_of(bowl & death, "w").alias("death_wickets"),
        F.count_if(F.col("kind") == "played").alias("played"), F.count_if(F.col("kind") == "won").alias("won"))


def team_stats(d: DataFrame, matches: DataFrame) -> DataFrame:
    """A3 to A6 per team that batted or bowled (J7), rolled up from the team
    cards and median-imputed (A7)."""
    def mean(top: str, count: str):
        return F.when(F.col(count) > 0, F.col(top) / F.col(count))

    def known(count: str):
        return F.when(F.col(count) > 0, F.col(count))

    cards = team_cards(d, matches).filter((F.col("bat_balls") > 0) | (F.col("bowl_balls") > 0))
    stats = cards.select(
        "team", mean("bat_runs", "bat_balls").alias("avg_runs_per_ball"), mean("bat_total", "bat_balls").alias("avg_total_runs"),
        mean("sixes", "bat_balls").alias("six_rate"), mean("fours", "bat_balls").alias("four_rate"),
        mean("wickets", "bowl_balls").alias("avg_wickets_per_ball"), mean("conceded", "bowl_balls").alias("avg_economy"),
        known("won").alias("total_wins"), known("played").alias("total_matches"),
        F.coalesce(known("won") / known("played"), F.lit(0.5)).alias("win_rate"),
        mean("pp_runs", "pp_balls").alias("pp_run_rate"), mean("death_runs", "death_balls").alias("death_run_rate"),
        mean("death_wickets", "death_bowled").alias("death_wicket_rate"))
    return impute_median(stats, [c for c in stats.columns if c != "team"])


# ------------------------------------------------------------------ A8, A9
def career_batting(d: DataFrame) -> DataFrame:
    """Batting career per player (strike rate with a zero-safe divisor)."""
    g = d.groupBy("batsman").agg(
        F.sum(F.col("batsman_runs")).alias("total_runs"), F.count("*").alias("balls_faced"),
        F.count_if(F.col("batsman_runs") == 6).alias("sixes"), F.count_if(F.col("batsman_runs") == 4).alias("fours"))
    return g.withColumn("strike_rate_live", E.safe_div(F.col("total_runs"), F.col("balls_faced")) * 100)


def career_bowling(d: DataFrame) -> DataFrame:
    g = d.groupBy("bowler").agg(
        F.count_if(F.col("is_wicket")).alias("wickets"), F.count("*").alias("balls_bowled"),
        F.sum(F.col("total_runs")).alias("runs_given"))
    return g.withColumn("economy_live", E.safe_div(F.col("runs_given"), F.col("balls_bowled") / 6))


def innings_features(d: DataFrame, first_balls: int = 36, min_total: int = 50) -> DataFrame:
    """A9 (+ W6): per (match, batting team): totals, boundaries, runs of the
    first ``first_balls`` balls in ball order, rates; totals over ``min_total``."""
    w = Window.partitionBy("match_id", "batting_team").orderBy("seq")
    numbered = d.withColumn("_n", F.row_number().over(w))
    g = numbered.groupBy("match_id", "batting_team").agg(
        F.sum(F.col("total_runs")).alias("total_runs"), F.count("*").alias("total_balls"),
        F.count_if(F.col("is_wicket")).alias("wickets_lost"), F.count_if(F.col("batsman_runs") == 6).alias("sixes"),
        F.count_if(F.col("batsman_runs") == 4).alias("fours"),
        F.coalesce(F.sum(F.when(F.col("_n") <= first_balls, F.col("total_runs"))), F.lit(0)).alias("pp_runs"))
    g = g.withColumns({
        "run_rate": E.safe_div(F.col("total_runs"), F.col("total_balls") / 6),
        "pp_run_rate": F.col("pp_runs") / 6,
        "boundary_pct": E.safe_div(F.col("sixes") + F.col("fours"), F.col("total_balls")),
    })
    return g.filter(F.col("total_runs") > min_total)


# ------------------------------------------------------------------ A11 - A13
def null_percent(df: DataFrame) -> DataFrame:
    """Percent of nulls per column, as (column_name, null_pct) rows."""
    agg = df.agg(*[(F.avg(_i(F.col(c).isNull())) * 100).alias(c) for c in df.columns])
    return agg.unpivot([], df.columns, "column_name", "null_pct")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows."""
    distinct = df.distinct().agg(F.count("*")).scalar()
    return df.agg(F.count("*").alias("rows")).select(
        "rows", distinct.alias("distinct_rows"), (F.col("rows") - distinct).alias("duplicates"))


# ------------------------------------------------------------------ A14 - A16
def team_kpis(d: DataFrame, team: str | None = None, death_first: int = E.DEATH_FIRST_OVER) -> DataFrame:
    """Per team runs scored, wickets taken, strike rate, death economy.
    Batting and bowling sides are two aggregates of the same scan."""
    bat = _maybe(d, "batting_team", team).groupBy(F.col("batting_team").alias("team")).agg(
        F.sum(F.col("batsman_runs")).alias("total_runs"), F.count("*").alias("balls"))
    bowl = _maybe(d, "bowling_team", team).groupBy(F.col("bowling_team").alias("team")).agg(
        F.count_if(F.col("is_wicket")).alias("total_wickets"),
        F.coalesce(F.sum(F.when(F.col("over_num") >= death_first, F.col("total_runs"))), F.lit(0)).alias("death_runs"),
        F.count_if(F.col("over_num") >= death_first).alias("death_balls"))
    return bat.join(bowl, "team", "full").select(
        "team",
        F.coalesce("total_runs", F.lit(0)).alias("total_runs"),
        F.coalesce("total_wickets", F.lit(0)).alias("total_wickets"),
        (F.coalesce("total_runs", F.lit(0)) / F.greatest(F.coalesce("balls", F.lit(0)), F.lit(1)) * 100).alias("strike_rate"),
        E.per_over(F.coalesce("death_runs", F.lit(0)), F.coalesce("death_balls", F.lit(0))).alias("death_economy"))


def runs_by_over(d: DataFrame, team: str | None = None) -> DataFrame:
    """Mean runs per ball by over with its phase, per batting team."""
    return (_maybe(d, "batting_team", team).groupBy(F.col("batting_team").alias("team"), "over_num")
            .agg(F.avg(F.col("total_runs")).alias("avg_runs"))
            .withColumn("phase", E.phase_of_over("over_num")))


def dismissal_kinds(d: DataFrame, team: str | None = None) -> DataFrame:
    """Wickets lost by kind per batting team."""
    return (_maybe(d, "batting_team", team).filter(F.col("is_wicket"))
            .groupBy(F.col("batting_team").alias("team"), "dismissal_kind").agg(F.count("*").alias("count")))


# ------------------------------------------------------------------ recent form
def recent_matches(matches: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` matches of every team by date (match id breaks ties).
    The per-team window keeps only n rows per team and task before the shuffle."""
    long = teams_long(matches).select("team", "match_id", "match_date")
    return topk.top_k_per_group(long, n, ["team"], F.col("match_date").desc_nulls_last(),
                                F.col("match_id").desc()).drop("rank")


def recent_batting(d: DataFrame, recent: DataFrame) -> DataFrame:
    """Balls a team faced in its recent matches (J9 as an equi-join on team
    and match; ``recent`` holds at most n rows per team)."""
    return d.join(recent.select(F.col("team").alias("batting_team"), "match_id"), ["batting_team", "match_id"], "left_semi")


def recent_bowling(d: DataFrame, recent: DataFrame) -> DataFrame:
    return d.join(recent.select(F.col("team").alias("bowling_team"), "match_id"), ["bowling_team", "match_id"], "left_semi")


def recent_form(d: DataFrame, matches: DataFrame, n: int = 5, wicket_weight: int = 20) -> DataFrame:
    """Per team and player: runs and wickets in the team's last n
    matches, form = runs + 20 x wickets (J13: full join, zero fill)."""
    rec = recent_matches(matches, n)
    runs = (recent_batting(d, rec).groupBy(F.col("batting_team").alias("team"), F.col("batsman").alias("player"))
            .agg(F.sum(F.col("batsman_runs")).alias("recent_runs")))
    wkts = (recent_bowling(d, rec).groupBy(F.col("bowling_team").alias("team"), F.col("bowler").alias("player"))
            .agg(F.count_if(F.col("is_wicket")).alias("recent_wickets")))
    out = runs.join(wkts, ["team", "player"], "full").na.fill({"recent_runs": 0, "recent_wickets": 0})
    return out.withColumn("form_score", F.col("recent_runs") + F.col("recent_wickets") * wicket_weight)


def best_powerplay_batter(d: DataFrame, matches: DataFrame, n: int = 5) -> DataFrame:
    """Per team, the recent batter with most powerplay runs (ties: name)."""
    rec = recent_batting(d, recent_matches(matches, n)).filter(F.col("over_num") <= E.POWERPLAY_LAST_OVER)
    g = rec.groupBy(F.col("batting_team").alias("team"), "batsman").agg(F.sum(F.col("batsman_runs")).alias("pp_runs"))
    return topk.top_k_per_group(g, 1, ["team"], F.col("pp_runs").desc(), "batsman").drop("rank")


def best_middle_batter(d: DataFrame, matches: DataFrame, n: int = 5) -> DataFrame:
    """Per team, best mean of per-match runs in overs 7 to 15."""
    rec = recent_batting(d, recent_matches(matches, n)).filter(F.col("over_num").between(E.POWERPLAY_LAST_OVER + 1, E.MIDDLE_LAST_OVER))
    per_match = rec.groupBy("batting_team", "batsman", "match_id").agg(F.sum(F.col("batsman_runs")).alias("r"))
    g = per_match.groupBy(F.col("batting_team").alias("team"), "batsman").agg(F.avg("r").alias("avg_runs"))
    return topk.top_k_per_group(g, 1, ["team"], F.col("avg_runs").desc(), "batsman").drop("rank")


def best_death_bowler(d: DataFrame, matches: DataFrame, n: int = 5, min_balls: int = 12) -> DataFrame:
    """Per team, the recent death bowler with the lowest economy
    (at least ``min_balls`` balls)."""
    rec = recent_bowling(d, recent_matches(matches, n)).filter(F.col("over_num") >= E.DEATH_FIRST_OVER)
    g = (rec.groupBy(F.col("bowling_team").alias("team"), "bowler")
         .agg(F.count("*").alias("balls"), F.sum(F.col("total_runs")).alias("runs"))
         .filter(F.col("balls") >= min_balls)
         .withColumn("economy", F.col("runs") / (F.col("balls") / 6)))
    return topk.top_k_per_group(g, 1, ["team"], F.col("economy").asc(), "bowler").drop("rank")


def duels(d: DataFrame) -> DataFrame:
    """Every batter v bowler pair that met: runs, balls, dismissals of
    that batter, strike rate."""
    g = d.groupBy("batsman", "bowler").agg(
        F.sum(F.col("batsman_runs")).alias("runs"), F.count("*").alias("balls"),
        F.count_if(F.col("is_wicket") & (F.col("player_dismissed") == F.col("batsman"))).alias("dismissals"))
    return g.withColumn("strike_rate", F.col("runs") / F.greatest(F.col("balls"), F.lit(1)) * 100)


def consistency(d: DataFrame, matches: DataFrame, n: int = 5, min_matches: int = 3) -> DataFrame:
    """Per team and batter over recent matches: matches, mean and sample
    standard deviation of per-match runs (0 when undefined)."""
    rec = recent_batting(d, recent_matches(matches, n))
    per_match = rec.groupBy("batting_team", "batsman", "match_id").agg(F.sum(F.col("batsman_runs")).alias("r"))
    g = per_match.groupBy(F.col("batting_team").alias("team"), "batsman").agg(
        F.count_distinct("match_id").alias("matches"), F.avg("r").alias("avg_runs"),
        F.count("r").alias("_n"), F.sum("r").alias("_s"), F.sum(F.col("r") * F.col("r")).alias("_q"))
    return g.filter(F.col("matches") >= min_matches).select(
        "team", "batsman", "matches", "avg_runs", sample_std("_n", "_s", "_q").alias("std_runs"))


def sample_std(n: str, s: str, q: str) -> Column:
    """Sample standard deviation from exact integer count, sum and sum of
    squares (0 below two values): the only rounding is one division and the
    square root, so any engine gives the same bits."""
    n_, s_, q_ = F.col(n), F.col(s), F.col(q)
    var = (n_ * q_ - s_ * s_) / (n_ * (n_ - 1))
    return F.when(n_ > 1, F.sqrt(var)).otherwise(F.lit(0.0))


def batting_positions(d: DataFrame, literal_minima: bool = True) -> DataFrame:
    """Batting position by first appearance in each innings.

    Literal (trap 23): separate minima of over and ball; otherwise the first
    ball actually faced. Partitioned by innings, bounded by the game."""
    g = d.groupBy("match_id", "inning", "batting_team", "batsman")
    if literal_minima:
        g = g.agg(F.min("over_num").alias("first_over"), F.min("ball_num").alias("first_ball"))
    else:
        g = g.agg(F.min(F.struct("over_num", "ball_num")).alias("_f")).select(
            "match_id", "inning", "batting_team", "batsman",
            F.col("_f.over_num").alias("first_over"), F.col("_f.ball_num").alias("first_ball"))
    w = Window.partitionBy("match_id", "inning").orderBy("first_over", "first_ball", "batsman")
    return g.withColumn("batting_position", F.row_number().over(w))


def batting_depth(d: DataFrame, lo: int = 6, hi: int = 8) -> DataFrame:
    """Innings batted at positions lo..hi per team and batter."""
    pos = batting_positions(d).filter(F.col("batting_position").between(lo, hi))
    return pos.groupBy(F.col("batting_team").alias("team"), "batsman").agg(F.count("*").alias("innings_at_6_8"))


def bowling_phase_effectiveness(d: DataFrame, matches: DataFrame, n: int = 5) -> DataFrame:
    """Per team and phase (recent matches): balls, wickets, wickets per
    over and economy (a zero over count reads as 1)."""
    rec = recent_bowling(d, recent_matches(matches, n))
    g = rec.groupBy(F.col("bowling_team").alias("team"), E.phase_of_over(F.col("over_num")).alias("phase")).agg(
        F.count("*").alias("balls"), F.count_if(F.col("is_wicket")).alias("wickets"), F.sum(F.col("total_runs")).alias("runs"))
    return g.withColumns({
        "wickets_per_over": E.safe_div(F.col("wickets"), F.col("balls") / 6),
        "economy": E.safe_div(F.col("runs"), F.col("balls") / 6),
    })


def weakness_profile(d: DataFrame) -> DataFrame:
    """Dismissals by kind for every dismissed batter."""
    out = d.filter(F.col("player_dismissed").isNotNull() & (F.col("player_dismissed") != ""))
    return out.groupBy("player_dismissed", "dismissal_kind").agg(F.count("*").alias("dismissals"))


# ------------------------------------------------------------------ A26 - A36
def batting_depth_score(d: DataFrame) -> DataFrame:
    """Total runs / distinct batters per team."""
    return d.groupBy(F.col("batting_team").alias("team")).agg(
        F.sum(F.col("batsman_runs")).alias("total_runs"), F.count_distinct("batsman").alias("unique_batters")
    ).withColumn("depth_score", F.col("total_runs") / F.col("unique_batters"))


def bowling_variety(d: DataFrame) -> DataFrame:
    """Wickets / distinct bowlers per team."""
    return d.groupBy(F.col("bowling_team").alias("team")).agg(
        F.count_if(F.col("is_wicket")).alias("total_wickets"), F.count_distinct("bowler").alias("unique_bowlers")
    ).withColumn("variety_index", F.col("total_wickets") / F.col("unique_bowlers"))


def toss_advantage(matches: DataFrame, min_matches: int = 3) -> DataFrame:
    """How often the toss winner also won, per toss winner."""
    helped = _i(F.col("toss_winner") == F.col("winner"))
    return (matches.groupBy(F.col("toss_winner").alias("team"))
            .agg((F.avg(helped) * 100).alias("win_rate"), F.count("*").alias("matches"))
            .filter(F.col("matches") >= min_matches))


def toss_decision_win(matches: DataFrame) -> DataFrame:
    """Win percent of the toss winner by toss decision."""
    return matches.groupBy("toss_decision").agg(
        (F.avg(_i(F.col("toss_winner") == F.col("winner"))) * 100).alias("win_pct"))


def phase_run_rate_top_teams(d: DataFrame, k: int = 8) -> DataFrame:
    """Mean runs per ball by phase for the k highest-scoring teams.
    The top-k team list is at most k rows."""
    totals = d.groupBy("batting_team").agg(F.sum(F.col("batsman_runs")).alias("runs"))
    top = topk.top_k(totals, k, F.col("runs").desc(), "batting_team").select("batting_team")
    return (d.join(top, "batting_team", "left_semi")
            .groupBy(F.col("batting_team").alias("team"), E.phase_of_over(F.col("over_num")).alias("phase"))
            .agg(F.avg(F.col("total_runs")).alias("avg_runs")))


def ordered_pairs(matches: DataFrame) -> DataFrame:
    """Every fixture seen from both sides: (team_a, team_b, winner, ...)."""
    a = matches.select(F.col("team1").alias("team_a"), F.col("team2").alias("team_b"), "*")
    b = matches.select(F.col("team2").alias("team_a"), F.col("team1").alias("team_b"), "*")
    return a.unionByName(b)


def head_to_head(matches: DataFrame, toss_boost: float = 5.0) -> DataFrame:
    """A31 + A33 (record): for every ordered pair that met: meetings, wins
    each way, and the win probability of team_a with and without the toss
    (+/- boost, clipped to 0..100)."""
    g = ordered_pairs(matches).groupBy("team_a", "team_b").agg(
        F.count("*").alias("meetings"),
        F.count_if(F.col("winner") == F.col("team_a")).alias("a_wins"),
        F.count_if(F.col("winner") == F.col("team_b")).alias("b_wins"))
    base = F.col("a_wins") / F.col("meetings") * 100
    return g.withColumns({
        "prob_a_toss_won": E.clip(base + toss_boost, 0, 100),
        "prob_a_toss_lost": E.clip(base - toss_boost, 0, 100),
    })


def expected_first_innings(d: DataFrame, matches: DataFrame, default: float = 160.0) -> DataFrame:
    """A32 (+ J15): for every (team, venue) where the team played: mean of the
    venue's and the team's first-innings totals, 160 for a missing side."""
    inn = (d.filter(F.col("inning") == 1).groupBy("match_id", "batting_team").agg(F.sum(F.col("total_runs")).alias("innings_total"))
           .join(matches.select("match_id", "venue"), "match_id", "left"))
    venue_avg = inn.groupBy("venue").agg(F.avg("innings_total").alias("venue_avg"))
    team_avg = inn.groupBy(F.col("batting_team").alias("team")).agg(F.avg("innings_total").alias("team_avg"))
    pairs = teams_long(matches).select("team", "venue").distinct()
    return (pairs.join(venue_avg, "venue", "left").join(team_avg, "team", "left")
            .withColumn("expected_score", (F.coalesce("venue_avg", F.lit(default))
                                           + F.coalesce("team_avg", F.lit(default))) / 2))


def venue_win_pct(matches: DataFrame) -> DataFrame:
    """Win percent of every team at every venue it played."""
    return (teams_long(matches).groupBy("team", "venue")
            .agg(F.count("*").alias("matches"), (F.avg(_i(F.col("winner") == F.col("team"))) * 100).alias("win_pct")))


def toss_impact(matches: DataFrame) -> DataFrame:
    """Win percent after winning the toss, per team."""
    return matches.groupBy(F.col("toss_winner").alias("team")).agg(
        (F.avg(_i(F.col("winner") == F.col("toss_winner"))) * 100).alias("toss_win_pct"))


def upset_proxy(matches: DataFrame) -> DataFrame:
    """For every ordered pair that met: (0.5 - win-rate gap) x 100,
    clipped; win rates over all of each team's matches."""
    wr = teams_long(matches).groupBy("team").agg(F.avg(_i(F.col("winner") == F.col("team"))).alias("wr"))
    pairs = ordered_pairs(matches).select("team_a", "team_b").distinct()
    a = wr.select(F.col("team").alias("team_a"), F.col("wr").alias("team_wr"))
    b = wr.select(F.col("team").alias("team_b"), F.col("wr").alias("opp_wr"))
    out = pairs.join(a, "team_a").join(b, "team_b")
    return out.withColumn("upset_prob", E.clip((F.lit(0.5) - (F.col("team_wr") - F.col("opp_wr"))) * 100, 0, 100))


def team_rates(d: DataFrame) -> DataFrame:
    """Team run rate (batting) and economy (bowling), runs per over with
    at least one over in the denominator, plus A41-style dot rate (P21)."""
    bat = d.groupBy(F.col("batting_team").alias("team")).agg(F.sum(F.col("total_runs")).alias("bat_runs"), F.count("*").alias("bat_balls"))
    bowl = d.groupBy(F.col("bowling_team").alias("team")).agg(
        F.sum(F.col("total_runs")).alias("bowl_runs"), F.count("*").alias("bowl_balls"),
        (F.avg(_i(E.is_dot("batsman_runs", "extra_runs"))) * 100).alias("dot_rate"))
    return bat.join(bowl, "team", "full").select(
        "team", E.per_over(F.col("bat_runs"), F.col("bat_balls")).alias("run_rate"),
        E.per_over(F.col("bowl_runs"), F.col("bowl_balls")).alias("economy"), "dot_rate")


def phase_run_rates(d: DataFrame) -> DataFrame:
    """Run rate by phase per batting team (a zero over count reads as 1)."""
    g = d.groupBy(F.col("batting_team").alias("team"), E.phase_of_over(F.col("over_num")).alias("phase")).agg(
        F.sum(F.col("total_runs")).alias("runs"), F.count("*").alias("balls"))
    return g.withColumn("run_rate", E.safe_div(F.col("runs"), F.col("balls") / 6))


def qualification_approx(matches: DataFrame, season_games: int = 14, points_needed: int = 16) -> DataFrame:
    """Current points plus 2 x projected wins of the remaining games
    against the points needed, capped at 100 percent."""
    g = teams_long(matches).groupBy("team").agg(
        F.count("*").alias("played"), F.count_if(F.col("winner") == F.col("team")).alias("won"))
    wr = F.col("won") / F.col("played")
    remaining = F.greatest(F.greatest(F.col("played"), F.lit(season_games)) - F.col("played"), F.lit(0))
    projected = wr * remaining
    return g.select("team", "played", "won", (F.col("won") * 2).alias("points"),
                    (F.least((F.col("won") * 2 + projected * 2) / points_needed, F.lit(1.0)) * 100).alias("qual_pct"))


# ------------------------------------------------------------------ A37 - A44
def top_run_scorers(d: DataFrame, k: int = 10) -> DataFrame:
    """The k batters with most runs."""
    g = d.groupBy("batsman").agg(F.sum(F.col("batsman_runs")).alias("total_runs"))
    return topk.top_k(g, k, F.col("total_runs").desc(), "batsman")


def top_wicket_takers(d: DataFrame, k: int = 10) -> DataFrame:
    g = d.filter(F.col("is_wicket")).groupBy("bowler").agg(F.count("*").alias("wickets"))
    return topk.top_k(g, k, F.col("wickets").desc(), "bowler")


def top_six_hitters(d: DataFrame, k: int = 10) -> DataFrame:
    g = d.filter(F.col("batsman_runs") == 6).groupBy("batsman").agg(F.count("*").alias("sixes"))
    return topk.top_k(g, k, F.col("sixes").desc(), "batsman")


def team_totals(d: DataFrame, k: int = 12) -> DataFrame:
    g = d.groupBy("batting_team").agg(F.sum(F.col("batsman_runs")).alias("total_runs"))
    return topk.top_k(g, k, F.col("total_runs").desc(), "batting_team")


def records(d: DataFrame) -> DataFrame:
    """Highest individual score, highest team total, sixes, fours. One
    pass sums each batter's innings; the sums count once for the batter and
    once for the team."""
    card = d.groupBy("match_id", "batting_team", "batsman").agg(
        F.sum("batsman_runs").alias("r"), F.sum("total_runs").alias("t"),
        F.count_if(F.col("batsman_runs") == 6).alias("sixes"), F.count_if(F.col("batsman_runs") == 4).alias("fours"))
    none = F.lit(0).cast("bigint")
    sides = card.select("match_id", F.explode(F.array(
        F.struct(F.lit("player").alias("kind"), F.col("batsman").alias("name"), F.col("r").alias("v"), "sixes", "fours"),
        F.struct(F.lit("team").alias("kind"), F.col("batting_team").alias("name"), F.col("t").alias("v"), none.alias("sixes"),
                 none.alias("fours")))).alias("x")).select("match_id", "x.*")
    total = sides.groupBy("kind", "match_id", "name").agg(F.sum("v").alias("v"), F.sum("sixes").alias("sixes"), F.sum("fours").alias("fours"))
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("v")))
    return total.agg(best("player").alias("highest_score"), best("team").alias("highest_total"),
                     F.sum("sixes").alias("total_sixes"), F.sum("fours").alias("total_fours"))


def venue_specialists(d: DataFrame, matches: DataFrame, k: int = 5) -> DataFrame:
    """Per venue the top k run scorers and top k wicket takers."""
    dv = d.join(matches.select("match_id", "venue"), "match_id")
    bat = (dv.groupBy("venue", F.col("batsman").alias("player")).agg(F.sum(F.col("batsman_runs")).alias("value"))
           .withColumn("kind", F.lit("runs")))
    bowl = (dv.groupBy("venue", F.col("bowler").alias("player")).agg(F.count_if(F.col("is_wicket")).alias("value"))
            .withColumn("kind", F.lit("wickets")))
    both = bat.unionByName(bowl)
    return topk.top_k_per_group(both, k, ["venue", "kind"], F.col("value").desc(), "player")


def fastest_scorers(d: DataFrame, min_balls: int = 60, k: int = 10) -> DataFrame:
    """Best strike rate among batters with at least ``min_balls``."""
    g = (d.groupBy("batsman").agg(F.sum(F.col("batsman_runs")).alias("runs"), F.count("*").alias("balls"),
                                  F.count_if(F.col("batsman_runs") == 6).alias("sixes"))
         .filter(F.col("balls") >= min_balls)
         .withColumn("strike_rate", F.col("runs") / F.col("balls") * 100))
    return topk.top_k(g, k, F.col("strike_rate").desc(), "batsman")


def momentum(d: DataFrame, from_over: int = 18, k: int = 8) -> DataFrame:
    """Mean runs per ball in the last overs, top k teams."""
    g = d.filter(F.col("over_num") >= from_over).groupBy("batting_team").agg(F.avg(F.col("total_runs")).alias("avg_runs"))
    return topk.top_k(g, k, F.col("avg_runs").desc(), "batting_team")


def bowlers_vs_opponent(d: DataFrame, k: int = 10) -> DataFrame:
    """For every (bowling team, batting team) the k bowlers with most
    wickets against that opponent."""
    g = d.groupBy("bowling_team", "batting_team", "bowler").agg(F.count_if(F.col("is_wicket")).alias("wickets"))
    return topk.top_k_per_group(g, k, ["bowling_team", "batting_team"], F.col("wickets").desc(), "bowler")


def leaders(d: DataFrame) -> DataFrame:
    """Leading run scorer, six hitter and wicket taker, one row. Every
    ball counts once for its batter and once for its bowler in one map-side
    combined pass; the leader is the least (negative value, name), so ties go
    to the first name."""
    none = F.lit(None).cast("int")
    side = F.explode(F.array(
        F.struct(F.col("batsman").alias("who"), F.col("batsman_runs").cast("int").alias("runs"), none.alias("out")),
        F.struct(F.col("bowler").alias("who"), none.alias("runs"), F.col("is_wicket").cast("int").alias("out"))))
    g = d.select(side.alias("s")).groupBy("s.who").agg(
        F.sum("s.runs").alias("runs"), F.count_if(F.col("s.runs") == 6).alias("sixes"), F.sum("s.out").alias("wickets"))

    def lead(value: str, played: Column) -> Column:
        return F.min(F.when(played, F.struct((-F.col(value)).alias("v"), "who")))["who"]

    return g.agg(lead("runs", F.col("runs").isNotNull()).alias("top_run_player"),
                 lead("sixes", F.col("sixes") > 0).alias("top_six_player"),
                 lead("wickets", F.col("wickets").isNotNull()).alias("top_wicket_player"))


def partnerships(d: DataFrame, team: str | None = None, min_balls: int = 12, k: int = 15) -> DataFrame:
    """Runs and balls per (striker, non-striker), at least ``min_balls``
    balls, top k by runs, per batting team."""
    ok = (F.col("batsman").isNotNull() & (F.trim("batsman") != "")
          & F.col("non_striker").isNotNull() & (F.trim("non_striker") != ""))
    g = (_maybe(d, "batting_team", team).filter(ok)
         .groupBy("batting_team", F.col("batsman").alias("striker"), "non_striker")
         .agg(F.sum(F.col("batsman_runs")).alias("runs"), F.count("*").alias("balls"))
         .filter(F.col("balls") >= min_balls))
    g = g.withColumn("partnership_sr", E.safe_div(F.col("runs"), F.col("balls")) * 100)
    return topk.top_k_per_group(g, k, ["batting_team"], F.col("runs").desc(), "striker", "non_striker")


# ------------------------------------------------------------------ A45 - A57
def points_table(matches: DataFrame, margin_scale: float = 0.1) -> DataFrame:
    """Played, won, lost, points and the margin-rate proxy (trap 24)."""
    long = teams_long(matches)
    won = F.col("winner") == F.col("team")
    runs = F.coalesce(F.col("win_by_runs"), F.lit(0))
    g = long.groupBy("team").agg(
        F.count("*").alias("played"), F.count_if(won).alias("won"),
        F.sum(F.when(won, runs).otherwise(0)).alias("runs_for"),
        F.sum(F.when(~won, runs).otherwise(0)).alias("runs_against"))
    return g.select("team", "played", "won", (F.col("played") - F.col("won")).alias("lost"),
                    (F.col("won") * 2).alias("points"),
                    ((F.col("runs_for") - F.col("runs_against")) / F.greatest(F.col("played"), F.lit(1)) * margin_scale).alias("nrr"))


def head_to_head_matrix(matches: DataFrame) -> DataFrame:
    """Wins of every team over every team it met, in long form (a pair
    that met has a row for each side, also with no win), so no team list is
    needed and none is cut off."""
    sides = [matches.select(F.col(x).alias("team"), F.col(y).alias("opponent"), (F.col("winner") == F.col(x)).alias("won"))
             for x, y in (("team1", "team2"), ("team2", "team1"))]
    return (sides[0].unionByName(sides[1]).groupBy("team", "opponent")
            .agg(F.count("*").alias("played"), F.count_if("won").alias("wins")))


def run_value_counts(d: DataFrame) -> DataFrame:
    """Frequency of every runs-off-the-bat value."""
    return d.groupBy(F.col("batsman_runs").alias("runs")).agg(F.count("*").alias("count"))


def margin_histogram(matches: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram of positive margins (``bins`` buckets
    between the min and max, as the charting library draws them). Margins are
    counted by value first; bounds and bins are read from the counts."""
    counted = matches.filter(F.col(column) > 0).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    bounds = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    raw = F.floor((v - lo) * bins / F.when(hi > lo, hi - lo).otherwise(F.lit(1))).cast("bigint") + 1
    bucket = F.when(hi > lo, F.least(raw, F.lit(bins))).otherwise(F.lit(1).cast("bigint"))
    return counted.crossJoin(bounds).groupBy(bucket.alias("bin")).agg(
        F.sum("n").alias("count"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))


def warehouse_snapshot(matches: DataFrame, players: DataFrame, d: DataFrame,
                       gender: str | None = None) -> DataFrame:
    """One row of scalar counts (scalar subqueries); a gender filters
    all of them."""
    m = _maybe(matches, "gender", gender)
    p = _maybe(players, "gender", gender)
    if gender is not None:
        d = d.join(m.select("match_id"), "match_id", "left_semi")
    teams = teams_long(m).select("team").distinct()
    return m.agg(F.count("*").alias("matches")).select(
        "matches",
        p.agg(F.count_distinct("player_name")).scalar().alias("players"),
        d.agg(F.count("*")).scalar().alias("deliveries"),
        teams.agg(F.count("*")).scalar().alias("teams"))


def latest_valid_date(df: DataFrame, key: str, text: str) -> DataFrame:
    """The latest parsable YYYY-MM-DD date per key (F8 guard)."""
    return df.groupBy(key).agg(F.max(E.guarded_date(text)).alias("last_played_date"))


def team_batters(d: DataFrame, k: int = 10) -> DataFrame:
    """Per team the top k batters by runs with their strike rate."""
    g = d.groupBy(F.col("batting_team").alias("team"), "batsman").agg(
        F.sum(F.col("batsman_runs")).alias("runs"), F.count("*").alias("balls"))
    g = g.withColumn("strike_rate", F.col("runs") / F.col("balls") * 100)
    return topk.top_k_per_group(g, k, ["team"], F.col("runs").desc(), "batsman")


def matches_per_team(matches: DataFrame, k: int = 15) -> DataFrame:
    """Matches per team, top k."""
    g = teams_long(matches).groupBy("team").agg(F.count("*").alias("matches"))
    return topk.top_k(g, k, F.col("matches").desc(), "team")


def column_sample(df: DataFrame, column: str, n: int = 4) -> DataFrame:
    """Min, max and the first n distinct values (sorted) of a column.
    The distinct set is reduced to n values with a bounded top-k first."""
    firsts = df.select(column).distinct().orderBy(column).limit(n)
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value")).select(
        "min_value", "max_value",
        firsts.agg(F.sort_array(F.collect_list(column))).scalar().alias("sample_values"))

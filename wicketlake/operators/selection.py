"""Team selection jobs (G rows) for every country at once, as ranked
windows instead of a driver-side greedy loop (W11, O6, W7, J14, J16).

Every window is partitioned by country and capped by a literal top-k, so
Spark plans a partial ``WindowGroupLimit`` before the shuffle: a country with
a huge player pool ships at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.functions import expressions as E
from wicketlake.operators import topk

# Role quotas of the XI (they sum to 11) and the XI size.
ROLE_QUOTAS = {"Batter": 4, "All-Rounder": 2, "Bowler": 4, "Unknown": 1}
XI = 11


def scored_players(players: DataFrame) -> DataFrame:
    """F13 score and a role folded onto the quota roles."""
    role = F.when(F.col("role").isin(list(ROLE_QUOTAS)), F.col("role")).otherwise("Unknown")
    # Rounded to two digits, half to even, before ranking: ties go by id.
    score = E.xi_score(F.col("batting_avg"), F.col("strike_rate"), F.col("bowling_avg"), F.col("economy"),
                       F.col("runs"), F.col("wickets"))
    return players.withColumns({"role_q": role, "perf_score": F.bround(score.cast("decimal(18,6)"), 2).cast("double")})


def optimal_xi(players: DataFrame) -> DataFrame:
    """G1 (W11): per country, the best players of each role up to its quota,
    then the best of the rest up to 11, ranked in selection order.
    (Names can repeat across players, so everything compares ids, trap 26.)

    A player of the XI is among the best ``XI + max quota`` of the own role,
    so that top-k (limited before the shuffle) comes first; the windows after
    it see at most 15 players of each role of a country."""
    order = (F.col("perf_score").desc(), F.col("player_id"))
    best = topk.top_k_per_group(scored_players(players), XI + max(ROLE_QUOTAS.values()), ["country", "role_q"], *order,
                                rank_col="_r")
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_QUOTAS.items() for x in kv])[F.col("role_q")], F.lit(0))
    country = Window.partitionBy("country")
    staged = best.withColumn("_stage", F.when(F.col("_r") <= quota, 1).otherwise(2))
    ranked = staged.withColumns({"_n": F.count_if(F.col("_stage") == 1).over(country),
                                 "_place": F.row_number().over(country.orderBy("_stage", *order))})
    return (ranked.filter((F.col("_stage") == 1) | (F.col("_place") <= F.greatest(F.lit(XI), F.col("_n"))))
            .withColumnRenamed("_place", "xi_rank").drop("_r", "_n", "_stage", "role_q"))


# Batting position labels.
POSITION_LABELS = {1: "Opener", 2: "Opener", 3: "No.3", 4: "Middle Order", 5: "Middle Order",
                   6: "Finisher", 7: "Finisher", 8: "All-Rounder", 9: "All-Rounder", 10: "Tail", 11: "Tail"}


def batting_order(xi: DataFrame) -> DataFrame:
    """G2 (O6): two best strike rates open, three best averages follow, two
    best strike rates of the rest finish, then the others in XI order."""
    sr, avg = F.col("strike_rate"), F.col("batting_avg")
    r1 = F.row_number().over(Window.partitionBy("country").orderBy(sr.desc(), "xi_rank"))
    df = xi.withColumn("_r1", r1).withColumn("_s1", F.col("_r1") <= 2)
    r2 = F.row_number().over(Window.partitionBy("country", "_s1").orderBy(avg.desc(), "xi_rank"))
    df = df.withColumn("_r2", r2).withColumn("_s2", ~F.col("_s1") & (F.col("_r2") <= 3))
    r3 = F.row_number().over(Window.partitionBy("country", "_s1", "_s2").orderBy(sr.desc(), "xi_rank"))
    df = df.withColumn("_r3", r3).withColumn("_s3", ~F.col("_s1") & ~F.col("_s2") & (F.col("_r3") <= 2))
    seg = F.when(F.col("_s1"), 1).when(F.col("_s2"), 2).when(F.col("_s3"), 3).otherwise(4)
    key = (F.when(F.col("_s1"), F.col("_r1")).when(F.col("_s2"), F.col("_r2"))
           .when(F.col("_s3"), F.col("_r3")).otherwise(F.col("xi_rank")))
    df = df.withColumns({"_seg": seg, "_key": key})
    pos = F.row_number().over(Window.partitionBy("country").orderBy("_seg", "_key"))
    from wicketlake.operators.filters import recode
    return (df.withColumn("batting_position", pos)
            .withColumn("role_in_order", recode(F.col("batting_position"), POSITION_LABELS))
            .select("country", "batting_position", "player_id", "player_name", "role_in_order",
                    sr.alias("sr"), avg.alias("avg")))


def form_xi(players: DataFrame, features: DataFrame, form: DataFrame, k: int = XI) -> DataFrame:
    """G3 (J14 + F13): per country the players ranked by form score +
    0.2 x strike rate + 3 x wickets, missing values zero, top k."""
    pool = players.select("player_name", "country")
    f = features.select("player_name", "strike_rate_live", "wickets")
    fm = form.select(F.col("player").alias("player_name"), "form_score", "recent_runs", "recent_wickets")
    xi = (pool.join(f, "player_name", "left").join(fm, "player_name", "left")
          .na.fill({"form_score": 0, "recent_runs": 0, "recent_wickets": 0, "strike_rate_live": 0.0, "wickets": 0}))
    xi = xi.withColumn("selection_score", E.selection_score(F.col("form_score"), F.col("strike_rate_live"), F.col("wickets")))
    return topk.top_k_per_group(xi, k, ["country"], F.col("selection_score").desc(), "player_name")


def nrr_what_if(points: DataFrame, margins: list[int], per_run: float = 0.005) -> DataFrame:
    """G4 (J16): for every team and hypothetical winning margin, the new
    margin rate and the rank it would give: 1 + teams with a larger rate.
    The points table has one row per team (bounded by the number of teams)."""
    hyp = points.select("team", "nrr", F.explode(F.array(*[F.lit(m) for m in margins])).alias("margin"))
    hyp = hyp.withColumn("new_nrr", F.col("nrr") + F.col("margin") * per_run)
    other = points.select(F.col("nrr").alias("other_nrr"))
    j = hyp.join(other, F.col("other_nrr") > F.col("new_nrr"), "left")
    return j.groupBy("team", "margin", "nrr", "new_nrr").agg((F.count("other_nrr") + 1).alias("new_rank"))


def qualification_pct(points: DataFrame, k: int = 8) -> DataFrame:
    """G5 (W7 + P17): the top k of the table; points share x 70 + percent
    rank of the rate (average ties) x 30, clipped to 0..100."""
    from wicketlake.operators.windows import pandas_pct_rank
    top = topk.top_k(points, k, F.col("points").desc(), F.col("nrr").desc(), "team")
    top = pandas_pct_rank(top, "nrr")
    max_pts = F.max("points").over(Window.partitionBy())
    return top.withColumn("qual_pct", E.clip(F.col("points") / max_pts * 70 + F.col("pct_rank") * 30, 0, 100))

"""Adapter views: the driver's TPC-H-like tables seen as cricket tables.

``deliveries`` (one row per ball) comes from ``lineitem``, ``matches`` (one
row per match) from ``orders``, and ``live`` (the event feed) from
``events``. Every view is a lazy projection of the whole source table, so
Catalyst prunes unused columns into the Parquet scan and removes the ``seq``
window when no downstream operator asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.functions.expressions import zero_padded

# Fixed values of the adapter mapping (shared with the DuckDB oracle text in
# wicketlake.plans.oracle): 50 orders form one match, 25 teams, 11 players a
# side, 20 overs, runs 0..6.
ORDERS_PER_MATCH = 50
N_TEAMS = 25
SQUAD = 11
OVERS = 20


def _match_no(key: Column) -> Column:
    return F.floor(key / ORDERS_PER_MATCH).cast("bigint")


def match_label(m: Column) -> Column:
    """M00042 style match id from the match number."""
    return F.concat(F.lit("M"), zero_padded(m, 5))


def _teams(m: Column) -> tuple[Column, Column]:
    t1 = m % N_TEAMS
    t2 = (m % N_TEAMS + 1 + F.floor(m / N_TEAMS).cast("bigint") % (N_TEAMS - 1)) % N_TEAMS
    return t1, t2


def _nation(t: Column) -> Column:
    return F.concat(F.lit("NATION_"), t.cast("string"))


# Columns that order the balls of a match; the deliveries layer keeps them.
ORDER_COLUMNS = ["m", "k", "pk", "sk", "xp"]


def ball_rows(lineitem: DataFrame) -> DataFrame:
    """The numbers that a delivery is made of, from any subset of the source
    rows: about a third of the bytes of the named delivery, so layers move and
    sort these and name them afterwards."""
    return lineitem.select(
        _match_no(F.col("l_orderkey")).alias("m"),
        F.col("l_orderkey").alias("k"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_extendedprice").alias("xp"),
        F.col("l_linenumber").alias("ball_num"),
        (F.col("l_quantity").cast("int") % 7).alias("runs"),
        F.when(F.col("l_tax") > 0.075, 1).otherwise(0).alias("extra"),
        F.col("l_returnflag").alias("flag"),
    )


def timed_balls(balls: DataFrame) -> DataFrame:
    """``ball_rows`` with the inning and over of each ball."""
    return balls.withColumns({
        "inning": (1 + F.col("k") % 2).cast("int"),
        "over_num": F.floor((F.col("k") % ORDERS_PER_MATCH) * OVERS / ORDERS_PER_MATCH).cast("int"),
    })


def named_balls(balls: DataFrame, *more: str) -> DataFrame:
    """Deliveries from ``timed_balls``, with the columns that order the match
    and the columns ``more`` at the end."""
    base = balls.withColumns({
        "bk": F.col("pk") % SQUAD, "off": 1 + F.col("sk") % 10, "wk": F.col("sk") % SQUAD,
        "is_wicket": F.col("pk") % 20 == 0,
    })
    t1, t2 = _teams(F.col("m"))
    first = F.col("inning") == 1
    bat = _nation(F.when(first, t1).otherwise(t2))
    bowl = _nation(F.when(first, t2).otherwise(t1))
    batsman = F.concat(F.col("batting_team"), F.lit("_B"), F.col("bk").cast("string"))
    return (
        base.withColumns({"batting_team": bat, "bowling_team": bowl})
        .select(
            match_label(F.col("m")).alias("match_id"),
            "inning", "over_num", "ball_num", "batting_team", "bowling_team",
            batsman.alias("batsman"),
            F.concat(F.col("batting_team"), F.lit("_B"),
                     ((F.col("bk") + F.col("off")) % SQUAD).cast("string")).alias("non_striker"),
            F.concat(F.col("bowling_team"), F.lit("_B"), F.col("wk").cast("string")).alias("bowler"),
            F.col("runs").alias("batsman_runs"),
            F.col("extra").alias("extra_runs"),
            (F.col("runs") + F.col("extra")).alias("total_runs"),
            "is_wicket",
            F.when(~F.col("is_wicket"), "not_out").when(F.col("flag") == "R", "caught")
            .when(F.col("flag") == "A", "bowled").otherwise("lbw").alias("dismissal_kind"),
            F.when(F.col("is_wicket"), batsman).alias("player_dismissed"),
            *ORDER_COLUMNS, *more,
        )
    )


def delivery_rows(lineitem: DataFrame) -> DataFrame:
    """One row per ball from any subset of the source rows: the delivery
    without its place in the match, and the columns that order the match."""
    return named_balls(timed_balls(ball_rows(lineitem)))


def sequenced(rows: DataFrame, *within: str) -> DataFrame:
    """``rows`` with each delivery's position in its match. The window is
    bounded by the game (one match is a few hundred balls), so partitioning by
    match never concentrates a large share of the table in one task; rows that
    are dealt by the columns ``within`` are not moved again."""
    order = Window.partitionBy(*within, "m").orderBy("inning", "over_num", "k", "ball_num", "pk", "sk", "xp")
    return rows.withColumn("seq", F.row_number().over(order))


def deliveries(lineitem: DataFrame) -> DataFrame:
    """Ball-by-ball deliveries (silver ``clean_deliveries`` plus
    ``player_dismissed``, ``non_striker`` and a per-match order key ``seq``)."""
    return sequenced(delivery_rows(lineitem)).drop(*ORDER_COLUMNS)


def match_sums(orders: DataFrame) -> DataFrame:
    """What a match takes from its orders, as sums, counts and maxima that add
    up over any split of the orders. Every attribute is an aggregate over all
    orders of the match, so any of its orders can change the row."""
    m = _match_no(F.col("o_orderkey"))
    return orders.groupBy(m.alias("m")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("match_date"),
        F.sum("o_custkey").alias("v"),
        F.sum(F.substring("o_orderpriority", 1, 1).cast("int")).alias("p"),
        F.count_if(F.col("o_orderstatus") == "F").alias("st"),
        F.sum(F.floor("o_totalprice").cast("bigint")).alias("w"),
    )


def merged_match_sums(sums: DataFrame, *within: str) -> DataFrame:
    """Partial rows of ``match_sums`` added up."""
    return sums.groupBy(*within, "m").agg(F.max("match_date").alias("match_date"), *[F.sum(c).alias(c) for c in ("v", "p", "st", "w")])


def matches(orders: DataFrame) -> DataFrame:
    """One row per match (silver ``clean_matches`` before cleaning)."""
    return matches_from_sums(match_sums(orders))


def matches_from_sums(sums: DataFrame) -> DataFrame:
    first = sums.withColumns({"v": F.col("v") % 10, "w": F.col("w") % 20})
    t1, t2 = _teams(F.col("m"))
    t1n, t2n = _nation(t1), _nation(t2)
    w = F.col("w")
    stage = (F.when(F.col("m") % 10 == 0, "Final").when(F.col("m") % 10 == 1, "Semi-Final")
             .when(F.col("m") % 10 <= 4, "Super Eight").otherwise("Group Stage"))
    return first.select(
        match_label(F.col("m")).alias("match_id"),
        "match_date",
        F.concat(F.lit("VENUE_"), F.col("v").cast("string")).alias("venue"),
        t1n.alias("team1"),
        t2n.alias("team2"),
        F.when(F.col("p") % 2 == 1, t1n).otherwise(t2n).alias("toss_winner"),
        F.when(F.col("st") % 2 == 1, "bat").otherwise("field").alias("toss_decision"),
        F.when(w == 0, "No Result").when(w % 2 == 1, t1n).otherwise(t2n).alias("winner"),
        F.when(w == 0, "No Result")
        .when(w <= 10, F.concat((w * 3).cast("string"), F.lit(" runs")))
        .otherwise(F.concat((w - 10).cast("string"), F.lit(" wickets"))).alias("margin"),
        stage.alias("stage"),
        F.when(F.col("m") % 3 == 0, "female").otherwise("male").alias("gender"),
    )


def live(events: DataFrame) -> DataFrame:
    """Live ball events (``live_ball_events``) from the ``events`` table."""
    return events.select(
        "event_id", "ts",
        F.concat(F.lit("L"), (F.col("user_id") % 5).cast("string")).alias("match_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("batsman"),
        (F.floor("value").cast("int") % 7).alias("runs_scored"),
        (F.col("event_type") == "error").alias("is_wicket"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("extras"),
    )


def venues(match_df: DataFrame) -> DataFrame:
    """Venue table (``clean_venues``): the distinct venues of the matches."""
    return (match_df.select(F.col("venue").alias("stadium_name")).distinct()
            .select("stadium_name",
                    F.concat(F.lit("CITY_"), F.regexp_extract("stadium_name", r"(\d+)$", 1)).alias("city"),
                    F.lit("Unknown").alias("country"),
                    F.lit("Balanced").alias("pitch_type")))


def dirty_orders(orders: DataFrame) -> DataFrame:
    """String-typed copy of ``orders`` with blanks, 'n/a', padded percent text
    and nulls injected by key, for the parsing and null-handling operators."""
    bucket = F.col("o_orderkey") % 17

    def dirt(c: Column) -> Column:
        return (F.when(bucket == 1, F.lit("")).when(bucket == 2, F.lit("n/a"))
                .when(bucket == 3, F.lit(" 12.5% ")).when(bucket == 4, F.lit(None).cast("string"))
                .otherwise(c))

    return orders.select(
        F.col("o_orderkey"),
        dirt(F.col("o_totalprice").cast("string")).alias("price_text"),
        dirt(F.col("o_custkey").cast("string")).alias("cust_text"),
        dirt(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_text"),
        dirt(F.col("o_orderpriority")).alias("priority_text"),
    )


def duplicated_orders(orders: DataFrame) -> DataFrame:
    """``orders`` plus an exact second copy of every 97th order, so that the
    duplicate counters and de-duplication have something to find."""
    return orders.unionAll(orders.filter(F.col("o_orderkey") % 97 == 0))

"""Column expressions: parsing, labels, buckets and scores.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; none needs a Python UDF. ANSI mode is on, so every parse uses the
``try_`` family and returns null instead of failing the task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phase boundaries on the zero-based over number, as the source
# data numbers overs (<= 6 powerplay, <= 15 middle, otherwise death).
POWERPLAY_LAST_OVER = 6
MIDDLE_LAST_OVER = 15
DEATH_FIRST_OVER = 16


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- F1, F2, F15
def safe_float(x: Column | str, default: float = 0.0) -> Column:
    """strip, drop '%', parse as double; unparsable or null -> default."""
    cleaned = F.regexp_replace(F.trim(col_(x)), "%", "")
    return F.coalesce(cleaned.try_cast("double"), F.lit(default))


def safe_int(x: Column | str, default: int = 0) -> Column:
    """integer part (toward zero) of the stripped text read as a number;
    unlike ``safe_float`` a '%' sign makes it unparsable."""
    return F.coalesce(F.trim(col_(x)).try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def nullable_float(x: Column | str, default: float | None = None) -> Column:
    """blank or null -> default, otherwise a double (or default if bad)."""
    parsed = F.nullif(F.trim(col_(x)), F.lit("")).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


# ---------------------------------------------------------------- F3
def over_and_ball(ball_text: Column | str) -> tuple[Column, Column]:
    """'12.4' -> (12, 4); '0.10' -> (0, 10). Splits the text, so the tenth
    ball of an over is not read as ball 1 (trap 4)."""
    parts = F.split(F.trim(col_(ball_text)), r"\.")
    over = parts.getItem(0).try_cast("int")
    ball = F.when(F.size(parts) > 1, parts.getItem(1).try_cast("int")).otherwise(F.lit(0))
    return over, ball


# ---------------------------------------------------------------- F4
def margin_number(margin: Column | str) -> tuple[Column, Column]:
    """(win_by_runs, win_by_wickets) from text like '12 runs' / '4 wickets'.

    Accepts 'wkt' and 'wicket' (trap 2). Anything else gives 0 and 0.
    """
    m = F.lower(F.coalesce(col_(margin), F.lit("")))
    lead = F.regexp_extract(m, r"^\s*(\d+)", 1).try_cast("int")
    runs = F.when(m.contains("run"), F.coalesce(lead, F.lit(0))).otherwise(F.lit(0))
    wkts = F.when(m.contains("wkt") | m.contains("wicket"), F.coalesce(lead, F.lit(0))).otherwise(F.lit(0))
    return runs, wkts


# ---------------------------------------------------------------- F5, F9, F16
def title_case(x: Column | str) -> Column:
    """trimmed title case (Spark ``initcap``; see trap 12 for apostrophes)."""
    return F.initcap(F.trim(col_(x)))


def norm_key(x: Column | str) -> Column:
    """F16: comparison key for names: trimmed, lower case."""
    return F.lower(F.trim(col_(x)))


def blank_to_null(x: Column | str) -> Column:
    """trim and turn the empty string into null."""
    return F.nullif(F.trim(col_(x)), F.lit(""))


# ---------------------------------------------------------------- F6, F7, F8
def parse_date(x: Column | str, fmt: str | None = None) -> Column:
    """text to date, null on failure."""
    c = F.trim(col_(x))
    return F.try_to_date(c, F.lit(fmt)) if fmt else F.try_to_date(c)


def date_parts(d: Column | str) -> dict[str, Column]:
    """year, month, month name, weekday name."""
    d = col_(d)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "month_name": F.date_format(d, "MMMM"),
        "day_of_week": F.date_format(d, "EEEE"),
    }


DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"


def guarded_date(x: Column | str) -> Column:
    """F8: a date only when the text looks like YYYY-MM-DD."""
    t = F.trim(col_(x))
    return F.when(t.rlike(DATE_PATTERN), F.try_to_date(t))


def within_months(d: Column | str, as_of: Column, months: int) -> Column:
    """F8: ``d`` falls in the trailing window of ``months`` before ``as_of``."""
    return col_(d) >= F.add_months(as_of, -months)


# ---------------------------------------------------------------- F10
def zero_padded(n: Column, width: int) -> Column:
    """Digits filled with zeros up to ``width``; longer numbers stay whole
    (``lpad`` alone would cut them)."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def padded_id(prefix: str, n: Column, width: int) -> Column:
    """'P' + zero padded number, e.g. P00042."""
    return F.concat(F.lit(prefix), zero_padded(n, width))


# ---------------------------------------------------------------- F12, P17
def safe_div(num: Column, den: Column) -> Column:
    """a zero denominator is replaced by 1."""
    return num / F.when(den == 0, F.lit(1)).otherwise(den)


def per_over(num: Column, balls: Column) -> Column:
    """Runs (or wickets) per six balls, at least one over in the denominator."""
    return num / F.greatest(balls / 6, F.lit(1))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bound to [lo, hi]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


# ---------------------------------------------------------------- P11 - P14
def phase_of_over(over: Column | str) -> Column:
    """Powerplay / Middle / Death from the over number."""
    o = col_(over)
    return (F.when(o <= POWERPLAY_LAST_OVER, "Powerplay")
            .when(o <= MIDDLE_LAST_OVER, "Middle").otherwise("Death"))


def tournament_phase(stage: Column | str) -> Column:
    """Final / Semi Final / Super 8 / Group Stage; 'semi' wins over 'final'."""
    s = F.lower(F.coalesce(col_(stage), F.lit("")))
    return (F.when(s.contains("semi"), "Semi Final").when(s.contains("final"), "Final")
            .when(s.contains("super"), "Super 8").otherwise("Group Stage"))


def wicket_flag(player_dismissed: Column | str, kind: Column | str) -> Column:
    """A wicket when a dismissed name is present or the kind (null read
    as 'not_out') is anything but 'not_out'."""
    name = F.trim(F.coalesce(col_(player_dismissed), F.lit("")))
    k = F.lower(F.coalesce(col_(kind), F.lit("not_out")))
    return (name != "") | (k != "not_out")


def infer_role(wickets: Column | str, runs: Column | str) -> Column:
    """All-rounder / Bowler / Batter / Unknown."""
    w, r = col_(wickets), col_(runs)
    return (F.when((w > 10) & (r > 100), "All-Rounder").when(w > 5, "Bowler")
            .when(r > 100, "Batter").otherwise("Unknown"))


# ---------------------------------------------------------------- P15, P16
def result_type(win_by_runs: Column | str) -> Column:
    """P15: 'runs' when won by runs, otherwise 'wickets' (no-result too)."""
    return F.when(F.coalesce(col_(win_by_runs), F.lit(0)) > 0, "runs").otherwise("wickets")


def result_margin(win_by_runs: Column | str, win_by_wickets: Column | str) -> Column:
    r = F.coalesce(col_(win_by_runs), F.lit(0))
    return F.when(r > 0, r).otherwise(F.coalesce(col_(win_by_wickets), F.lit(0)))


def opponent(team: Column | str, team1: Column | str, team2: Column | str) -> Column:
    """The other side of the fixture."""
    return F.when(col_(team) == col_(team1), col_(team2)).otherwise(col_(team1))


def win_loss(team: Column | str, winner: Column | str) -> Column:
    return F.when(col_(team) == col_(winner), "W").otherwise("L")


# ---------------------------------------------------------------- P20, P21
def event_badge(is_wicket: Column | str, runs: Column | str) -> Column:
    """P20: WICKET / SIX / FOUR / runs text."""
    r = col_(runs)
    return (F.when(col_(is_wicket), "WICKET").when(r == 6, "SIX").when(r == 4, "FOUR")
            .otherwise(F.concat(r.cast("string"), F.lit(" run(s)"))))


def is_dot(batsman_runs: Column | str, extra_runs: Column | str) -> Column:
    """No runs off the bat and no extras."""
    return (col_(batsman_runs) == 0) & (col_(extra_runs) == 0)


# ---------------------------------------------------------------- F13, F14, F17
def selection_score(form_score: Column, strike_rate: Column, wickets: Column) -> Column:
    """F13 (form XI): form + 0.2 x strike rate + 3 x wickets."""
    return form_score + strike_rate * 0.2 + wickets * 3


def xi_score(batting_avg: Column, strike_rate: Column, bowling_avg: Column, economy: Column,
             runs: Column, wickets: Column) -> Column:
    """F13 (optimal XI): batting credit, bowling credit below the average and
    economy caps, and an all-rounder bonus. Missing values take the defaults
    below (fixed values)."""
    bat = F.coalesce(batting_avg, F.lit(0.0)) * 0.30 + F.coalesce(strike_rate, F.lit(0.0)) * 0.10
    bowl = (F.greatest(F.lit(0.0), F.lit(30.0) - F.coalesce(bowling_avg, F.lit(30.0))) * 0.25
            + F.greatest(F.lit(0.0), F.lit(10.0) - F.coalesce(economy, F.lit(8.0))) * 0.10)
    bonus = F.when((F.coalesce(runs, F.lit(0)) > 100) & (F.coalesce(wickets, F.lit(0)) > 5), 15.0).otherwise(0.0)
    return bat + bowl + bonus


def current_run_rate(runs: Column, balls: Column) -> Column:
    """runs per over so far, at least 0.1 over in the denominator."""
    return runs / F.greatest(balls / 6, F.lit(0.1))


def projected_score(runs: Column, balls: Column, overs: int = 20) -> Column:
    """current run rate carried over a full innings."""
    return current_run_rate(runs, balls) * overs


def win_proxy(projected: Column, baseline_rr: Column, overs: int = 20) -> Column:
    """projected total against the baseline total, scaled to 25..75 and
    clipped to 5..95 (fixed values)."""
    return clip(projected / F.greatest(baseline_rr * overs, F.lit(1)) * 50 + 25, 5, 95)


def over_axis(over: Column | str, ball: Column | str) -> Column:
    """over + ball / 10 for an over.ball axis."""
    return col_(over) + col_(ball) / 10

"""Raw file readers (S1 to S8): text CSV tables, many-file ball-by-ball scans
and the ragged key/value match info files.

All readers are plain Spark file scans: they split by file and byte range
across executors, take an explicit all-string schema (no inference pass) and
tag rows with their source file through the ``_metadata`` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OVERFLOW = "_overflow"

# The ball file header (all text).
BALL_COLUMNS = ["match_id", "season", "start_date", "venue", "innings", "ball", "batting_team",
                "bowling_team", "striker", "non_striker", "bowler", "runs_off_bat", "extras",
                "wides", "noballs", "byes", "legbyes", "penalty", "wicket_type",
                "player_dismissed", "other_wicket_type", "other_player_dismissed"]


def normalise_name(name: str) -> str:
    """Lower case, strip, spaces to underscores."""
    return name.lower().strip().replace(" ", "_")


def normalise_columns(df: DataFrame) -> DataFrame:
    """S5 on every column of a DataFrame."""
    return df.toDF(*[normalise_name(c) for c in df.columns])


def string_schema(columns: list[str], overflow: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in columns]
    if overflow:
        fields.append(T.StructField(OVERFLOW, T.StringType()))
    return T.StructType(fields)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line (reads one line, no inference)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                  rename: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """S1 + S5 + S6 + S7: every column as text; a line with more fields than
    the header is skipped, a short line is kept with nulls (trap 25); names
    normalised, renamed, pruned; all-null rows dropped."""
    columns = columns or read_header(spark, path)
    df = (spark.read.schema(string_schema(columns)).option("header", True)
          .option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
          .filter(F.col(OVERFLOW).isNull()).drop(OVERFLOW))
    df = normalise_columns(df)
    if rename:
        df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    if keep:
        df = df.select(*[c for c in keep if c in df.columns])
    return df.na.drop(how="all")


def read_ball_files(spark: SparkSession, path: str, key_pattern: str | None = r"([^/]+)\.csv$",
                    columns: list[str] | None = None) -> DataFrame:
    """Many ball-by-ball files in one scan. With one match per file the
    match key comes from the file path (``key_pattern``'s first group) and
    overwrites ``match_id``; without a pattern, files hold many matches and
    the ``match_id`` column stays."""
    columns = columns or BALL_COLUMNS
    df = (spark.read.schema(string_schema(columns)).option("header", True)
          .option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.csv").csv(path)
          .filter(F.col(OVERFLOW).isNull()).drop(OVERFLOW))
    df = normalise_columns(df)
    if key_pattern is None:
        return df
    return df.withColumn("match_id", F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1))


INFO_DDL = "f0 STRING, f1 STRING, f2 STRING, f3 STRING, f4 STRING"


def read_info_lines(spark: SparkSession, path: str, key_pattern: str = r"([^/]+?)(_info)?\.csv$",
                    glob: str = "*.csv") -> DataFrame:
    """S3: the ragged ``info,<key>,<value>[,<value2>]`` lines of every info
    file with their line position. Each file is one small record (a few dozen
    lines), split into lines on the executor that read it."""
    files = (spark.read.option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).text(path, wholetext=True)
             .select(F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1).alias("match_no"),
                     F.col("_metadata.file_path").alias("_file"), "value"))
    return _parse_info(files.select("match_no", "_file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")))


def read_info_archive(spark: SparkSession, path: str) -> DataFrame:
    """S3 at scale: files that hold the info lines of many matches, each line
    behind its match id and position (tab-separated); splittable by line."""
    parts = F.split("value", "\t", 3)
    return _parse_info(spark.read.text(path).select(
        parts[0].alias("match_no"), F.col("_metadata.file_path").alias("_file"), parts[1].cast("int").alias("pos"),
        parts[2].alias("line")))


def _parse_info(lines: DataFrame) -> DataFrame:
    parsed = lines.filter(F.length("line") > 0).select(
        "match_no", "_file", "pos", F.from_csv("line", INFO_DDL).alias("r"))
    return (parsed.filter((F.col("r.f0") == "info") & F.col("r.f2").isNotNull())
            .select("match_no", "_file", "pos", F.col("r.f1").alias("key"),
                    F.col("r.f2").alias("value"), F.col("r.f3").alias("value2")))


def info_to_matches(info: DataFrame) -> DataFrame:
    """S3 + S4: one raw match row per file. Teams keep their line order, the
    first value wins for every other key (one partial aggregate per file)."""
    def first(key: str):
        return F.min_by("value", F.when(F.col("key") == key, F.col("pos")))

    agg = info.groupBy("match_no").agg(
        F.sort_array(F.collect_list(F.when(F.col("key") == "team", F.struct("pos", "value")))).alias("teams"),
        *[first(k).alias(k) for k in ("winner", "winner_runs", "winner_wickets", "date", "venue",
                                      "city", "toss_winner", "toss_decision", "gender")],
    )
    runs, wkts = F.col("winner_runs"), F.col("winner_wickets")
    return agg.select(
        "match_no",
        F.lit("Group Stage").alias("stage"),
        F.lit("").alias("group"),
        F.coalesce(F.regexp_replace("date", "/", "-"), F.lit("")).alias("date"),
        F.coalesce("venue", F.lit("Unknown Venue")).alias("venue"),
        F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce(F.col("teams")[0]["value"], F.lit("Unknown")).alias("team1"),
        F.coalesce(F.col("teams")[1]["value"], F.lit("Unknown")).alias("team2"),
        F.coalesce("toss_winner", F.lit("")).alias("toss_winner"),
        F.coalesce("toss_decision", F.lit("bat")).alias("toss_decision"),
        F.coalesce("winner", F.lit("")).alias("winner"),
        F.when(F.coalesce("winner", F.lit("")) != "", "normal").otherwise("no result").alias("result"),
        F.when(F.coalesce(runs, F.lit("")) != "", F.concat(runs, F.lit(" runs")))
        .when(F.coalesce(wkts, F.lit("")) != "", F.concat(wkts, F.lit(" wickets")))
        .otherwise("No Result").alias("margin"),
        F.col("gender"),
    )


def info_to_squads(info: DataFrame) -> DataFrame:
    """S3: ``info,player,<team>,<name>`` rows, distinct per (team, name)."""
    return (info.filter((F.col("key") == "player") & F.col("value2").isNotNull())
            .select(F.col("value").alias("team"), F.col("value2").alias("player_name"))
            .distinct()
            .withColumns({"role": F.lit("Unknown"), "designation": F.lit("Playing XI")}))


# ------------------------------------------------------------------ exporters
def write_ball_files(deliveries: DataFrame, path: str) -> None:
    """Write deliveries in the raw ball-file layout (all text, '<over>.<ball>'
    notation), files of many matches each, so the raw readers run on data
    derived from the driver tables."""
    out = deliveries.select(
        F.col("match_id"),
        F.lit("2026").alias("season"),
        F.lit("").alias("start_date"),
        F.lit("").alias("venue"),
        F.col("inning").cast("string").alias("innings"),
        F.concat_ws(".", F.col("over_num").cast("string"), F.col("ball_num").cast("string")).alias("ball"),
        "batting_team", "bowling_team",
        F.col("batsman").alias("striker"), "non_striker", "bowler",
        F.col("batsman_runs").cast("string").alias("runs_off_bat"),
        F.col("extra_runs").cast("string").alias("extras"),
        *[F.lit(None).cast("string").alias(c) for c in ("wides", "noballs", "byes", "legbyes", "penalty")],
        F.when(F.col("is_wicket"), F.col("dismissal_kind")).alias("wicket_type"),
        "player_dismissed",
        F.lit(None).cast("string").alias("other_wicket_type"),
        F.lit(None).cast("string").alias("other_player_dismissed"),
    )
    out.write.mode("overwrite").option("header", True).csv(path)


def write_info_files(matches: DataFrame, deliveries: DataFrame, path: str) -> None:
    """Write the ragged info lines of every match (version line, info keys,
    squads) as archive files of many matches (``read_info_archive``)."""
    m = matches
    margin_runs = F.regexp_extract("margin", r"^(\d+) runs$", 1)
    margin_wkts = F.regexp_extract("margin", r"^(\d+) wickets$", 1)
    kv = [
        (0, F.lit("version,2.2.0")),
        (1, F.concat(F.lit("info,team,"), "team1")),
        (2, F.concat(F.lit("info,team,"), "team2")),
        (3, F.concat(F.lit("info,gender,"), "gender")),
        (4, F.concat(F.lit("info,date,"), F.date_format("match_date", "yyyy/MM/dd"))),
        (5, F.concat(F.lit("info,venue,"), "venue")),
        (6, F.concat(F.lit("info,toss_winner,"), "toss_winner")),
        (7, F.concat(F.lit("info,toss_decision,"), "toss_decision")),
        (8, F.when(F.col("winner") != "No Result", F.concat(F.lit("info,winner,"), "winner"))),
        (9, F.when(margin_runs != "", F.concat(F.lit("info,winner_runs,"), margin_runs))),
        (10, F.when(margin_wkts != "", F.concat(F.lit("info,winner_wickets,"), margin_wkts))),
        (11, F.lit("info,umpire,First Umpire")),
        (12, F.lit("info,umpire,Second Umpire")),
    ]
    head = m.select("match_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("line")) for i, c in kv])).alias("x"))
    players = (deliveries.select("match_id", F.col("batting_team").alias("team"), F.col("batsman").alias("name"))
               .unionByName(deliveries.select("match_id", F.col("bowling_team").alias("team"), F.col("bowler").alias("name")))
               .distinct()
               .select("match_id", F.struct(F.lit(100).alias("i"),
                                            F.concat_ws(",", F.lit("info"), F.lit("player"), "team", "name").alias("line")).alias("x")))
    lines = head.unionByName(players).filter(F.col("x.line").isNotNull())
    lines.select(F.concat_ws("\t", "match_id", F.col("x.i").cast("string"), "x.line").alias("value")).write.mode("overwrite").text(path)

"""Document building and vector retrieval (X rows).

Documents are rows (id, doc_type, text, meta struct) built from the tables
with string templates. Vector search goes through ``vector_index`` and text
search through ``text_index``; ``nearest_by_scan`` compares every vector: the
vectors are dealt into salts, the stated query set is copied to every salt,
both meet in an equi-join on the salt, and a per-query ``row_number() <= k``
(with its partial group limit) keeps the top k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.operators import topk
from wicketlake.retrieval import text_index
from wicketlake.retrieval.vector_index import squared_distance
from wicketlake.session import written


def one_digit(c: Column) -> Column:
    """A rate to one decimal, half to even, so no formatter meets a tie."""
    return F.bround(F.coalesce(c, F.lit(0)).cast("decimal(18,6)"), 1).cast("double")


def match_documents(cm: DataFrame) -> DataFrame:
    """One summary document per match."""
    result = (F.when(F.col("winner") == "No Result", F.lit("no result"))
              .when(F.col("win_by_runs") > 0, F.format_string("%s won by %d runs", "winner", "win_by_runs"))
              .when(F.col("win_by_wickets") > 0, F.format_string("%s won by %d wickets", "winner", "win_by_wickets"))
              .otherwise(F.format_string("%s won", "winner")))
    text = F.format_string("%s against %s, played on %s at %s. %s took the toss and chose to %s. Outcome: %s. "
                           "Best player: %s. Phase: %s.", "team1", "team2", F.col("match_date").cast("string"), "venue",
                           "toss_winner", "toss_decision", result, "player_of_match", "tournament_phase")
    return cm.select(F.concat(F.lit("match_"), "match_id").alias("id"), F.lit("match").alias("doc_type"),
                     text.alias("text"),
                     F.struct(F.lit("match").alias("type"), "team1", "team2", "winner",
                              F.col("tournament_phase").alias("phase")).alias("meta"))


def player_documents(players: DataFrame) -> DataFrame:
    """One profile per player."""
    text = F.format_string("%s plays for %s as %s. With the bat: %d runs, average %.1f, strike rate %.1f, %d hundreds, %d fifties. "
                           "With the ball: %d wickets, average %.1f, economy %.1f.",
                           "player_name", "country", "role", "runs", one_digit(F.col("batting_avg")),
                           one_digit(F.col("strike_rate")), "hundreds", "fifties", "wickets",
                           one_digit(F.col("bowling_avg")), one_digit(F.col("economy")))
    return players.select(F.concat(F.lit("player_"), "player_id").alias("id"), F.lit("player").alias("doc_type"),
                          text.alias("text"),
                          F.struct(F.lit("player").alias("type"), F.col("player_name").alias("name"), "country", "role").alias("meta"))


def team_stats(cm: DataFrame, d: DataFrame) -> DataFrame:
    """Per-team statistics for the team documents: matches, and the
    team's batting and bowling over all balls."""
    long = cm.select("winner", F.explode(F.array("team1", "team2")).alias("team"))
    g = long.groupBy("team").agg(F.count("*").alias("matches"), F.count_if(F.col("winner") == F.col("team")).alias("wins"))
    bat = d.groupBy(F.col("batting_team").alias("team")).agg(
        F.sum("batsman_runs").alias("runs"), F.count_if(F.col("batsman_runs") == 6).alias("sixes"),
        (F.sum("batsman_runs") / F.count("*") * 100).alias("strike_rate"))
    bowl = d.groupBy(F.col("bowling_team").alias("team")).agg(F.count_if("is_wicket").alias("wickets"))
    zero = F.lit(0).cast("long")
    return g.join(bat, "team", "left").join(bowl, "team", "left").select(
        "team", "matches", "wins", (F.col("matches") - F.col("wins")).alias("lost"),
        (F.col("wins") / F.col("matches") * 100).alias("win_pct"), F.coalesce("runs", zero).alias("runs"),
        F.coalesce("wickets", zero).alias("wickets"), F.coalesce("strike_rate", F.lit(0.0)).alias("strike_rate"),
        F.coalesce("sixes", zero).alias("sixes"))


def team_documents(cm: DataFrame, d: DataFrame) -> DataFrame:
    s = team_stats(cm, d)
    text = F.format_string("%s played %d matches, won %d and lost %d, a win share of %.1f percent. Runs: %d, wickets: %d, "
                           "strike rate: %.1f, sixes: %d.", "team", "matches", "wins", "lost", one_digit(F.col("win_pct")),
                           "runs", "wickets", one_digit(F.col("strike_rate")), "sixes")
    return s.select(F.concat(F.lit("team_"), "team").alias("id"), F.lit("team").alias("doc_type"), text.alias("text"),
                    F.struct(F.lit("team").alias("type"), "team").alias("meta"))


def venue_match_counts(venues: DataFrame, cm: DataFrame) -> DataFrame:
    """Matches whose venue text contains the stadium name (plain
    containment, not a pattern: trap 22). Matches are counted per venue text
    first, so the containment test sees one row per text, not per match."""
    texts = cm.groupBy("venue").agg(F.count("match_id").alias("n"))
    j = venues.select("stadium_name", "city").join(texts, F.col("venue").contains(F.col("stadium_name")), "left")
    return j.groupBy("stadium_name", "city").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))


def venue_documents(venues: DataFrame, cm: DataFrame) -> DataFrame:
    c = venue_match_counts(venues, cm)
    text = F.format_string("%s in %s hosted %d matches.", "stadium_name", "city", "matches")
    return c.select(F.concat(F.lit("venue_"), "stadium_name").alias("id"), F.lit("venue").alias("doc_type"),
                    text.alias("text"), F.struct(F.lit("venue").alias("type"), "stadium_name").alias("meta"))


def fact_documents(cm: DataFrame, d: DataFrame) -> DataFrame:
    """Tournament fact documents derived from the tables (one row each)."""
    m = cm.agg(F.count("*").alias("n"))
    runs = d.agg(F.sum("total_runs")).scalar()
    sixes = d.agg(F.count_if(F.col("batsman_runs") == 6)).scalar()
    facts = m.select(F.explode(F.array(
        F.struct(F.lit("fact_matches").alias("id"), F.format_string("The tournament had %d matches.", "n").alias("text")),
        F.struct(F.lit("fact_runs").alias("id"), F.format_string("%d runs were scored.", runs).alias("text")),
        F.struct(F.lit("fact_sixes").alias("id"), F.format_string("%d sixes were hit.", sixes).alias("text")),
    )).alias("f"))
    return facts.select("f.id", F.lit("fact").alias("doc_type"), "f.text")


def all_documents(cm: DataFrame, players: DataFrame, venues: DataFrame, d: DataFrame) -> DataFrame:
    """Union of unlike document sets (missing columns become null)."""
    out = match_documents(cm)
    for f in (player_documents(players), team_documents(cm, d), venue_documents(venues, cm), fact_documents(cm, d)):
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def text_vectors(docs: DataFrame, text_col: str = "text", features: int = 1 << 14) -> DataFrame:
    """Hashed term frequencies, IDF weights, unit length (MLlib)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+"),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="vector", p=2.0),
    ])
    return pipe.fit(docs).transform(docs).drop("_tok", "_tf", "_idf")


def nearest_by_scan(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """The k nearest vectors of every query (exact), without an index. ``queries`` has
    (query_id, query_vec), the caller's stated query set."""
    salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copied = queries.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    dealt = vectors.select(id_col, vec_col, F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("_salt"))
    scored = dealt.join(copied, "_salt").select(
        "query_id", id_col, squared_distance(F.col(vec_col), F.col("query_vec")).alias("dist"))
    return topk.top_k_per_group(scored, k, ["query_id"], F.col("dist").asc(), id_col)


def label_exemplars(embeddings: DataFrame) -> DataFrame:
    """Queries derived from the data: the first vector of every label."""
    return embeddings.groupBy(F.col("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("query_vec"))


def context_block(hits: DataFrame, texts: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """X6: '[rank] text' lines per query in rank order (k lines at most)."""
    j = hits.join(texts, id_col)
    lines = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return j.groupBy("query_id").agg(lines.alias("_l")).select(
        "query_id", F.array_join(F.transform("_l", lambda x: F.format_string("[%d] %s", x["rank"], x["text"])), "\n").alias("context"))


def chat_history(conversations: DataFrame, turns: int = 4) -> DataFrame:
    """The last ``turns`` turns of every conversation as 'Role: text'
    lines, oldest first (bounded to ``turns`` rows per conversation)."""
    last = topk.top_k_per_group(conversations, turns, ["conv_id"], F.col("turn").desc())
    lines = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return last.groupBy("conv_id").agg(lines.alias("_l")).select(
        "conv_id", F.array_join(F.transform("_l", lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), x["text"])), "\n").alias("history"))


def preview_contexts(cm: DataFrame, docs: DataFrame, index: DataFrame, team_docs: int = 3, venue_docs: int = 2) -> DataFrame:
    """Per fixture, the prompt context: three retrievals, of ``team_docs``
    documents for each team and ``venue_docs`` for the venue. Every team and
    venue is asked for once, in one search of the text index; its block of
    texts is joined to the fixtures."""
    def asked(kind: str, columns: list[str], words: str, k: int) -> DataFrame:
        subject = cm.select(F.explode(F.array(*columns)).alias("subject")).distinct()
        return subject.select(F.concat(F.lit(kind), "subject").alias("query_id"), F.concat("subject", F.lit(words)).alias("question"),
                              F.lit(k).alias("k"))

    queries = asked("team:", ["team1", "team2"], " matches won lost strike rate wickets", team_docs).unionByName(
        asked("venue:", ["venue"], " hosted matches", venue_docs))
    hits = text_index.search(index, queries).hits.join(docs.select("id", "text"), "id")
    lines = F.sort_array(F.collect_list(F.struct("rank", "text")))
    blocks = written(hits.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("block")), "context-blocks")
    out = cm.select("match_id", "team1", "team2", "venue")
    for n, (kind, column) in enumerate((("team:", "team1"), ("team:", "team2"), ("venue:", "venue"))):
        part = blocks.select(F.col("query_id").alias(f"q{n}"), F.col("block").alias(f"b{n}"))
        out = out.join(part, F.concat(F.lit(kind), column) == F.col(f"q{n}"), "left")
    return out.select("match_id", F.concat_ws("\n", "b0", "b1", "b2").alias("context"))

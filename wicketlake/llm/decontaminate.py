"""Operator 7, benchmark decontamination by spaced seeds (DataFrame functions only).

Texts are lower-cased and cut into words of letters and digits. A fixed mask
looks at some of the words of a short window and ignores the others, so a
substituted word at an ignored place leaves the seed's hash unchanged:

    111111      six words in a row
    1110111     one substitution in the middle of seven words
    11011011    two substitutions within eight words

Seeds of all documents are joined with the seeds of the benchmark. Hits of a
document and an item on one diagonal (same shift) are one candidate, and its
words are compared along the whole diagonal. A candidate is an overlap if

- the words of the item that fall inside the document cover at least half of
  the item, at least ``min_overlap`` words, and ``min_identity`` of them agree, or
- some stretch of the diagonal scores ``min_score`` or more, where a word that
  agrees counts 1 and a word that differs counts -4 (so a stretch of 80 %
  agreement counts 0): ten equal words in a row, or more with substitutions.

Scale. The documents are read once for seeds, one codegen pass without a
shuffle: the benchmark's seed table is broadcast only when its counted rows
are within ``broadcast_rows``; beyond that the same join shuffles. Only hits
are aggregated (partially before the shuffle). The second pass re-reads the
texts of documents with hits, picked by a semi join under the same check.
Equal benchmark texts are one class for the join and listed apart afterwards.

Defined results: null and empty texts match nothing; items of fewer than
``min_overlap`` words are too short to be evidence and match nothing; rows
with equal ids count as one document if any of them matches; a null id is
never reported; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import BROADCAST_ROWS, small, without_ids, written

MASKS = ("111111", "1110111", "11011011")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def seeds_of(df: DataFrame, keep: list[str], hashes: Column, masks: tuple[str, ...] = MASKS,
             whole: bool = False) -> DataFrame:
    """``(*keep, pos, seed)``: the masked hashes at every word position.
    ``whole`` drops seeds that reach over the end of the text; on the other
    side of the join they may stay, as they can equal none of those kept."""
    span = max(map(len, masks))
    zipped = df.select(*keep, hashes.alias("h")).select(*keep, F.arrays_zip(
        *[F.slice("h", k + 1, F.size("h")).alias(f"w{k}") for k in range(span)]).alias("z"))
    rows = zipped.select(*keep, F.posexplode("z").alias("pos", "s"))
    word = [F.col("s").getField(f"w{k}") for k in range(span)]

    def seed(number: int, mask: str) -> Column:
        hashed = F.xxhash64(F.lit(number), *[word[k] for k, c in enumerate(mask) if c == "1"])
        return F.when(word[len(mask) - 1].isNotNull(), hashed) if whole else hashed

    seeds = rows.select(*keep, "pos", F.explode(F.array(*[seed(k, m) for k, m in enumerate(masks)])).alias("seed"))
    return seeds.filter("seed is not null") if whole else seeds


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_overlap: int = 8,
             min_identity: float = 0.8, min_score: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, item_id, n_seeds, n_overlap, n_equal, score, doc_start)``:
    the best overlap of each document and benchmark item that have one."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter(
        "doc_id is not null and text is not null")
    listed = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).filter(
        "item_id is not null and text is not null")
    listed = written(listed.select("item_id", hashed_words(F.col("text")).alias("g")).filter(F.size("g") >= min_overlap)
                     .withColumn("class_id", F.xxhash64("g")).distinct(), "benchmark-words")
    classes = listed.groupBy("class_id").agg(F.first("g").alias("g"))

    item_seeds = seeds_of(classes, ["class_id"], F.col("g"), masks, whole=True).withColumnRenamed("pos", "at")
    hits = seeds_of(own, ["doc_id"], hashed_words(F.col("text")), masks).join(small(item_seeds, broadcast_rows), "seed")
    candidates = written(hits.groupBy("doc_id", "class_id", (F.col("pos") - F.col("at")).alias("shift"))
                         .agg(F.count("*").alias("n_seeds")), "decontaminate-hits")

    hit_ids = small(candidates.select("doc_id").distinct(), broadcast_rows)
    hashed = own.join(hit_ids, "doc_id", "left_semi").select("doc_id", hashed_words(F.col("text")).alias("h"))
    begin = F.greatest(F.col("shift"), F.lit(0))  # first word of the document on the diagonal
    length = F.least(F.size("h"), F.col("shift") + F.size("g")) - begin
    agree = F.zip_with(F.slice("h", begin + 1, F.col("n_overlap")), F.slice("g", begin - F.col("shift") + 1, F.col("n_overlap")),
                       lambda a, b: F.when(a == b, 1).otherwise(0))
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, equal: Column) -> Column:
        run = F.greatest(state["run"] + F.when(equal == 1, 1).otherwise(-4), F.lit(0))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    compared = (hashed.join(candidates, "doc_id").join(small(classes, broadcast_rows // 10), "class_id")
                .withColumn("n_overlap", length).filter("n_overlap > 0")
                .select("doc_id", "class_id", "n_seeds", "n_overlap", begin.alias("doc_start"), F.size("g").alias("n_item"),
                        agree.alias("agree"))
                .withColumn("n_equal", F.aggregate("agree", F.lit(0), lambda a, x: a + x))
                .withColumn("score", F.aggregate("agree", zero, step, lambda s: s["best"])))
    covering = ((F.col("n_overlap") * 2 >= F.col("n_item")) & (F.col("n_overlap") >= min_overlap)
                & (F.col("n_equal") >= F.col("n_overlap") * min_identity))
    found = compared.filter(covering | (F.col("score") >= min_score))
    best = F.max(F.struct("score", "n_equal", "n_overlap", "n_seeds", (-F.col("doc_start")).alias("back"))).alias("best")
    return (found.groupBy("doc_id", "class_id").agg(best).join(small(listed.select("class_id", "item_id"), broadcast_rows), "class_id")
            .select("doc_id", "item_id", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("n_seeds", "n_overlap", "n_equal", "score")],
                    (-F.col("best.back")).cast("long").alias("doc_start")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **rules) -> DataFrame:
    """Documents without an overlap, all columns as they came."""
    bad = written(overlaps(docs, benchmark, id_col, **rules).select("doc_id").distinct(), "decontaminate-bad")
    return without_ids(docs, small(bad, BROADCAST_ROWS), id_col)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS g
  FROM benchmark WHERE text IS NOT NULL
), masks(mask, places, span) AS (VALUES
  (0, [0, 1, 2, 3, 4, 5], 6), (1, [0, 1, 2, 4, 5, 6], 7), (2, [0, 1, 3, 4, 6, 7], 8)
), dp AS (SELECT doc_id, h, unnest(range(len(h))) AS pos FROM d),
bp AS (SELECT item_id, g, unnest(range(len(g))) AS ipos FROM b WHERE len(g) >= 8),
ds AS (SELECT doc_id, pos, mask, [h[pos + p + 1] for p in places] AS seed FROM dp, masks WHERE pos + span <= len(h)),
bs AS (SELECT item_id, ipos, mask, [g[ipos + p + 1] for p in places] AS seed FROM bp, masks WHERE ipos + span <= len(g)),
cand AS (
  SELECT doc_id, item_id, pos - ipos AS shift, count(*) AS n_seeds FROM ds JOIN bs USING (mask, seed) GROUP BY ALL
), region AS (
  SELECT cand.*, greatest(shift, 0) AS doc_start, least(len(h), shift + len(g)) - greatest(shift, 0) AS n_overlap, h, g
  FROM cand JOIN d USING (doc_id) JOIN b USING (item_id)
), place AS (
  SELECT doc_id, item_id, shift, unnest(range(n_overlap)) AS k, h, g, doc_start FROM region
), summed AS (
  SELECT doc_id, item_id, shift, k, h[doc_start + k + 1] = g[doc_start - shift + k + 1] AS equal,
         sum(CASE WHEN h[doc_start + k + 1] = g[doc_start - shift + k + 1] THEN 1 ELSE -4 END)
           OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS total FROM place
), lowest AS (
  SELECT *, least(0, coalesce(min(total) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM summed
), scored AS (
  SELECT doc_id, item_id, shift, count(*) FILTER (equal) AS n_equal, greatest(max(total - low), 0) AS score FROM lowest GROUP BY ALL
), found AS (
  SELECT doc_id, item_id, n_seeds, n_overlap, n_equal, score, doc_start FROM region JOIN scored USING (doc_id, item_id, shift)
  WHERE score >= 10 OR (n_overlap * 2 >= len(g) AND n_overlap >= 8 AND n_equal >= n_overlap * 0.8)
)
SELECT doc_id, item_id, CAST(n_seeds AS BIGINT) AS n_seeds, CAST(n_overlap AS BIGINT) AS n_overlap,
       CAST(n_equal AS BIGINT) AS n_equal, CAST(score AS BIGINT) AS score, CAST(doc_start AS BIGINT) AS doc_start
FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, n_equal DESC, n_overlap DESC, n_seeds DESC, doc_start) = 1
"""

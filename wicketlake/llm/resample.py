"""Operator 11, target-distribution importance resampling by overlapped regex
scanning.

A text's ASCII capitals become small letters and every run of separators one
space; one regular expression, run with ``overlapped=True``, then matches at
every word start, and its groups are the runs of three, two and one words from
there: neighbouring matches share the space between them, and a lookahead
closes the last word. Each run's bytes give a CRC and a bucket; the groups of a
block of matches are taken at once, without a step of Python per word.

Jobs: (1) every text is scanned once, and its sparse bucket counts are written
(at most ``buckets`` entries a document, whatever its length); (2) each task
sums its documents' counts to one row per bucket, and those rows are added up;
(3) corpus and target counts give one gain per bucket (``buckets`` numbers, the
only thing that passes through the driver), and every document's weight is a
sum over its written counts; (4) scores of documents with enough words are
range-partitioned, numbered and cut at the share to draw. Texts never shuffle.

Defined results: a null or empty text has no words, no features and weight 0,
and cannot be drawn; a null id counts as the empty string in the random draw
and sorts before the others; equal scores go to the smaller id, and repeated
rows are scored and ranked each on its own; texts are scanned whole, in blocks
of bounded memory; with an empty target all counts t are 0; an empty table
gives an empty result; other columns stay behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import bound_batches, texts_of, worker_state, written
from wicketlake.operators.keys import dense_index

#: Features whose checksums are held at once for one text.
BLOCK_FEATURES = 1 << 18
LONGEST_RUN = 3


def word_bytes() -> bytes:
    """The translation of every byte: letters and digits stay (capitals become
    small), bytes of non-ASCII characters stay, all others become a space."""
    keep = {*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
    return bytes(b if b in keep else b + 32 if b + 32 in keep and chr(b).isupper() else 32 for b in range(256))


class Scanner:
    """Spans and buckets of the word runs of a text."""

    def __init__(self, buckets: int):
        import regex

        self.buckets, self.table = buckets, word_bytes()
        # Groups of a match: three, two and one words; where words are missing, a group equals the next one.
        word = rb"[^ ]++"
        self.runs = regex.compile(rb" (((" + word + rb")(?: " + word + rb")?+)(?: " + word + rb")?+)(?= )")

    def collapsed(self, text: str) -> bytes:
        words = text.encode().translate(self.table).split()
        return b" %s " % b" ".join(words) if words else b""

    def spans(self, line: bytes) -> Iterator[tuple[int, int]]:
        """Byte spans of all runs in a collapsed line, ``(start, end)``."""
        for match in self.runs.finditer(line, overlapped=True):
            (start, three), (_, two), (_, one) = match.regs[1:]
            yield start, one
            if two > one:
                yield start, two
                if three > two:
                    yield start, three

    def counts(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """``(words, buckets met, their counts)`` of one text: the features of
        ``spans``, whose bytes the expression gives for a block of word starts
        at once."""
        from zlib import crc32

        line = self.collapsed(text)
        total, words, begin = np.zeros(self.buckets, np.int64), 0, 0
        block = max(1, BLOCK_FEATURES * 2 // 3)  # bytes: a word and its space take two at least, and start three features
        while begin < len(line) - 1:
            # The two words after a block are scanned with it and start the next block's own matches.
            cut = line.find(b" ", begin + block)
            after = line.find(b" ", line.find(b" ", cut + 1) + 1) if 0 <= cut < len(line) - 1 else -1
            last = after <= cut
            found = self.runs.findall(line, begin, len(line) if last else after + 1, overlapped=True)
            ones = len(found) if last else len(found) - 2
            threes, twos, single = zip(*found)
            pairs, triples = (max(0, ones - 1), max(0, ones - 2)) if last else (ones, ones)
            held = np.fromiter(map(crc32, chain(single[:ones], twos[:pairs], threes[:triples])), np.uint32, ones + pairs + triples)
            total += np.bincount(held % self.buckets, minlength=self.buckets)
            words += ones
            begin = len(line) if last else cut
        met = np.flatnonzero(total)
        return words, met.astype(np.int32), total[met]


def feature_counts(docs: DataFrame, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, met, n)``: the buckets that a
    document's features meet, ascending, and how often, both as the bytes of
    little-endian unsigned 32-bit numbers; no shuffle."""
    own = texts_of(docs, id_col, text_col)
    bound_batches(own.sparkSession)
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "met", "n"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_state(("resample", buckets), lambda: Scanner(buckets))
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [scanner.counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([int(f[2].sum()) for f in found], pa.int64()),
                 *(pa.array([f[k].astype("<u4").tobytes() for f in found], pa.binary()) for k in (1, 2))], names=names)

    return own.mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_features bigint, met binary, n binary")


def _numbers(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_py(), "<u4") for x in column)


def bucket_totals(counts: DataFrame, buckets: int) -> list[int]:
    """Features per bucket over all rows of ``feature_counts``. A task keeps
    ``buckets`` sums and ships one row per bucket that it met."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for met, n in zip(*map(_numbers, batch.columns)):
                total[met] += n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    out = [0] * buckets
    parts = counts.select("met", "n").mapInArrow(add_up, "bucket int, n bigint")
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """One integer per bucket: 1000 x the log ratio of the smoothed shares, rounded down."""
    size = len(corpus)
    below, above = float(sum(corpus) + size), float(sum(target) + size)
    return [math.floor(1000 * math.log((t + 1.0) * below / ((s + 1.0) * above))) for s, t in zip(corpus, target, strict=True)]


def document_weights(counts: DataFrame, gain: list[int]) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the sum of gains over all of
    a document's features."""
    kind = counts.schema["doc_id"].dataType.simpleString()
    worth = np.array(gain, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(worth[met] @ n.astype(np.int64)) for met, n in zip(_numbers(batch.column("met")), _numbers(batch.column("n")))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return counts.mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(seed: int, key: Column) -> Column:
    """A Gumbel draw that a seed and an id fix, x 1000 and rounded down."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_scores(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20,
                      buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                      target_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``;
    ``rank`` counts the drawn ones from 1 and is null elsewhere. ``share`` of
    the rows with ``min_words`` words or more is drawn, rounded down."""
    counts = written(feature_counts(docs, buckets, id_col, text_col), "resample-counts")
    wanted = feature_counts(target.select(F.lit(0).alias("item"), target_text_col), buckets, "item", target_text_col)
    gain = gains(bucket_totals(counts, buckets), bucket_totals(wanted, buckets))
    scored = written(document_weights(counts, gain).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))), "resample-scores")
    fit = scored.filter(F.col("n_words") >= min_words)
    drawn = share[0] * fit.count() // share[1]
    ranked = dense_index(fit.withColumn("_down", -F.col("score")), ["_down", "doc_id", "n_features", "weight"], "rank")
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out).unionByName(rest.select(*out))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the draw takes, all columns as they came.
    Ids should be distinct: a row goes where a row of its id goes."""
    id_col = options.get("id_col", "doc_id")
    taken = importance_scores(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(taken, F.col(f"`{id_col}`").eqNullSafe(F.col("_drawn")), "left_semi")


ORACLE = """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc_of),
d AS (SELECT doc_id, row_number() OVER () AS r, 'd' AS side, text FROM documents UNION ALL SELECT NULL, row_number() OVER (), 'b', text FROM benchmark),
w AS (SELECT r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM d),
g AS (SELECT r, side, unnest(list_concat(words,
    list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS f FROM w),
c AS (SELECT r, side, f, count(*) AS n FROM g GROUP BY 1, 2, 3),
fs AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM c),
b AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda x, y: xor(crc_of[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 10000 AS bucket FROM fs, tab),
m AS (SELECT side, bucket, sum(n) AS n FROM c JOIN b USING (f) GROUP BY 1, 2),
total AS (SELECT CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS BIGINT) AS big_s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS BIGINT) AS big_t FROM m),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (big_t * 0 + big_s + 10000) AS DOUBLE) / CAST((s + 1) * (big_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
    FROM (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS BIGINT) AS t
          FROM m GROUP BY 1) x, total),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM c JOIN b USING (f) JOIN gain USING (bucket)
    WHERE side = 'd' GROUP BY 1),
scored AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
      / 4294967296.0))) AS BIGINT) AS score
    FROM w LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS rn,
    count(*) FILTER (n_words >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND rn <= 5 * fit // 100 THEN rn END AS rank FROM ranked"""

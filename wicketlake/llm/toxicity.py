"""Operator 4, toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A text is cut into short windows (its words; longer ones into pieces of 64
bytes), and every window is compressed under both dictionaries, between two
fixed frames that both dictionaries hold: a window alone would be stored raw.
A window counts as toxic where it is nearly free under the toxic dictionary
(at most ``slack`` bytes more than an empty window) and costs at least ``gap``
bytes more under the ordinary one. The pair of thresholds and the weights that
turn counts into a probability are calibrated on labelled documents that took
no part in the training of the dictionaries.

Training text. The labels hold for documents, and most windows of a toxic
document are ordinary; a dictionary of everything in toxic documents is mostly
a second ordinary dictionary. The toxic samples are therefore the words that
occur in significantly more toxic than ordinary documents (G test), the
ordinary samples the most frequent words of ordinary documents.

Folds, by crc32 of the document id as text modulo 5: 0 is held out and never
learned from, 1 to 3 train the dictionaries, 4 calibrates. Labels, language,
source and id are no input of a score.

Bounds: at most about ``max_training`` labelled documents of each class are
learned from and as many calibrate, chosen by a hash of the id; what reaches
the driver is ``max_words`` words for each dictionary and one row of counts
per calibrating document. The model (both dictionaries, under 200 kB) travels
with the task. Scoring is a map over the documents, no shuffle; windows are
kept in a bounded memo.

Defined results: a null text is empty; a text without windows gets the score
of a document without toxic windows; a null id is held out; repeated rows get
equal scores; labels with a null are not learned from, of repeated labels the
largest counts; without toxic and ordinary examples every score is 0.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import TwoGenerationCache, bound_batches, small, texts_of, worker_state

FOLDS, HELD_OUT, CALIBRATING = 5, 0, 4
#: Thresholds that calibration chooses from: (slack, gap) in bytes.
THRESHOLDS = ((2, 3), (2, 4), (3, 4), (4, 3), (4, 4), (3, 5))
TOXIC_BYTES, ORDINARY_BYTES, WINDOW = 8192, 112_000, 64
_WORD = re.compile(r"\w+")


def fold_of(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def _frames() -> tuple[bytes, bytes]:
    """Two fixed byte strings that no text holds (bytes from 128, by a seeded draw)."""
    draw = random.Random(5)
    return bytes(draw.choices(range(128, 256), k=32)), bytes(draw.choices(range(128, 256), k=24))


def train_dictionary(words: list[tuple[str, int]], size: int, segment: int) -> bytes:
    """Content of a dictionary trained on words, each as often as its weight
    (up to 400); the plain words where there is too little for a training."""
    import zstandard

    samples = [f" {w} ".encode() for w, n in words for _ in range(min(400, n))]
    random.Random(1).shuffle(samples)
    samples = [b"".join(samples[k:k + 6]) for k in range(0, len(samples), 6)]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(f" {w} ".encode() for w, _ in reversed(words))[-size:]


def _measure(content: bytes, log: int):
    """Compressed length of a window between the frames, under a dictionary."""
    import zstandard

    before, after = _frames()
    dictionary = zstandard.ZstdCompressionDict(content + after + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=log, hash_log=log, search_log=4, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_LAZY2, write_checksum=0, write_content_size=0, write_dict_id=0)
    dictionary.precompute_compress(compression_params=parameters)
    compress = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress
    return lambda window: len(compress(before + b" " + window + b" " + after))


class Windows:
    """Codes of windows under two dictionaries: bit k is set where pair k of
    ``THRESHOLDS`` calls the window toxic."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _measure(toxic, 13), _measure(ordinary, 15)
        self.free = self.toxic(b"")
        self.code = TwoGenerationCache(self._code)

    def _code(self, word: str) -> int:
        data, code = word.encode(), 0
        for low in range(0, len(data), WINDOW):
            window = data[low:low + WINDOW]
            cost = self.toxic(window)
            if cost <= self.free + max(s for s, _ in THRESHOLDS):
                gain = self.ordinary(window) - cost
                code |= sum(1 << k for k, (slack, gap) in enumerate(THRESHOLDS) if cost <= self.free + slack and gain >= gap)
        return code

    def counts(self, text: str) -> list[int]:
        """Number of windows, then toxic windows by each pair of thresholds."""
        codes = bytes(map(self.code.__getitem__, _WORD.findall(text.lower())))
        seen = [(c, codes.count(c)) for c in set(codes) if c]
        return [len(codes)] + [sum(n for c, n in seen if c >> k & 1) for k in range(len(THRESHOLDS))]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    pair: int = 0
    weights: tuple[float, ...] = ()

    def windows(self) -> Windows:
        return worker_state(("toxicity", self.toxic, self.ordinary), lambda: Windows(self.toxic, self.ordinary))

    def probability(self, counts: list[int]) -> float:
        import math

        if not self.weights:
            return 0.0
        z = sum(w * x for w, x in zip(self.weights, features(counts, self.pair)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(counts: list[int], pair: int) -> list[float]:
    import math

    n, hits = counts[0], counts[1:]
    main = hits[pair]
    return [1.0, float(main > 0), math.log1p(main), 30.0 * main / (n + 30), *[math.log1p(h) for k, h in enumerate(hits) if k != pair]]


def _counts_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def counts(texts: pd.Series) -> pd.Series:
        windows = model.windows()
        return pd.Series([windows.counts(t) for t in texts])

    return counts(text)


def _logistic(x, y, steps: int = 60, ridge: float = 0.1):
    """Newton steps of a ridge logistic regression."""
    import numpy as np

    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_training: int = 20_000, max_words: int = 40_000, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Fits dictionaries, thresholds and weights; see the module's bounds."""
    import numpy as np

    bound_batches(docs.sparkSession)
    own = texts_of(docs, id_col, text_col).filter("doc_id is not null")
    known = (labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold_of(F.col("doc_id")))
             .filter(F.col("fold") != HELD_OUT))
    sizes = {(r["cal"], r["toxic"]): r["n"] for r in known.groupBy((F.col("fold") == CALIBRATING).alias("cal"), "toxic")
             .agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for (calibrating, toxic), n in sizes.items():
        share = F.when(((F.col("fold") == CALIBRATING) == calibrating) & (F.col("toxic") == toxic), min(1.0, max_training / n)).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = own.join(small(known.filter(place < share)), "doc_id")

    training = chosen.filter(F.col("fold") != CALIBRATING)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), 0))
    counted = (training.select("toxic", F.explode(words).alias("word")).groupBy("word")
               .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    n1 = float(sum(n if n <= max_training else max_training for (cal, tox), n in sizes.items() if not cal and tox == 1))
    n0 = float(sum(n if n <= max_training else max_training for (cal, tox), n in sizes.items() if not cal and tox == 0))
    if not n1 or not n0:
        return Model(b"", b"")
    counted = counted.persist()
    a, b = F.col("a"), F.col("b")
    expected = lambda n: (a + b) * (n / (n1 + n0))
    g = 2 * (a * F.log(a / expected(n1)) + F.when(b > 0, b * F.log(b / expected(n0))).otherwise(0.0))
    rich = (counted.filter((a >= 3) & (a / n1 >= 8 * b / n0)).withColumn("g", g).filter("g >= 20")
            .orderBy(F.desc("g"), "word").limit(2000).select("word", "a").collect())
    if len(rich) < 5:  # too few documents for significance: the words of the largest G
        rich = (counted.filter((a >= 2) & (a / n1 >= 8 * b / n0)).withColumn("g", g).orderBy(F.desc("g"), "word").limit(10)
                .select("word", "a").collect())
    plain = counted.filter(b > 0).orderBy(F.desc("b"), "word").limit(max_words).select("word", "b").collect()
    counted.unpersist()
    if not rich or not plain:
        return Model(b"", b"")
    model = Model(train_dictionary([(r.word, 8 * r.a) for r in rich], TOXIC_BYTES, 32),
                  train_dictionary([(r.word, min(20, 2 * r.b)) for r in plain], ORDINARY_BYTES, 24))

    seen = chosen.filter(F.col("fold") == CALIBRATING).select("toxic", _counts_column(model, F.col("text")).alias("c")).collect()
    y = np.array([r.toxic for r in seen], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(b"", b"")
    best = None
    for pair in range(len(THRESHOLDS)):
        x = np.array([features(r.c, pair) for r in seen])
        w = _logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        loss = float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
        if best is None or loss < best[0]:
            best = (loss, pair, tuple(map(float, w)))
    return Model(model.toxic, model.ordinary, best[1], best[2])


def score_column(model: Model, text: Column) -> Column:
    """Probability that ``text`` is toxic."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not model.weights:
            return pd.Series([0.0] * len(texts))
        windows = model.windows()
        return pd.Series([model.probability(windows.counts(t)) for t in texts])

    return score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``."""
    bound_batches(docs.sparkSession)
    scored = texts_of(docs, id_col, text_col).select("doc_id", score_column(model, F.col("text")).alias("score"))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents below a score of 0.5, all columns as they came."""
    bound_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("row"), score_column(model, F.col(f"`{text_col}`")).alias("score"))
    return packed.filter("score < 0.5").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

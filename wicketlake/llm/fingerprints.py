"""Operator 8, document fingerprints: a quartile bucket digest.

A window of five bytes slides over the text's UTF-8 bytes (padded with four
zero bytes, so short texts have windows too). Six byte triplets of each window
are hashed into 256 buckets and counted. The quartiles of the 256 counts code
each bucket in two bits; a head of length code (logarithmic) and two quartile
ratios precedes them. Two digests are compared by a difference score: bucket
code differences (a jump across all quartiles counts double), plus bounded
differences of length and ratios, over the largest such score; likeness is
``1 - min(1, score / unlike)``, where ``unlike`` is the score at which two
digests of unrelated bytes lie.

The next document of each document is found by one range partitioning on the
id: each sorted partition is read once, holding two texts. The first and the
last document of a partition are written out with their texts, and joined
along the partitions (two rows per partition) to give the missing neighbours.

Defined results: a null text is empty; an empty text's digest is all zeros;
equal texts have equal digests; rows with equal ids are ordered by text; a
null id comes first; a single document is its own next document; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicketlake.llm.common import map_batches, stream_batches, texts_of, written

BUCKETS = 256
#: Triplets of a five-byte window, as distances from its newest byte.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4), (0, 3, 4))
#: Mean bucket score of independent codes: quartile codes differ by 1 in 6, 2 in 4 and 3 in 2 of 16 cases.
UNLIKE = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16
#: Bytes handled at once; the counts of longer texts are added up.
CHUNK = 1 << 18

_TABLES = None


def _tables():
    """One table of 256 byte values per triplet and place, from a fixed rule:
    permutations drawn by a seeded generator."""
    global _TABLES
    if _TABLES is None:
        import numpy as np

        draw = np.random.Generator(np.random.PCG64(8))
        _TABLES = [[draw.permutation(BUCKETS).astype(np.uint8) for _ in triplet] for triplet in TRIPLETS]
    return _TABLES


def bucket_counts(data: bytes):
    import numpy as np

    counts = np.zeros(BUCKETS, dtype=np.int64)
    padded = np.frombuffer(data + b"\0" * 4, dtype=np.uint8)
    for low in range(0, len(data), CHUNK):
        part = padded[low:low + CHUNK + 4]
        n = len(part) - 4
        hashed = np.empty((len(TRIPLETS), n), dtype=np.uint8)
        for row, places, tables in zip(hashed, TRIPLETS, _tables()):
            views = [part[4 - p:4 - p + n] for p in places]
            np.take(tables[0], views[0], out=row)
            row ^= tables[1][views[1]]
            row ^= tables[2][views[2]]
        counts += np.bincount(hashed.reshape(-1), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Head (length code, two ratio codes) and 64 bytes of bucket codes, in hex."""
    import numpy as np

    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(q, counts, side="left").astype(np.uint8)
    body = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    length = min(255, round(math.log(len(data) + 1, 1.1)))
    top = max(1, int(q[2]))
    return f"{length:02x}{15 * int(q[0]) // top:x}{15 * int(q[1]) // top:x}{body.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for digests as far apart as unrelated ones or more."""
    import numpy as np

    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[4:]), dtype=np.uint8) for s in (a, b))
    score = 0
    for shift in (6, 4, 2, 0):
        d = np.abs(((x >> shift) & 3).astype(np.int8) - ((y >> shift) & 3).astype(np.int8))
        score += int(d.sum()) + 3 * int((d == 3).sum())
    score += min(24, abs(int(a[:2], 16) - int(b[:2], 16)))
    score += sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (2, 3))
    return max(0.0, 1.0 - score / UNLIKE)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every document: a map over the rows."""
    own = texts_of(docs, id_col, text_col)
    kind = dict(own.dtypes)["doc_id"]
    return map_batches(own, _fingerprints, f"doc_id {kind}, fingerprint string")


def _fingerprints(columns: list[list]) -> list[list]:
    return [columns[0], [fingerprint(t.encode()) for t in columns[1]]]


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _row(doc_id, text: str, own: str, after: str, after_print: str) -> tuple:
    edited = _edited(text, after).encode()
    edited_print = fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, edited_print, likeness(own, edited_print),
            likeness(own, after_print))


_COLUMNS = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
            "near_next double")


def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of all but the last document of a partition; the first and the
    last leave their texts for the neighbouring partitions."""
    part, held, first = TaskContext.get().partitionId(), None, None
    for doc_id, text in rows:
        own = fingerprint(text.encode())
        if held is None:
            first = text
        else:
            yield *_row(*held, text, own), None, None, None
        held = (doc_id, text, own)
    if held is not None:
        yield held[0], None, None, held[2], None, None, None, part, first, held[1]


def _close(columns: list[list]) -> list[list]:
    rows = [_row(i, t, p, a, fingerprint(a.encode())) for i, t, p, a in zip(*columns)]
    return [list(c) for c in zip(*rows)]


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of the query ``op8_fingerprints``."""
    own = texts_of(docs, id_col, text_col)
    kind = dict(own.dtypes)["doc_id"]
    # Range partitioning samples at random; its output is used once and written, so all rows see the same bounds.
    walked = written(stream_batches(own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"), _walk,
                                    f"doc_id {kind}, {_COLUMNS}, part int, first_text string, last_text string"), "fingerprints")
    ends = walked.filter("part is not null").select("doc_id", "part", "fingerprint", "first_text", "last_text")
    order = Window.orderBy("part")  # one row per partition
    wrap = F.first("first_text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    joined = ends.select("doc_id", F.col("last_text").alias("text"), "fingerprint",
                         F.coalesce(F.lead("first_text").over(order), wrap).alias("after"))
    closed = map_batches(joined, _close, f"doc_id {kind}, {_COLUMNS}")
    return walked.filter("part is null").drop("part", "first_text", "last_text").unionByName(closed)

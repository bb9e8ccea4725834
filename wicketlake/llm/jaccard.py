"""Operator 9, an exact Jaccard join in metric space.

Documents are sets of word shingles; two sets link when 100 * |A & B| >= 85 *
|A | B|, a Jaccard distance of at most eps = 0.15.

The distance of unrelated sets is exactly 1, so in the whole corpus every
pivot is equally far from nearly all documents, and no triangle inequality
tells them apart. The corpus is therefore first cut, exactly, into separate
spaces in which distances are below 1, and the metric join works in these:

1. Equal sets are one node.
2. Signatures. Sets of sizes a <= b that link differ in at most D = floor(0.15
   / 1.85 * (a + b)) shingles. Shingles are dealt by hash into m = D + 1 +
   spare classes: at least 1 + spare classes have equal content on both sides. Each set gives the hash of each non-empty class's content; a
   set with so many empty classes that all equal ones might be empty (m - D or
   more) also gives one signature that says so. Sizes go by intervals [l, l /
   0.85], and a set signs for its own interval and for the one below, so D is
   known to both sides. Sets of a link share a signature, hence are in one
   component of the graph of sets and signatures: the components are the
   spaces, and no link leaves one.
3. Spaces of more shingles than ``leaf`` holds are split (``regions``): by
   signatures of their rare shingles, by Voronoi regions of pivots with windows
   of twice eps and a region of the sets that no pivot is near to, and by
   blocks against a group of near copies that a pivot has joined already.
   Regions recurse until they fit a leaf.
4. A leaf is joined exactly with its own inverted index, by a search over the
   sets not reached yet: each set is compared with all others of the leaf once
   and only a spanning forest of the links leaves it, so a group of n near
   copies gives n - 1 rows, not n^2 / 2.

Components of the forests are those of all links.

Scale. Pass one over the texts emits per distinct set about 0.35 signatures
per shingle (copies inside a task sign once); the largest shuffle is those, as
pairs of 64-bit numbers. Sets themselves travel only for documents that share
a signature with a different set. The leaves' bound is in shingles, so memory
holds for any document length.

Defined results: a null text is empty; an empty text, or one without words,
has an empty set, is linked with nothing and is its own component; a null id
is its own component; rows with equal ids are linked by their texts like any
others; other columns are ignored; an empty table gives an empty result.
Shingles, sets and signatures are 64-bit hashes; equal hashes of different
shingles in two compared sets could change a result, with a chance under
1e-12 per compared pair of a thousand shingles.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import TwoGenerationCache, discard, map_batches, passing_tables, small, stream_batches, texts_of, without_ids, worker_state, written
from wicketlake.llm.components import connected_components
from wicketlake.llm.regions import split_regions

#: Least similarity as a fraction of whole numbers, so that no rounding decides.
SIMILARITY = (85, 100)
#: Shingles of a leaf (8 bytes each): some sixty documents of usual length.
LEAF = 20_000

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x):
    """A 64-bit finaliser over a uint64 array."""
    import numpy as np

    x = x + np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingles as sorted distinct uint64 arrays."""

    def __init__(self, size: int):
        import xxhash

        self.size = size
        self.word = TwoGenerationCache(lambda w: xxhash.xxh3_64_intdigest(w), 150_000)
        self.task, self.signed = None, None

    def shingles(self, text: str):
        import numpy as np

        words = text.encode().lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        w = np.fromiter(map(self.word.__getitem__, words), dtype=np.uint64, count=n)
        size = self.size
        if n < size:  # the whole sequence is one shingle; its length tells it from longer ones
            acc, size = np.full(1, n, dtype=np.uint64), n
        else:
            acc = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            acc = _mix(acc ^ w[k:k + len(acc)])
        return np.unique(acc)


@cache
def intervals(similarity: tuple[int, int], limit: int = 1 << 40) -> tuple[int, ...]:
    """Lower ends of the size intervals: l, then the first size that is too
    large to link with l."""
    num, den = similarity
    ends = [1]
    while ends[-1] < limit:
        ends.append(ends[-1] * den // num + 1)
    return tuple(ends)


@cache
def classes_of(interval: int, similarity: tuple[int, int]) -> tuple[int, int]:
    """``(m, D)`` of links whose smaller set is in ``interval``."""
    num, den = similarity
    a = intervals(similarity)[interval + 1] - 1
    b = a * den // num
    # The difference is a + b - 2 i, and a link has (den + num) * i >= num * (a + b).
    most = (a + b) * (den - num) // (den + num)
    if not most:
        return 1, 0
    # As few spare classes as leave a set of the least size with D or fewer occupied classes next to
    # never (three and a half deviations): else sets would meet by their empty classes alone.
    n, m = intervals(similarity)[interval], most + 2
    while True:
        free = math.exp(-n / m)
        deviation = math.sqrt(max(0.0, m * free * (1 - (1 + n / m) * free)))
        if m * (1 - free) - 3.5 * deviation > most:
            return m, most
        m += 1 + m // 100


def signatures(shingles, similarity: tuple[int, int] = SIMILARITY, rare=None):
    """Signatures of a non-empty set, as an int64 array. With ``rare``, some of
    the set's shingles, the classes hold only these; a set that leaves too many
    of them empty signs with all shingles too, in classes of their own."""
    import numpy as np

    own = bisect_right(intervals(similarity), len(shingles)) - 1
    dealt = shingles if rare is None else rare
    deal, content = _mix(dealt), _mix(dealt ^ np.uint64(_MIX[0]))
    out = [np.zeros(0, np.uint64)]
    for interval in {own, max(own - 1, 0)}:
        m, most = classes_of(interval, similarity)
        sums, places = _contents(deal, content, m)
        tag = (interval + 1) << 40 if rare is None else (interval + 1) << 40 | 1 << 61
        out.append(_mix(sums ^ _mix(places + np.uint64(tag))))
        if m - len(places) >= m - most:
            if rare is None:
                out.append(_mix(np.array([(interval + 1) << 41 | 1 << 62], dtype=np.uint64)))
            else:
                out.append(_interval_signatures(shingles, interval, similarity))
    return np.concatenate(out).view(np.int64)


def _contents(deal, content, m: int):
    """``(sums, classes)``: the content hash of every non-empty class."""
    import numpy as np

    if not len(deal):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    cls = (deal % np.uint64(m)).astype(np.int64)
    order = np.argsort(cls, kind="stable")
    ranked = cls[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1])
    return np.add.reduceat(content[order], starts), ranked[starts].astype(np.uint64)


def _interval_signatures(shingles, interval: int, similarity: tuple[int, int]):
    """The signatures of all shingles for one interval."""
    import numpy as np

    m, most = classes_of(interval, similarity)
    sums, places = _contents(_mix(shingles), _mix(shingles ^ np.uint64(_MIX[0])), m)
    out = _mix(sums ^ _mix(places + np.uint64((interval + 1) << 40)))
    if m - len(places) >= m - most:
        out = np.append(out, _mix(np.array([(interval + 1) << 41 | 1 << 62], dtype=np.uint64)))
    return out


def shingler(size: int) -> Shingler:
    return worker_state(("jaccard", size), lambda: Shingler(size))


def key_of(shingles) -> int:
    """A set's key: a hash of its size and the sum of its mixed shingles."""
    import numpy as np

    total = np.add.reduce(_mix(shingles), keepdims=True) + np.uint64(len(shingles))
    return int(_mix(total).view(np.int64)[0])


def _sign(columns: list[list], size: int, similarity: tuple[int, int]) -> list:
    """Batches of texts to ``(doc_id, n, key, signatures)``; the signatures of
    a set are given once per task, as far as a bounded memory reaches."""
    import numpy as np

    own, task = shingler(size), TaskContext.get().taskAttemptId()
    if own.task != task:
        own.task, own.signed = task, TwoGenerationCache(lambda key: True, 50_000)
    seen, find = own.signed, own.shingles
    ids, texts = columns
    ns, keys, flat, offsets = [], [], [np.zeros(0, np.int64)], [0]
    for text in texts:
        s = find(text)
        ns.append(len(s))
        keys.append(key_of(s) if len(s) else None)
        if len(s) and keys[-1] not in seen:
            seen[keys[-1]]
            flat.append(signatures(s, similarity))
            offsets.append(offsets[-1] + len(flat[-1]))
        else:
            offsets.append(offsets[-1])
    return [ids, ns, keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat)))]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``(sig, key)`` sorted by both: ``(key, first key of its sig)``
    wherever they differ."""
    import numpy as np

    last_sig = last_first = None
    for batch in batches:
        sigs, keys = (c.to_numpy() for c in batch.columns)
        if not len(sigs):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(sigs)) + 1])
        first = np.repeat(keys[cuts], np.diff(np.concatenate([cuts, [len(sigs)]])))
        if sigs[0] == last_sig:
            first[:cuts[1] if len(cuts) > 1 else len(sigs)] = last_first
        last_sig, last_first = sigs[-1], first[-1]
        differ = first != keys
        if differ.any():
            pairs = np.unique(np.stack([keys[differ], first[differ]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def linked(n, m, both, similarity: tuple[int, int] = SIMILARITY):
    """Whether sets of ``n`` and ``m`` shingles with ``both`` in common link."""
    num, den = similarity
    return den * both >= num * (n + m - both)


def leaf_links(keys: list[int], sets: list, similarity: tuple[int, int] = SIMILARITY) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of a leaf."""
    import numpy as np

    if len(keys) < 2:
        return
    num, den = similarity
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    ranked, owners = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    ends = np.concatenate([starts[1:], [len(ranked)]])
    group = np.empty(len(flat), dtype=np.int64)  # posting list of each shingle of each set
    group[order] = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.concatenate([[0], np.cumsum(sizes)])
    lengths = ends - starts

    def postings(lists):
        """Owners in the given posting lists, one after another."""
        n = lengths[lists]
        return owners[np.repeat(starts[lists] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    free = np.ones(len(sets), dtype=bool)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue:
            u = queue.pop()
            own = group[place[u]:place[u + 1]]
            own = own[np.argsort(lengths[own], kind="stable")]
            # A linked set has that share of u's shingles at least, so one of u's rarest ones.
            rare = own[:sizes[u] - -(-num * sizes[u] // den) + 1]
            maybe = np.unique(postings(rare))
            maybe = maybe[free[maybe] & (den * np.minimum(sizes[maybe], sizes[u]) >= num * np.maximum(sizes[maybe], sizes[u]))]
            if not len(maybe):
                continue
            if len(maybe) * 8 < lengths[own].sum() / sizes[u]:
                both = np.array([np.isin(sets[u], sets[v], assume_unique=True).sum() for v in maybe])
            else:
                both = np.bincount(postings(own), minlength=len(sets))[maybe]
            found = maybe[linked(sizes[maybe], sizes[u], both, similarity)]
            free[found] = False
            for v in found:
                yield keys[u], keys[v]
            queue += found.tolist()


def _leaves(rows: Iterator[tuple], similarity: tuple[int, int]) -> Iterator[tuple]:
    """Rows ``(region, key, set)`` sorted by region and key."""
    import numpy as np

    region, keys, sets = None, [], []
    for r, key, data in rows:
        if r != region:
            yield from leaf_links(keys, sets, similarity)
            region, keys, sets = r, [], []
        if not keys or keys[-1] != key:
            keys.append(key)
            sets.append(np.frombuffer(data, dtype=np.uint64))
    yield from leaf_links(keys, sets, similarity)


def _keys_and_groups(docs: DataFrame, shingle: int, similarity: tuple[int, int], leaf: int, id_col: str,
                     text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, key)`` of every document, and ``(key, component_id)`` of
    the sets that more than one document has or links lead to."""
    own = texts_of(docs, id_col, text_col)
    kind = dict(own.dtypes)["doc_id"]
    signed = written(map_batches(own, _sign, f"doc_id {kind}, n bigint, key bigint, signatures array<bigint>", shingle, similarity),
                     "jaccard-sets")
    pairs = signed.select(F.explode("signatures").alias("sig"), "key")
    stars = pairs.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_stars, "a bigint, b bigint")
    spaces = connected_components(stars, "jaccard-spaces")
    # The signatures are most of the bytes, and nothing reads them from here on.
    whole, signed = signed, written(signed.select("doc_id", "n", "key"), "jaccard-keys")
    discard(whole)

    # One document for each set of a space of two sets or more; its set is made anew from the text.
    classes = signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    bearers = written(classes.filter("doc_id is not null").join(spaces, F.col("key") == F.col("node"))
                      .select("doc_id", "key", F.col("component").alias("region")), "jaccard-bearers")

    def sets(columns):
        made = [(r, k, s) for t, r, k in zip(*columns) if len(s := shingler(shingle).shingles(t)) and key_of(s) == k]
        return [[r for r, _, _ in made], [k for _, k, _ in made], [len(s) for _, _, s in made], [s.tobytes() for _, _, s in made]]

    texts = own.join(small(bearers), "doc_id").select("text", "region", "key")
    made = written(map_batches(texts, sets, "region bigint, key bigint, n bigint, data binary"), "jaccard-members")
    found, links = split_regions(made, leaf, 1 - similarity[0] / similarity[1], lambda n, m, both: linked(n, m, both, similarity),
                                 lambda own, rare: signatures(own, similarity, rare), _stars)
    ready = found.repartition("region").sortWithinPartitions("region", "key")
    links.append(stream_batches(ready, lambda rows: _leaves(rows, similarity), "a bigint, b bigint"))
    joined = connected_components(reduce(DataFrame.unionByName, links), "jaccard-links")

    # The smallest id of each component, from one row per set.
    ids = classes.join(joined, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("component", "key"))
    smallest = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = written(ids.filter("copies > 1 or component is not null").join(smallest, "root").select("key", "component_id"), "jaccard-groups")
    return signed, grouped


def jaccard_components(docs: DataFrame, shingle: int = 4, similarity: tuple[int, int] = SIMILARITY, leaf: int = LEAF,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document; the component
    id is the smallest doc_id reachable by links."""
    with passing_tables() as keep:
        signed, grouped = map(keep, _keys_and_groups(docs, shingle, similarity, leaf, id_col, text_col))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "key").join(grouped, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
                      .alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group: the one with the smallest id, all columns
    as they came. Rows without an id stay; rows with equal ids go together."""
    with passing_tables() as keep:
        groups = jaccard_components(docs, id_col=id_col, **options)
        gone = keep(written(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone"))
    return without_ids(docs, gone, id_col)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles FROM w
), x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL
), link AS (SELECT a, b FROM met WHERE 100 * shared >= 85 * (na + nb - shared)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS doc_id, a AS seen FROM sym UNION SELECT r.doc_id, y.b FROM reach r JOIN sym y ON y.a = r.seen)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1) m ON m.doc_id = s.doc_id
"""

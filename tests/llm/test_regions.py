"""The regions of operator 9: every link is inside a leaf or emitted, regions
really divide, and copies stay few."""

import random

import numpy as np
from pyspark.sql import functions as F

from wicketlake.llm import jaccard, regions

LIMIT = (85, 100)


def spaces():
    """Near copies of one set, sets that share a passage, and loose families."""
    r = random.Random(7)

    def fresh(n):
        return {r.getrandbits(64) for _ in range(n)}

    out = []
    base = fresh(120)
    for i in range(150):  # one large group of near copies
        gone = set(r.sample(sorted(base), r.randint(0, 4)))
        out.append((1, (base - gone) | fresh(r.randint(0, 4))))
    passage = fresh(50)
    for i in range(80):  # a passage in common, no more
        out.append((1, passage | fresh(r.randint(60, 140))))
    for _ in range(12):  # families whose members are half alike, with some links
        root = sorted(fresh(150))
        for _ in range(6):
            member = set(r.sample(root, 110)) | fresh(20)
            out.append((2, member))
            if r.random() < 0.5:
                out.append((2, set(sorted(member)[3:]) | fresh(2)))
    return [(region, k, np.array(sorted(s), dtype=np.uint64)) for k, (region, s) in enumerate(out)]


def brute(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if jaccard.linked(len(sets[a]), len(sets[b]), both, LIMIT):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(sets))]


def split(spark, rows, leaf, **options):
    df = spark.createDataFrame([(reg, k, len(s), bytearray(s.tobytes())) for reg, k, s in rows], "region long, key long, n long, data binary")
    leaves, links = regions.split_regions(df, leaf, 0.15, lambda n, m, both: jaccard.linked(n, m, both, LIMIT),
                                          lambda own, rare: jaccard.signatures(own, LIMIT, rare), jaccard._stars, **options)
    found = {}
    for x in leaves.collect():
        found.setdefault(x.region, {})[x.key] = np.frombuffer(x.data, dtype=np.uint64)
    return found, [(x.a, x.b) for part in links for x in part.collect()]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def joined(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_regions_divide_and_lose_no_link(spark):
    rows = spaces()
    sets = [s for _, _, s in rows]
    leaf = 3000
    found, links = split(spark, rows, leaf)
    edges = list(links)
    for members in found.values():
        edges += jaccard.leaf_links(list(members), list(members.values()), LIMIT)
    for a, b in edges:  # only real links are emitted
        assert jaccard.linked(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])), LIMIT)
    assert same_partition(joined(len(sets), edges), brute(sets))
    # The near copies were joined by pivots, the passage does not hold its sets together,
    assert len(links) >= 100
    # regions reach leaves, and copies are bounded.
    weights = [sum(map(len, m.values())) for m in found.values()]
    assert len(weights) > 3 and max(weights) <= leaf
    assert sum(len(m) for m in found.values()) <= 3 * len(rows)


def test_undivided_regions_are_leaves_or_blocks(spark):
    rows = [x for x in spaces() if x[0] == 2][:40]
    rows = [(reg, k, s) for k, (reg, _, s) in enumerate(rows)]
    sets = [s for _, _, s in rows]
    for last in (regions.LAST_LEAF, 1500):
        found, links = split(spark, rows, 300, rounds=(), last_leaf=last)
        edges = list(links)
        for members in found.values():
            edges += jaccard.leaf_links(list(members), list(members.values()), LIMIT)
        assert same_partition(joined(len(sets), edges), brute(sets))
        assert (len(found) == 1) == (last == regions.LAST_LEAF)


def test_windows_cover_links():
    """For random distances that obey the triangle inequality, both ends of a
    link have a region in common."""
    r = random.Random(3)
    eps = 0.15
    for _ in range(3000):
        k = r.randint(1, 6)
        x = [r.choice([r.random(), r.uniform(0.6, 1)]) for _ in range(k)]
        y = [min(1.0, max(0.0, v + r.uniform(-eps, eps))) for v in x]
        assert set(regions.windows(x, eps)) & set(regions.windows(y, eps)), (x, y)


def test_rare_signatures_meet_for_every_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64))
        drop, add = int(rng.integers(0, n // 10 + 1)), int(rng.integers(0, n // 10 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.int64).view(np.uint64)]))
        common = rng.permutation(np.union1d(a, b))[:int(rng.integers(0, n + 1))]
        if len(b) and jaccard.linked(len(a), len(b), len(np.intersect1d(a, b)), LIMIT):
            one, two = (jaccard.signatures(s, LIMIT, np.setdiff1d(s, common)) for s in (a, b))
            assert set(one) & set(two)


def test_pivots_are_on_the_path_of_the_query(spark, monkeypatch):
    """On sf0.1 the query's own leaf is small enough for regions to form."""
    called = []
    original = regions.by_pivots

    def counted(large, *rest):
        called.append(large.agg(F.count("*")).first()[0])
        return original(large, *rest)

    monkeypatch.setattr(regions, "by_pivots", counted)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert jaccard.jaccard_components(docs).count() == docs.count()
    assert called and called[0] > 10

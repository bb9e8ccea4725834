"""Vector and text indexes against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wicketlake.retrieval import documents as X
from wicketlake.retrieval import text_index as TI
from wicketlake.retrieval import vector_index as VI


def clustered(spark, n=3000, dim=8, groups=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 10, (groups, dim))
    rows = [(i, [float(np.float32(v)) for v in centres[i % groups] + r.normal(0, 0.3, dim)], i % groups) for i in range(n)]
    rows += [(n + i, rows[i % 7][1], 0) for i in range(200)]  # copies: ties, and a hot place
    rows += [(5000, None, 1), (5001, [0.0] * dim, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sum((np.array(e, float) - np.array(v, float)) ** 2)), i) for i, e in rows if e is not None)
        out[q] = [i for _, i in d[:k]]
    return out


def answers(hits, id_col):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r[id_col])
    return out


def test_indexed_search_is_exact_and_prunes_cells(spark):
    vectors = clustered(spark)
    centres = VI.cell_centres(vectors, sample_rows=500)
    index = VI.build_index(vectors, centres).cache()
    assert index.count() == vectors.filter("embedding is not null").count()
    queries = vectors.filter("vec_id in (3, 77, 5001, 3004)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    rows, asked = [(r.vec_id, r.embedding) for r in vectors.collect()], [(r.query_id, r.query_vec) for r in queries.collect()]
    pairs = len(rows) * len(asked)
    for k in (1, 40):
        found = VI.search(index, centres, queries, k)
        assert answers(found.hits, "id") == brute_nearest(rows, asked, k)
        # Clustered vectors: whole cells are left out, and few of the rest are compared.
        assert found.coded.count() < pairs / 2
        assert k > 1 or found.compared.count() < pairs / 10
    index.unpersist()


def test_random_directions_compare_under_half(spark):
    """On the sphere no cell can be left out; the codes leave few vectors."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    centres = VI.cell_centres(e)
    index = VI.build_index(e, centres)
    queries = X.label_exemplars(e)
    found = VI.search(index, centres, queries, 5)
    want = answers(X.nearest_by_scan(e, queries, 5), "vec_id")
    assert answers(found.hits, "id") == want
    assert found.compared.count() < e.count() * queries.count() / 20


def test_search_of_nothing(spark):
    vectors = clustered(spark).limit(0)
    centres = VI.cell_centres(vectors)
    index = VI.build_index(vectors, centres)
    queries = spark.createDataFrame([(1, [0.0] * 8)], "query_id long, query_vec array<double>")
    assert VI.search(index, centres, queries, 3).hits.count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    centres = VI.cell_centres(few)
    asked = spark.createDataFrame([(9, [1.0, 2.0])], "query_id long, query_vec array<double>")
    assert answers(VI.search(VI.build_index(few, centres), centres, asked, 5).hits, "id") == {9: [1, 2]}


# Text ------------------------------------------------------------------------

def brute_terms(text):
    return [w for w in re.split("[^a-z0-9_]+", (text or "").lower()) if w]


def brute_postings(docs):
    held = {i: brute_terms(t) for i, t in docs if brute_terms(t)}
    df = Counter(w for ws in held.values() for w in set(ws))
    n, mean = len(held), sum(map(len, held.values())) / max(1, len(held))
    out = {}
    for i, ws in held.items():
        for w, tf in Counter(ws).items():
            rarity = math.log(1.0 + (n - df[w] + 0.5) / (df[w] + 0.5))
            out[w, i] = math.floor(1000.0 * (rarity * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))))
    return out


def corpus(n=400):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(f"d{i:04d}", " ".join(["the"] + [words[min(299, int(r.expovariate(0.02)))] for _ in range(r.randint(3, 60))])) for i in range(n)]
    docs += [(f"c{i}", docs[3][1]) for i in range(30)] + [("e1", ""), ("e2", None), ("e3", "... !"), ("big", "w1 " * 3000 + "w299 Rare_Word")]
    return docs


def test_text_search_is_exact_for_any_k(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "id string, text string")
    index = TI.postings(frame).cache()
    want = brute_postings(docs)
    assert {(r.term, r.id): r.impact for r in index.collect()} == want
    asked = [("q1", "the w1 w5 w120", 3), ("q2", "THE", 50), ("q3", "rare_word, w2?", 1), ("q4", "nothing here", 5), ("q5", "w0 w0 w250 w299", 500), ("q6", "", 2), ("q7", None, 2),
             ("q8", docs[3][1], 7)]
    queries = spark.createDataFrame(asked, "query_id string, question string, k int")
    found = TI.search(index, queries)
    got = {}
    for r in found.hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for q, text, k in asked:
        terms = set(brute_terms(text))
        scores = Counter()
        for (w, i), impact in want.items():
            if w in terms:
                scores[i] += impact
        assert got.get(q, []) == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], q
    index.unpersist()


def test_pruning_scores_fewer_documents(spark):
    docs = corpus(1500)
    index = TI.postings(spark.createDataFrame(docs, "id string, text string")).cache()
    queries = spark.createDataFrame([("q", "the w0 w280", 3)], "query_id string, question string, k int")
    found = TI.search(index, queries)
    holders = index.filter("term in ('the', 'w0', 'w280')").select("id").distinct().count()
    assert found.candidates.count() < holders / 3 and found.hits.count() == 3
    index.unpersist()


def test_candidates_meet_documents_by_id(spark):
    """No row for each candidate and each term of its query is made to be
    joined: with every join a shuffle, none is dealt by term and id."""
    docs = [(i, "common words here " + " ".join(f"w{(i * j) % 37}" for j in range(1, 9))) for i in range(60)]
    index = TI.postings(spark.createDataFrame(docs, "id long, text string"))
    queries = spark.createDataFrame([(1, "common words w3 w5 w8", 4), (2, "here w1 w36", 2)], "query_id long, question string, k int")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = TI.search(index, queries).hits
        plan = hits._jdf.queryExecution().executedPlan().toString()
        found = {(r.query_id, r["rank"]): (r.id, r.score) for r in hits.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert not re.search(r"hashpartitioning\(term#\d+L?, id#", plan), plan
    held = {}
    for r in index.collect():
        held.setdefault(r.id, {})[r.term] = r.impact
    for q in queries.collect():
        sums = sorted((-sum(own[t] for t in q.question.split() if t in own), i) for i, own in held.items() if set(own) & set(q.question.split()))
        assert [found[q.query_id, n + 1] for n in range(q.k)] == [(i, -s) for s, i in sums[:q.k]]


def test_sizes_come_from_the_term_counts(spark, monkeypatch):
    """The texts are cut into terms once; equal ids count as documents of
    their own, as they did."""
    read, kept = [], TI.written
    monkeypatch.setattr(TI, "written", lambda df, name: read.append(name) or kept(df, name))
    docs = [(1, "a b b"), (1, "a c d"), (2, "a"), (3, None), (4, "..."), (5, "e f g h")]
    index = TI.postings(spark.createDataFrame(docs, "id long, text string").coalesce(1))
    assert read == ["term-counts"] and "split(" not in index._jdf.queryExecution().optimizedPlan().toString()
    n, mean, df = 4, 11 / 4, {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1}
    tf = {(1, "a"): (2, 3), (1, "b"): (2, 3), (1, "c"): (1, 3), (1, "d"): (1, 3), (2, "a"): (1, 1), **{(5, t): (1, 4) for t in "efgh"}}
    want = {key: math.floor(1000 * math.log(1 + (n - df[key[1]] + 0.5) / (df[key[1]] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)))
            for key, (f, length) in tf.items()}
    assert {(r.id, r.term): r.impact for r in index.collect()} == want


def test_postings_of_nothing(spark):
    index = TI.postings(spark.createDataFrame([], "id string, text string"))
    queries = spark.createDataFrame([("q", "a", 3)], "query_id string, question string, k int")
    assert index.count() == 0 and TI.search(index, queries).hits.count() == 0


def test_previews_honour_k(spark):
    from wicketlake.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    docs = X.all_documents(t.clean_matches, t.players, t.venues, t.deliveries).select("id", "doc_type", "text")
    index = TI.postings(docs).cache()
    texts = {r.text for r in docs.collect()}
    for team, venue in ((3, 2), (6, 4)):
        for r in X.preview_contexts(t.clean_matches, docs, index, team, venue).collect():
            lines = r.context.split("\n")
            assert len(lines) == 2 * team + venue and set(lines) <= texts
    index.unpersist()


def test_terms_are_counted_without_a_shuffle(spark):
    """Words are counted in the row of their document; documents that share an
    id and a length, null ids too, are summed as one."""
    docs = [(1, "b a b a b"), (2, "The the, THE x_1"), (3, None), (4, " .. "), (5, "only")]
    count = lambda rows: Counter((r.id, r.length, r.term, r.tf) for r in TI.term_counts(spark.createDataFrame(rows, "id long, text string")).collect())
    plan = TI.term_counts(spark.createDataFrame(docs, "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan
    want = Counter([(1, 5, "a", 2), (1, 5, "b", 3), (2, 4, "the", 3), (2, 4, "x_1", 1), (5, 1, "only", 1)])
    assert count(docs) == want
    more = [(1, "b c d e f"), (1, "a"), (None, "n m"), (None, "n n"), (3, "z")]
    want = want - Counter([(1, 5, "b", 3)]) + Counter([(1, 5, "b", 4), (1, 1, "a", 1), (None, 2, "n", 3), (None, 2, "m", 1), (3, 1, "z", 1)]
                                                      + [(1, 5, t, 1) for t in "cdef"])
    assert count(docs + more) == want


def test_index_and_search_free_what_they_read(spark, monkeypatch):
    """The term counts are gone when the postings are there; no shuffle file
    of a written step stays; the parts written in rounds are whole."""
    read, kept = {}, TI.written
    monkeypatch.setattr(TI, "written", lambda df, name: read.setdefault(name, kept(df, name)))
    docs = corpus(200)
    index = TI.postings(spark.createDataFrame(docs, "id string, text string"))
    assert spark.read.schema("id string").parquet(read["term-counts"]._folder).count() == 0 and [t.count() for t in index.spent] == [index.count()]
    assert {(r.term, r.id): r.impact for r in index.collect()} == brute_postings(docs)
    queries = spark.createDataFrame([("q", "the w0 w280", 3), (None, "the", 2)], "query_id string, question string, k int")
    found = TI.search(index, queries)
    assert "search-floors" in read and {r.query_id for r in found.hits.collect()} == {"q"}

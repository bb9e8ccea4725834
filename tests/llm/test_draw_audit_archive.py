"""Operators 11, 12 and 13 against brute force, on planted rows and tables."""

import base64
import gzip
import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from wicketlake.llm import audit, registered, resample, warc

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def oracle(sql, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql)


# Operator 11 ----------------------------------------------------------------

def brute_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_draw(docs, target, share=(5, 100), min_words=20, buckets=10_000):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    found = [brute_features(t) for _, t in docs]
    s = Counter(bucket(f) for _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in brute_features(x)[1])
    big_s, big_t = s.total(), t.total()

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))

    out = []
    for (doc_id, _), (words, features) in zip(docs, found):
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, score, None, len(words)])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[:share[0] * len(fit) // share[1]], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


ODD = ["", None, " ", "...", "One", "a-b a_b A1 1a", "ÉCOLE école İx ß y", "x\x00y\x7fz{w", "日本語 テスト", "😀 ok 😀", "w " * 25, "The the THE " * 30,
       " ".join(f"t{i}" for i in range(60)), "same words in each of these many copies " * 3, "same words in each of these many copies " * 3]
DRAW = ["doc_id", "n_features", "weight", "score", "rank"]


def test_resample_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, ODD[-1]), (None, "n " * 40), (3, ODD[10]), (3, ODD[10])]
    target = ["same words in each", None, "", "THE the w w w"]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, met int, score int")
    wanted = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = rows_of(resample.importance_scores(docs, wanted, share=(50, 100), min_words=10), *DRAW)
    assert got == brute_draw(rows, target, share=(50, 100), min_words=10)
    none = rows_of(resample.importance_scores(docs, wanted.limit(0)), *DRAW)
    assert none == brute_draw(rows, [])
    assert resample.importance_scores(docs.limit(0), wanted).count() == 0
    taken = resample.resample(docs, wanted, share=(50, 100), min_words=10)
    assert taken.columns == docs.columns and 0 < taken.count() < len(rows)


def test_resample_blocks_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(9000))
    whole = resample.Scanner(10_000).counts(text)
    monkeypatch.setattr(resample, "BLOCK_FEATURES", 1000)
    blocks = resample.Scanner(10_000).counts(text)
    assert whole[0] == blocks[0] == 9000 and all((a == b).all() for a, b in zip(whole[1:], blocks[1:]))
    scanner = resample.Scanner(10_000)
    line = scanner.collapsed(text)
    assert Counter(line[a:b].decode() for a, b in scanner.spans(line)) == Counter(brute_features(text)[1])


def test_resample_blocks_cut_at_any_word(monkeypatch):
    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choice("aBé -_\n9 ") for _ in range(rng.randrange(60)))
        monkeypatch.setattr(resample, "BLOCK_FEATURES", rng.choice([1, 4, 12, 45]))
        words, met, n = resample.Scanner(97).counts(text)
        brute = Counter(zlib.crc32(f.encode()) % 97 for f in brute_features(text)[1])
        assert words == len(brute_features(text)[0]) and dict(zip(met.tolist(), n.tolist())) == brute


def test_resample_takes_no_python_step_per_word():
    scanner, steps = resample.Scanner(10_000), []
    text = " ".join(f"w{i % 700}" for i in range(5000))

    def step(frame, event, arg):
        steps.append(event)
        return step

    sys.settrace(lambda frame, event, arg: step if frame.f_code.co_name == "counts" else None)
    try:
        scanner.counts(text)
    finally:
        sys.settrace(None)
    assert 0 < len(steps) < 1000


def test_resample_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(registered.op11_resample(spark, SF), *DRAW) == brute_draw(docs, target)


# Operator 12 ----------------------------------------------------------------

def brute_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    failed = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
              re.search(r"[#$%&*|]", text) is not None]
    return {k for k, f in zip("ABCD", failed) if f}


def brute_audit(docs, labels):
    lowest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            lowest[text or ""] = min(doc_id, lowest.get(text or "", doc_id))
    parts = defaultdict(list)
    for doc_id, text, lang in docs:
        fails = brute_mask(text or "")
        if doc_id is not None and doc_id > lowest[text or ""]:
            fails = fails | {"E"}
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        parts[lang or ""].append((fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            kept = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in kept if letter in r[0]]
                redundant = sum(letter in r[0] for r in rows) - len(gone)
                kept = [r for r in kept if letter not in r[0]]
                total[letter] += len(gone)
                out[part, order, step] = [len(kept), len(gone), redundant, sum(r[0] == {letter} for r in rows),
                                          sum(r[1] for r in gone), sum(r[2] for r in gone), letter]
        for key in list(out):
            if key[0] == part:
                out[key][-1] = total[out[key][-1]]
    return out


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def check_audit(got, docs, labels):
    have = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in AUDIT[3:]] for r in got.collect()}
    assert have == brute_audit(docs, labels)


def in_files(spark, rows, folder, n):
    """Rows dealt to ``n`` files so that smaller ids arrive later."""
    for k in range(n):
        spark.createDataFrame(rows[k::n], "doc_id long, text string, lang string, mask int, key string").coalesce(1).write.mode("append").parquet(folder)
    names = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
    assert len(names) == n
    for k, name in enumerate(names):  # the stream takes older files first
        os.utime(f"{folder}/{name}", (1_000_000 + k, 1_000_000 + k))


@pytest.mark.parametrize("batches", [1, 7])
def test_audit_retracts(spark, tmp_path, batches):
    good = " ".join(f"word{i}" for i in range(220))
    texts = [good, good + " #", "", None, " \t\n", "ABC DEF " * 120, "dup dup\x0bdup", "é" * 30 + " x y z\x85w", good.upper(), "long " * 5000, "日本 " * 210]
    rows = [(1000 - i, texts[i % len(texts)], ["en", "de", None, ""][i % 4], 1, "k") for i in range(90)]
    rows += [(None, good, "en", 1, "k"), (None, good, None, 1, "k"), (5, good, "en", 1, "k"), (5, good, "en", 1, "k"), (5, good, "fr", 1, "k"), (2000, good, "fr", 1, "k")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(900, 1000, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (980, None, 1), (77, 1, 1)]
    folder = str(tmp_path / "documents.parquet")
    in_files(spark, rows, folder, 7)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    check_audit(audit.audit_filters(spark, folder, table, batches=batches), [r[:3] for r in rows], labels)


def test_audit_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = audit.audit_filters(spark, str(tmp_path / "documents.parquet"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == 0 and got.columns == AUDIT


def test_audit_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    check_audit(registered.op12_audit(spark, SF), docs, labels)


# Operator 13 ----------------------------------------------------------------

PAGES = "page_id long, url string, html string, refers_to string, shard int"
FOUND = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute_warc(pages, min_bytes=0):
    groups = defaultdict(list)
    for page_id, html in pages:
        groups[html or ""].append(page_id)
    out = Counter()
    for html, ids in groups.items():
        data = html.encode()
        told = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        for k, i in enumerate(ids):
            first = k == 0 or len(data) < min_bytes
            out[(i, *told, "response" if first else "revisit", None if first else ids[0])] += 1
    return out


def odd_pages():
    rows = [(i, f"http://a.example/{i}", f"<p>{i}</p>\r\n\r\nWARC/1.1\r\n" * (i % 5 + 1)) for i in range(60)]
    rows += [(100 + i, "http://copy.example/ \r\nWARC-Type: x", "copied é日本😀") for i in range(30)]
    rows += [(7, None, "copied é日本😀"), (None, None, None), (None, "n", "copied é日本😀"), (200, "", ""), (201, "u", None), (202, "u", " ")]
    rows += [(300, "u", "twice"), (300, "u", "twice"), (300, "v", "twice"), (300, "w", "other"), (301, "big", "x" * 2_000_000), (None, "q", "twice"), (None, "q", "only"), (None, "q", "only")]
    return rows


def test_warc_round_trip(spark):
    rows = odd_pages()
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    plain = [(r[0], r[2]) for r in rows]
    for options in ({}, {"shard_bytes": 300, "file_bytes": 900}, {"min_bytes": 5}):
        folder, manifest = warc.write_warc(pages, **options)
        back = warc.read_warc(spark, folder).collect()
        assert len(back) == len(rows) == sum(r.records for r in manifest.collect())
        assert {r.record_id for r in back}.__len__() == len(rows)
        got = rows_of(warc.warc_digest(pages, **options), *FOUND)
        assert got == brute_warc(plain, options.get("min_bytes", 0))
        responses = Counter(r.payload for r in back if r.record_type == "response")
        assert set(responses) == {r[2] or "" for r in rows}
        names = {r.record_id for r in back if r.record_type == "response"}
        assert all(r.refers_to in names for r in back if r.record_type == "revisit")


def archives(folder):
    path = folder.removeprefix("file://") + "/archives"
    return {name: open(f"{path}/{name}", "rb").read() for name in os.listdir(path)}


def test_warc_files_are_deterministic_and_rolled(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in odd_pages()], PAGES)
    options = {"shard_bytes": 1000, "file_bytes": 1500}
    one, manifest = warc.write_warc(pages.repartition(1), **options)
    two, _ = warc.write_warc(pages.repartition(7, F.rand(3)), **options)
    a, b = archives(one), archives(two)
    assert a == b and not any(name.endswith(".tmp") for name in a)
    assert {r.file: (r.bytes, r.sha256) for r in manifest.collect()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in a.items()}
    assert len({n[:14] for n in a}) > 3 and any(n.endswith("-00001.warc.gz") for n in a)
    last = max(zlib.compress(r[2].encode()).__len__() for r in odd_pages() if r[2])
    assert all(len(d) < 1500 + last + 1000 for d in a.values())
    for data in a.values():  # every file begins with its own warcinfo record
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_warc_readers_trust_the_manifest_only(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in odd_pages()], PAGES)
    folder, _ = warc.write_warc(pages)
    path = folder.removeprefix("file://") + "/archives"
    with open(f"{path}/.pages-left-over.tmp", "wb") as f:
        f.write(b"half a file of a lost attempt")
    assert warc.read_warc(spark, folder).count() == len(odd_pages())
    name = next(n for n in os.listdir(path) if n.endswith(".warc.gz"))
    with open(f"{path}/{name}", "ab") as f:
        f.write(gzip.compress(b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Block-Digest: sha1:" + warc.base32_sha1(b"").encode() + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read_warc(spark, folder).collect()


def test_warc_of_nothing(spark):
    assert warc.warc_digest(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_on_the_table(spark):
    plain = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert rows_of(registered.op13_warc(spark, SF), *FOUND) == brute_warc(plain)
    rel = oracle(warc.ORACLE, SF)
    names = [d[0] for d in rel.description]
    assert Counter(tuple(r[names.index(c)] for c in FOUND) for r in rel.fetchall()) == brute_warc(plain)

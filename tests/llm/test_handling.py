"""Nulls, empty tables, repeated rows, long texts and clashing columns, for the
operators whose other tests leave them out."""

import hashlib
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_maps import base_spans, digest
from wicketlake.llm import chat, common, decontaminate, fingerprints, linededup, packing, pii, registered, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum a.b@example.org 10.0.0.1 dolor\n" * 6000
ROWS = [(None, "x a@b.cd"), (None, "x a@b.cd"), (5, "call +49 30 1234567"), (5, "call +49 30 1234567"), (5, "other"), (7, None), (8, ""), (9, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "c", 1, "k") for i, t in ROWS], "doc_id long, text string, spans string, n_tokens int, cut string")


def test_pii_rows(spark, docs):
    got = Counter((r.doc_id, r.base_sha256) for r in pii.pii_digest(docs).collect())
    assert got == Counter((i, digest(base_spans(t or ""))) for i, t in ROWS)


def test_token_rows(spark, docs):
    from tokenizers import Tokenizer

    path = registered.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path).collect())
    want = Counter()
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want and tokens.count_tokens(docs.limit(0), path).count() == 0


def test_packing_rows(spark, docs):
    path = registered.tokenizer_path("word_bpe_49k.json")
    pieces = packing.pack_documents(docs, path).collect()
    encoder = packing.Encoder(path)
    sizes = Counter()
    for i, t in ROWS:
        sizes[i] += len(encoder.ids(t or "")) // 4 + 1
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == sizes
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]  # gapless from 0
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 4096


def test_fingerprint_rows(spark, docs):
    got = fingerprints.neighbour_fingerprints(docs).collect()
    assert len(got) == len(ROWS) and Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    by_size = {}
    for r in got:
        by_size.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(by_size[len(ROWS[0][1])]) == 1 and by_size[0] == {fingerprints.fingerprint(b"")}


def test_chat_of_nothing_and_of_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string, piece string"
    assert chat.conversation_digest(chat.format_turns(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "user", LONG * 3, "c"), (1, 1, "assistant", "<|im_end|>" * 50_000, "c")]
    r = chat.conversation_digest(chat.format_turns(spark.createDataFrame(rows, schema))).first()
    said = "".join(f"{x[2]}\n{x[3]}\n" for x in rows)
    assert r.n_turns == 2 and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_chars == 500_000


def test_url_rows(spark):
    schema = "page_id long, url string, host string, verdict int"
    rows = [(None, "http://a.org/x", "c", 1), (1, None, "c", 1), (1, "http://a.org/x", "c", 1), (1, "http://a.org/x", "c", 1), (2, "no scheme", "c", 1), (3, "", "c", 1)]
    labelled = spark.createDataFrame([("http://q.net/a", True), ("http://q.net/b", False), (None, True)], "url string, blocked boolean")
    got = urls.judge_urls(spark.createDataFrame(rows, schema), labelled).collect()
    assert len(got) == len(rows)
    assert {r.verdict for r in got if r.host == "a.org"} == {"allow"} and sum(r.host == "" for r in got) == 3
    assert urls.judge_urls(spark.createDataFrame([], schema), labelled).count() == 0


def test_toxicity_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(whole, labels)
    assert toxicity.score_documents(whole.limit(0), model).count() == 0
    rows = spark.createDataFrame([(i, t, 0.5) for i, t in ROWS], "doc_id long, text string, score double")
    got = toxicity.score_documents(rows, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) <= 2 and len({r.score for r in got if r.doc_id in (7, 8)}) == 1


def test_wide_line_rows(spark):
    line = "one two three four five six seven eight nine ten"
    long_line = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, f"{line}\nown words that nobody else has here"), (2, f"{line.upper()}!\nlast"), (3, None), (4, ""), (None, line), (5, long_line), (6, long_line + " more")]
    docs = spark.createDataFrame([(i, t, 3, "p") for i, t in rows], "doc_id long, text string, cut int, places string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs, wide=True).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "last" and got[3].text is None and got[4].text == "" and got[None].text == line
    assert got[5].text == long_line and got[6].text == "" and got[1].cut == 3 and got[2].cut_.n_dropped == 1
    assert linededup.dedup_lines(docs.limit(0), wide=True).count() == 0


def test_decontamination_rows(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    benchmark = spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string")
    rows = [(1, LONG + item + LONG), (1, item), (2, "nothing of it"), (None, item), (3, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    got = decontaminate.overlaps(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1)}
    kept = decontaminate.decontaminate(docs, benchmark)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, None, 3]) and kept.columns == docs.columns


def test_pipeline_of_nothing_and_of_odd_rows(spark):
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, "a b c", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words here for all of us", "en", "s", 29),
                      (3, "same words here for all of us", "en", "s", 29), (4, "same words here for all of us", "en", "s", 29)]):
        docs = spark.createDataFrame(rows, names)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in names.split(", ")], name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        # The repeated line of document 4 is cut; empty documents and rows without an id or text stay.
        assert {r.doc_id for r in packed.collect()} == ({None, 1, 2, 3, 4} if rows else set())
        assert {r.doc_id for r in packed.collect() if r.doc_tokens > 1} <= {None, 3}


def test_written_tables_leave_no_shuffle_files(spark):
    """The files of the shuffles behind a written table go with it, so those of
    an operator's many steps do not add up on disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(common.FREE_SHUFFLES)
    rows = spark.range(20_000).withColumn("k", F.xxhash64("id"))
    made = common.written(rows.repartition(8, "k").groupBy("k").agg(F.max("id").alias("id")), "freed")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(common.FREE_SHUFFLES) == setting
    assert made.count() == 20_000 and made.agg(F.max("id")).first()[0] == 19_999


def test_jaccard_frees_signatures_and_shingles(spark):
    """What a step has used up does not stay on disk beside later steps."""
    from wicketlake.llm import jaccard
    from wicketlake.session import ensure_checkpoint_dir

    base = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "wicketlake")

    def made():
        return {f for f in os.listdir(base) if f.startswith(("jaccard-sets-", "jaccard-shingles-"))} if os.path.isdir(base) else set()

    before = made()
    common_part = " ".join(f"c{i}" for i in range(40))
    texts = [f"{common_part} " + " ".join(f"w{k}x{i}" for i in range(60)) for k in range(40)]
    texts += [t + " end" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, leaf=200).collect()}
    assert got == {k: k if k < 40 else k - 40 for k in range(45)}
    fresh = made() - before
    assert any(f.startswith("jaccard-sets-") for f in fresh) and any(f.startswith("jaccard-shingles-") for f in fresh)
    assert all(spark.read.parquet(f"file://{base}/{f}").isEmpty() for f in fresh)

"""Operators 1, 2, 3, 6, 8, 10 against brute force, round trips and planted cases."""

import hashlib
import os
import re
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wicketlake.llm import chat, fingerprints, packing, pii, registered, tokens, urls

SF = "/root/testdata/sf0.001"
HARD = ["", None, " ", "a", "\n\n  x \t\t y  ", "  lead", "trail  ", "don't we'll IT'S", "é ÉCOLE naïve ß Σίσυφος İx", "日本語 テスト 123", "<|endoftext|>a <|endoftext|> b",
        "<|ENDOFTEXT|> <|startoftext|>", "a\u0301 e\u0301", "x\x1cy \x1cz \x85w\u00a0v", "😀😀 👩‍👩‍👧 ok", "aaaa" * 300, "1234567890" * 30, "!!!...,,, ?!", "\r\n\r\n a \r\n", "tab\t\ttab ",
        "a,b.c; d.", "The end. The end.", "word " * 3000]


def frame(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# Operator 1 -----------------------------------------------------------------

def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


PII = ["a@b@c.de x.y+z@mail.example.org.", "a@b.c@d.e @x.y p@q p@-.-", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111",
       "+1 (017) 555-7713, +1+2345678901 +12 ((( +4 5", "é +49 30 1234567 日本 10.0.0.1", "9" * 5000 + "." + "1" * 5000, "+" * 50 + "1" * 20, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1  4111",
       "see https://a.example.com/x?y=1 at 12 Main Street, IBAN: DE89 3704 0044 0532 0130 00 account 12345678", "@" * 3000]


def test_pii_equals_regex(spark):
    got = by_id(pii.pii_digest(frame(spark, PII + HARD, spans="clash", n_ip=3)))
    for i, t in enumerate(PII + HARD):
        want = base_spans(t)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS], t
        assert r["base_sha256"] == digest(want)
        assert r["spans"].startswith(",".join(f"{k}:{s}:{e}" for k, s, e in want))
    kinds = {s.split(":")[0] for s in got[9]["spans"].split(",")}
    assert {"url", "address", "account"} <= kinds


def test_pii_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = by_id(pii.pii_digest(docs))
    for r in docs.collect():
        assert got[r.doc_id]["base_sha256"] == digest(base_spans(r.text))
    assert pii.pii_digest(docs.limit(0)).count() == 0


def test_pii_redacts(spark):
    got = pii.redact(frame(spark, ["mail a.b@c.org now", None])).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["mail [EMAIL] now", ""]


# Operator 2 -----------------------------------------------------------------

def test_chat_round_trip_and_blocks(spark):
    hard = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<|b", "<", "|x", "", None, "\n<|im_start|>user\nq<|im_end|>\n"]
    rows = [(7, k, "assistant" if k % 2 else "user", hard[k % len(hard)]) for k in range(200)]
    rows += [(8, 0, None, "x"), (8, 0, "user", "x"), (8, 0, "user", "x"), (None, 0, "user", "n"), (9, None, "assistant", "z"), (9, 5, "ro\\n\nle<|", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = by_id(chat.conversation_digest(chat.format_turns(df, block_turns=16)), "conv_id")
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (7, 8, 9, None):
        own = sorted((r for r in rows if r[0] == conv), key=order)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["n_rewrites"] == 0
        if conv in (8, 9, None):
            assert r["formatted_chars"] == len(chat.marked_template([(x[2] or "", x[3] or "") for x in own]))


def test_chat_spans_join_to_the_rendering(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.with_spans(chat.format_turns(df, block_turns=8)).orderBy("conv_start").collect()
    whole = chat.marked_template([("user", f"t{k}") for k in range(70)])
    assert "".join(p.piece for p in pieces) == whole
    assert all(whole[p.conv_start:p.conv_end] == p.piece for p in pieces)


def test_chat_detects_rewriting_templates(spark):
    def only_last_is_whole(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t[:1]}." for k, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "def")], "conv_id long, turn long, role string, text string")
    got = chat.format_turns(df, only_last_is_whole).orderBy("pos").collect()
    assert [r.rewrites for r in got] == [False, True]


def test_chat_templates_see_their_whole_conversation(spark):
    def no_old_thoughts(turns):  # a counter, and history before the last user turn is rewritten
        asked = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"[{k} {r}]{t.split('#')[-1] if r == 'assistant' and k < asked else t}." for k, (r, t) in enumerate(turns))

    def alternating(turns):
        assert all(r == ("assistant" if k % 2 else "user") for k, (r, _) in enumerate(turns))
        return "".join(f"[{k}]{r}:{t};" for k, (r, t) in enumerate(turns))

    # Few user turns: the first assistant turns are far from the user turn that rewrites them.
    few = [("user" if k in (0, 69) else "assistant", f"thought#t{k}") for k in range(70)]
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(70)]
    for template, said in ((no_old_thoughts, few), (alternating, turns)):
        rows = [(c, k + 20 * c, r, t) for c in (0, 1) for k, (r, t) in enumerate(said)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {}
        for r in chat.format_turns(df, template).orderBy("conv_id", "block", "pos").collect():
            got.setdefault(r.conv_id, []).append(r)
        for own in got.values():
            before = ""
            for k, r in enumerate(own):
                after = template(said[:k + 1])
                assert r.rewrites == (not after.startswith(before))
                assert r.piece == after[len(os.path.commonprefix([before, after])):] and r.pos == k
                before = after
            assert len(own) == 70


def test_chat_oracle(spark):
    got = registered.op2_chat(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(chat.ORACLE).df().sort_values("conv_id").reset_index(drop=True)
    assert got[want.columns].equals(want)


def test_pii_anchors_that_expand_to_the_right():
    anchors = pii.automaton()
    for text, kind, want in (
            ("call tel:0301234567 now", "url", ["tel:0301234567"]), ("tel:+49-30-123456.", "url", ["tel:+49-30-123456"]),
            ("hotel:0301234567 tel:12", "url", []), ("mailto:a.b@c.de?x", "url", ["mailto:a.b@c.de"]),
            ("au 12 rue de la Paix, Paris", "address", ["12 rue de la Paix"]), ("12, Rue Victor Hugo", "address", ["12, Rue Victor Hugo"]),
            ("Calle Mayor 5 y", "address", ["Calle Mayor 5"]), ("la calle 5 true Paix 7", "address", []), ("dans la rue de la Paix", "address", []),
            ("Hauptstraße 12.", "address", ["Hauptstraße 12"]), ("Lange Straße 3a und", "address", ["Lange Straße 3a"]),
            ("HAUPTSTRASSE 12, Karl-Marx-Strasse 7", "address", ["HAUPTSTRASSE 12", "Karl-Marx-Strasse 7"]),
            ("eine Straße ohne", "address", []), ("5 Old Mill Road", "address", ["5 Old Mill Road"])):
        assert [text[a:b] for a, b in pii.expand(text, anchors).get(kind, [])] == want, text


# Operator 3 -----------------------------------------------------------------

def test_url_rules(spark):
    cases = {"http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
             "http://x.org": ("x.org", "", None, "allow"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "ftp://a.com/de/1": ("a.com", "/de/1", "com/de/", "block"),
             "http://com/fr/": ("com", "/fr/", "com/fr/", "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://é.com?x=/fr/": ("é.com", "", None, "allow"),
             "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://a.org\n/x": ("a.org\n", "/x", None, "allow")}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit(1))
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = by_id(urls.judge_urls(pages, none), "page_id")
    for i, want in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want


def test_url_rules_are_mined_and_matched(spark):
    bad = [(f"http://ads.spam{k % 3}.net/offer/{k}", True) for k in range(60)]
    good = [(f"http://www.good{k % 3}.net/offer/{k}", False) for k in range(60)] + [(f"http://ads.fine.net/news/{k}", False) for k in range(60)]
    labelled = spark.createDataFrame(bad + good, "url string, blocked boolean")
    pages = spark.createDataFrame([(0, "http://ads.spam1.net/offer/999"), (1, "http://www.good1.net/offer/9"), (2, "http://ads.fine.net/news/2")], "page_id long, url string")
    got = by_id(urls.judge_urls(pages, labelled, min_support=0.05), "page_id")
    assert [got[i]["verdict"] for i in range(3)] == ["block", "allow", "allow"]
    # The index agrees with testing every rule on every URL.
    rules = urls.mine_rules(labelled.select(urls.tokens_of(F.col("url")).alias("tokens"), "blocked"), min_support=0.05)
    sets = [(set(r.tokens), r.rule_id) for r in rules.collect()]
    assert sets and not any(a < b for a, _ in sets for b, _ in sets)
    shapes = pages.select("page_id", urls.tokens_of(F.col("url")).alias("tokens"))
    hits = {tuple(r.tokens): r.n_rules for r in urls.fired(shapes.select("tokens").distinct(), rules).collect()}
    for r in shapes.collect():
        assert hits.get(tuple(r.tokens), 0) == sum(a <= set(r.tokens) for a, _ in sets)


# Operators 6 and 10 ---------------------------------------------------------

def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registered.tokenizer_path(name))


def table_texts(n=150):
    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id limit {n}").fetchall()]


def test_encoder_equals_library():
    tok, enc = library("word_bpe_49k.json"), packing.Encoder(registered.tokenizer_path("word_bpe_49k.json"))
    for t in [t or "" for t in HARD] + table_texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert enc.ids(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t[:80])


def test_token_counts_equal_library(spark):
    tok = library("byte_bpe_50k.json")
    texts = HARD + table_texts()
    got = by_id(tokens.count_tokens(frame(spark, texts, n_tokens="x"), registered.tokenizer_path("byte_bpe_50k.json")))
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[i]["n_tokens"] == n, repr((t or "")[:80])
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (n > 512)


def test_random_texts_equal_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    byte, word = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    own = tokens.Counter(registered.tokenizer_path("byte_bpe_50k.json"))
    enc = packing.Encoder(registered.tokenizer_path("word_bpe_49k.json"))
    chars = st.text(st.one_of(st.sampled_from(" \t\n\r\x1c\x85\u00a0'.,!aBsSéÉß1٣日<|>"), st.characters(exclude_categories=["Cs"])), max_size=40)

    @settings(max_examples=400, deadline=None)
    @given(chars)
    def same(t):
        assert own.count(t) == len(byte.encode(t, add_special_tokens=False).ids)
        ids = word.encode(t, add_special_tokens=False).ids
        assert enc.ids(t) == struct.pack(f"<{len(ids)}I", *ids)

    same()


def test_memo_stays_bounded():
    from wicketlake.llm.common import TwoGenerationCache

    memo = TwoGenerationCache(lambda k: k * 2, limit=10)
    assert [memo[k] for k in range(1000)] == [2 * k for k in range(1000)]
    assert len(memo) + len(memo.old) <= 20


def test_packing_places_each_id_once(spark):
    path = registered.tokenizer_path("word_bpe_49k.json")
    tok = library("word_bpe_49k.json")
    texts = HARD + table_texts() + ["long text with many words " * 9000]
    rows = packing.pack_documents(frame(spark, texts, ids="x", length=1).repartition(3), path, pool_tokens=9000).collect()
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    padded = 0
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(r.doc_tokens == len(ids) and r.length * 4 == len(r.ids) for r in own)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        n = sum(r.length for r in own)
        assert n <= 4096
        padded += n not in (512, 1024, 2048, 4096)
    assert padded <= 3
    digest_rows = packing.packing_digest(frame(spark, ["one two"]), path).collect()
    ids = tok.encode("one two", add_special_tokens=False).ids + [2]
    assert digest_rows[0].ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert packing.packing_digest(frame(spark, ["x"]).limit(0), path).count() == 0


# Operator 8 -----------------------------------------------------------------

@pytest.mark.parametrize("parts", [1, 5])
def test_neighbour_fingerprints(spark, parts):
    texts = HARD + table_texts(40) + ["same", "same"]
    got = by_id(fingerprints.neighbour_fingerprints(frame(spark, texts, part=1, fingerprint="x").repartition(parts)))
    texts = [t or "" for t in texts]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(t.encode())
        assert r["near_edited"] == fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(edited.encode()))
        assert r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(after.encode()))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.fingerprint(b"same") == got[len(texts) - 1]["fingerprint"]


def test_bucket_counts_by_hand():
    data = bytes(range(50)) * 3
    padded = data + b"\0" * 4
    want = [0] * 256
    for i in range(4, len(padded)):
        for places, t in zip(fingerprints.TRIPLETS, fingerprints._tables()):
            want[t[0][padded[i - places[0]]] ^ t[1][padded[i - places[1]]] ^ t[2][padded[i - places[2]]]] += 1
    assert fingerprints.bucket_counts(data).tolist() == want


def test_single_and_empty_tables(spark):
    one = fingerprints.neighbour_fingerprints(frame(spark, ["abcdef"])).collect()
    assert len(one) == 1 and one[0].near_edited < 1
    assert fingerprints.neighbour_fingerprints(frame(spark, ["x"]).limit(0)).count() == 0

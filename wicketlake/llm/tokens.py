"""Operator 10, token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens as the tokenizer file's byte-level rule does.
The symbols of a pre-token form a doubly linked list; every adjacent pair with
a merge rank waits in a heap. The pair of lowest rank (leftmost of equals) is
popped and merged, its two new neighbour pairs are pushed, and stale entries
are skipped. The count is the number of initial symbols minus the number of
merges; ids are never looked up.

A pre-token is counted once per worker and kept in a bounded memo. Texts cut
at a space before a non-space give the same pre-tokens as the whole text, so
such pieces are memoised too, and most of a text is a sum over memo hits.

Defined results: a null text is empty and has no tokens; a special string of
the tokenizer file inside a text is one token, as the library's default has
it; rows are independent, so ties, repeats and other columns change nothing;
texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import TwoGenerationCache, map_batches, texts_of, worker_state

# Fixed value: the byte-level pre-token pattern of the tokenizer family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, by rule: visible Latin-1
    characters stand for themselves, the others for the code points from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two was merged meanwhile
        merges += 1
        joined = symbols[i] = left + right
        symbols[j] = ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((joined, symbols[k]))
            if rank is not None:
                heappush(heap, (rank, i, joined, symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], joined))
            if rank is not None:
                heappush(heap, (rank, h, symbols[h], joined))
    return n - merges


class Counter:
    """Token counts under one byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.symbols = byte_symbols()
        self.odd = regex.compile(r" (?:\s|[\x1c-\x1f]|\Z)").search
        self.pre = TwoGenerationCache(self._pre)
        self.piece = TwoGenerationCache(lambda p: sum(map(self.pre.__getitem__, self.find(" " + p))))

    def _pre(self, token: str) -> int:
        symbols = self.symbols
        return count_merged([symbols[b] for b in token.encode()], self.ranks)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if self.odd(text):  # spaces that are not followed by a word: no safe cuts
            return sum(map(self.pre.__getitem__, self.find(text)))
        first, *rest = text.split(" ")
        return sum(map(self.pre.__getitem__, self.find(first))) + sum(map(self.piece.__getitem__, rest))

    def count(self, text: str) -> int:
        if self.special and any(s in text for s in self.specials):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


def _count(columns: list[list], path: str) -> list[list]:
    ids, sizes, texts = columns
    count = worker_state(("tokens", path), lambda: Counter(path)).count
    return [ids, sizes, [count(t) for t in texts]]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``; a map over the rows, no
    shuffle. ``tokenizer_path`` must exist on every executor."""
    own = texts_of(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = dict(own.dtypes)["doc_id"]
    counted = map_batches(own, _count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint", tokenizer_path)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

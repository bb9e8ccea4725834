"""Operator 6, hierarchical multi-length packing.

Every document becomes token ids and an end id. Ids of a document that fill
whole long windows are cut off at once; the rest is routed to the smallest of
several context sizes (512, 1024, 2048, 4096) that holds it. Each task then
works through its documents in pools of bounded size:

1. tiers are packed from long to short, largest piece first, each piece into
   the fullest open window of its tier that holds it, else a new window;
2. gaps of a window are filled from shorter tiers, the largest fitting piece
   first; where none fits exactly, a shorter piece is cut to close the gap;
3. only full windows leave the pool, and the rest moves to the next pool;
4. full windows are dealt into step groups of equal token count, in snake
   order of their attention cost (sum of squared piece lengths), so that the
   steps of a group cost alike.

What is left at the end of a task is packed into long windows; only the last
of them is padded, so padding is under one window per task. Full windows of a
shorter tier are a power of two and need none.

Packing is a map over the partitions of the input: no shuffle, no key, memory
bounded by the pool. Sequence ids hold the partition number and are unique; a
task that runs again gives a consistent set of its own documents' pieces.

Defined results: a null text is empty; an empty text is its end id alone; null
ids and repeated rows are documents of their own; other columns are ignored;
an empty table gives an empty result; texts are tokenised whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import TwoGenerationCache, stream_batches, texts_of, worker_state
from wicketlake.llm.tokens import byte_symbols

TIERS = (512, 1024, 2048, 4096)
POOL_TOKENS = 1_500_000
STEP_TOKENS = 8 * 4096

# Fixed value: the pre-token pattern of the tokenizer family, for words of visible ASCII.
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_VISIBLE = re.compile(rb"[!-~]+\Z")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, under a
    tokenizers file whose rule drops white space and lowers case: the ids of
    a text are then those of its white-space separated words in order, so each
    distinct word is tokenised once per worker and kept in a bounded memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.stand_in = dict(enumerate(byte_symbols()))
        self.word = TwoGenerationCache(self._word)

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        if _VISIBLE.match(word):
            parts = _PARTS.findall(word)
            if len(parts) > 1:  # several pre-tokens, each a word of its own
                return b"".join(map(self.word.__getitem__, parts))
            return self._merged(word)
        text = word.decode()
        if text.isalpha() and text.islower() and unicodedata.is_normalized("NFC", text) and text.lower() == text:
            # One pre-token of lower-case letters: the merges alone.
            return self._merged(word)
        return self._library(text)

    def _merged(self, token: bytes) -> bytes:
        ids = [t.id for t in self.model.tokenize(token.decode("latin-1").translate(self.stand_in))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if "<|" in text:  # may hold a special string: read as a whole
            return self._library(text)
        return b"".join(map(self.word.__getitem__, text.encode().lower().split()))


class Pool:
    """Pieces waiting to be packed. A piece is ``(doc, start, n)`` of a
    document kept in ``docs``; each tier holds its pieces sorted by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (n, doc, start)
        self.tokens = 0

    def add(self, doc: int, start: int, n: int) -> None:
        insort(self.waiting[bisect_left(self.tiers, n)], (n, doc, start))
        self.tokens += n

    def take(self, tier: int, room: int):
        """The longest piece of a tier that fits into ``room``, or None."""
        held = self.waiting[tier]
        at = bisect_right(held, (room, float("inf"), 0)) - 1
        if at < 0:
            return None
        self.tokens -= held[at][0]
        return held.pop(at)

    def cut(self, below: int, room: int):
        """A piece of exactly ``room`` ids, cut from the shortest tier under
        ``below`` that has a longer piece; what remains is routed anew."""
        for tier in range(below + 1):
            held = self.waiting[tier]
            at = bisect_right(held, (room, float("inf"), 0))
            if at < len(held):
                n, doc, start = held.pop(at)
                self.tokens -= n
                self.add(doc, start + room, n - room)
                return room, doc, start
        return None

    def windows(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows ``(tier, pieces)``; pieces of windows that cannot be
        filled go back to wait."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.waiting[tier]:
                room, pieces = size, []
                while room:
                    # Largest piece that fits, from the own tier, then from shorter ones.
                    piece = next((p for t in range(tier, -1, -1) if (p := self.take(t, room))), None) or self.cut(tier, room)
                    if piece is None:
                        break
                    pieces.append(piece)
                    room -= piece[0]
                if room:
                    for n, doc, start in pieces:
                        self.add(doc, start, n)
                    break
                yield tier, pieces

    def rest(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """All that waits, longest first, cut at the long window's end."""
        size, room, pieces = self.tiers[-1], self.tiers[-1], []
        for held in reversed(self.waiting):
            for n, doc, start in reversed(held):
                while n:
                    part = min(n, room)
                    pieces.append((part, doc, start))
                    start, n, room = start + part, n - part, room - part
                    if not room:
                        yield len(self.tiers) - 1, pieces
                        room, pieces = size, []
        if pieces:
            yield len(self.tiers) - 1, pieces


def _balanced(windows: list, tiers: tuple[int, ...], step_tokens: int) -> list[tuple[int, int, list]]:
    """``(step, tier, pieces)``: windows of a tier in snake order of cost."""
    out, first = [], 0
    for tier, size in enumerate(tiers):
        own = sorted((w for t, w in windows if t == tier), key=lambda w: -sum(n * n for n, _, _ in w))
        groups = -(-len(own) // max(1, step_tokens // size))
        for k, w in enumerate(own):
            turn, at = divmod(k, groups)
            out.append((first + (groups - 1 - at if turn % 2 else at), tier, w))
        first += groups
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS,
                   pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids, doc_tokens,
    sequence_id, offset, tier, step_group)``; ``ids`` are little-endian
    unsigned 32-bit."""
    longest, end = tiers[-1], struct.pack("<I", end_id)

    def pack(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = worker_state(("packing", tokenizer_path), lambda: Encoder(tokenizer_path)).ids
        part = TaskContext.get().partitionId() << 36
        pool, docs, sequence, step, full = Pool(tiers), {}, 0, 0, []

        def emit(windows):
            nonlocal sequence, step
            last = -1
            for group, tier, pieces in _balanced(windows, tiers, step_tokens):
                offset = 0
                for n, doc, start in pieces:
                    doc_id, ids, left = docs[doc]
                    yield (doc_id, start, n, ids[4 * start:4 * (start + n)], len(ids) // 4, part + sequence, offset,
                           tiers[tier], part + step + group)
                    offset += n
                    if left == n:
                        del docs[doc]  # all its ids are placed
                    else:
                        docs[doc] = (doc_id, ids, left - n)
                sequence += 1
                last = max(last, group)
            step += last + 1

        for k, (doc_id, text) in enumerate(rows):
            ids = encode(text) + end
            n = len(ids) // 4
            docs[k] = (doc_id, ids, n)
            whole = n - n % longest
            full += [(len(tiers) - 1, [(longest, k, s)]) for s in range(0, whole, longest)]
            if n > whole:
                pool.add(k, whole, n - whole)
            if pool.tokens + longest * len(full) >= pool_tokens:
                yield from emit(full + list(pool.windows()))
                full = []
        yield from emit(full + list(pool.windows()) + list(pool.rest()))

    own = texts_of(docs, id_col, text_col)
    kind = dict(own.dtypes)["doc_id"]
    return stream_batches(own, pack, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
                                     "sequence_id bigint, offset bigint, tier int, step_group bigint")


def packing_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The columns of the query ``op6_packing``."""
    return pack_documents(docs, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier",
        "step_group")

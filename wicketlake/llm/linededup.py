"""Operator 5, fuzzy line de-duplication by SimHash.

A line (text between newlines) is normalised to its lower-case words. Lines of
fewer than ``min_words`` words are always kept. Every distinct normalised line
gets a 64-bit SimHash of its distinct words (distinct, as words like "the"
would else make unrelated lines alike).

Candidates are all pairs of SimHashes at most three bits apart, found exactly
by the pigeonhole principle: the 64 bits are cut into ``b`` blocks, three
differing bits leave at least ``b - 3`` blocks equal, and for each choice of
``b - 3`` blocks the SimHashes are grouped by those blocks. ``b`` is the
smallest number for which such a key has at most five bits less than the count
of distinct SimHashes needs, and groups of more than eight are cut by parts of
the other bits; the pairs found are the same for every ``b``. Inside a group a search over the unvisited
SimHashes emits a spanning forest, never all pairs; a very large group is cut
by the same principle again.

Few pairs at an edit similarity of 0.8 are so near in bits (about 13 bits are
expected to differ). With ``wide``, lines therefore also meet at places: a line
of 8 words and more at the runs of three words that follow its 12 anchors, the
words of least hash under 12 hashes (two lines with a fifth of the words
changed have a given run in common with a chance of about 0.43), a line of up
to 9 words at what is left when any one word is taken out (exact, as one edit
is allowed there). Lines that share a run, differ in at most 24 bits and may be
similar are candidates. Whether they may be is read off their numbers of words
and 256 marks, a bit for each word and how many times the line had it before: a
bit that only one line has is a word of its own, of which it has no more than
edits are allowed. So the pairs that cannot hold, most of them, are no edges.
Groups of more than 20,000 are cut into blocks and searched by pairs of blocks.

Forest edges, and edges from each line to the first line of its SimHash, are
verified: edit similarity over words, one minus edits by the longer length,
must reach ``min_similarity``. Where all edges of a candidate component hold,
it is a group; where some fail, they are dropped and the component's lines are
joined anew: lines that share a quarter of the SimHash bits meet in leaves of
bounded size, and pairs that no edge has joined yet are verified. Of each connected group one occurrence stays: the first by document id,
then line number. The others are cut out of their documents.

Scale. One pass over the texts gives keys, marks and places of about 120 bytes
per line. Places move as bytes, 16 for each; the six of seven that one SimHash
has alone go before the rest is joined with the marks. The texts of candidate
lines are fetched by a second pass over the documents that hold them, and the
third pass cuts lines out. A repeated line, however frequent, is one row after
a partial aggregate. Ids of the documents that hold candidates
are broadcast up to four million, the line numbers to cut up to a million;
beyond that the same joins shuffle the texts. Components with failed edges are
cut into leaves of about a thousand lines or 4 MB, which are tasks of their
own and get their words in up to eight rounds, so that an eighth of these words
is on disk at once; lines with the same words in other orders stay quadratic in number, spread
over pairs of blocks.

Defined results: a null text stays null and a null id drops nothing; an empty
text stays; documents with equal ids are ordered by text and none of their
lines is told apart by more than id and line number, so equal lines at equal
places of such rows stay or go together; documents whose lines are all cut
stay with an empty text; other columns pass through unchanged; an empty table
gives an empty result. Keys are 64 bits: among n distinct lines about
n^2 / 2^65 pairs share one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import (BROADCAST_IDS, BROADCAST_ROWS, TwoGenerationCache, discard, map_batches, passing_tables, small, stream_batches,
                                   worker_state, written)
from wicketlake.llm.components import connected_components

MAX_BITS = 3
#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 20
#: Base of the polynomial word hash and multiplier of a line's word places (odd numbers).
_BASE, _PLACE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_MASK = (1 << 64) - 1
#: Words of a run, anchors of a line, most bits apart of lines that share a run, and from which number of words lines
#: have runs and up to which they have deletions (at most one edit is allowed there).
RUN, ANCHORS, RUN_BITS, RUN_FROM, DELETE_TO = 3, 12, 24, 8, 9
#: Lines that share a run and are compared in one place.
RUN_GROUP = 20_000
#: Numbers of 64 bits that mark the words of a line, and their columns.
MARKS = 4
MARK_NAMES = [f"mark{k}" for k in range(MARKS)]
#: Rows that a task sorts by itself, of two numbers each, and lines up to which a group is searched together with others.
SORT_ROWS, SHIFTED = 2_000_000, 64
#: Words up to which edits are counted by bits: a bit for each word and distinct word, 50 MB at most.
BITS_TO = 20_000
#: Bytes and number of the lines that are compared with each other in one place.
LEAF_BYTES, LEAF_LINES = 4 << 20, 1000
#: Rounds in which the words of lines are dealt to their leaves, and rows of a round at least: a round's words lie on
#: disk at once, so many rounds take that part of the space.
ROUNDS, ROUND_ROWS = 8, 25_000
#: Masks of the four quarters of a SimHash, as signed 64-bit numbers.
QUARTERS = (0xFFFF, 0xFFFF << 16, 0xFFFF << 32, -(1 << 48))

# Non-ASCII characters that separate words; every other one is part of a word.
_SEPARATORS = "\u00a0«»¡¿·‐‑‒–—―‘’‚“”„•…\u2028\u2029\u3000、。"
_WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")


def normalised(text: str) -> bytes:
    """Lower case, non-ASCII separators as spaces, UTF-8. Lines keep their
    number; words are runs of ASCII letters, digits, ``_`` and other
    non-ASCII characters."""
    text = text.lower()
    if not text.isascii():
        for c in _SEPARATORS:
            if c in text:
                text = text.replace(c, " ")
    return text.encode()


def _mixed(x):
    """A 64-bit finaliser over a uint64 array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Keys and SimHashes of the lines of a text, over whole arrays of bytes.

    A word's hash is a polynomial of its bytes, read off the running sums of
    the text. A line's key is a hash of its word hashes in order. Its SimHash
    votes with the distinct words: their 64 hash bits are 64 bytes of 0 or 1,
    read as eight 64-bit numbers, so that up to 255 of them add up bytewise
    without a carry."""

    def __init__(self):
        import numpy as np

        self.powers = {}
        self.task, self.given = None, None
        self.is_word = np.zeros(256, dtype=bool)
        self.is_word[[b for b in range(256) if _WORD.match(bytes([b]))]] = True

    def _powers(self, base: int, n: int):
        """``base`` to the powers 0 to n - 1, modulo 2^64; kept and grown."""
        import numpy as np

        have = self.powers.get(base)
        if have is None or len(have) < n:
            steps = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=np.uint64)
            steps[0] = 1
            have = self.powers[base] = np.cumprod(steps)
        return have[:n]

    def lines(self, data: bytes, min_words: int, wide: bool = False):
        """``(number, key, simhash)`` arrays of the lines with enough words;
        with ``wide`` also their numbers of words, their marks, and the places
        at which they meet, as ``(line, place)`` arrays sorted by line."""
        import numpy as np

        text = np.frombuffer(data, dtype=np.uint8)
        inside = np.concatenate([[False], self.is_word[text], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        line = np.searchsorted(np.flatnonzero(text == 10), starts)
        counts = np.bincount(line) if len(line) else np.zeros(0, dtype=np.int64)
        numbers = np.flatnonzero(counts >= min_words)
        empty = np.zeros(0, dtype=np.int64)
        if not len(numbers):
            return (empty, empty, empty, empty, np.zeros((0, MARKS), np.int64), (empty, empty)) if wide else (empty, empty, empty)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * self._powers(_BASE, len(text)))])
        wanted = counts[line] >= min_words
        starts, ends = starts[wanted], ends[wanted]
        inverse = self._powers(pow(_BASE, -1, 1 << 64), len(text))
        words = _mixed((sums[ends] - sums[starts]) * inverse[starts])

        n = counts[numbers]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        place = np.arange(len(words)) - np.repeat(first, n)
        terms = words * self._powers(_PLACE, int(n.max()))[place]
        keys = _mixed(np.add.reduceat(terms, first) + n.astype(np.uint64))

        # Distinct words of each line: sorted by line and 40 bits of the hash.
        ranked = np.sort(np.repeat(np.arange(len(numbers), dtype=np.uint64), n) << np.uint64(40) | words >> np.uint64(24))
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        marks = self._marks(ranked, fresh, len(numbers)) if wide else None
        ranked = ranked[fresh]
        sizes = np.bincount((ranked >> np.uint64(40)).astype(np.int64), minlength=len(numbers))
        votes = _mixed((ranked & np.uint64((1 << 40) - 1)) + np.uint64(_BASE))
        found = numbers, keys.view(np.int64), self._vote(votes, sizes)
        return (*found, n, marks, self._meeting_places(words, terms, first, n)) if wide else found

    def _marks(self, ranked, fresh, lines: int):
        """A bit, of ``MARKS`` times 64, for each word of a line and how many
        times the line had it before, from the words sorted by line and hash."""
        import numpy as np

        at = np.flatnonzero(fresh)
        nth = np.arange(len(ranked)) - np.repeat(at, np.diff(np.append(at, len(ranked))))
        bit = _mixed((ranked & np.uint64((1 << 40) - 1)) * np.uint64(_PLACE) + nth.astype(np.uint64)) % np.uint64(64 * MARKS)
        held = np.zeros((lines, 64 * MARKS), dtype=bool)
        held[(ranked >> np.uint64(40)).astype(np.int64), bit.astype(np.int64)] = True
        return np.packbits(held, axis=1).view(np.int64)

    def _meeting_places(self, words, terms, first, n):
        """Long lines meet by runs of words after their anchors, the words of
        least hash under several hashes; short ones by what is left when a word
        is taken out. The lowest bit of a place is set for the latter."""
        import numpy as np

        at = np.arange(len(words)) + 1
        at[first + n - 1] = first  # the first word follows the last one
        run, follower = words.copy(), at
        for k in range(1, RUN):
            run += words[follower] * np.uint64(pow(_BASE, k, 1 << 64))
            follower = at[follower]
        run = _mixed(run) & ~np.uint64(1)
        chosen = np.empty((len(n), ANCHORS), dtype=np.uint64)
        for k in range(ANCHORS):
            ranked = words * np.uint64(pow(_PLACE, 2 * k + 1, 1 << 64))
            least = np.repeat(np.minimum.reduceat(ranked, first), n)
            chosen[:, k] = np.minimum.reduceat(np.where(ranked == least, run, np.uint64(_MASK)), first)
        chosen.sort(axis=1)
        fresh = np.concatenate([np.ones((len(n), 1), bool), chosen[:, 1:] != chosen[:, :-1]], axis=1) & (n >= RUN_FROM)[:, None]
        line, _ = np.nonzero(fresh)

        short = np.flatnonzero(n <= DELETE_TO)
        of = np.repeat(np.arange(len(n)), n)
        word = np.flatnonzero((n <= DELETE_TO)[of])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        begin, end = first[of[word]], (first + n)[of[word]]
        rest = (sums[word] - sums[begin]) + (sums[end] - sums[word + 1]) * np.uint64(pow(_PLACE, -1, 1 << 64))
        whole = sums[(first + n)[short]] - sums[first[short]]
        left = _mixed(np.concatenate([rest + (n[of[word]] - 1).astype(np.uint64), whole + n[short].astype(np.uint64)]) ^ np.uint64(_BASE))
        lines = np.concatenate([line, of[word], short])
        order = np.argsort(lines, kind="stable")
        return lines[order], np.concatenate([chosen[fresh], left | np.uint64(1)])[order].view(np.int64)

    def _vote(self, votes, sizes):
        """SimHashes of groups of so many votes each."""
        import numpy as np

        begin = np.concatenate([[0], np.cumsum(sizes)])
        out, line = np.empty(len(sizes), dtype=np.int64), 0
        while line < len(sizes):
            stop = max(line + 1, int(np.searchsorted(begin, begin[line] + 100_000, side="right")) - 1)
            own = votes[begin[line]:begin[stop]]
            lanes = np.unpackbits(own.view(np.uint8)).reshape(-1, 64).view(np.uint64)
            pieces = -(-sizes[line:stop] // 255)
            which = np.repeat(np.arange(stop - line), pieces)
            nth = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
            sums = np.add.reduceat(lanes, begin[line:stop][which] - begin[line] + 255 * nth, axis=0).view(np.uint8).astype(np.int64)
            if len(which) > stop - line:
                sums = np.add.reduceat(sums, np.flatnonzero(nth == 0), axis=0)
            bits = 2 * sums > sizes[line:stop, None]
            out[line:stop] = np.packbits(bits, axis=1).view(">i8").reshape(-1)
            line = stop
        return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, int, bytes]]:
    """``(row, first line, bytes)``: texts, long ones cut at line ends."""
    for row, text in enumerate(texts):
        data, line = normalised(text), 0
        while len(data) > CHUNK:
            cut = data.rfind(b"\n", 0, CHUNK)
            cut = data.find(b"\n", CHUNK) if cut < 0 else cut
            if cut < 0:
                break
            yield row, line, data[:cut]
            line += data.count(b"\n", 0, cut) + 1
            data = data[cut + 1:]
        yield row, line, data


def _chunks(texts: list[str]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces of a batch, gathered up to ``CHUNK`` bytes."""
    held, size = [], 0
    for piece in _pieces(texts):
        if held and size + len(piece[2]) > CHUNK:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield held


def _lines(columns: list[list], min_words: int, wide: bool = False) -> list:
    """``(doc_id, line, line_key, sim)`` of all lines of a batch, in chunks of
    joined texts; with ``wide`` also ``(length, mark0, .., places)``. Lines that
    a task has given already get no places again, as far as a bounded memory
    reaches."""
    import numpy as np

    sketcher = worker_state("linededup", Sketcher)
    if wide and sketcher.task != (task := TaskContext.get().taskAttemptId()):
        sketcher.task, sketcher.given = task, TwoGenerationCache(lambda key: True, 100_000)
    ids, texts = columns
    parts = []
    for held in _chunks(texts):
        number, key, sim, *more = sketcher.lines(b"\n".join(d for _, _, d in held), min_words, wide)
        begin = np.cumsum([0] + [d.count(b"\n") + 1 for _, _, d in held])
        piece = np.searchsorted(begin, number, side="right") - 1
        part = [np.array([r for r, _, _ in held])[piece], number - begin[piece] + np.array([n for _, n, _ in held])[piece], key, sim]
        if wide:
            length, marks, (line, place) = more
            fresh = np.zeros(len(key), bool)
            for k, x in enumerate(key.tolist()):
                if x not in sketcher.given:
                    sketcher.given[x]
                    fresh[k] = True
            wanted = fresh[line]
            part += [length, *marks.T, np.bincount(line[wanted], minlength=len(key)), place[wanted]]
        parts.append(part)
    row, *rest = [np.concatenate(x) for x in zip(*parts)]
    out = [pa.array(ids).take(pa.array(row)), *map(pa.array, rest[:3])]
    if not wide:
        return out
    *kept, counts, places = rest[3:]
    ends = np.concatenate([[0], np.cumsum(8 * counts)]).astype(np.int32)
    return [*out, *map(pa.array, kept), pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(places))])]


def _spread(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """``(part, rows)`` of the lines ``(sim, places)``: places and SimHashes as
    bytes, dealt to ``parts`` by place. Spark moves them as a few rows then."""
    import numpy as np

    def dealt(held):
        at, sim = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        part = (_mixed(at.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        begins, ends = _groups(part[order])
        rows = np.stack([at[order], sim[order]], axis=1)
        for k in range(0, len(begins), 200):
            own = list(zip(begins[k:k + 200], ends[k:k + 200]))
            yield pa.RecordBatch.from_arrays([pa.array(part[order[begins[k:k + 200]]]), pa.array([rows[x:y].tobytes() for x, y in own], pa.binary())], names=["part", "rows"])

    held, n = [], 0
    for batch in batches:
        sims, places = batch.columns
        ends = np.frombuffer(places.buffers()[1], np.int32)[places.offset:places.offset + len(places) + 1] if len(places) else np.zeros(1, np.int32)
        if ends[-1] > ends[0]:
            at = np.frombuffer(places.buffers()[2], np.uint8)[ends[0]:ends[-1]].copy().view(np.int64)
            held.append((at, np.repeat(sims.to_numpy(), np.diff(ends) // 8)))
            n += len(at)
        if n > SORT_ROWS:
            yield from dealt(held)
            held, n = [], 0
    if held:
        yield from dealt(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows ``(at, sim)`` of a partition of ``(part, rows)``, each once,
    whose place two SimHashes or more have: about one in seven."""
    import numpy as np

    def once(held):
        at, sim = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.lexsort((sim, at))
        at, sim = at[order], sim[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (sim[1:] != sim[:-1])
        return at[fresh], sim[fresh]

    held, rows, most = [], 0, SORT_ROWS
    for batch in batches:
        held += [np.frombuffer(x, np.int64).reshape(-1, 2).T for x in batch.column(1).to_pylist()]
        rows = sum(len(x[0]) for x in held)
        if rows > most:
            held = [once(held)]
            rows = len(held[0][0])
            most = max(most, 2 * rows)
    if rows:
        at, sim = once(held)
        same = at[1:] == at[:-1]
        met = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at, sim = at[met], sim[met]
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k:k + 100_000]), pa.array(sim[k:k + 100_000])], names=["at", "sim"])


def _meet(columns: list[list]) -> list:
    """``(line_key, component, joined, sim, bytes, place)`` of the places of
    lines that are given by their words."""
    import numpy as np

    words = columns[-1]
    *_, (line, place) = worker_state("linededup", Sketcher).lines(b"\n".join(words), 1, True)
    sizes = [len(w) for w in words]
    return [pa.array(np.array(c, dtype=np.int64)[line]) for c in (*columns[:-1], sizes)] + [pa.array(place)]


def block_masks(distinct: int) -> list[int]:
    """Masks of the equal blocks, as signed 64-bit numbers, for a corpus of so
    many distinct SimHashes."""
    need = max(1, distinct).bit_length() - 5
    b = next((b for b in range(MAX_BITS + 1, 17) if (64 // b) * (b - MAX_BITS) >= need), 16)
    edges = [round(64 * k / b) for k in range(b + 1)]
    blocks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(b)]
    masks = [sum(c) for c in combinations(blocks, b - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_forest(sims) -> list[tuple[int, int]]:
    """Edges that span the components of distinct SimHashes (uint64) at most
    three bits apart."""
    import numpy as np

    if len(sims) <= 4096:
        return _search(sims)
    # Three bits leave one of four parts of the varying bits equal.
    varying = int(np.bitwise_or.reduce(sims ^ sims[0]))
    places = [1 << k for k in range(64) if varying >> k & 1]
    edges = []
    for quarter in range(4):
        part = sims & np.uint64(sum(places[quarter::4]))
        order = np.argsort(part, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(same) > 1:
                edges += near_forest(sims[same])
    return edges


def _search(sims) -> list[tuple[int, int]]:
    import numpy as np

    edges, left = [], sims
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(left ^ u) <= MAX_BITS
            if near.any():
                found = left[near]
                edges += [(int(u), int(v)) for v in found]
                queue += list(found)
                left = left[~near]
    return edges


def spanning(a, b, n: int):
    """Which of the edges ``(a[k], b[k])`` among ``n`` nodes span the same
    components, the least forest by the order of the edges (Boruvka), and the
    component of each node."""
    import numpy as np

    chosen, label, rest = np.zeros(len(a), bool), np.arange(n), np.arange(len(a))
    while True:
        x, y = label[a[rest]], label[b[rest]]
        apart = x != y
        rest, x, y = rest[apart], x[apart], y[apart]
        if not len(rest):
            return chosen, label
        least = np.full(n, len(a))
        np.minimum.at(least, x, rest)
        np.minimum.at(least, y, rest)
        roots = np.flatnonzero(least < len(a))
        own = least[roots]
        chosen[own] = True
        # Every component follows its least edge; of two that follow the same one, the smaller stays.
        other = np.where(label[a[own]] == roots, label[b[own]], label[a[own]])
        up = np.arange(n)
        up[roots] = other
        both = roots[(up[other] == roots) & (roots < other)]
        up[both] = both
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _groups(keys):
    """Begin and end of each run of equal ``keys``."""
    import numpy as np

    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    return cuts[:-1], cuts[1:]


def _pairs_in_small(begins, ends, sims, bits):
    """Pairs of rows ``(i, j)``, i before j, of the groups of up to
    ``SHIFTED`` rows whose SimHashes are at most ``bits[i]`` apart: each row is
    compared with the one so many places further on, for all groups at once."""
    import numpy as np

    sizes = ends - begins
    left = np.repeat(np.where(sizes > SHIFTED, 0, ends), sizes) - np.arange(len(sims))  # rows from here to the end of the group
    rows, found, step = np.flatnonzero(left > 1), [], 1
    while len(rows):
        if len(rows) > len(sims) // 4:  # most rows: whole arrays, without picking
            i = np.flatnonzero((np.bitwise_count(sims[step:] ^ sims[:-step]) <= bits[:-step]) & (left[:-step] > step))
        else:
            i = rows[np.bitwise_count(sims[rows + step] ^ sims[rows]) <= bits[rows]]
        found.append((i, i + step))
        step += 1
        rows = rows[left[rows] > step]
    return [np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]


def _pairs_in_large(begin: int, end: int, sims, bits):
    """The same in one group, a bounded number of pairs at a time."""
    import numpy as np

    at, step = begin, max(1, 1_000_000 // (end - begin))
    while at < end - 1:
        i, j = np.nonzero(np.bitwise_count(sims[at:at + step, None] ^ sims[None, at + 1:end]) <= bits[at:at + step, None])
        yield (i + at)[j >= i], (j + at + 1)[j >= i]
        at += step


def _forest(begins, ends, sims, bits, near=None):
    """Edges ``(i, j)`` between rows that span, in each group, the components
    of the rows whose SimHashes are at most ``bits`` apart and for which
    ``near`` holds, as arrays."""
    import numpy as np

    def kept(i, j):
        ok = near(i, j) if near else slice(None)
        return i[ok], j[ok]

    i, j = kept(*_pairs_in_small(begins, ends, sims, bits))
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    chosen, _ = spanning(i, j, len(sims))
    edges = [(i[chosen], j[chosen])]
    for k in np.flatnonzero(ends - begins > SHIFTED):
        begin, end = begins[k], ends[k]
        label = np.arange(end - begin)
        for i, j in _pairs_in_large(begin, end, sims, bits):
            apart = label[i - begin] != label[j - begin]
            i, j = kept(i[apart], j[apart])
            chosen, joined = spanning(label[i - begin], label[j - begin], len(label))
            edges.append((i[chosen], j[chosen]))
            label = joined[label]
    return [np.concatenate([x[k] for x in edges]) for k in (0, 1)]


def _block_edges(batches: Iterator[pa.RecordBatch], masks: list[int]) -> Iterator[pa.RecordBatch]:
    """Forest edges of every block's group, from ``(choice, sim)`` with all
    rows of a block in this partition."""
    import numpy as np

    held = [tuple(c.to_numpy() for c in batch.columns) for batch in batches if batch.num_rows]
    if not held:
        return
    choice, sims = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    # One number for choice and block; two blocks that met in it would only be searched together.
    keys = _mixed((sims & np.array(masks, dtype=np.int64)[choice]).view(np.uint64) + choice.astype(np.uint64) * np.uint64(_PLACE))
    sims = sims.view(np.uint64)

    def edges(keys, sims, most):
        """Edges of the groups of up to ``most`` rows, and which rows are in larger ones."""
        order = np.argsort(keys)
        keys, sims = keys[order], sims[order]
        begins, ends = _groups(keys)
        few = np.repeat(ends - begins <= most, ends - begins)
        a, b = _forest(*_groups(keys[few]), sims[few], np.full(few.sum(), MAX_BITS)) if few.any() else (np.zeros(0, np.int64),) * 2
        return sims[few][a], sims[few][b], order[~few]

    a, b, rest = edges(keys, sims, 8)
    found = [(a, b)]
    # In a large group, three bits leave one of four parts of the other bits equal.
    keys, sims, choice = keys[rest], sims[rest], choice[rest]
    others = [[k for k in range(64) if not mask >> k & 1] for mask in masks]
    for quarter in range(4) if len(rest) else ():
        part = sims & np.array([sum(1 << k for k in places[quarter::4]) for places in others], dtype=np.uint64)[choice]
        finer = _mixed(keys + _mixed(part + np.uint64(quarter)))
        a, b, large = edges(finer, sims, 4096)
        found.append((a, b))
        large = large[np.argsort(finer[large], kind="stable")]
        for x, y in zip(*_groups(finer[large])) if len(large) else ():
            if near := near_forest(np.unique(sims[large[x:y]])):
                found.append(tuple(np.array(c, dtype=np.uint64) for c in zip(*near)))
    yield _edge_batch(*(np.concatenate(c).view(np.int64) for c in zip(*found)))


def _edge_batch(*columns) -> pa.RecordBatch:
    """``(a, b)``, or ``(a, b, at)`` in which a column of None is null."""
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in columns], names=["a", "b", "at"][:len(columns)])


def _run_edges(batches: Iterator[pa.RecordBatch], share: float, most: int | None) -> Iterator[pa.RecordBatch]:
    """Forest edges ``(a, b)`` of the lines at each place, from ``(at,
    line_key, sim, length, mark0, ..)`` sorted by the first two. A group of more
    than ``most`` is given back as rows ``(line_key, null, at)``."""
    import numpy as np

    def edges(places, keys, sims, lengths, *marks):
        sims, *marks = (c.view(np.uint64) for c in (sims, *marks))  # bits of signed numbers are counted without their sign
        begins, ends = _groups(places)
        if most:
            for begin, end in zip(begins, ends) if len(places) > most else ():
                if end - begin > most:
                    yield _edge_batch(keys[begin:end], None, places[begin:end])
            few = np.repeat(ends - begins <= most, ends - begins)
            if not few.all():
                places, keys, sims, lengths, *marks = (c[few] for c in (places, keys, sims, lengths, *marks))
                begins, ends = _groups(places)
        if len(places):
            a, b = _forest(begins, ends, sims, np.where(places & 1, 64, RUN_BITS), lambda i, j: may_be_similar(i, j, lengths, marks, share))
            if len(a):
                yield _edge_batch(keys[a], keys[b], None)

    held = None
    for rows in batches:
        if not rows.num_rows:
            continue
        rows = [c.to_numpy() for c in rows.columns]
        fresh = np.ones(len(rows[0]), bool)
        fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [c[fresh] for c in rows]
        if held is not None:
            if held[0][-1] == rows[0][0] and held[1][-1] == rows[1][0]:
                rows = [c[1:] for c in rows]
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))  # it may go on in the next batch
        if last:
            yield from edges(*(c[:last] for c in rows))
        held = [c[last:] for c in rows]
    if held is not None:
        yield from edges(*held)


def may_be_similar(i, j, lengths, marks: list, share: float):
    """Of which pairs of rows ``(i, j)`` the lengths and marks allow the
    similarity: an edit takes one word of a line away at most, so neither has
    more words of its own than edits; a bit that only one line has is a word
    that only this line has."""
    import numpy as np

    limits = edits_allowed(np.maximum(lengths[i], lengths[j]), share)
    ok = np.flatnonzero(np.abs(lengths[i] - lengths[j]) <= limits)
    i, j, limits = i[ok], j[ok], limits[ok]
    for part in np.array_split(np.arange(len(ok)), len(ok) // 200_000 + 1):
        own = sum(np.bitwise_count(m[i[part]] & ~m[j[part]]).astype(np.int64) for m in marks)
        other = sum(np.bitwise_count(m[j[part]] & ~m[i[part]]).astype(np.int64) for m in marks)
        ok[part] = np.where(np.maximum(own, other) <= limits[part], ok[part], -1)
    return ok[ok >= 0]


def run_forest(meets: DataFrame, keys: DataFrame, min_similarity: float, group: int = RUN_GROUP) -> DataFrame:
    """Edges ``(a, b)`` that span, at each place of ``meets (at, sim)``, the
    components of the lines of these SimHashes that are at most ``RUN_BITS``
    apart and whose lengths and marks in ``keys (line_key, sim, length, mark0,
    ..)`` allow the similarity. Groups of more than ``group`` are cut into
    blocks, and each pair of blocks is searched."""
    columns = ["line_key", "sim", "length", *MARK_NAMES]

    def searched(df, most):
        dealt = df.select("at", *columns).repartition("at").sortWithinPartitions("at", "line_key")
        return dealt.mapInArrow(lambda batches: _run_edges(batches, min_similarity, most), "a bigint, b bigint, at bigint")

    found = written(searched(meets.join(keys.select(columns), "sim"), group), "line-runs")
    edges, heavy = found.filter("b is not null").select("a", "b"), found.filter("b is null").select("at", F.col("a").alias("line_key"))
    if heavy.isEmpty():
        return edges
    parts = heavy.groupBy("at").agg(F.ceil(F.count("*") * 2 / group).cast("int").alias("parts"))
    cut = (heavy.join(parts, "at").withColumn("block", F.pmod(F.xxhash64("line_key", F.lit(7)), F.col("parts")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    # The lowest bit says which bound holds at a place.
    region = F.xxhash64("at", F.least("block", "other"), F.greatest("block", "other")).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("at").bitwiseAND(F.lit(1)))
    return edges.unionByName(searched(cut.select(region.alias("at"), "line_key").join(keys.select(columns), "line_key"), None).select("a", "b"))


def too_many_own(a: frozenset, b: frozenset, limit: int) -> bool:
    """Whether one of the sets of words has more than ``limit`` words of its
    own. An edit takes one word away at most, and brings in one at most, so
    lists of these words are more than ``limit`` edits apart then."""
    return len(a) > limit + len(b) or len(b) > limit + len(a) or len(a) - (both := len(a & b)) > limit or len(b) - both > limit


def within_edits(a: list, b: list, limit: int) -> bool:
    """Whether at most ``limit`` insertions, deletions and substitutions turn
    one list into the other: the distance by columns of bits (Myers) after
    the common ends are taken off."""
    if abs(len(a) - len(b)) > limit:
        return False
    low, n = 0, min(len(a), len(b))
    while low < n and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low:len(a) - high], b[low:len(b) - high]
    if not a or not b:
        return max(len(a), len(b)) <= limit
    if too_many_own(frozenset(a), frozenset(b), limit):
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) > BITS_TO:
        return _within_edits_by_diagonals(a, b, limit)
    # A column of the distance table at a time: which entries are one more, which one less than the entry above.
    places, mask, last = {}, (1 << len(a)) - 1, 1 << len(a) - 1
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    more, less, score, left = mask, 0, len(a), len(b)
    for w in b:
        equal, left = places.get(w, 0), left - 1
        level = ((equal & more) + more ^ more) | equal
        up, down = less | mask & ~(level | more), more & level
        score += bool(up & last) - bool(down & last)
        if score - left > limit:
            return False
        up = up << 1 | 1
        more, less = (down << 1 | ~(equal | less | up)) & mask, up & (equal | less) & mask
    return score <= limit


def _within_edits_by_diagonals(a: list, b: list, limit: int) -> bool:
    """The same by the furthest reach per diagonal, in memory of the limit."""
    goal, far = len(b) - len(a), {}
    for edits in range(limit + 1):
        reach = {}
        for k in range(-edits, edits + 1):
            i = 0 if edits == 0 else max(far.get(k - 1, -9), far.get(k, -9) + 1, far.get(k + 1, -9) + 1)
            if i < 0 or i > len(a) or i + k > len(b) or i + k < 0:
                continue
            while i < len(a) and i + k < len(b) and a[i] == b[i + k]:
                i += 1
            if k == goal and i >= len(a):
                return True
            reach[k] = i
        far = reach
    return False


def edits_allowed(longer, share: float):
    """Edits of two lists at a similarity of ``share``, by the longer length."""
    return (1 - share) * longer + 1e-9


def similar_words(x: list, y: list, share: float) -> bool:
    return within_edits(x, y, int(edits_allowed(max(len(x), len(y)), share)))


def similar(a: bytes, b: bytes, share: float) -> bool:
    return similar_words(a.split(b" "), b.split(b" "), share)


def line_groups(docs: DataFrame, min_words: int, min_similarity: float, wide: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lines (doc_id, line, line_key, sim)`` of every occurrence, ``keys
    (line_key, n)`` of the distinct lines, and ``groups (line_key, group)`` of
    the keys that are in a group of two keys or more."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, line bigint, line_key bigint, sim bigint"
    if wide:
        schema += f", length bigint, {', '.join(f'{m} bigint' for m in MARK_NAMES)}, places binary"
    lines = written(map_batches(docs.select("doc_id", "text"), _lines, schema, min_words, wide), "lines")
    own = ["sim", "length", *MARK_NAMES] if wide else ["sim"]
    distinct = written(lines.groupBy("line_key").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in own]), "line-keys")
    reps = written(distinct.groupBy("sim").agg(F.min("line_key").alias("rep")), "line-sims")

    # Candidate forest over the SimHashes, then over the lines.
    count = reps.count()
    masks = block_masks(count)
    # Only choice and SimHash are shuffled; the block follows from them.
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("choice") + 1)
    chosen = reps.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("choice"), "sim")
    blocks = chosen.repartition(max(parts, len(masks) * count // SORT_ROWS), "choice", F.col("sim").bitwiseAND(mask))
    near = blocks.mapInArrow(lambda batches: _block_edges(batches, masks), "a bigint, b bigint")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rep = lambda s: reps.select(F.col("sim").alias(s), F.col("rep").alias(f"r{s}"))
    across = near.join(rep("a"), "a").join(rep("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    inside = distinct.select("line_key", "sim").join(reps, "sim").filter("line_key <> rep").select(F.col("line_key").alias("a"), F.col("rep").alias("b"))
    edges = across.unionByName(inside)
    if wide:
        # Most places have one line alone; only the others are joined with what tells their lines apart.
        dealt = max(parts, lines.count() * (ANCHORS + 1) // SORT_ROWS)
        spread = lines.select("sim", "places").mapInArrow(lambda batches: _spread(batches, 4 * dealt), "part bigint, rows binary")
        meets = spread.repartition(dealt, "part").mapInArrow(_shared, "at bigint, sim bigint")
        edges = edges.unionByName(run_forest(meets, distinct, min_similarity))
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-edges")

    # Words of the candidate lines, from the documents of their first occurrences.
    ends = written(edges.select(F.explode(F.array("a", "b")).alias("line_key")).distinct(), "line-ends")
    firsts = (lines.select("doc_id", "line", "line_key").join(small(ends), "line_key", "left_semi")
              .groupBy("line_key").agg(F.min(F.struct("doc_id", "line")).alias("first")))
    wanted = written(firsts.groupBy(F.col("first.doc_id").alias("doc_id"))
                     .agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "line_key")).alias("wanted")), "line-wanted")
    if ends.count() <= BROADCAST_ROWS:
        bearers, wanted = docs, F.broadcast(wanted)
    else:
        bearers = docs.join(small(wanted.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi")
    texts = written(map_batches(bearers.join(wanted, "doc_id").select("text", "wanted"), _fetch, "line_key bigint, words binary, length int")
                    .dropDuplicates(["line_key"]), "line-words")
    # Only words of edges that the lengths of their lines allow are shuffled; of the others it is known that they fail.
    size = lambda s: texts.select(F.col("line_key").alias(s), F.col("length").alias(f"n{s}"))
    possible = F.abs(F.col("na") - F.col("nb")) <= F.floor(edits_allowed(F.greatest("na", "nb"), min_similarity))
    sized = edges.join(size("a"), "a").join(size("b"), "b").select("a", "b", F.when(possible, F.col("a")).alias("x"),
                                                                F.when(possible, F.col("b")).alias("y"))
    word = lambda s: texts.select(F.col("line_key").alias(s), F.col("words").alias(f"w{s}"))
    checked = written(map_batches(sized.join(word("x"), "x", "left").join(word("y"), "y", "left").select("a", "b", "wx", "wy"), _verify,
                                  "a bigint, b bigint, holds boolean", min_similarity), "line-links")
    held = checked.filter("holds").select("a", "b")
    groups = connected_components(held, "line-held")
    failed = checked.filter("not holds").select(F.col("a").alias("node"))
    if not failed.isEmpty():
        # Candidate components with a failed edge: every pair three bits apart at most that is not joined yet is verified.
        whole = connected_components(edges, "line-candidates")
        unsure = whole.join(failed.join(whole, "node").select("component").distinct(), "component", "left_semi")
        members = (unsure.join(groups.select("node", F.col("component").alias("joined")), "node", "left")
                   .select(F.col("node").alias("line_key"), "component", F.coalesce("joined", "node").alias("joined"))
                   .join(distinct.drop("n", "length"), "line_key").join(texts, "line_key"))
        unsure = written(members, "line-unsure")
        discard(texts)  # the words that are still wanted are in ``unsure``
        met = written(may_link(leaves(unsure, wide=True), unsure, min_similarity) if wide else leaves(unsure), "line-meetings")
        groups = connected_components(held.unionByName(rejoined_in_rounds(met, unsure, min_similarity)), "line-rejoined")
    return lines, distinct, groups.select(F.col("node").alias("line_key"), F.col("component").alias("group"))


def leaves(members: DataFrame, leaf_bytes: int = LEAF_BYTES, leaf_lines: int = LEAF_LINES, wide: bool = False) -> DataFrame:
    """Places ``(line_key, region, part, block, own, joined, sim)`` at
    which ``members (line_key, component, joined, sim, words)`` meet that are
    not in one group ``joined`` yet: by each quarter of their SimHashes, with
    ``wide`` by their places (parts 4 and 5), and where such a group exceeds a
    leaf, its lines are cut into blocks and the pairs of blocks are leaves."""
    quarter = F.element_at(F.array(*[F.lit(m) for m in QUARTERS]), F.col("part") + 1)
    bare = members.withColumn("bytes", F.length("words"))
    rows = (bare.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .select("line_key", "joined", "sim", "part", "bytes", F.xxhash64("component", "part", F.col("sim").bitwiseAND(quarter)).alias("at")))
    if wide:
        placed = map_batches(members.select("line_key", "component", "joined", "sim", "words"), _meet,
                             "line_key bigint, component bigint, joined bigint, sim bigint, bytes bigint, place bigint")
        rows = rows.unionByName(placed.select("line_key", "joined", "sim", (F.col("place").bitwiseAND(F.lit(1)) + 4).cast("int").alias("part"),
                                              "bytes", F.xxhash64("component", F.lit(4), "place").alias("at")))
    # Lines of one SimHash meet in the first quarter already.
    sizes = (rows.groupBy("at", "part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("joined").alias("low"),
                                            F.max("joined").alias("high"), F.min("sim").alias("s"), F.max("sim").alias("t"))
             .filter("low <> high and (part = 0 or s <> t)")
             .select("at", F.greatest(F.lit(1), F.ceil(F.col("bytes") * 2 / leaf_bytes), F.ceil(F.col("n") * 2 / leaf_lines)).cast("int").alias("parts")))
    return (rows.join(sizes, "at").withColumn("block", F.pmod(F.xxhash64("line_key", F.lit(7)), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("region", F.xxhash64("at", F.least("block", "other"), F.greatest("block", "other")))
            .select("line_key", "region", "part", "block", (F.col("block") == F.col("other")).alias("own"), "joined", "sim"))


def may_link(met: DataFrame, members: DataFrame, min_similarity: float) -> DataFrame:
    """The rows of ``met`` that lengths and marks allow a link with another
    row of their leaf, by ``members (line_key, length, mark0, ..)``."""
    columns = met.columns
    sketched = met.join(members.select("line_key", "length", *MARK_NAMES), "line_key").select(*columns, "length", *MARK_NAMES)
    dealt = sketched.repartition("region").sortWithinPartitions("region")
    kinds = ", ".join(f"{c} {t}" for c, t in met.dtypes)
    return dealt.mapInArrow(lambda batches: _may_link(batches, columns, min_similarity), kinds)


def _may_link(batches: Iterator[pa.RecordBatch], columns: list[str], share: float) -> Iterator[pa.RecordBatch]:
    import numpy as np

    def linked(table: pa.Table) -> list[pa.RecordBatch]:
        region, part, block, own, joined, sims, lengths = (table[c].to_numpy() for c in ("region", "part", "block", "own", "joined", "sim", "length"))
        sims, marks = sims.view(np.uint64), [table[m].to_numpy().view(np.uint64) for m in MARK_NAMES]
        begins, ends = _groups(region)
        bits = np.where(part < 4, MAX_BITS, np.where(part == 4, RUN_BITS, 64))
        met = np.zeros(len(region), bool)

        def meet(i, j):
            ok = (joined[i] != joined[j]) & (own[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            ok = may_be_similar(i, j, lengths, marks, share)
            met[i[ok]] = met[j[ok]] = True

        meet(*_pairs_in_small(begins, ends, sims, bits))
        for k in np.flatnonzero(ends - begins > SHIFTED):
            for i, j in _pairs_in_large(begins[k], ends[k], sims, bits):
                meet(i, j)
        return table.select(columns).filter(pa.array(met)).combine_chunks().to_batches()

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        region = held["region"].to_numpy()
        last = int(np.argmax(region == region[-1]))  # it may go on in the next batch
        if last:
            yield from linked(held.slice(0, last))
            held = held.slice(last)
    if held is not None:
        yield from linked(held)


def rejoined_in_rounds(met: DataFrame, members: DataFrame, min_similarity: float) -> DataFrame:
    """Verified links ``(a, b)`` that join the groups of all leaves ``met``, a
    share of the leaves at a time: a line's words are shuffled to each of its
    leaves, which for all leaves together is several times the texts. What a
    round shuffled is freed before the next."""
    rounds, links = max(1, min(ROUNDS, met.count() // ROUND_ROWS)), None
    for k in range(rounds):
        dealt = met.filter(F.pmod("region", F.lit(rounds)) == k).join(members.select("line_key", "words"), "line_key").select(
            "region", "part", "block", "own", "line_key", "joined", "sim", "words")
        found = written(rejoined(dealt, min_similarity), "line-again")
        links = found if links is None else links.unionByName(found)
    return links


def rejoined(dealt: DataFrame, min_similarity: float) -> DataFrame:
    """Verified links ``(a, b)`` that join the groups of every leaf."""
    def pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, leaf in groupby(rows, lambda r: r[:1]):
            yield from _pairs(list(leaf), min_similarity)

    return stream_batches(dealt.repartition("region").sortWithinPartitions("region", "line_key"), pairs, "a bigint, b bigint")


def _pairs(leaf: list, share: float) -> Iterator[tuple]:
    """Verified links that join the groups of a leaf, from rows ``(region,
    part, block, own, line_key, joined, sim, words)``. In a leaf of two blocks
    only lines of different blocks are compared."""
    import numpy as np

    part, own = leaf[0][1], leaf[0][3]
    sims = np.array([r[6] for r in leaf], dtype=np.int64).view(np.uint64)
    block, joined = np.array([r[2] for r in leaf]), np.array([r[5] for r in leaf], dtype=np.int64)
    words = [r[7].split(b" ") for r in leaf]
    lengths = np.array([len(w) for w in words])
    held = cache(lambda k: frozenset(words[k]))
    for u in range(len(leaf) - 1):
        bits = sims[u + 1:] ^ sims[u]
        apart = np.bitwise_count(bits)
        near = joined[u + 1:] != joined[u]
        near &= apart <= MAX_BITS if part < 4 else (apart > MAX_BITS) & (apart <= (RUN_BITS if part == 4 else 64))
        for earlier in QUARTERS[:part] if part < 4 else ():  # pairs that meet in an earlier quarter are compared there
            near &= (bits & np.uint64(earlier & _MASK)) != 0
        if not own:
            near &= block[u + 1:] != block[u]
        limits = edits_allowed(np.maximum(lengths[u + 1:], lengths[u]), share).astype(np.int64)
        near &= np.abs(lengths[u + 1:] - lengths[u]) <= limits
        for v in np.flatnonzero(near) + u + 1:
            limit = int(limits[v - u - 1])
            if joined[v] != joined[u] and not too_many_own(held(u), held(int(v)), limit) and within_edits(words[u], words[v], limit):
                yield leaf[u][4], leaf[v][4]
                joined[joined == joined[v]] = joined[u]


def _fetch(columns: list[list]) -> list[list]:
    keys, words, lengths = [], [], []
    for text, wanted in zip(*columns):
        lines = normalised(text).split(b"\n")
        for w in wanted:
            if w["line"] < len(lines):
                found = _WORD.findall(lines[w["line"]])
                keys.append(w["line_key"])
                words.append(b" ".join(found))
                lengths.append(len(found))
    return [keys, words, lengths]


def _verify(columns: list[list], share: float) -> list[list]:
    """Edges without words are known to fail."""
    a, b, wa, wb = columns
    return [a, b, [x is not None and similar(x, y, share) for x, y in zip(wa, wb)]]


def dropped_lines(docs: DataFrame, min_words: int = 5, min_similarity: float = 0.8, wide: bool = False) -> DataFrame:
    """``(doc_id, dropped)``: the line numbers to cut, for the documents that
    lose any. ``docs`` is ``(doc_id, text)`` without nulls."""
    with passing_tables() as keep:
        return keep(_dropped_lines(*line_groups(docs, min_words, min_similarity, wide)))


def _dropped_lines(lines: DataFrame, keys: DataFrame, groups: DataFrame) -> DataFrame:
    # Of keys that are repeated or grouped, the first occurrence of each group stays.
    doomed = keys.join(small(groups), "line_key", "left").filter("n > 1 or group is not null").select("line_key", F.coalesce("group", "line_key").alias("group"))
    held = lines.select("doc_id", "line", "line_key").join(small(written(doomed, "lines-doomed")), "line_key").select("doc_id", "line", "group")
    held = written(held, "lines-held")
    kept = held.groupBy("group").agg(F.min(F.struct("doc_id", "line")).alias("kept"))
    gone = held.join(kept, "group").filter("not (doc_id = kept.doc_id and line = kept.line)")
    return written(gone.groupBy("doc_id").agg(F.collect_list("line").alias("dropped")), "lines-dropped")


def cut_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of ``dropped``, all columns as they came,
    and a last column ``cut (n_lines, n_dropped)``, the numbers of lines before
    and cut; where ``docs`` has that name already, underscores are added."""
    name = "cut"
    while name in docs.columns:
        name += "_"
    text, gone = F.col(f"d.`{text_col}`"), F.col("x.dropped")
    lines = F.split(text, "\n")
    rest = F.array_join(F.filter(lines, lambda _, k: ~F.array_contains(gone, k)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    # Broadcast only when all line numbers together are counted to be few; else both sides are shuffled.
    total = dropped.agg(F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()[0]
    listed = F.broadcast(dropped) if total <= BROADCAST_ROWS else dropped
    joined = docs.alias("d").join(listed.alias("x"), F.col(f"d.`{id_col}`") == F.col("x.doc_id"), "left")
    return joined.select(
        *[F.when(gone.isNotNull(), rest).otherwise(text).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns],
        F.struct(n_lines.alias("n_lines"), F.when(text.isNull() | gone.isNull(), 0).otherwise(
            F.size(F.array_distinct(F.filter(gone, lambda k: k < F.size(lines))))).alias("n_dropped")).alias(name))


def dedup_lines(docs: DataFrame, min_words: int = 5, min_similarity: float = 0.8, id_col: str = "doc_id",
                text_col: str = "text", wide: bool = False) -> DataFrame:
    """Every document with its near-duplicate lines cut out, all columns as
    they came, and the struct of ``cut_lines`` at the end. Links are pairs of
    SimHashes three bits apart; ``wide`` finds those of the edit similarity
    alone."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    dropped = dropped_lines(own.filter("doc_id is not null and text is not null"), min_words, min_similarity, wide)
    return cut_lines(docs, dropped, id_col, text_col)

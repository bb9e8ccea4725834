"""Voronoi regions of operator 9: spaces of sets are split until each region
fits a leaf, so that every link of two sets is inside some region, or is
emitted on the way.

A space is a table of rows ``(region, key, n, label, data)``: ``data`` is the
set as sorted 64-bit shingles. Sets with the same label are known to be
connected, so only pairs of different labels have to meet.

Each round looks at the regions above ``leaf`` shingles:

* By pivots. Each set goes to the region of its nearest pivot p and, as a
  replica, to that of every pivot q before p with d(x, q) <= d(x, p) + 2 eps:
  by the triangle inequality both ends of a link lie in the window of either
  end's region, so they meet in the region of the earlier pivot. A set within
  eps of a pivot is linked with it; the link is emitted and the set takes the
  pivot's label. A region that holds sets of one label only is done. Sets that
  no pivot is near to (from 1 - 2 eps on, where windows would reach every
  region) go to a region of their own, and as replicas to pivots nearer than
  1 - eps: an end of a link that is near a pivot has its other end there.
  Windows are computed without moving sets; a region is divided where its
  children weigh at most ``GROWTH`` times as much and the largest is smaller.
  Elsewhere only the labels are kept, and the region is a leaf if it has at
  most ``LAST_LEAF`` shingles.
* Where one label holds nearly all of a region, as in a large group of near
  copies, the others (at most half a leaf) meet its sets in blocks: the sets
  of the label are written once, the others once for each block.
* By rare shingles, before pivots. Sets of a large space often share no more
  than a passage that very many sets hold. Shingles of the space that more than
  ``often`` of its sets hold are left out of the classes of new signatures,
  and the region falls apart into the components of these (sets with too few
  rare shingles for that sign with all of them): the same pigeonhole argument,
  without the passages.

What no round divides is one leaf, or, above
``LAST_LEAF`` shingles, cut into blocks whose pairs are leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wicketlake.llm.common import discard, map_batches, stream_batches, written
from wicketlake.llm.components import connected_components

#: What each round does, with the bound of a rare shingle.
ROUNDS = (("rare", 32), ("pivots", 0), ("rare", 4), ("pivots", 0), ("pivots", 0), ("pivots", 0))
#: Shingles of a leaf that no round has divided.
LAST_LEAF = 2_000_000
#: Pivots of a region: one for each half leaf, between these numbers.
PIVOTS = (2, 16)
#: Most that the regions of a divided one may weigh together, and the largest
#: of them, as shares of its weight.
GROWTH, SHRINK = 1.5, 0.8
#: Tasks that the sets of one region are dealt to.
SALTS = 16
SPACE = "region bigint, key bigint, n bigint, label bigint, data binary"
#: The slot of the sets that no pivot is near to.
FAR = -1


def distances(data: bytes, pivots: list) -> list[float]:
    """Jaccard distances of a set to pivots given as arrays."""
    import numpy as np

    own, out = np.frombuffer(data, dtype=np.uint64), []
    for other in pivots:
        at = np.searchsorted(other, own)
        both = int((other[np.minimum(at, len(other) - 1)] == own).sum())
        out.append(1 - both / (len(own) + len(other) - both))
    return out


def windows(d: list[float], eps: float) -> list[int]:
    """The regions of a set with distances ``d`` to the pivots of its space."""
    near, slack = min(d), 1e-9
    if near + 2 * eps < 1 - slack:
        home = d.index(near)
        return [k for k, x in enumerate(d[:home]) if x <= near + 2 * eps + slack] + [home]
    return [FAR] + [k for k, x in enumerate(d) if x < 1 - eps + slack]


def _place(rows: Iterator[tuple], eps: float, is_link: Callable) -> Iterator[tuple]:
    """``(region, key, n, label, slots, labels, ties)`` of each set: its
    regions, the label it has in each, and the pivots it is linked with. The
    pivots of a (region, salt) come before its sets."""
    import numpy as np

    space, pivots = None, []
    for region, salt, member, key, n, label, data in rows:
        if (region, salt) != space:
            space, pivots = (region, salt), []
        if not member:
            pivots.append((key, np.frombuffer(data, dtype=np.uint64)))
            continue
        d = distances(data, [p for _, p in pivots])
        tied = [is_link(n, len(p), round((1 - x) * (n + len(p)) / (2 - x))) for x, (_, p) in zip(d, pivots)]
        ties = [pivot for (pivot, _), yes in zip(pivots, tied) if yes]
        slots = windows(d, eps)
        yield (region, key, n, ties[0] if ties else label, slots,
               [pivots[k][0] if k >= 0 and tied[k] else label for k in slots], ties)


def by_pivots(large: DataFrame, eps: float, is_link: Callable, round_no: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(children, undivided, links)`` of the regions ``large``, which come
    with their ``weight`` and ``most`` (the label of most weight). Pivots are
    drawn from the sets of other labels, one for each hash slot."""
    low, high = PIVOTS
    slots = F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(F.col("weight") * 2 / F.col("leaf")))).cast("int")
    drawn = (large.filter("label is null or most is null or label <> most")
             .groupBy("region", F.pmod(F.xxhash64("key", F.lit(round_no + 100)), slots).alias("slot"))
             .agg(F.min_by(F.struct("key", "data"), F.xxhash64("key")).alias("p")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    none = F.lit(None).cast("bigint")
    own = large.select("region", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("member"), "key", "n", "label", "data")
    met = own.unionByName(drawn.select("region", salts.alias("salt"), F.lit(0).alias("member"), F.col("p.key").alias("key"),
                                       F.lit(0).cast("bigint").alias("n"), none.alias("label"), F.col("p.data").alias("data")))
    dealt = met.repartition("region", "salt").sortWithinPartitions("region", "salt", "member", "key")
    placed = written(stream_batches(dealt, lambda rows: _place(rows, eps, is_link),
                                    "region bigint, key bigint, n bigint, label bigint, slots array<int>, labels array<bigint>, ties array<bigint>"),
                     f"jaccard-placed-{round_no}")
    links = placed.select(F.col("key").alias("a"), F.explode("ties").alias("b")).filter("a <> b")

    # Which regions are worth dividing: only what is not done yet weighs.
    each = placed.select("region", "key", "n", F.explode(F.arrays_zip("slots", "labels")).alias("to"))
    sums = each.groupBy("region", F.col("to.slots").alias("slot"), F.col("to.labels").alias("label")).agg(F.sum("n").alias("own"))
    children = sums.groupBy("region", "slot").agg(F.sum("own").alias("own"), F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("own"))), F.lit(0)).alias("tied"))
    children = children.filter("own > tied").groupBy("region").agg(F.sum("own").alias("all"), F.max(F.col("own") - F.col("tied")).alias("largest"))
    before = large.select("region", "weight", "tied").distinct()
    verdict = before.join(children, "region", "left").select("region", F.coalesce(
        (F.col("all") <= GROWTH * F.col("weight")) & (F.col("largest") <= SHRINK * (F.col("weight") - F.col("tied"))), F.lit(True)).alias("divide"))
    verdict = written(verdict, f"jaccard-verdict-{round_no}")
    sets = large.select("region", "key", "data")
    down = (each.join(verdict.filter("divide").select("region"), "region").join(sets, ["region", "key"])
            .select(F.xxhash64("region", "to.slots", F.lit(round_no)).alias("region"), "key", "n", F.col("to.labels").alias("label"), "data"))
    same = placed.select("region", "key", "n", "label").join(verdict.filter("not divide").select("region"), "region").join(
        large.select("region", "key", "data", "weight"), ["region", "key"])
    return down, same, links


def by_rare_shingles(large: DataFrame, often: int, sign: Callable, stars: Callable, round_no: int) -> DataFrame:
    """Children of the regions ``large``: components of signatures over the
    shingles that at most ``often`` sets of the region hold. Sets that meet no
    other set have no links and leave."""
    def shingles(columns: list[list]) -> list[list]:
        import numpy as np

        regions, keys, _, sets = columns
        found = [np.frombuffer(s, dtype=np.int64) for s in sets]
        sizes = [len(s) for s in found]
        return [list(np.repeat(regions, sizes)), list(np.repeat(keys, sizes)), np.concatenate(found)]

    held = map_batches(large.select("region", "key", "n", "data"), shingles, "region bigint, key bigint, shingle bigint")
    held = written(held, f"jaccard-shingles-{round_no}")
    common = held.groupBy("region", "shingle").agg(F.count("*").alias("times")).filter(F.col("times") > often)
    lists = held.join(common.select("region", "shingle"), ["region", "shingle"]).groupBy("region", "key").agg(F.collect_list("shingle").alias("common"))

    def signed(columns: list[list]) -> list[list]:
        import numpy as np

        regions, keys, sets, commons = columns
        out = [[], [], []]
        for region, key, data, common in zip(regions, keys, sets, commons):
            own = np.frombuffer(data, dtype=np.uint64)
            rare = own if not common else np.setdiff1d(own, np.array(common, dtype=np.int64).view(np.uint64), assume_unique=True)
            sigs = sign(own, rare)
            out[0] += [region] * len(sigs)
            out[1] += [key] * len(sigs)
            out[2] += sigs.tolist()
        return out

    known = large.select("region", "key", "data").join(lists, ["region", "key"], "left")
    sigs = map_batches(known, signed, "region bigint, key bigint, sig bigint")
    # One number for region and set, and for region and signature: regions stay apart.
    node = F.xxhash64("region", "key")
    pairs = sigs.select(F.xxhash64("region", "sig").alias("sig"), node.alias("key"))
    edges = pairs.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(stars, "a bigint, b bigint")
    parts = connected_components(edges, f"jaccard-parts-{round_no}")
    discard(held)
    return large.withColumn("node", node).join(parts, "node").select(
        F.xxhash64("region", "component", F.lit(round_no)).alias("region"), "key", "n", "label", "data")


def _blocks(rows: DataFrame, parts, again: str) -> DataFrame:
    return rows.withColumn("parts", parts.cast("int")).withColumn("block", F.pmod(F.xxhash64("key", F.lit(again)), F.col("parts")).cast("int"))


def split_regions(spaces: DataFrame, leaf: int, eps: float, is_link: Callable, sign: Callable, stars: Callable,
                  rounds: tuple = ROUNDS, last_leaf: int = LAST_LEAF) -> tuple[DataFrame, list[DataFrame]]:
    """``(region, key, data)`` of the leaves of ``spaces (region, key, n,
    data)``, and the tables of links ``(a, b)`` that were emitted on the way."""
    leaves, links, spent = [], [], []
    rest = spaces.withColumn("label", F.lit(None).cast("bigint"))
    for round_no, (how, often) in enumerate((*rounds, ("last", 0))):
        if round_no:
            rest = written(rest, f"jaccard-round-{round_no}")
            discard(*spent)
            spent = []
        sums = rest.groupBy("region", "label").agg(F.sum("n").alias("own"))
        known = F.when(F.col("label").isNotNull(), F.struct("own", "label"))
        state = sums.groupBy("region").agg(F.sum("own").alias("weight"), F.max(known).alias("m")).select(
            "region", "weight", F.coalesce("m.own", F.lit(0)).alias("tied"), F.col("m.label").alias("most"), F.lit(leaf).alias("leaf"))
        state = written(state.filter("weight > tied"), f"jaccard-state-{round_no}")  # of one label: done
        small = state.filter("weight <= leaf").select("region")
        leaves.append(rest.join(small, "region", "left_semi").select("region", "key", "data"))
        if state.filter("weight > leaf").isEmpty():
            break
        # Others of at most half a leaf meet the label's sets in blocks.
        other = "label is null or label <> most"
        meet = rest.join(state.filter("weight > leaf and tied > 0 and (weight - tied) * 2 <= leaf"), "region")
        parts = F.ceil(F.col("tied") * 2 / F.lit(leaf))
        ours = _blocks(meet.filter(f"not ({other})"), parts, "tied")
        theirs = meet.filter(other).withColumn("block", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
        leaves += [x.select(F.xxhash64("region", "block", F.lit("tied")).alias("region"), "key", "data") for x in (ours, theirs)]
        heavy = state.filter("weight > leaf and not (tied > 0 and (weight - tied) * 2 <= leaf)")
        if heavy.isEmpty():
            break
        large = written(rest.join(heavy, "region"), f"jaccard-large-{round_no}")
        if how == "pivots":
            rest, same, found = by_pivots(large, eps, is_link, round_no)
            links.append(found)
            # Undivided regions that fit the last leaf are done; larger ones try other pivots.
            leaves.append(same.filter(F.col("weight") <= last_leaf).select("region", "key", "data"))
            rest = rest.unionByName(same.filter(F.col("weight") > last_leaf).drop("weight"))
        elif how == "rare":
            rest = by_rare_shingles(large, often, sign, stars, round_no)
            spent.append(large)  # its sets are in the next round's table
        else:
            parts = F.when(F.col("weight") <= last_leaf, F.lit(1)).otherwise(F.ceil(F.col("weight") * 2 / F.lit(last_leaf)))
            cut = _blocks(large, parts, "last").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            pair = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"), F.lit("blocks"))
            leaves.append(cut.select(pair.alias("region"), "key", "data"))
    return reduce(DataFrame.unionByName, leaves), links

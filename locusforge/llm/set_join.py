"""Pairs of shingle sets of at least a Jaccard similarity, found through deletion-variant signatures of wide SimHashes.

A text's set of words has a SimHash of 256 bits: words move far less than shingles of five when a few of them change. It is
cut into eight segments of 32 bits, and each is indexed once for every bit of it that may be wild. Fingerprints within
fifteen bits always have a segment that differs by at most one bit; the others meet with a probability that is measured
(tests, README). A small bucket emits its pairs, a crowded one a star. What these candidates connect is compared whole where
it is small; else pairs are verified one by one, and the sets that stars connect are compared in blocks, each with a few of
all: what is then still apart from the largest part is compared with everything. Only links that were verified are thinned to a spanning forest, so no failed link stands for another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.common import cut, slices, stash
from locusforge.llm.components import components

#: Words of 64 bits in a wide fingerprint; each has two segments of 32 bits.
WIDE = 4
SEGMENTS, SEGMENT_BITS = 2 * WIDE, 32
#: Beside its segment an entry has this many bits of the next one; members of a bucket that differ in more than
#: ``CHECK_MOST`` of them make no pair: half of them would in unrelated texts, one or two do in similar ones.
CHECK_BITS, CHECK_MOST = 23, 8
#: A bucket of up to this many sets emits pairs, a larger one a star; what stars connect is compared in blocks of about so many,
#: each with some hubs.
PAIRED_ROWS = 8
BLOCK_SETS = 1024
HUBS = 8
_TOLD = 1 << 18
#: Crowds (of over ``BLOCK_SETS`` sets each) whose sizes, some 100 bytes, are sent to all; beyond, they are joined by a shuffle.
BROADCAST_CROWDS = 100_000


def bag_of(shingles: np.ndarray) -> int:
    """One number for a set of shingles, given in ascending order; equal sets have equal numbers."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def word_hashes(text: str, seed: int = 42) -> np.ndarray:
    """XXH64 of each distinct word."""
    own = set(text.encode("utf-8", "surrogatepass").lower().split())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in own), np.uint64, len(own))


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other 64 bits from each hash (the finisher of splitmix64)."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_fingerprints(words: list[np.ndarray], majority: Callable) -> np.ndarray:
    """Rows of ``WIDE`` words of 64 bits: a bit is set if it is in over half of the mixed hashes."""
    return np.stack([majority([_mixed(w, turn) for w in words]) for turn in range(WIDE)], axis=1)


def entries(wide: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint (rows), one for every segment and wild bit.

    From the top: segment and wild bit (8 bits), the segment with its wild bit cleared (32), that bit, and check bits.
    """
    segments = np.ascontiguousarray(wide.astype("<u8")).view("<u4").reshape(-1, SEGMENTS).astype(np.uint64)
    check = np.roll(segments, -1, axis=1) >> np.uint64(SEGMENT_BITS - CHECK_BITS)
    wild = np.uint64(1) << np.arange(SEGMENT_BITS, dtype=np.uint64)
    which = (np.arange(SEGMENTS, dtype=np.uint64)[:, None] * np.uint64(SEGMENT_BITS) + np.arange(SEGMENT_BITS, dtype=np.uint64)) << np.uint64(56)
    own = segments[:, :, None]
    bit = (own & wild != 0).astype(np.uint64)
    return (which | (own & ~wild) << np.uint64(24) | bit << np.uint64(CHECK_BITS) | check[:, :, None]).reshape(len(wide), -1)


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, max_rows=512):
        bags = batch.column(0).to_numpy(zero_copy_only=False)
        wide = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(WIDE)], axis=1).view(np.uint64)
        keys = entries(wide)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(bags, keys.shape[1]))], names=["key", "bag"])


def _pairs_of(key: np.ndarray, bag: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of members ``i`` and ``j`` of the same buckets those that may be similar. Equal segments meet under every wild bit; only
    the first of these counts."""
    differ = key[i] ^ key[j]
    check = np.uint64((1 << CHECK_BITS) - 1)
    first = (key[i] >> np.uint64(56)) % np.uint64(SEGMENT_BITS) == 0
    near = (np.bitwise_count(differ & check) <= CHECK_MOST) & (first | (differ >> np.uint64(CHECK_BITS) != 0))
    return bag[i[near]], bag[j[near]]


def _meet(paired: int):
    """Over entries sorted by key: pairs of small buckets, and stars (crowded) of others."""
    corners = {n: np.triu_indices(n, 1) for n in range(2, paired + 1)}

    def emit(a, b, crowded):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

    def star(bag):
        """A bucket's least member with each of the others. Buckets of one group mostly have the same least, and few links in all."""
        least = bag.min()
        others = bag[bag != least]
        return emit(np.full(len(others), least), others, True)

    def closed(key, bag, bounds):
        """Links of whole buckets."""
        sizes = np.diff(bounds)
        for n in range(2, paired + 1):
            starts = bounds[:-1][sizes == n]
            if len(starts):
                i, j = ((starts[:, None] + corner).ravel() for corner in corners[n])
                a, b = _pairs_of(key, bag, i, j)
                if len(a):
                    yield emit(a, b, False)
        for k in np.flatnonzero(sizes > paired).tolist():
            yield star(bag[bounds[k] : bounds[k + 1]])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowd = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), False  # the last bucket, and whether a star began with it
        for batch in slices(batches, max_rows=1 << 17):
            key = np.concatenate([held[0], batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            bag = np.concatenate([held[1], batch.column(1).to_numpy(zero_copy_only=False)])
            own = key >> np.uint64(24)
            bounds = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(key)]])
            if crowd:  # what is held is the star's centre
                first = bag[: bounds[1]]
                if len(first) > 1:
                    yield star(first)
                if len(bounds) == 2:
                    held = (key[:1], first.min(keepdims=True))
                    continue
                bounds, crowd = bounds[1:], False
            yield from closed(key, bag, bounds[:-1])
            held = (key[bounds[-2] :], bag[bounds[-2] :])
            if len(held[1]) > paired:
                yield star(held[1])
                held, crowd = (held[0][:1], held[1].min(keepdims=True)), True
        if not crowd and len(held[1]) > 1:
            yield from closed(*held, np.array([0, len(held[1])]))

    return over


def candidate_links(nodes: DataFrame, paired: int = PAIRED_ROWS) -> DataFrame:
    """Pairs ``a, b`` of sets of ``nodes(bag, wide0 to wide3)`` that meet; ``crowded`` ones are stars, which only connect."""
    index = nodes.select("bag", *[f"wide{k}" for k in range(WIDE)]).mapInArrow(_entry_batches, "key long, bag long")
    met = index.repartition(F.shiftrightunsigned("key", 24)).sortWithinPartitions("key", "bag")
    found = met.mapInArrow(_meet(paired), "a long, b long, crowded boolean").distinct()
    # A set is in no more stars than it has entries, so its rows stay few.
    dealt = found.repartition("b").sortWithinPartitions("b", "a")
    return dealt.mapInArrow(_thinned, "a long, b long, crowded boolean").distinct()


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over links sorted by ``b`` and ``a``: pairs as they are; of the stars that a set is in, its link to the least centre, and
    that centre's links to the others, which many sets have in common. What is connected stays so."""
    own, least = None, None
    told: set[tuple[int, int]] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, crowded = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        x, y = a[~crowded], b[~crowded]
        a, b = a[crowded], b[crowded]
        if len(a):
            begins = np.concatenate([[b[0] != own], b[1:] != b[:-1]])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(b)), -1))
            first = np.where(at >= 0, a[np.maximum(at, 0)], least if least is not None else 0)
            own, least = b[-1], first[-1]
            centres = set(zip(first[~begins].tolist(), a[~begins].tolist())) - told
            told |= centres
            if len(told) > _TOLD:
                told.clear()
            between = np.array(sorted(centres), np.int64).reshape(-1, 2)
            a, b = np.concatenate([a[begins], between[:, 0]]), np.concatenate([b[begins], between[:, 1]])
        marks = np.concatenate([np.zeros(len(x), bool), np.ones(len(a), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, a])), pa.array(np.concatenate([y, b])), pa.array(marks)], names=["a", "b", "crowded"])


def verified_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Positions of links that connect ``sets`` as all their pairs of that similarity do, at most one less than them.

    Breadth first over an index of the shingles; what a member reaches is verified before it is taken off the rest.
    """
    sizes = np.array([len(s) for s in sets])
    shingle = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingle, kind="stable")
    _, number, times = np.unique(shingle, return_inverse=True, return_counts=True)
    ends = np.cumsum(times)
    owners = owner[order]
    starts = np.cumsum(sizes) - sizes
    rest = np.ones(len(sets), bool)
    left, links = len(sets), []
    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first], left, front = False, left - 1, [first]
        while front and left:
            own = front.pop()
            mine = number[starts[own] : starts[own] + sizes[own]]
            mine = mine[times[mine] > 1]
            if not len(mine):
                continue
            met = np.concatenate([owners[ends[k] - times[k] : ends[k]] for k in mine.tolist()])
            common = np.bincount(met, minlength=len(sets))
            found = np.flatnonzero(rest & (common >= similarity * (sizes + sizes[own] - common) - 1e-9))
            links += [(own, int(f)) for f in found]
            front += found.tolist()
            rest[found] = False
            left -= len(found)
    return links


def _compare_blocks(similarity: float, hashed):
    def close(bags: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        links = np.array(verified_forest(sets, similarity), np.int64).reshape(-1, 2)
        own = np.array(bags, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[links[:, 0]]), pa.array(own[links[:, 1]])], names=["a", "b"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bags, sets = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for at, (own, bag) in enumerate(zip(keys, batch.column(3).to_pylist())):
                if own != key:
                    if len(bags) > 1:
                        yield close(bags, sets)
                    key, bags, sets = own, [], []
                if not bags or bag != bags[-1]:
                    bags.append(bag)
                    sets.append(np.unique(np.array(hashed(batch.column(4)[at].as_py()), np.uint64)))
        if len(bags) > 1:
            yield close(bags, sets)

    return over


def _whole_sets(hashed):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 20):
            sets = [np.unique(np.array(hashed(t.as_py() or ""), np.uint64)) for t in batch.column(0)]
            bags = np.array([bag_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bags), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["bag", "shingles"])

    return over


def similar_links(texts: DataFrame, rows: DataFrame, nodes: DataFrame, similarity: float, hashed, *, paired: int = PAIRED_ROWS, block: int = BLOCK_SETS) -> DataFrame:
    """Links ``a, b`` between the sets (``bag``) of ``texts(text)`` that keep every component of the similar pairs that meet.

    ``rows(bag, text_key)`` has the set and ``xxhash64(text)`` of each text, ``nodes`` the wide fingerprint of each set;
    ``hashed`` gives a text's shingles.
    """
    found = cut(candidate_links(nodes, paired))
    # Sets that candidates connect, in one task while they are few: each text moves there once.
    whole = components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("bag"), F.col("component").alias("c"))
    placed = whole.join(whole.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c")
    chosen = rows.join(placed, "bag").groupBy("bag", "c", "n").agg(F.min("text_key").alias("text_key"))
    held = texts.select("text", F.xxhash64("text").alias("text_key")).join(chosen, "text_key").dropDuplicates(["bag"])
    held = stash(held.select("bag", "c", "n", "text"), "set-join")

    def compared(tiles: DataFrame) -> DataFrame:
        dealt = tiles.repartition("c", "k", "v").sortWithinPartitions("c", "k", "v", "bag")
        return dealt.mapInArrow(_compare_blocks(similarity, hashed), "a long, b long")

    links = compared(held.where(F.col("n") <= block).select("c", F.lit(0).alias("k"), F.lit(0).alias("v"), "bag", "text"))
    large = held.where(F.col("n") > block)
    if large.isEmpty():
        return cut(links.distinct())
    sets = cut(large.select("text").mapInArrow(_whole_sets(hashed), "bag long, shingles array<long>"))
    pairs = found.where("not crowded").join(sets.select(F.col("bag").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("bag").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = links.union(pairs.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"))
    stars = found.where("crowded").join(large.select(F.col("bag").alias("a")), "a", "left_semi")
    if stars.isEmpty():
        return cut(links.distinct())
    crowd = cut(components(stars.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("bag"), F.col("component").alias("c")))
    hubs = [F.min(F.struct(F.xxhash64("bag", F.lit(k)), F.col("bag"))).getField("bag") for k in range(HUBS)]
    sizes = crowd.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.array_distinct(F.array(*hubs)).alias("hubs"))
    sizes = cut(sizes)
    few = sizes.count() <= BROADCAST_CROWDS

    def beside(rows: DataFrame, of_crowds: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(of_crowds) if few else of_crowds, "c")

    def dealt(tiles: DataFrame) -> DataFrame:
        return compared(large.select("bag", "text").join(tiles, "bag").select("c", "k", "v", "bag", "text"))

    placed = cut(beside(crowd, sizes.select("c", "blocks")).select("bag", "c", "blocks", F.pmod(F.xxhash64("bag"), F.col("blocks")).cast("int").alias("i")))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    everywhere = sizes.select("c", "blocks", F.explode("hubs").alias("bag")).select("bag", "c", F.explode(each).alias("k"))
    first = cut(dealt(placed.select("bag", "c", F.col("i").alias("k")).union(everywhere).distinct().withColumn("v", F.lit(-1))).distinct())
    links = links.union(first)
    # Who is not yet with the most of its crowd meets all of it, block by block.
    part = components(first.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("bag"), F.col("component").alias("part"))
    parted = cut(placed.join(part, "bag", "left").withColumn("part", F.coalesce("part", "bag")))
    most = parted.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.max(F.struct("n", "part")).getField("part").alias("most"))
    apart = beside(parted, most).where("part <> most").drop("part", "most")
    apart = cut(beside(apart, apart.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("groups"))).withColumn("g", F.pmod(F.xxhash64("bag", F.lit(1)), F.col("groups")).cast("int")))
    if not apart.isEmpty():
        ways = apart.groupBy("c").agg(F.max("groups").alias("groups"))
        of_all = beside(placed, ways).select("bag", "c", F.col("i").alias("k"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("v"))
        of_apart = apart.select("bag", "c", F.explode(each).alias("k"), F.col("g").alias("v"))
        links = links.union(dealt(of_all.union(of_apart).distinct()))
    return cut(links.distinct())

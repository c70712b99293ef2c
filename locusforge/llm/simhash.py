"""Near duplicates by 64-bit SimHash, linked through deletion-variant signatures.

The fingerprint is cut into segments, few enough that by the pigeonhole principle some choice of segments differs by at
most one bit between any two fingerprints within the allowed distance. Each fingerprint is indexed once for every such
choice and every bit of it that may be wild; equal signatures meet in a bucket (the equality join), where distances are
verified. Only distinct fingerprints are indexed, so copies cost nothing. A bucket returns a spanning forest of its links
and not its pairs, which keeps every component and makes the output linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.common import cut, quoted, slices, unused
from locusforge.llm.components import components
from locusforge.llm.set_join import WIDE, bag_of, similar_links, wide_fingerprints, word_hashes

BITS = 64
#: A bucket of up to this many fingerprints is searched in one task (512 KB of them); a larger one by radius keys.
BUCKET_ROWS = 1 << 16
#: Distinct fingerprints up to which three segments are used; beyond, six with longer signatures.
THREE_SEGMENTS_UP_TO = 300_000_000
#: Distance up to which the members of crowded buckets are linked by radius keys (2081 a fingerprint for four bits).
RADIUS_UP_TO = 4
_CHUNK_SHINGLES = 1 << 18


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, words: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of ``text``; of the whole sequence if it has fewer words; none if it has none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, seed)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends[: len(parts) - words + 1] - [len(p) + 1 for p in parts[: len(parts) - words + 1]]).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the fingerprint whose bits are set in over half of it; zero for an empty array."""
    sizes = np.array([len(h) for h in hashes])
    if not sizes.sum():
        return np.zeros(len(hashes), np.uint64)
    owner = np.repeat(np.arange(len(hashes)), sizes) * 256
    planes = np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
    bit_of = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    out = np.zeros(len(hashes), np.uint64)
    for plane in range(8):
        counts = np.bincount(owner + planes[:, plane], minlength=256 * len(hashes)).reshape(-1, 256) @ bit_of
        for bit in range(8):
            out |= (counts[:, bit] * 2 > sizes).astype(np.uint64) << np.uint64(8 * plane + bit)
    return out


def _fingerprint_batches(words: int, seed: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, held, total = [], [], 0
            for text in batch.column(1):
                held.append(np.array(shingle_hashes(text.as_py() or "", words, seed), np.uint64))
                total += len(held[-1])
                if total >= _CHUNK_SHINGLES or len(held) >= 512:
                    out.append(majority_bits(held))
                    held, total = [], 0
            if held:
                out.append(majority_bits(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "fp"])

    return over


def fingerprints(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of each whole text; null counts as empty and has fingerprint zero."""
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(words, seed), "doc_id long, fp long")


# ---------------------------------------------------------------- signatures


def variant_masks(distance: int, segments: int) -> list[int]:
    """Masks of the bits that two fingerprints within ``distance`` must share in at least one of them.

    ``segments - distance + 1`` segments are chosen: of ``distance`` differing bits at most one can fall into the
    least touched ones. (For three segments and up to five bits one segment is chosen.) One bit of the choice is wild.
    """
    bounds = [BITS * i // segments for i in range(segments + 1)]
    bits = [range(a, b) for a, b in zip(bounds, bounds[1:])]
    chosen = max(segments - distance + 1, 1)
    if chosen == 1 and distance // segments > 1:
        raise ValueError("too few segments: one could differ by more than one bit")
    masks = []
    for choice in combinations(range(segments), chosen):
        own = [b for s in choice for b in bits[s]]
        whole = sum(1 << b for b in own)
        masks += [whole & ~(1 << wild) for wild in own]
    return masks


def _signature_batches(masks: list[int]):
    table = np.array(masks, np.uint64)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_rows=max(1, (1 << 17) // len(table))):
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = (fps[:, None] & table[None, :]).ravel().view(np.int64)
            which = np.tile(np.arange(len(table), dtype=np.int32), len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(values), pa.array(np.repeat(fps, len(table)).view(np.int64))], names=["k", "v", "fp"])

    return over


# ---------------------------------------------------------------- verification


def spanning_links(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect ``members`` (distinct) as their pairs within ``distance`` do, at most one less than them.

    Breadth first: each member reached is compared with those not reached yet, which a dense bucket exhausts at once.
    """
    links = []
    rest = members
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            own = front.pop()
            near = np.bitwise_count(rest ^ own) <= distance
            if near.any():
                found = rest[near]
                links += [(int(own), int(f)) for f in found]
                front += list(found)
                rest = rest[~near]
    return links


def _bucket_batches(distance: int, limit: int):
    """Over rows sorted by signature: the links of each bucket; of one beyond ``limit`` its members, as (fp, null)."""

    def emit(links: list[tuple[int, int]], large: np.ndarray) -> pa.RecordBatch:
        a = np.array([x for x, _ in links], np.uint64)
        b = np.array([x for _, x in links], np.uint64)
        left = np.concatenate([a, large.astype(np.uint64)]).view(np.int64)
        right = pa.array(np.concatenate([b, large.astype(np.uint64)]).view(np.int64), mask=np.arange(len(left)) >= len(a))
        return pa.RecordBatch.from_arrays([pa.array(left), right], names=["a", "b"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size = None, [], 0
        links: list[tuple[int, int]] = []
        none = np.zeros(0, np.uint64)

        def close():
            if 1 < size <= limit:
                links.extend(spanning_links(np.concatenate(parts), distance))

        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1])) + 1, [len(k)]])
            sizes = np.diff(bounds)
            if (k[0], v[0]) != key:
                close()
                key, parts, size = (k[0], v[0]), [], 0
            # Buckets of two inside the batch, the common case, at once.
            twos = bounds[1:-2][sizes[1:-1] == 2] if len(sizes) > 2 else bounds[:0]
            if len(twos):
                near = np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= distance
                links.extend(zip(fp[twos[near]].tolist(), fp[twos[near] + 1].tolist()))
            for i in np.flatnonzero((sizes > 2) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                if i:
                    close()
                    key, parts, size = (k[bounds[i]], v[bounds[i]]), [], 0
                part = fp[bounds[i] : bounds[i + 1]]
                size += len(part)
                if size <= limit:
                    parts.append(part)
                elif parts is not None:
                    held, parts = [*parts, part], []
                    yield emit([], np.concatenate(held))
            if len(links) >= 4096:
                yield emit(links, none)
                links = []
        close()
        if links:
            yield emit(links, none)

    return over


def _radius_links(crowd: DataFrame, distance: int) -> DataFrame:
    """Links among the members of crowded buckets, whatever their number.

    Two fingerprints are within ``2r`` bits exactly if some point lies within ``r`` bits of both, and all members of such
    a point are within ``2r`` of each other, so a link to the least of them is right without a check. The keys are linear
    in the members. For an odd distance the remaining bit is taken on one side.
    """
    flips = [0, *[sum(1 << b for b in c) for r in range(1, distance // 2 + 1) for c in combinations(range(BITS), r)]]
    near = np.array(flips, np.uint64)
    odd = distance % 2

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_rows=64):
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            points = (fps[:, None] ^ near[None, :]).ravel()
            own = np.repeat(fps, len(near))
            yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(own.view(np.int64))], names=["point", "fp"])

    points = crowd.distinct().mapInArrow(over, "point long, fp long")
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    if odd:
        wild = F.transform(F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(BITS)]), lambda m: F.struct(F.col("point").bitwiseXOR(m).alias("point")))
        other = least.select(F.explode(wild).alias("s"), "a").select("s.point", F.col("a").alias("b"))
        bridged = least.join(other, "point").select("a", "b")
        return points.join(least.where("a <> z"), "point").select("a", F.col("fp").alias("b")).union(bridged).where("a <> b").distinct()
    return points.join(least.where("a <> z"), "point").select("a", F.col("fp").alias("b")).where("a <> b").distinct()


def _tiled_links(crowd: DataFrame, distance: int, rows: int) -> DataFrame:
    """Links among the members of crowded buckets, block against block, where the distance is too far for radius keys."""
    members = cut(crowd.distinct())
    blocks = max(1, -(-members.count() // max(1, rows // 2)))
    own = F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = members.select(own.alias("i"), other.alias("j"), "fp").select(F.least("i", "j").alias("k"), F.greatest("i", "j").cast("long").alias("v"), "fp")
    met = tiles.repartition("k", "v").sortWithinPartitions("k", "v", "fp")
    return met.mapInArrow(_bucket_batches(distance, 1 << 62), "a long, b long").distinct()


def fingerprint_links(distinct: DataFrame, *, distance: int = 4, segments: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints of ``distinct(fp)`` that keep every component."""
    if segments is None:  # the fewest; for many fingerprints more, and with them longer signatures
        segments = distance // 2 + 1
        if distance <= 5 and distinct.count() > THREE_SEGMENTS_UP_TO:
            segments = distance + 2
    index = distinct.select("fp").mapInArrow(_signature_batches(variant_masks(distance, segments)), "k int, v long, fp long")
    met = index.repartition("k", "v").sortWithinPartitions("k", "v", "fp")
    found = cut(met.mapInArrow(_bucket_batches(distance, bucket_rows), "a long, b long").distinct())
    crowd = found.where("b is null").select(F.col("a").alias("fp"))
    links = found.where("b is not null")
    if crowd.isEmpty():
        return links
    return links.union(_radius_links(crowd, distance) if distance <= RADIUS_UP_TO else _tiled_links(crowd, distance, bucket_rows))


def _signed_batches(words: int, seed: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 20):
            texts = batch.column(2).to_pylist()
            held = [np.array(shingle_hashes(t, words, seed), np.uint64) for t in texts]
            bags = np.array([bag_of(np.unique(h)) for h in held], np.uint64)
            wide = wide_fingerprints([word_hashes(t, seed) for t in texts], majority_bits)
            columns = [majority_bits(held), bags, *wide.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]], names=["doc_id", "text_key", "fp", "bag", *_WIDES])

    return over


_WIDES = [f"wide{k}" for k in range(WIDE)]


def near_duplicates(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", words: int = 4, seed: int = 42, distance: int = 4, segments: int | None = None, bucket_rows: int = BUCKET_ROWS, similarity: float | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``df``: the smallest identifier that links lead to.

    With ``similarity`` rows are linked if their shingle sets have that Jaccard similarity. Candidates meet through the
    signatures of wider fingerprints (``set_join``) and are verified on whole sets, so that an equal fingerprint alone joins
    nothing. ``distance``, ``segments`` and ``bucket_rows`` have no part in that.

    Null texts count as empty; texts without words share fingerprint zero. Rows that repeat an identifier each get a row.
    A null identifier never names a component unless all identifiers of the component are null. An empty table gives an
    empty result. Columns beside the two named are ignored.
    """
    by = "fp" if similarity is None else "bag"
    if similarity is None:
        rows = cut(fingerprints(df, text_col=text_col, id_col=id_col, words=words, seed=seed))
    else:
        texts = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
        rows = cut(texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_signed_batches(words, seed), "doc_id long, text_key long, fp long, bag long, " + ", ".join(f"{w} long" for w in _WIDES)))
    wides = [] if similarity is None else [F.min(w).alias(w) for w in _WIDES]  # one for each set of shingles but for equal hashes
    nodes = cut(rows.groupBy(by).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *wides))
    if similarity is None:
        links = fingerprint_links(nodes, distance=distance, segments=segments, bucket_rows=bucket_rows)
    else:
        links = similar_links(texts, rows, nodes, similarity, lambda text: shingle_hashes(text, words, seed))
    if links.isEmpty():
        merged = nodes
    else:
        found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        named = found.join(nodes, found.node == nodes[by]).select(by, "least", "component")
        least = named.groupBy("component").agg(F.min("least").alias("reached"))
        renamed = named.join(least, "component").select(by, "reached")
        merged = cut(nodes.join(renamed, by, "left").select(by, "n", F.coalesce("reached", "least").alias("least")))
    # A fingerprint with a thousandth of all rows would fill a task; at most a thousand can have that many.
    common = max(2, (nodes.agg(F.sum("n")).first()[0] or 0) // 1000)
    frequent = merged.where(F.col("n") > common).select(by, F.col("least").alias("component_id"))
    others = merged.where(F.col("n") <= common).select(by, F.col("least").alias("component_id"))
    met = rows.join(F.broadcast(frequent), by)
    rare = rows.join(F.broadcast(frequent.select(by)), by, "left_anti").join(others, by)
    return met.unionByName(rare).select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose identifier names their component, one document of each group; columns as they were.

    Rows that share an identifier are one document and stay or go together. Rows without identifier cannot stand for a
    group and always stay.
    """
    found = near_duplicates(df, text_col=text_col, id_col=id_col, **options)
    own = unused(df, "stays")
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    key = F.col(quoted(id_col)).cast("long")
    kept = df.join(stay, key == F.col(own), "left_semi")
    return kept.union(df.where(key.isNull()))

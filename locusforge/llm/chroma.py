"""Chroma audio fingerprints and their alignment.

A recording becomes frames, each frame twelve pitch-class energies. Filters over a few frames and classes, summed from an
integral image, are quantised to two bits each; sixteen of them make one 32-bit integer a frame. To find recordings that
share sound, equal halves of integers vote for a time offset between two recordings, and the share of differing bits at the
offsets with the most votes decides. Equal fingerprints are searched once, under the smallest identifier.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.common import cut, quoted, slices

FILTERS = 16
#: Integers of the recordings sought for at once, which every task holds (4 bytes each and 12 in its index).
BLOCK_PRINTS = 1 << 21
#: Votes counted at once (4 to 8 bytes each, a few times over).
PIECE_VOTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Frames of ``frame`` samples every ``hop`` at ``rate`` Hz; tones between ``low`` and ``high`` Hz count."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    low: float = 28.0
    high: float = 3520.0


# ---------------------------------------------------------------- fingerprint


@lru_cache(maxsize=4)
def _pitch_classes(s: Settings) -> np.ndarray:
    """Which pitch class each frequency of a frame's spectrum belongs to, as a matrix; class 0 is A."""
    f = np.fft.rfftfreq(s.frame, 1 / s.rate)
    out = np.zeros((len(f), 12), np.float32)
    own = (f >= s.low) & (f <= s.high)
    out[np.flatnonzero(own), np.round(12 * np.log2(f[own] / 440.0)).astype(int) % 12] = 1
    return out


@lru_cache(maxsize=4)
def _taper(n: int) -> np.ndarray:
    return np.hanning(n).astype(np.float32)


def chroma(samples: np.ndarray, s: Settings) -> np.ndarray:
    """Frames by twelve energies, smoothed over five frames and brought to unit length; silence stays zero."""
    if len(samples) < s.frame:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), s.frame)[:: s.hop]
    spectrum = np.fft.rfft(frames * _taper(s.frame), axis=1)
    power = np.square(spectrum.real)
    power += np.square(spectrum.imag)
    image = power.astype(np.float32, copy=False) @ _pitch_classes(s)
    if len(image) >= 5:
        kernel = np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)
        image = sum(k * image[i : len(image) - 4 + i] for i, k in enumerate(kernel))
    length = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(length > 1e-6, image / np.maximum(length, 1e-6), 0)


@lru_cache(maxsize=1)
def filter_bank() -> tuple[tuple[int, int, int, int], ...]:
    """(kind, first class, classes, frames) of each filter: kinds in turn, places and extents stepped through their ranges."""
    return tuple((i % 5, (5 * i) % 7, 4 + i % 3 * 2 if (5 * i) % 7 + 4 + i % 3 * 2 <= 12 else 4, 2 + 2 * (i % 4)) for i in range(FILTERS))


def fingerprint(samples: np.ndarray, s: Settings) -> np.ndarray:
    """One unsigned 32-bit integer for each frame that has all the frames after it which the longest filter covers."""
    image = chroma(samples, s)
    longest = max(w for *_, w in filter_bank())
    n = len(image) - longest + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return integral[t1 : t1 + n, c1] - integral[t0 : t0 + n, c1] - integral[t1 : t1 + n, c0] + integral[t0 : t0 + n, c0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filter_bank():
        whole = area(0, w, y, y + h)
        if kind == 0:  # lower against upper classes
            part = area(0, w, y, y + h // 2)
        elif kind == 1:  # earlier against later frames
            part = area(0, w // 2, y, y + h)
        elif kind == 2:  # one diagonal against the other
            part = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 3:  # middle classes against the rest
            part = area(0, w, y + h // 4, y + h - h // 4)
        else:  # these classes against all others
            part, whole = whole, area(0, w, 0, 12)
        value = np.log((1 + part) / (1 + np.maximum(whole - part, 0)))
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbours differ by one bit
    return out


def read_wav(raw: bytes | None, s: Settings) -> np.ndarray:
    """Samples of a PCM WAV file in -1 to 1, channels averaged, at the settings' rate; empty for null or anything else."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as f:
            width, channels, rate, body = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32)
    if width not in (1, 2, 4) or not rate or not channels:
        return np.zeros(0, np.float32)
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[width]
    x = np.frombuffer(body[: len(body) // (width * channels) * width * channels], kind).astype(np.float32).reshape(-1, channels).mean(1)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    if rate != s.rate and len(x):
        x = np.interp(np.arange(0, len(x), rate / s.rate), np.arange(len(x)), x).astype(np.float32)
    return x


def fingerprints(df: DataFrame, *, media_col: str = "audio", id_col: str = "media_id", settings: Settings = Settings(), reader: Callable | None = None) -> DataFrame:
    """``media_id, prints``: the integers (as signed ones) of each row's recording.

    ``reader(value, settings)`` turns a column's value into samples; by default WAV bytes. What cannot be read, is null or
    is shorter than the filters has an empty list. Rows that repeat are read each for itself; no rows give none.
    """
    read = read_wav if reader is None else reader

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_rows=256):
            found = [fingerprint(read(v.as_py(), settings), settings).view(np.int32) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["media_id", "prints"])

    return df.select(F.col(quoted(id_col)).cast("long").alias("media_id"), F.col(quoted(media_col)).alias("media")).mapInArrow(over, "media_id long, prints array<int>")


# ---------------------------------------------------------------- alignment


class _Index:
    """Places of a set of recordings by the upper and the lower half of their integers, sorted for look-up."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        self.sizes = np.array([len(p) for p in prints], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        flat, owner, place = _turns(prints)
        self.halves = []
        for shift in (0, 16):
            key = (flat >> np.uint32(shift)) & np.uint32(0xFFFF)
            order = np.argsort(key, kind="stable")
            first = np.searchsorted(key[order], np.arange((1 << 16) + 1))
            self.halves.append((first, owner[order], place[order]))

    def voted(self, prints: list[np.ndarray], least_votes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(recording of ``prints``, recording of the index, offset between them) with at least so many pairs of places that have
        an equal half; each once, in pieces that come from about ``PIECE_VOTES`` votes (more only for a single recording)."""
        flat, owner, place = _turns(prints)
        span = max(self.longest, max(map(len, prints), default=0)) + 1
        count = len(self.ids)
        kind = np.int32 if len(prints) * count * 2 * span < 1 << 31 else np.int64
        own = (owner * (count * 2 * span) + place + span).astype(kind)
        sides = []
        for shift, (first, owners, places) in zip((0, 16), self.halves):
            key = (flat >> np.uint32(shift)) & np.uint32(0xFFFF)
            low = first[key]
            sides.append((low, first[key + np.uint32(1)] - low, (owners * (2 * span) - places).astype(kind)))
        each = np.bincount(owner, sides[0][1] + sides[1][1], len(prints)).astype(np.int64)
        bounds = np.searchsorted(owner, _pieces_of(each, PIECE_VOTES))
        for a, b in zip(bounds, bounds[1:]):
            cells = []
            for low, n, theirs in sides:
                low, n = low[a:b], n[a:b]
                at = np.repeat(low - np.cumsum(n) + n, n)
                at += np.arange(len(at))
                cell = theirs.take(at)
                cell += np.repeat(own[a:b], n)
                cells.append(cell)
            cell = np.concatenate(cells)
            cell.sort()
            cell = cell[: max(0, len(cell) - least_votes + 1)][cell[least_votes - 1 :] == cell[: max(0, len(cell) - least_votes + 1)]]
            cell = cell[np.concatenate([[True], cell[1:] != cell[:-1]])] if len(cell) else cell
            pair, offset = np.divmod(cell, cell.dtype.type(2 * span))
            mine, other = np.divmod(pair, pair.dtype.type(count)) if count else (pair, pair)
            yield mine, other, offset - cell.dtype.type(span)


def _pieces_of(work: np.ndarray, most: int) -> list[int]:
    """Bounds of runs of neighbours whose ``work`` adds up to ``most`` at most, or that are single."""
    bounds, held = [0], 0
    for i, n in enumerate(work.tolist()):
        if held and held + n > most:
            bounds.append(i)
            held = 0
        held += n
    return [*bounds, len(work)]


def _turns(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers, recordings and places, of places whose integer is not that of the place before: a long tone votes once."""
    kept = [np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64) for p in prints]
    owner = np.repeat(np.arange(len(prints)), [len(k) for k in kept])
    return np.concatenate([p[k] for p, k in zip(prints, kept)] or [np.zeros(0, np.uint32)]), owner, np.concatenate(kept or [np.zeros(0, np.int64)])


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where the two overlap, and over how many places; ``b`` begins ``offset`` places after ``a``."""
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(x), len(y))
    return (float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n), n) if n > 0 else (1.0, 0)


def bit_errors(a: list[np.ndarray], b: list[np.ndarray], a_at: np.ndarray, b_at: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bit_error`` of many pairs of places in two lists of prints. Pairs of one overlap are compared together, whole stretches
    at a time."""
    (flat_a, first_a, size_a), (flat_b, first_b, size_b) = _flat(a), _flat(b)
    offset = offset.astype(np.int64)
    skip_a, skip_b = np.maximum(0, offset), np.maximum(0, -offset)
    n = np.maximum(0, np.minimum(size_a[a_at] - skip_a, size_b[b_at] - skip_b))
    at_a, at_b = first_a[a_at] + skip_a, first_b[b_at] + skip_b
    errors = np.ones(len(n))
    order = np.argsort(n.astype(np.uint16) if n.max(initial=0) < 1 << 16 else n, kind="stable")  # small ones numpy sorts by radix
    own = n[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
        m = int(own[low])
        if not m:
            continue
        x, y = (np.lib.stride_tricks.as_strided(f, (len(f) - m + 1, m), (f.itemsize, f.itemsize), writeable=False) for f in (flat_a, flat_b))
        step = max(1, (1 << 18) // m)
        for at in range(low, high, step):
            part = order[at : min(high, at + step)]
            bits = x[at_a[part]]
            bits ^= y[at_b[part]]
            errors[part] = np.bitwise_count(bits).sum(1, dtype=np.uint32) / (32 * m)
    return errors, n


def _flat(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in prints], np.int64)
    return np.concatenate(prints or [np.zeros(0, np.uint32)]), np.cumsum(size) - size, size


def _search(shared, least_votes: int, most_error: float, least_overlap: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(*shared.value)
        count = len(index.ids)
        for batch in slices(batches, max_rows=128):
            ids = batch.column(0).to_pylist()
            prints = [np.asarray(v.values).view(np.uint32) for v in batch.column(1)]
            sizes = np.array([len(p) for p in prints], np.int64)
            best: dict[int, tuple] = {}
            for mine, other, d in index.voted(prints, least_votes):
                # Where the two overlap too little nothing is compared.
                enough = np.minimum(sizes[mine] - np.maximum(0, d), index.sizes[other] - np.maximum(0, -d)) >= least_overlap
                mine, other, d = mine[enough], other[enough], d[enough]
                errors, overlaps = bit_errors(prints, index.prints, mine, other, d)
                near = (errors <= most_error) & (overlaps >= least_overlap)
                for i, j, offset, error, n in zip(mine[near].tolist(), other[near].tolist(), d[near].tolist(), errors[near].tolist(), overlaps[near].tolist()):
                    if ids[i] != index.ids[j]:
                        p = i * count + j
                        best[p] = min(best.get(p, (2.0, 0, 0)), (error, -n, offset))
            out = [(index.ids[p % count], ids[p // count], m[2], -m[1], round(m[0], 6)) for p, m in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["q", "class_id", "offset", "overlap", "error"])

    return over


def align(prints: DataFrame, queries, *, block: int = 1024, least_votes: int = 2, most_error: float = 0.2, least_overlap: int = 16) -> DataFrame:
    """One row for each recording of ``prints(media_id, prints)`` with what its sound is also found in.

    Returns ``media_id, class_id, n_prints, is_query, n_links, links``. Recordings with the same prints are a class, named
    by its smallest identifier (recordings without prints: each its own, and never linked). ``queries``, a condition on
    ``media_id``, picks the searches. They are taken in blocks of up to ``block`` classes and ``BLOCK_PRINTS`` integers (more
    only for a single recording), which every task holds while it reads all others: places with an equal half of their
    integer vote for an offset, and every offset with ``least_votes`` is tried. A query's ``links`` are the classes whose prints differ in at most ``most_error`` of
    the bits over ``least_overlap`` places or more, each with offset, overlap and error. Rows that repeat an identifier
    each get a row.
    """
    spark = prints.sparkSession
    keys = [F.xxhash64(F.lit(seed), "prints").alias(f"key{seed}") for seed in (1, 2)]
    rows = cut(prints.select("media_id", "prints", F.coalesce(queries, F.lit(False)).alias("is_query"), *keys))
    own = ["key1", "key2"]
    some = rows.where(F.size("prints") > 0)
    classes = cut(some.groupBy(own).agg(F.min("media_id").alias("class_id"), F.max("is_query").alias("asked"), F.count(F.lit(1)).alias("n"), F.first("prints").alias("prints")).where("class_id is not null"))
    kind = "q long, class_id long, offset int, overlap int, error double"
    found = spark.createDataFrame([], kind)
    last = None
    while True:
        left = classes.where("asked" if last is None else F.col("asked") & (F.col("class_id") > last))
        sizes = left.orderBy("class_id").limit(block).select("class_id", F.size("prints").alias("n")).collect()
        if not sizes:
            break
        held = np.cumsum([r.n for r in sizes])
        taken = max(1, int(np.searchsorted(held, BLOCK_PRINTS, "right")))
        last = sizes[taken - 1].class_id
        asked = left.where(F.col("class_id") <= last).select("class_id", "prints").collect()
        shared = spark.sparkContext.broadcast(([r.class_id for r in asked], [np.array(r.prints, np.int32).view(np.uint32) for r in asked]))
        found = found.union(classes.select("class_id", "prints").mapInArrow(_search(shared, least_votes, most_error, least_overlap), kind))
        if taken == len(sizes) < block:
            break
    links = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("class_id", "offset", "overlap", "error"))).alias("links"))
    # A class with a thousandth of all rows would fill a task; at most a thousand can have that many, of 24 bytes each.
    common = max(2, (classes.agg(F.sum("n")).first()[0] or 0) // 1000)
    frequent = F.broadcast(classes.where(F.col("n") > common).select(*own, "class_id"))
    others = classes.where(F.col("n") <= common).select(*own, "class_id")
    by_all = rows.join(frequent.withColumnRenamed("class_id", "of_frequent"), own, "left")
    rare = by_all.where(F.col("of_frequent").isNull()).drop("of_frequent").join(others, own, "left")
    back = by_all.where(F.col("of_frequent").isNotNull()).withColumnRenamed("of_frequent", "class_id").unionByName(rare)
    none = F.array().cast("array<struct<class_id:bigint,offset:int,overlap:int,error:double>>")
    plain = back.where(~F.col("is_query")).withColumn("links", none)
    listed = back.where("is_query").join(links, F.col("class_id") == F.col("q"), "left").drop("q").withColumn("links", F.coalesce("links", none))
    return plain.unionByName(listed).select("media_id", F.coalesce("class_id", "media_id").alias("class_id"), F.size("prints").cast("long").alias("n_prints"), "is_query", F.size("links").cast("long").alias("n_links"), "links")


# ---------------------------------------------------------------- recordings made from number series


def tone_series(values: list[float] | None, s: Settings) -> np.ndarray:
    """A recording that plays one tone for each number, an eighth of a second long: larger numbers sound higher.

    Numbers count from -0.5 to 0.5 over three octaves from 110 Hz, each with one overtone; nulls are rests. Two series
    that differ by little give recordings that sound alike.
    """
    if not values:
        return np.zeros(0, np.float32)
    v = np.array([np.nan if x is None else x for x in values], np.float64)
    rest = ~np.isfinite(v)
    pitch = 110.0 * 2.0 ** (3 * (np.clip(np.where(rest, 0, v), -0.5, 0.5) + 0.5))
    each = s.rate // 8
    # Within a tone the wave is a rotation's powers: products of few of them take the place of a sine for each sample.
    turn, fine = 2j * np.pi / s.rate * pitch[:, None], max(1, int(each**0.5))
    coarse = np.exp(turn * np.arange(0, each, fine) + 2j * np.pi / s.rate * each * (np.cumsum(pitch) - pitch)[:, None])
    tone = (coarse[:, :, None] * np.exp(turn * np.arange(1, fine + 1))[:, None, :]).reshape(len(v), -1)[:, :each]
    sound = (1 + 0.6 * tone.real) * tone.imag  # sin + 0.3 sin of twice the angle
    sound[rest] = 0
    return sound.ravel().astype(np.float32)

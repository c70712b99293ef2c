import io
import tracemalloc
import wave
from collections import Counter

import numpy as np
from pyspark.sql import functions as F


from locusforge.llm.chroma import _Index, Settings, align, bit_error, bit_errors, chroma, filter_bank, fingerprint, fingerprints, read_wav, tone_series
from locusforge.llm.registry import TONES

S = Settings(rate=4000, frame=1024, hop=256, low=100, high=1900)


def wav(samples, rate=4000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat((np.clip(samples, -1, 1) * 30000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def brute_bits(image, t):
    bits = 0
    for kind, y, h, w in filter_bank():
        block = image[t : t + w].astype(float)
        own = block[:, y : y + h]
        part = {0: own[:, : h // 2], 1: own[: w // 2], 3: own[:, h // 4 : h - h // 4], 4: own}.get(kind)
        p = part.sum() if part is not None else own[: w // 2, : h // 2].sum() + own[w // 2 :, h // 2 :].sum()
        rest = (block if kind == 4 else own).sum() - p
        v = np.log((1 + p) / (1 + max(rest, 0)))
        level = int(v > -0.25) + int(v > 0) + int(v > 0.25)
        bits = bits << 2 | (level ^ level >> 1)
    return bits


def tune(seed, n=60):
    return tone_series((np.random.default_rng(seed).random(n) - 0.5).tolist(), S)


def test_integral_filters_match_plain_sums():
    x = tune(1)
    image, got = chroma(x, S), fingerprint(x, S)
    assert [brute_bits(image, t) for t in range(len(got))] == got.tolist()


def test_pitch_classes_ignore_octaves():
    t = np.arange(8000) / 4000
    a, b, c = (chroma(np.sin(2 * np.pi * f * t), S).mean(0).argmax() for f in (220, 440, 247))
    assert a == b == 0 and c == 2


def test_excerpts_noise_and_others(spark):
    rng = np.random.default_rng(0)
    long = np.concatenate([tune(1), tune(2)])
    part = long[10_000:34_000] + 0.02 * rng.normal(size=24_000)
    rows = [
        (100, wav(long)), (1, wav(part)), (2, wav(np.repeat(long, 2), rate=8000, channels=2)), (3, wav(tune(3))), (4, wav(long)), (5, None), (6, b"no wav"), (7, b""),
        (8, wav(np.zeros(9000))), (9, wav(tune(4)[:3000])), (200, wav(tune(3))), (None, wav(tune(5))), (3, wav(tune(3))), (300, None),
    ]
    df = spark.createDataFrame([(i, bytearray(w) if w is not None else None, 1, "x") for i, w in rows], "media_id long, audio binary, prints int, class_id string")
    got = align(fingerprints(df, settings=S), F.col("media_id") % 100 == 0).collect()
    assert len(got) == len(rows)
    by = {r.media_id: r for r in got}
    assert by[100].class_id == by[4].class_id == by[2].class_id == 2 and by[200].class_id == by[3].class_id == 3
    links = {x.class_id: x for x in by[100].links}
    assert set(links) == {1} and links[1].error < 0.1 and abs(links[1].offset) in range(38, 41)
    assert by[4].links == [] and by[4].is_query is False and by[200].n_links == 0 and by[5].n_prints == 0 and by[300].n_links == 0
    assert align(fingerprints(df.limit(0), settings=S), F.lit(True)).count() == 0


def test_search_against_all_pairs(spark):
    """Recall against brute force over every pair of recordings and every offset."""
    rng = np.random.default_rng(4)
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").limit(50).collect()
    values = [np.array(r.embedding) + rng.normal(0, 0.008 * k, 64) for k in range(5) for r in base]
    prints = [fingerprint(tone_series(v.tolist(), TONES), TONES) for v in values]
    query = F.col("media_id") % 20 == 0
    table = fingerprints(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>"), media_col="embedding", id_col="vec_id", settings=TONES, reader=tone_series)
    got = {(r.media_id, x.class_id) for r in align(table, query, most_error=0.25, least_overlap=48).collect() for x in r.links}
    want = set()
    for i in range(0, len(values), 20):
        for j in range(len(values)):
            a, b = prints[i], prints[j]
            errors = []
            for d in range(-(len(a) - 48), len(b) - 47):
                x, y = (a[-d:], b[: len(a) + d]) if d < 0 else (a[: len(b) - d], b[d:])
                n = min(len(x), len(y))
                errors.append(np.bitwise_count(x[:n] ^ y[:n]).sum() / 32 / n)
            if i != j and min(errors) <= 0.25:
                want.add((i, j))
    assert len(want) >= 4 and len(got & want) >= 0.95 * len(want) and got <= want


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(0, 0.15, (30, 64))
    values = np.concatenate([base, base + rng.normal(0, 0.01, base.shape), base[:10]])
    table = fingerprints(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "`vec.id` long, embedding array<double>"), media_col="embedding", id_col="vec.id", settings=TONES, reader=tone_series)
    table = spark.createDataFrame(table.collect(), table.schema)
    ask = lambda **o: sorted(map(str, align(table, F.col("media_id") % 3 == 0, most_error=0.25, least_overlap=48, **o).collect()))
    want = ask()
    assert sum("class_id=" in r for r in want) == 70 and ask(block=4) == want
    monkeypatch.setattr("locusforge.llm.chroma.BLOCK_PRINTS", 300)
    assert ask() == want


def test_many_bit_errors_are_the_single_ones():
    rng = np.random.default_rng(3)
    prints = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (5, 0, 40, 17)]
    at = [(i, j, d) for i in range(4) for j in range(4) for d in (-50, -3, 0, 2, 16, 60)]
    errors, n = bit_errors(prints, prints, *(np.array(c) for c in zip(*at)))
    for (i, j, d), e, k in zip(at, errors, n):
        want, m = bit_error(prints[i], prints[j], d)
        assert k == m and np.isclose(e, want)


def test_votes_are_those_of_a_plain_count(monkeypatch):
    """Pieces of votes of any size give each offset with enough of them, once."""
    rng = np.random.default_rng(9)
    ours, theirs = ([rng.choice(np.array([7, 0x50007, 0x50009, 1 << 31], np.uint32), n) for n in sizes] for sizes in ((9, 0, 30, 4), (12, 25, 0)))
    votes = Counter()
    for i, a in enumerate(ours):
        for j, b in enumerate(theirs):
            for x in range(len(a)):
                for y in range(len(b)):
                    if (x and a[x] == a[x - 1]) or (y and b[y] == b[y - 1]):
                        continue
                    votes[i, j, x - y] += int(a[x] & 0xFFFF == b[y] & 0xFFFF) + int(a[x] >> 16 == b[y] >> 16)
    for least in (1, 2, 5):
        for most in (1, 100, 1 << 20):
            monkeypatch.setattr("locusforge.llm.chroma.PIECE_VOTES", most)
            got = [k for piece in _Index([1, 2, 3], theirs).voted(ours, least) for k in zip(*(c.tolist() for c in piece))]
            assert sorted(got) == sorted(k for k, n in votes.items() if n >= least)
    assert not [p for p in _Index([], []).voted(ours, 2) if len(p[0])]


def test_votes_of_like_recordings_are_counted_in_bounded_memory():
    trill = np.tile(np.array([5, 9], np.uint32), 64)
    index = _Index(list(range(32)), [trill] * 32)
    tracemalloc.start()
    found = sum(len(mine) for mine, _, _ in index.voted([trill] * 32, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 32 * 32 * 253 and peak < 100 << 20


def test_wav_reading():
    assert len(read_wav(None, S)) == 0 and len(read_wav(wav(np.zeros(0)), S)) == 0
    x = tune(7)
    assert np.allclose(read_wav(wav(x / 2, channels=2), S), x / 2 * 30000 / 32768, atol=1e-3)

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from locusforge.llm.byte_bpe import ByteBpe, byte_alphabet, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world's 12345 tests!!", "naïve café — 日本語のテキスト 🤦🏽‍♂️🏳️‍🌈", "a" * 5000, "é" * 3000, "  \u0085​ x",
    "don't we'll I'VE 'em", "\x00\x1c\x1f ctrl", "مرحبا بالعالم", "Ünïcödé" * 200, "<|endoftext|> ok", "word " * 40_000, "ﷺ ᠎٣४",
]


@pytest.fixture(scope="module")
def bpe(spark):
    return ByteBpe(spark, PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, "no id", "y", 4), (1, "", "z", 5)], "doc_id long, text string, ids string, n_tokens int")


def test_ids_offsets_and_round_trip(spark, bpe, reference):
    encoded = bpe.encode(frame(spark))
    rows = encoded.collect()
    assert len(rows) == len(TEXTS) + 2
    table = {r.id: r for r in rows}
    for i, text in enumerate(TEXTS):
        r = table[i]
        assert r.ids == reference.encode_ordinary(text or "")
        if text:
            assert r.starts[0] == 0 and r.ends[-1] == len(text)
            covered = set()
            for a, b in zip(r.starts, r.ends):
                assert a < b
                covered.update(range(a, b))
            assert covered == set(range(len(text)))
    for r in bpe.decode(encoded).collect():
        if r.id is not None:
            assert r.text == (TEXTS[r.id] or "") and bytes(r.bytes) == (TEXTS[r.id] or "").encode()


def test_split_characters_decode_together(spark, bpe):
    rows = bpe.encode(spark.createDataFrame([(1, "🤦🏽")], "doc_id long, text string")).first()
    assert len(rows.ids) > 2
    parts = spark.createDataFrame([(1, rows.ids[:1]), (2, rows.ids), (3, None)], "id long, ids array<int>")
    got = {r.id: r.text for r in bpe.decode(parts).collect()}
    assert got == {1: None, 2: "🤦🏽", 3: ""}


def test_digests(spark, bpe, reference):
    for r in bpe.digest(frame(spark)).collect():
        if r.doc_id is None or r.doc_id >= len(TEXTS):
            continue
        ids = reference.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digest(frame(spark).limit(0)).count() == 0


def test_alphabet_is_one_to_one():
    assert len(set(byte_alphabet())) == 256


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "`d.id` long, `te.xt` string")
    got = {r.doc_id: r.n_tokens for r in ByteBpe(spark, PATH, P.PATTERN).digest(df, text_col="te.xt", id_col="d.id").collect()}
    assert got == {1: 2, 2: 0}

"""Byte-level BPE with the ``tokenizers`` library, from a table of byte strings and ranks.

The library works on characters, so each byte stands for one character of a fixed alphabet; decoding reverses that table
on whole id sequences, so that a character split over several tokens comes out right. The library wants merge pairs, and
a rank table has none: the pair of a token is what encoding its own bytes by the lower ranks leaves. A piece that is
itself in the table is taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.common import quoted, slices

#: UTF-8 bytes encoded at once: bounds what the library holds.
CHUNK_BYTES = 2 << 20


def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for byte in range(256):
        out.append(chr(byte) if byte in shown else chr(extra))
        extra += byte not in shown
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a file with a base64 string and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def parts_below(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """``token`` encoded by the ranks below ``rank``: lowest first, leftmost of equals."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank), default=None)
        if best is None:
            break
        at = best[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's description of a tokenizer that encodes as the ranks do."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    letters = byte_alphabet()
    shown = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            pair = parts_below(token, rank, ranks)
            if len(pair) == 2:  # else no sequence of merges leads to it, and only a whole piece can be this token
                merges.append((shown[pair[0]], shown[pair[1]]))
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


def description(path: str, pattern: str) -> str:
    """``tokenizer_json`` of a rank table's file; made once for each content."""
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    return _described(path, pattern, digest)


@lru_cache(maxsize=2)
def _described(path: str, pattern: str, digest: str) -> str:
    return tokenizer_json(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _loaded(description: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(description)


@lru_cache(maxsize=2)
def _bytes_of(description: str) -> list[bytes]:
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = json.loads(description)["model"]["vocab"]
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token)
    return out


def decode(ids, table: list[bytes]) -> bytes:
    """Bytes of a whole id sequence; joined before any reading as UTF-8, so split characters are whole again."""
    return b"".join([table[i] for i in ids])


def _encoded(texts: list[str], tokenizer, offsets: bool) -> Iterator:
    encode = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield from encode(texts[start : i + 1], add_special_tokens=False)
            start, size = i + 1, 0


class ByteBpe:
    """Encoding and decoding of DataFrame columns by one rank table."""

    def __init__(self, spark, path: str, pattern: str):
        #: Fixed size: it follows the vocabulary, not the data.
        self._shared = spark.sparkContext.broadcast(description(path, pattern))

    def encode(self, df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """``id, ids, starts, ends``: token ids of each whole text, and the characters that each token covers.

        ``starts`` and ``ends`` count code points. Tokens that share a character each have its offsets. A null text counts
        as empty and has no ids. Rows that repeat are encoded each for itself; an empty table gives an empty result.
        """
        shared = self._shared

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizer = _loaded(shared.value)
            for batch in slices(batches, max_bytes=2 << 20):
                ids, starts, ends = [], [], []
                for e in _encoded(_texts(batch.column(1)), tokenizer, True):
                    ids.append(e.ids)
                    starts.append([a for a, _ in e.offsets])
                    ends.append([b for _, b in e.offsets])
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, kind), pa.array(starts, kind), pa.array(ends, kind)], names=["id", "ids", "starts", "ends"])

        return _input(df, text_col, id_col).mapInArrow(over, "id long, ids array<int>, starts array<int>, ends array<int>")

    def decode(self, df: DataFrame, *, ids_col: str = "ids", id_col: str = "id") -> DataFrame:
        """``id, bytes, text``: a null list counts as empty; text is null if the bytes are not UTF-8; an unknown id raises."""
        shared = self._shared

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _bytes_of(shared.value)
            for batch in slices(batches):
                found = [decode(row.as_py() or [], table) for row in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array([_utf8(b) for b in found], pa.string())], names=["id", "bytes", "text"])

        return df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(ids_col)).cast("array<int>").alias("ids")).mapInArrow(over, "id long, bytes binary, text string")

    def digest(self, df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row's ids and of what they decode to.

        Encoding and decoding meet in one pass, so that ids need not travel. Cases are those of ``encode``.
        """
        shared = self._shared

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizer, table = _loaded(shared.value), _bytes_of(shared.value)
            for batch in slices(batches, max_bytes=2 << 20):
                n, of_ids, of_bytes = [], [], []
                for e in _encoded(_texts(batch.column(1)), tokenizer, False):
                    ids = e.ids
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    of_bytes.append(hashlib.sha256(decode(ids, table)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return _input(df, text_col, id_col).mapInArrow(over, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))


def _texts(column: pa.Array) -> list[str]:
    return column.to_pylist()


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None

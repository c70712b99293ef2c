"""Toxicity by a factorization machine over hashed terms.

A term is a word or the beginning of one. Terms are hashed into a table of fixed size; each bucket has a weight and a
small vector, and a document's logit is the sum of its buckets' weights plus, for each pair of its buckets, the product of
their vectors. The pairs catch what weights alone miss, such as an insult next to the name of a group.

Of all hashed terms those enter the machine whose own slope, where they have no weight yet, exceeds a penalty in standard
deviations (the condition of an absolute-value penalty for a weight to leave zero). Where the fit still errs, pairs of terms
are tried in the same way, so that a pair whose members are even between the labels enters too. There is no cap on either.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusforge.llm.common import cut, quoted, slices, unused

#: Labelled documents used at most for fitting, those with the smallest hash of their identifier.
MAX_LABELLED = 20_000
#: Size of the hash table.
BUCKETS = 1 << 20
#: Penalty on a term: least square of its slope in standard deviations.
MIN_SPREAD = 12.0
#: Penalty on a pair of terms: least slope in standard deviations, and least documents with both. There are more pairs.
PAIR_SPREAD, PAIR_DOCUMENTS = 6.0, 5
#: A pair is sought if its members are in at least this share of the documents that the fit gets wrong, and these are so many.
PAIR_SHARE, MISFITS = 0.2, 10
PAIR_ROUNDS = 3
#: Lengths, in characters, of word beginnings that count as terms.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
FACTORS = 8
#: Terms of documents that a step of fitting handles at once.
CHUNK_TERMS = 1 << 17
_CACHE_WORDS = 100_000
_SEPARATORS = bytes(i for i in range(128) if not chr(i).isalpha())
_SPACES = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: str) -> set[bytes]:
    """Distinct words in lower case: runs of letters and of anything that is not ASCII."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split())


def term_buckets(word: bytes) -> tuple[int, ...]:
    """Hash buckets of a word and of its beginnings."""
    letters = word.decode("utf-8", "replace")
    terms = [b"=" + word, *[b"^" + letters[:n].encode("utf-8", "replace") for n in BEGINNINGS if len(letters) >= n]]
    return tuple(zlib.crc32(t) & (BUCKETS - 1) for t in terms)


@dataclass(frozen=True)
class Machine:
    """``buckets`` sorted; ``bias``, ``weights`` and ``factors`` of a second-order factorization machine."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, positions: np.ndarray) -> float:
        """Of a document with the given distinct positions in ``buckets``."""
        if not len(positions):
            return self.bias
        v = self.factors[positions]
        total = v.sum(0)
        return float(self.bias + self.weights[positions].sum() + 0.5 * (total @ total - (v * v).sum()))


    def error(self, label: float, terms: np.ndarray) -> float:
        """Probability less ``label`` of a document with these distinct buckets."""
        return float(sigmoid(self.logit(np.flatnonzero(np.isin(self.buckets, terms, assume_unique=True)))) - label)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_machine(buckets: np.ndarray, documents: list[np.ndarray], labels: np.ndarray, *, factors: int = FACTORS, steps: int = 300, rate: float = 0.05, decay: float = 0.2, pair_decay: float = 0.5, seed: int = 7) -> Machine:
    """Fit by full-batch Adam on the mean log loss with squared penalties. ``documents``: positions in ``buckets``."""
    n, m = len(documents), len(buckets)
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean() if n else 0.5, 0.01, 0.99)
    bias, weights, table = float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.02, (m, factors))
    if not n or not m:
        return Machine(buckets, bias if n else -1.0, weights.astype(np.float32), (table * 0).astype(np.float32))
    sizes = np.array([len(d) for d in documents], np.int64)
    ends = np.cumsum(sizes)
    # Parts of the documents with about CHUNK_TERMS terms each bound what a step holds.
    cuts = sorted({0, n, *np.searchsorted(ends, np.arange(CHUNK_TERMS, int(ends[-1]), CHUNK_TERMS)).tolist()})
    parts = [_part(documents[low:high], labels[low:high]) for low, high in zip(cuts, cuts[1:])]
    state = [np.zeros((m, factors + 1)), np.zeros((m, factors + 1))]
    of_bias = np.zeros(2)
    for step in range(1, steps + 1):
        # Factors of each term, and what it adds to a logit by itself, side by side.
        both = np.concatenate([table, (weights - 0.5 * (table * table).sum(1))[:, None]], 1).astype(np.float32)
        slope = np.concatenate([pair_decay * table / n, (decay * weights / n)[:, None]], 1)
        at_bias = 0.0
        for part in parts:
            sums = np.zeros((len(part.labels), factors + 1), np.float32)
            sums[part.filled] = np.add.reduceat(both.take(part.terms, 0), part.starts, 0) if len(part.starts) else 0
            logit = bias + sums[:, -1] + 0.5 * (sums[:, :-1] * sums[:, :-1]).sum(1)
            error = (sigmoid(logit) - part.labels) / n
            at_bias += error.sum()
            sums[:, -1] = 1
            sums *= error[:, None].astype(np.float32)
            if len(part.own):
                found = np.add.reduceat(sums.take(part.owners, 0), part.firsts, 0)
                slope[part.own] += found
                slope[part.own, :-1] -= table[part.own] * found[:, -1:]
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.999 * state[1] + 0.001 * slope * slope
        of_bias = np.array([0.9, 0.999]) * of_bias + np.array([0.1, 0.001]) * np.array([at_bias, at_bias**2])
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        moved = rate * (state[0] / fix1) / (np.sqrt(state[1] / fix2) + 1e-9)
        bias -= rate * (of_bias[0] / fix1) / (math.sqrt(of_bias[1] / fix2) + 1e-9)
        table, weights = table - moved[:, :-1], weights - moved[:, -1]
    return Machine(buckets, float(bias), weights.astype(np.float32), table.astype(np.float32))


@dataclass(frozen=True)
class _Part:
    """Documents side by side: ``terms`` one after the other, where each document with terms (``filled``) begins; and the same
    by term: ``own`` terms, where each begins in ``owners``."""

    labels: np.ndarray
    terms: np.ndarray
    filled: np.ndarray
    starts: np.ndarray
    own: np.ndarray
    owners: np.ndarray
    firsts: np.ndarray


def _part(documents: list[np.ndarray], labels: np.ndarray) -> _Part:
    sizes = np.array([len(d) for d in documents], np.int64)
    terms = np.concatenate(documents).astype(np.int64)
    filled = np.flatnonzero(sizes)
    order = np.argsort(terms, kind="stable")
    own, firsts = np.unique(terms[order], return_index=True)
    return _Part(labels, terms, filled, (np.cumsum(sizes) - sizes)[filled], own, np.repeat(np.arange(len(documents)), sizes)[order], firsts)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, tuple[int, ...]] = {}
    for batch in slices(batches, max_bytes=2 << 20):
        out = []
        for text in batch.column(1):
            found: set[int] = set()
            for word in words_of(text.as_py() or ""):
                if word not in cache:
                    if len(cache) >= _CACHE_WORDS:
                        cache.clear()
                    cache[word] = term_buckets(word)
                found.update(cache[word])
            out.append(np.sort(np.fromiter(found, np.int32, len(found))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["y", "terms"])


def fit(texts: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Machine:
    """Fit on the labelled rows of ``texts``.

    At most ``max_labelled`` identifiers take part (smallest hash first). Labels other than 0 and 1, null labels and null
    identifiers are left out; of repeated labels the larger counts. Without labelled rows the model says "not toxic".
    """
    label, key = F.col(quoted(label_col)), F.col(quoted(id_col))
    one = labels.where(label.isin(0, 1) & key.isNotNull()).groupBy(key.cast("long").alias("x_id")).agg(F.max(label.cast("int")).alias("y"))
    chosen = one.orderBy(F.xxhash64("x_id"), "x_id").limit(max_labelled)
    # Bounded by max_labelled rows of two numbers.
    rows = texts.select(key.cast("long").alias("x_id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(chosen), "x_id")
    terms = cut(rows.select("y", "text").mapInArrow(_document_terms, "y int, terms array<int>"))
    n, positive = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return fit_machine(np.zeros(0, np.int64), [], np.zeros(0))
    each = terms.select("y", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("t"))
    # Square of each bucket's slope over its variance; both directions inform. Bounded with the labelled rows.
    want = F.col("c") * F.lit(positive / n)
    spread = (F.col("t") - want) * (F.col("t") - want) / (want * F.lit(max(1e-9, 1 - positive / n)) + F.lit(0.5))
    uneven = each.where("c >= 3").where(spread >= MIN_SPREAD).select("bucket").toArrow()
    machine = _fit_on(terms, uneven.column(0).to_numpy())
    for _ in range(PAIR_ROUNDS):
        more = np.setdiff1d(_paired_buckets(terms, machine), machine.buckets)
        if not len(more):
            break
        machine = _fit_on(terms, np.concatenate([machine.buckets, more]))
    return machine


def _fit_on(terms: DataFrame, buckets: np.ndarray) -> Machine:
    buckets = np.sort(buckets.astype(np.int64))
    documents, y = _local(terms, buckets)
    order = sorted(range(len(documents)), key=lambda i: (y[i], documents[i].tobytes()))  # sums then agree between runs
    return fit_machine(buckets, [documents[i] for i in order], y[order])


def _local(terms: DataFrame, buckets: np.ndarray, machine: Machine | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Positions in ``buckets`` of each labelled document's terms; and its label, or the error of ``machine`` on it."""
    local = terms.mapInArrow(_positions(buckets, machine), "y double, positions array<int>").toArrow().combine_chunks()
    lists = local.column("positions").combine_chunks()
    flat, offsets = lists.values.to_numpy().astype(np.int32), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])], local.column("y").to_numpy()


def pair_slopes(documents: list[np.ndarray], errors: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of ``m`` terms its slope in standard deviations, and the documents that have both."""
    slope, spread, both = (np.zeros((m, m), np.float32) for _ in range(3))
    for at in range(0, len(documents), 1024):
        part = documents[at : at + 1024]
        has = np.zeros((len(part), m), np.float32)
        has[np.repeat(np.arange(len(part)), [len(d) for d in part]), np.concatenate(part)] = 1
        error = errors[at : at + 1024].astype(np.float32)[:, None]
        slope += has.T @ (has * error)
        spread += has.T @ (has * (np.abs(error) * (1 - np.abs(error))))
        both += has.T @ has
    return slope / np.sqrt(spread + 0.5), both


def _paired_buckets(terms: DataFrame, machine: Machine) -> np.ndarray:
    """Buckets of pairs that explain what ``machine`` gets wrong."""

    def misfits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for y, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = own.values.to_numpy()
                if abs(machine.error(y, at)) >= 0.5:
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32())], names=["bucket"])

    counts = cut(terms.mapInArrow(misfits, "bucket int").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    wrong = counts.where("bucket = -1").first()
    if wrong is None or wrong.n < MISFITS:
        return np.zeros(0, np.int64)
    # No more than a document's terms divided by the share.
    common = np.sort(counts.where((F.col("bucket") >= 0) & (F.col("n") >= PAIR_SHARE * wrong.n)).select("bucket").toArrow().column(0).to_numpy().astype(np.int64))
    documents, errors = _local(terms, common, machine)
    z, both = pair_slopes(documents, errors, len(common))
    found = (np.abs(z) >= PAIR_SPREAD) & (both >= PAIR_DOCUMENTS)
    np.fill_diagonal(found, False)
    return common[found.any(0)]


def _positions(buckets: np.ndarray, machine: Machine | None):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, values = [], []
            for y, terms in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms.values.to_numpy()
                out.append(np.flatnonzero(np.isin(buckets, own, assume_unique=True)).astype(np.int32))
                values.append(float(y) if machine is None else machine.error(y, own))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), pa.array(out, pa.list_(pa.int32()))], names=["y", "positions"])

    return over


def _scores(machine: Machine, at: int):
    place = {int(b): i for i, b in enumerate(machine.buckets)}

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, tuple[int, ...]] = {}
        for batch in slices(batches, max_bytes=2 << 20):
            out = []
            for text in batch.column(at):
                found: set[int] = set()
                for word in words_of(text.as_py() or ""):
                    own = cache.get(word)
                    if own is None:
                        if len(cache) >= _CACHE_WORDS:
                            cache.clear()
                        own = cache[word] = tuple(place[b] for b in term_buckets(word) if b in place)
                    if own:
                        found.update(own)
                out.append(machine.logit(np.array(sorted(found), np.int64)))
            score = sigmoid(np.array(out, float))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *batch.columns[at + 1 :], pa.array(score)], names=[*[f"c_{i}" for i in range(batch.num_columns - 1)], "score"])

    return over


def score(df: DataFrame, machine: Machine, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``df`` with ``score_col``, the model's probability in 0 to 1; no shuffle.

    Null and empty texts get the score of a document without terms. A column already named ``score_col`` is replaced.
    """
    kept = [c for c in df.columns if c != score_col]
    schema = T.StructType([*[T.StructField(f"c_{i}", df.schema[c].dataType) for i, c in enumerate(kept)], T.StructField("score", T.DoubleType())])
    scored = df.select(*[F.col(quoted(c)).alias(f"c_{i}") for i, c in enumerate(kept)], F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(_scores(machine, len(kept)), schema)
    return scored.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)], F.col("score").alias(score_col))


def drop_toxic(df: DataFrame, machine: Machine, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with their columns as they were; cases as in ``score``."""
    own = unused(df, "toxicity")
    return score(df, machine, text_col=text_col, score_col=own).where(F.col(own) < threshold).select(*[quoted(c) for c in df.columns])

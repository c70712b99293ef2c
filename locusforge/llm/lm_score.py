"""Language-model scores: a word-frequency base, and a causal self-attention model over subword ids.

A text is its words in lower case and one end. The base is the smoothed frequency of each in the training rows; counts of
all words stay distributed, and only the most frequent words (a fixed number) travel to every executor.

The model spells each word in subword ids of a given vocabulary and predicts each id from those before it: first a class of
ids of like frequency and then the id in the class, both from what attention made of the window. So every id sequence has a
probability. Texts are split and spelled once, into shared storage. The model is fitted in two steps: on the driver on a
bounded sample of windows, and from there on every partition on all its training windows, where the partitions' models are
averaged by the windows they saw.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.llm.attention import Adam, Attention, Tree, copy_of, log_probabilities, make_tree, new_attention
from locusforge.llm.byte_bpe import _bytes_of, _loaded, description
from locusforge.llm.common import hold_freed, quoted, slices, stash

#: Words sent to all executors at most; none has more than ``KEY_BYTES`` and a digest's few.
FREQUENT_WORDS = 1 << 18
#: A longer word goes by a space, which no word has, and its SHA-256.
KEY_BYTES = 64
WIDTH, INNER, WINDOW, STRIDE = 16, 32, 32, 28
#: All windows of the training rows take part in fitting; the driver's first model, where it starts from, sees at most so many.
FIRST_WINDOWS = 12_000
FIRST_BATCH, BATCH_WINDOWS = 64, 512
#: Step length of the partitions' fits.
RATE = 3e-3
_COUNTED_WORDS = 200_000
_BLOCK = 4096
END = b""


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after the other, and how many each has; nulls have none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # beside white space at an end, and of empty texts
    if blank.any():
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[blank], minlength=len(sizes))
        words = words.filter(pa.array(~blank))
    return words, sizes


def _bytes_each(words: pa.Array) -> list[bytes]:
    """Of strings without nulls; as ``to_pylist`` of binary, but several times faster."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    raw = words.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


# ---------------------------------------------------------------- counts


def key_of(word: bytes) -> bytes:
    return word if len(word) <= KEY_BYTES else b" " + hashlib.sha256(word).hexdigest().encode()


def _keyed(words: pa.Array) -> pa.Array:
    """``key_of`` each."""
    long = pc.greater(pc.binary_length(words), KEY_BYTES)
    if not pc.any(long).as_py():
        return words
    return pc.replace_with_mask(words, long, pa.array([key_of(w) for w in _bytes_each(words.filter(long))], pa.binary()).cast(pa.string()))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "n"]
    counts, fresh, ends = [], 0, 0  # tables to add up, their rows since that was done, and texts
    for batch in slices(batches, max_bytes=2 << 20):
        found = pc.value_counts(split_words(batch.column(0))[0])
        counts.append(pa.table([_keyed(found.field(0)), found.field(1)], names=names))
        fresh, ends = fresh + len(found), ends + batch.num_rows
        if fresh > _COUNTED_WORDS:
            counts, fresh = [_added(counts)], 0
            if len(counts[0]) > _COUNTED_WORDS:
                yield from counts[0].to_batches()
                counts = []
    if ends:
        yield from _added([*counts, pa.table([pa.array([END.decode()]), pa.array([ends], pa.int64())], names=names)]).to_batches()


def _added(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over the texts of a one-column DataFrame; the end is the empty word."""
    return stash(texts.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


def frequent_words(counts: DataFrame, most: int = FREQUENT_WORDS) -> pa.Table:
    """All words with at least a count chosen so that they are no more than ``most``."""
    steps = sorted(counts.groupBy(F.floor(F.log2("c") * 4).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r.step)
    held, least = 0, None
    for r in steps:
        if held + r.n > most:
            break
        held, least = held + r.n, r.least
    if least is None:
        return pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
    return counts.where(F.col("c") >= least).select("word", "c").toArrow()


# ---------------------------------------------------------------- spelling


#: What the quick spelling knows how to take apart.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer words, and those with more than ASCII's visible characters and the letters U+00C0 to U+00FF, or with an apostrophe, are
#: spelled by the tokenizer.
PLAIN_BYTES = 32
_NONE, _SLOT_BITS = np.iinfo(np.int32).max, 18


@dataclass
class Merges:
    """Pairs of ids that merge, and into which; the lowest goes first. Pairs go by ``left * size + right``, each in the slot that
    its hash gives, or where another had that, among the ``others``, in order. ``of_bytes``: id of each byte; ``of_pairs``: what
    two bytes merge into."""

    size: int
    keys: np.ndarray
    into: np.ndarray
    others: np.ndarray
    others_into: np.ndarray
    crowded: np.ndarray
    of_bytes: np.ndarray
    of_pairs: np.ndarray

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)

    @classmethod
    def make(cls, size: int, keys: np.ndarray, into: np.ndarray, of_bytes: np.ndarray) -> Merges:
        slots = cls.slot(keys)
        _, one = np.unique(slots, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), one)
        rest = rest[np.argsort(keys[rest])]
        table, out, crowded = np.full(1 << _SLOT_BITS, -1, np.int64), np.full(1 << _SLOT_BITS, _NONE, np.int32), np.zeros(1 << _SLOT_BITS, bool)
        table[slots[one]], out[slots[one]], crowded[slots[rest]] = keys[one], into[one], True
        found = cls(size, table, out, keys[rest], into[rest], crowded, of_bytes, np.zeros((0, 0), np.int32))
        found.of_pairs = found.of(np.repeat(of_bytes, 256), np.tile(of_bytes, 256)).reshape(256, 256)
        return found

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        slots = self.slot(wanted)
        met = self.keys[slots] == wanted
        out = np.where(met, self.into[slots], _NONE)
        more = np.flatnonzero(self.crowded[slots] & ~met)
        if len(more):
            at = self.others.searchsorted(wanted[more])
            out[more] = np.where(self.others.take(at, mode="clip") == wanted[more], self.others_into.take(at, mode="clip"), _NONE)
        return out


@lru_cache(maxsize=2)
def _merges(description: str) -> Merges | None:
    """None where the pattern is another, or merging does not lead to every token in the order of ids."""
    made = json.loads(description)
    model = made["model"]
    vocab, size = model["vocab"], max(model["vocab"].values(), default=-1) + 1
    pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    tokens = _bytes_of(description)
    of_bytes = np.full(256, -1, np.int32)
    for i, token in enumerate(tokens):
        if len(token) == 1:
            of_bytes[token[0]] = i
    whole = made["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == PLAIN_PATTERN and not made.get("normalizer") and not made.get("added_tokens")
    into = np.array([c for *_, c in pairs], np.int32)
    if not whole or (of_bytes < 0).any() or len(pairs) != sum(len(t) > 1 for t in tokens) or (np.diff(into) <= 0).any():
        return None
    keys = np.array([a * size + b for a, b, _ in pairs], np.int64)
    return Merges.make(size, keys, into, of_bytes)


_CLASS = np.full(256, 3, np.uint8)  # of bytes: letters, digits, others; the space is none
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]], _CLASS[[*b"0123456789"]], _CLASS[32] = 1, 2, 0
_CLASS[0x80:0xC0], _CLASS[0xC3] = 1, 1  # the letters U+00C0 to U+00FF
_ODD = np.ones(256, bool)
_ODD[33:127], _ODD[0x80:0xC0], _ODD[0xC3], _ODD[ord("'")] = False, False, False, True


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings without nulls, one after the other, and where each begins, with the end of all."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _merged(raw: np.ndarray, bounds: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """As ``_spelled`` for plain words, none empty: all their pieces are merged side by side, in each turn the lowest pairs of
    every piece."""
    sizes = np.diff(bounds)
    begin = bounds[:-1] + np.arange(len(sizes))
    shown = np.full(len(raw) + len(sizes), 32, np.uint8)
    shown[np.arange(len(raw)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = raw
    head = np.zeros(len(shown), bool)
    head[begin] = True
    kind = _CLASS[shown]
    head[1:] |= (kind[1:] != kind[:-1]) & (shown[:-1] != 32)
    ids, place, made = merges.of_bytes[shown], np.arange(len(shown)), np.full(len(shown), -1, np.int32)
    pair = np.full(len(shown), _NONE, np.int32)
    pair[:-1] = merges.of_pairs[shown[:-1], shown[1:]]
    pair[:-1][head[1:]] = _NONE
    while len(ids):
        heads = np.flatnonzero(head)
        least = np.repeat(np.minimum.reduceat(pair, heads), np.diff(heads, append=len(ids)))
        goes = least < _NONE
        if 4 * np.count_nonzero(goes) < 3 * len(ids):  # pieces that have no more to merge are put down
            made[place[~goes]] = ids[~goes]
            ids, pair, head, place, least = ids[goes], pair[goes], head[goes], place[goes], least[goes]
            goes = goes[goes]
        hit = np.flatnonzero((pair == least) & goes)
        if not len(hit):
            made[place] = ids
            break
        new = np.concatenate([[True], np.diff(hit) > 1])
        if not new.all():  # of hits that overlap, each second one from the left
            turn = np.arange(len(hit))
            hit = hit[(turn - np.maximum.accumulate(np.where(new, turn, 0))) % 2 == 0]
        ids[hit] = pair[hit]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        ids, pair, head, place = ids[keep], pair[keep], head[keep], place[keep]
        own = hit - np.arange(len(hit))
        own = np.concatenate([own, own[~head[own]] - 1])
        pair[own] = _NONE
        own = own[own + 1 < len(ids)]
        own = own[~head[own + 1]]
        pair[own] = merges.of(ids[own], ids[own + 1])
    left = np.flatnonzero(made >= 0)
    return made[left], np.diff(np.searchsorted(left, begin), append=len(left))


def spell(words: pa.Array, description: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has. A word is spelled with a space before it."""
    raw, bounds = _letters(words)
    sizes, merges = np.diff(bounds), _merges(description)
    odd = (sizes > PLAIN_BYTES) | (sizes == 0)
    strange = _ODD[raw]
    strange[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # the signs of times and division
    odd[np.searchsorted(bounds, np.flatnonzero(strange), "right") - 1] = True
    if merges is None:
        odd[:] = True
    if not odd.any():
        return _merged(raw, bounds, merges)
    others, more = _spelled(_bytes_each(words.filter(pa.array(odd))), description)
    if odd.all():
        return others, more
    plain, fewer = _merged(*_letters(words.filter(pa.array(~odd))), merges)
    lengths = np.empty(len(words), np.int64)
    lengths[odd], lengths[~odd] = more, fewer
    ids, where = np.empty(len(others) + len(plain), np.int64), np.repeat(odd, lengths)
    ids[where], ids[~where] = others, plain
    return ids, lengths


@lru_cache(maxsize=2)
def _begins_word(description: str) -> np.ndarray:
    return np.array([token[:1] == b" " for token in _bytes_of(description)])


def _spelled(words: list[bytes], description: str, together: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has. A word is spelled with a space before it.

    Words are encoded many to a text, in which each begins at an id that begins with a space; where that does not add up
    (white space beyond ASCII inside words) they are encoded one by one.
    """
    tokenizer, begins = _loaded(description), _begins_word(description)
    shown = [" " + w.decode("utf-8", "replace") for w in words]
    groups = [shown[i : i + together] for i in range(0, len(shown), together)]
    flat, lengths = [], []
    joined = ["".join(g) for g in groups]
    for group, text, e in zip(groups, joined, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
        ids = np.array(e.ids, np.int64)
        starts = np.flatnonzero(begins[ids])
        if len(starts) == len(group) and len(ids) and starts[0] == 0 and text.isprintable():  # the only space that is printable is ASCII's
            flat.append(ids)
            lengths.append(np.diff(np.append(starts, len(ids))))
        else:
            each = [x.ids for x in tokenizer.encode_batch_fast(group, add_special_tokens=False)]
            flat.append(np.array([i for x in each for i in x], np.int64))
            lengths.append(np.array([len(x) for x in each], np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate(flat or [none]), np.concatenate(lengths or [none])


def _number_type(size: int):
    """Of ids, ranks and their few extra values."""
    return np.uint16 if size + 4 < 1 << 16 else np.uint32


@dataclass
class Base:
    """Counts of the frequent words, joined by line ends, and what all counts add up to."""

    words: bytes
    counts: np.ndarray
    tokens: int
    distinct: int

    def scores(self) -> np.ndarray:
        return np.log10((self.counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


class Speller:
    """Ids and base scores of words. What the frequent ones have is held, in arrays by number; others are spelled as they come."""

    def __init__(self, description: str, base: Base):
        self.description = description
        self.kind = _number_type(_loaded(description).get_vocab_size())
        self.words = pa.array(base.words.split(b"\n") if len(base.counts) else [], pa.binary()).cast(pa.string())
        self.score = base.scores()
        ids, self.size = spell(self.words, description)
        self.text = ids.astype(self.kind)
        self.first = np.cumsum(self.size) - self.size

    _last: tuple | None = None

    @classmethod
    def shared(cls, name: str, make: Callable[[], Speller]) -> Speller:
        """The one of that name if this process made it last: tasks of a worker share it."""
        if cls._last is None or cls._last[0] != name:
            cls._last = None
            cls._last = (name, make())
        return cls._last[1]

    @classmethod
    def forget(cls) -> None:
        cls._last = None
        _loaded.cache_clear()
        _merges.cache_clear()

    def score_of(self, word: str) -> float | None:
        at = pc.index_in(word, value_set=self.words).as_py() if len(self.words) else None
        return None if at is None else float(self.score[at])

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of different words: the base score (NaN if not frequent), and the ids of all in one array with first place and size."""
        keyed = _keyed(words)
        found = pc.fill_null(pc.index_in(keyed, value_set=self.words), -1).to_numpy().astype(np.int64)
        known = found >= 0
        score = np.full(len(words), np.nan)
        score[known] = self.score[found[known]]
        held = known & (pc.less_equal(pc.binary_length(words), KEY_BYTES).to_numpy(zero_copy_only=False))  # a key has no letters of its word
        first, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[held], size[held] = self.first[found[held]], self.size[found[held]]
        ids, sizes = spell(words.filter(pa.array(~held)), self.description)
        first[~held], size[~held] = np.cumsum(sizes) - sizes + len(self.text), sizes
        return score, np.concatenate([self.text, ids.astype(self.kind)]), first, size


def _spell_rows(shared):
    """Per row: word count, known words and base over frequent words, the ids, and the words still to be looked up."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, description, base = shared.value
        speller = Speller.shared(name, lambda: Speller(description, base))
        row = TaskContext.get().partitionId() << 40
        of_end = speller.score_of(END.decode())
        for batch in slices(batches, max_bytes=2 << 20, max_rows=1024):
            words, sizes = split_words(batch.column(2))
            distinct = words.dictionary_encode()
            score, text, first, size = speller.look(distinct.dictionary)
            numbers = distinct.indices.to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            logs = score[numbers]
            missing = np.flatnonzero(np.isnan(logs))
            gaps = np.bincount(owner[missing], minlength=len(sizes))
            # The end is counted like a word: here if it is frequent, else with the others.
            known = sizes - gaps + (of_end is not None)
            sums = np.bincount(owner, np.nan_to_num(logs), len(sizes)) + (of_end or 0.0)
            rare = _keyed(words.take(pa.array(missing)))
            if of_end is None:
                order = np.argsort(np.concatenate([owner[missing], np.arange(len(sizes))]), kind="stable")
                rare = pa.concat_arrays([rare, pa.array([END.decode()] * len(sizes))]).take(pa.array(order))
                gaps = gaps + 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(gaps)]), pa.int32()), rare)
            size = size[numbers]
            lengths = np.bincount(owner, size, len(sizes)).astype(np.int64)
            flat = text[np.repeat(first[numbers] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            ends = np.cumsum(lengths)
            ids = [flat[end - n : end].tobytes() for end, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sizes))), batch.column(0), batch.column(1), pa.array(sizes + 1), pa.array(known), pa.array(sums), pa.array(ids, pa.binary()), lists],
                names=["row", "id", "held_out", "n_tokens", "known", "base", "ids", "rare"],
            )
            row += len(sizes)

    return over


# ---------------------------------------------------------------- windows


def _sequences(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, and how many each has."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts or [np.zeros(0, kind)]), np.array([len(p) for p in parts], np.int64)


@dataclass
class Ranks:
    """Rank of each id and of the end, by falling count."""

    of_id: np.ndarray
    tree: Tree

    @property
    def end(self) -> int:
        return int(self.of_id[-1])

    @property
    def unseen(self) -> int:
        """As an input; the next two are the begin of a text and none."""
        return self.tree.seen


def make_ranks(counts: np.ndarray) -> tuple[Ranks, np.ndarray]:
    """For counts of the ids and, last, the end; also the counts by rank."""
    order = np.argsort(-counts, kind="stable")
    of_id = np.empty(len(counts), _number_type(len(counts)))
    of_id[order] = np.arange(len(counts))
    return Ranks(of_id, make_tree(counts[order])), counts[order]


def windows(ranks: Ranks, flat: np.ndarray, lengths: np.ndarray, window: int, stride: int, together: int) -> Iterator[tuple]:
    """Batches of windows over sequences of ids that lie one after the other in ``flat``, each with its end.

    Yields the sequence of each window, inputs, the inputs before them, targets and which targets count. The first window of
    a sequence counts all its targets; each later one ``stride`` more, so that every target but a text's first ones has at
    least ``window - stride`` inputs in its window before it, and each counts once.
    """
    if not len(lengths):
        return
    sizes = lengths + 1
    first = np.cumsum(sizes) - sizes
    targets = np.full(sizes.sum(), ranks.end, ranks.of_id.dtype)
    targets[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = ranks.of_id[flat]
    inputs = np.empty_like(targets)
    np.minimum(targets[:-1], ranks.unseen, out=inputs[1:])
    inputs[first] = ranks.unseen + 1
    before = np.empty_like(targets)
    before[1:] = inputs[:-1]
    before[first] = ranks.unseen + 2
    count = np.where(sizes <= window, 1, 1 + -(-(sizes - window) // stride))
    owner = np.repeat(np.arange(len(sizes)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(sizes[owner], window + stride * turn)
    start = np.maximum(0, end - window) if stride < window else window * turn
    done = np.where(turn == 0, 0, window + stride * (turn - 1))
    steps = np.arange(window)
    for part in np.array_split(np.arange(len(owner)), -(-len(owner) // together)):
        place = start[part, None] + steps
        wanted = (place >= done[part, None]) & (place < end[part, None])
        at = np.minimum(place, end[part, None] - 1) + first[owner[part], None]
        yield owner[part], inputs[at], before[at], targets[at], wanted


def score_sequences(model: Attention, ranks: Ranks, flat: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Natural log probability of each id sequence with its end; every target scored once."""
    out = np.zeros(len(lengths))
    for owner, *arrays in windows(ranks, flat, lengths, model.window, stride, BATCH_WINDOWS):
        logs = log_probabilities(model, ranks.tree, *arrays)
        out += np.bincount(np.repeat(owner, arrays[-1].sum(1)), logs, len(lengths))
    return out


# ---------------------------------------------------------------- model


def _id_counts(size: int, kind):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for batch in slices(batches):
            flat, lengths = _sequences(batch.column(0), kind)
            counts[:size] += np.bincount(flat, minlength=size)
            counts[size] += len(lengths)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["id", "n"])

    return over


def _sampled_windows(kind, window: int, rate: float):
    """Windows side by side of ``window`` ids at places drawn by the text's content: (begins the text, ends it, ids)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for x in batch.column(0):
                raw = x.as_py()
                ids = np.frombuffer(raw, kind)
                starts = np.arange(0, len(ids) + 1, window)
                drawn = np.random.default_rng(zlib.crc32(raw)).random(len(starts)) < rate
                out += [(at == 0, at + window > len(ids), ids[at : at + window].tobytes()) for at in starts[drawn].tolist()]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary())], names=["head", "tail", "w"])

    return over


def _first_fit(model: Attention, ranks: Ranks, rows: list, kind, passes: int) -> None:
    """Fit ``model`` in place on sampled windows."""
    window = model.window
    shape = (len(rows), window)
    inputs, before, targets = (np.zeros(shape, ranks.of_id.dtype) for _ in range(3))
    wanted = np.zeros(shape, bool)
    for i, r in enumerate(rows):
        y = ranks.of_id[np.frombuffer(bytes(r.w), kind)]
        y = np.append(y, ranks.of_id[-1:])[:window] if r.tail else y
        x = np.minimum(y, ranks.unseen)
        n = len(y)
        targets[i, :n], wanted[i, : n] = y, True
        inputs[i, 0], inputs[i, 1:n] = ranks.unseen + 1, x[: n - 1]
        before[i, :2], before[i, 2:n] = ranks.unseen + 2, x[: max(0, n - 2)]
        if n > 1:
            before[i, 1] = ranks.unseen + 1
        if not r.head:  # what comes before is not known here: nothing is asked of the first place
            wanted[i, 0], inputs[i, 0] = False, ranks.unseen + 2
            before[i, 1:2] = ranks.unseen + 2
    adam, rng = Adam(model, ranks.tree, 1e-2), np.random.default_rng(2)
    for turn in range(passes if len(rows) else 0):
        order = rng.permutation(len(rows))
        adam.rate = 1e-2 / (1 + turn)
        for at in range(0, len(order), FIRST_BATCH):
            part = order[at : at + FIRST_BATCH]
            adam.step(inputs[part], before[part], targets[part], wanted[part])


def _partition_fit(shared, kind, rate: float):
    """One pass over a partition: its windows train a copy of the shared model, whose weights come back in blocks."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        Speller.forget()
        hold_freed()
        ranks, start = shared.value
        adam, seen = Adam(copy_of(start), ranks.tree, rate), 0
        for batch in slices(batches, max_bytes=2 << 20):
            for owner, *arrays in windows(ranks, *_sequences(batch.column(0), kind), start.window, start.window, BATCH_WINDOWS):
                adam.step(*arrays)
                seen += len(owner)
        if seen:
            flat = adam.model.flat().astype(np.float64) * seen
            blocks = [flat[at : at + _BLOCK].tobytes() for at in range(0, len(flat), _BLOCK)]
            salt = TaskContext.get().partitionId() % 64
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, salt, np.int32)), pa.array(blocks, pa.binary()), pa.array(np.full(n, float(seen)))], names=["block", "salt", "w", "n"])

    return over


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the weights of each block, over rows dealt out by block."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, w, n in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            own = np.frombuffer(w.as_buffer(), np.float64)
            if block in sums:
                sums[block][0] += own
                sums[block][1] += n
            else:
                sums[block] = [own.copy(), n]
    names = list(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()), pa.array(np.zeros(len(names), np.int32)), pa.array([sums[b][0].tobytes() for b in names], pa.binary()), pa.array([sums[b][1] for b in names], pa.float64())],
        names=["block", "salt", "w", "n"],
    )


_BLOCKS = "block int, salt int, w binary, n double"


def averaged(parts: DataFrame) -> np.ndarray | None:
    """Mean of the partitions' weights; first over a share of the partitions, then over all. None without rows."""
    sums = parts.repartition("block", "salt").mapInArrow(_add_blocks, _BLOCKS).repartition("block").mapInArrow(_add_blocks, _BLOCKS)
    rows = sorted(sums.collect(), key=lambda r: r.block)  # as large as the model
    return np.concatenate([np.frombuffer(bytes(r.w), np.float64) / r.n for r in rows]) if rows else None


def fit(spelled: DataFrame, size: int, *, first_windows: int = FIRST_WINDOWS, passes: int = 6) -> tuple[Ranks, Attention]:
    """Fit on the ``ids`` of all rows of ``spelled``, of a vocabulary of ``size``; no rows are allowed."""
    spark, kind = spelled.sparkSession, _number_type(size)
    texts = spelled.select("ids")
    found = texts.mapInArrow(_id_counts(size, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    counts = np.zeros(size + 1, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    ranks, by_rank = make_ranks(counts)
    model = new_attention(ranks.tree, by_rank.astype(float), width=WIDTH, inner=INNER, window=WINDOW, seed=1)
    if counts.any():
        # The bounded sample of the first step: a share of windows that gives about first_windows, cut there.
        rate = min(1.0, 1.5 * first_windows / (counts.sum() / WINDOW + counts[-1]))
        some = texts.mapInArrow(_sampled_windows(kind, WINDOW, rate), "head boolean, tail boolean, w binary").orderBy(F.xxhash64("w"), "w", "head", "tail").limit(first_windows).collect()
        _first_fit(model, ranks, some, kind, passes)
        start = spark.sparkContext.broadcast((ranks, model))
        flat = averaged(texts.mapInArrow(_partition_fit(start, kind, RATE), _BLOCKS))
        start.destroy()
        if flat is not None:
            model = model.like(flat)
    return ranks, model


def _score_rows(shared, kind):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Speller.forget()
        hold_freed()
        ranks, model = shared.value
        for batch in slices(batches, max_bytes=2 << 20):
            scores = score_sequences(model, ranks, *_sequences(batch.column(batch.num_columns - 1), kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores / np.log(10))], names=[*batch.schema.names[:-1], "score"])

    return over


def score(df: DataFrame, held_out: Column, *, tokenizer_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", frequent: int = FREQUENT_WORDS, **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``df``.

    Rows where ``held_out`` is not true train. Null texts count as empty: one token, the end. Without training rows every
    count is zero. Rows that repeat are scored each for itself; further columns are ignored; no rows give none.
    """
    spark = df.sparkSession
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(quoted(text_col)).cast("string").alias("text"))
    counts = word_counts(rows.where(~F.col("held_out")).select("text"))
    tokens, distinct = (int(x) for x in counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first())
    table = frequent_words(counts, frequent)
    base = Base(b"\n".join(w.encode() for w in table.column("word").to_pylist()), table.column("c").to_numpy(), tokens, distinct)
    described = description(tokenizer_path, pattern)
    size = _loaded(described).get_vocab_size()
    spelling = spark.sparkContext.broadcast((uuid.uuid4().hex, described, base))
    kind = "row long, id long, held_out boolean, n_tokens long, known long, base double, ids binary, rare array<string>"
    spelled = stash(rows.mapInArrow(_spell_rows(spelling), kind), "lm-rows")
    spelling.destroy()
    model = spark.sparkContext.broadcast(fit(spelled.where(~F.col("held_out")), size, **options))
    own = ["row", "id", "held_out", "n_tokens", "known", "base"]
    kind = "row long, id long, held_out boolean, n_tokens long, known long, base double, score double"
    scored = spelled.select(*own, "ids").mapInArrow(_score_rows(model, _number_type(size)), kind)
    # What is rare is looked up by a join; words frequent enough to crowd a partition are not among it.
    words = spelled.select("row", F.explode("rare").alias("word"))
    total = F.lit(tokens + 0.5 * (distinct + 1))
    c = F.coalesce(F.col("c"), F.lit(0))
    looked = words.join(counts, "word", "left").groupBy("row").agg(F.count(F.when(c > 0, 1)).alias("more"), F.sum(F.log10((c + 0.5) / total)).alias("add"))
    return scored.join(looked, "row", "left").select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"), "score",
    )

"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Its documents are first taken whole as often as the target holds all of them;
for the rest of the target every document has an inclusion probability, and documents are ranked by their random odds
divided by the odds of their inclusion. The first of this order, as many as come nearest to the rest, are taken once more.
The place where a source's order is cut is found from sums over slices of the order, so no source is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.llm.common import cut, quoted

#: Slices of the order for which sums are kept: at most so many rows for a source.
SLICES = 1 << 14
#: Sources up to which their table is sent to every executor (some 100 bytes each); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes. No target is over
    ``most`` times its source's size; what is over is shared by weight among the others until none is. One row a source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.select("*", F.element_at(cycle, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * most).alias("most"))
    # The least room for its weight fills first: the level is the first that does not overfill the next source.
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = weighed.select("*", ((total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"))
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight") * (1 + 1e-12), F.struct((F.col("most") / F.col("weight")).alias("room"), F.col("level")))
    chosen = level.select("*", F.min(fits).over(Window.partitionBy()).getField("level").alias("settled"))
    return chosen.select("source", "source_size", F.least(F.col("most"), F.coalesce("settled", "level") * F.col("weight")).alias("target"))


def _lottery(id_col: str, text_col: str, seed: int) -> Column:
    """A number between 0 and 1, both excluded, that only depends on the document and the seed."""
    h = F.xxhash64(F.lit(seed), F.col(quoted(id_col)).cast("long"), F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def _order(number: Column, share: Column) -> tuple[Column, Column]:
    """Pareto rank, and its slice; null for a share of zero."""
    odds = number / (1 - number)
    rank = F.when(share > 0, odds * (1 - share) / share)
    return rank, F.floor(rank / (1 + rank) * SLICES).cast("long")


def _plan(rows: DataFrame, weights: Sequence[float], most: float) -> tuple[DataFrame, bool]:
    """Per source: size, target, whole copies, share of the rest, and where its order is cut; and whether these are few enough
    to be sent to all. ``rows``: source, size, number."""
    targets = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, most=most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = cut(
        targets.select("*", F.floor(ratio + 1e-12).cast("long").alias("whole"))
        .select("*", F.greatest(F.lit(0.0), ratio - F.col("whole")).alias("share"))
        .select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    )
    small = shares.count() <= BROADCAST_SOURCES
    rank, piece = _order(F.col("number"), F.col("share"))
    ranked = _with_sources(rows, shares, small).select("source", "size", "rest", rank.alias("rank"), piece.alias("piece")).where("rank is not null")
    sums = ranked.groupBy("source", "piece").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("piece")
    sums = sums.select("*", F.sum("words").over(upto).alias("upto"))
    cuts = cut(sums.where("upto >= rest").groupBy("source").agg(F.min(F.struct("piece", (F.col("upto") - F.col("words")).alias("before"))).alias("c")).select("source", "c.piece", "c.before"))
    inside = _with_sources(ranked, cuts.withColumnRenamed("piece", "cut_piece"), small).where(F.col("piece") == F.col("cut_piece"))
    running = Window.partitionBy("source").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select("*", (F.col("before") + F.sum("size").over(running)).alias("sofar"))
    last = inside.where(2 * (F.col("rest") - F.col("sofar") + F.col("size")) >= F.col("size")).groupBy("source").agg(F.max("rank").alias("cut_rank"))
    with_cut = _with_sources(shares, cuts.select("source", F.col("piece").alias("cut_piece")), small, "left")
    return cut(_with_sources(with_cut, cut(last), small, "left")), small


def _with_sources(rows: DataFrame, sources: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``rows`` beside their source's row; the table of sources is sent to all only if it was counted and is small."""
    right = sources.withColumnRenamed("source", "x_source")
    if small:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("x_source")), how).drop("x_source")


def _again(number: Column) -> Column:
    """Whether the rest of its source takes a document once more."""
    rank, piece = _order(number, F.col("share"))
    # Without a cut the whole order does not fill the rest, which rounding alone can cause.
    inside = F.when(F.col("cut_piece").isNull(), F.lit(True)).otherwise((piece < F.col("cut_piece")) | ((piece == F.col("cut_piece")) & (rank <= F.col("cut_rank"))))
    return F.coalesce((F.col("share") > 0) & inside, F.lit(False))


def mixture(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 6) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for each row of ``df``.

    ``size`` counts words (null text: none) and ``taken`` is ``size`` times ``copies``, at most ``most`` times rounded up.
    A null source is a source of its own. The draw depends on identifier and text alone, so reruns agree; rows that repeat
    both share their fate. A source without words has target zero. An empty table gives an empty result.
    """
    rows = cut(df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(source_col)).cast("string").alias("source"), word_count(F.col(quoted(text_col))).alias("size"), _lottery(id_col, text_col, seed).alias("number")))
    found = _with_sources(rows, *_plan(rows, weights, most))
    copies = F.col("whole") + _again(F.col("number")).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 6) -> DataFrame:
    """The mixture itself: each row of ``df`` as often as ``mixture`` takes it, columns as they were; texts stay in place.

    The cases are those of ``mixture``; rows without words are taken as their source's other rows are. Columns may have any
    names.
    """
    rows = cut(df.select(F.col(quoted(source_col)).cast("string").alias("source"), word_count(F.col(quoted(text_col))).alias("size"), _lottery(id_col, text_col, seed).alias("number")))
    plan = _plan(rows, weights, most)
    wide = df.select(F.col(quoted(source_col)).cast("string").alias("source"), _lottery(id_col, text_col, seed).alias("number"), F.struct(*[F.col(quoted(c)).alias(f"c_{i}") for i, c in enumerate(df.columns)]).alias("x_row"))
    copies = (F.col("whole") + _again(F.col("number")).cast("long")).cast("int")
    taken = _with_sources(wide, *plan).select("x_row", copies.alias("x_copies")).where("x_copies > 0")
    return taken.select("x_row", F.explode(F.sequence(F.lit(1), F.col("x_copies")))).select(*[F.col("x_row").getField(f"c_{i}").alias(c) for i, c in enumerate(df.columns)])

"""Exact duplicates by content sort.

Rows are range-partitioned on splitters that Spark samples from their content keys and sorted externally inside each
partition, so equal texts stand next to each other. One pass compares each text in full with its neighbour. A run of
equal texts may span partitions, because the identifier is the last part of the range key; a group that holds a third of
all rows is therefore spread over many tasks. What is known of the partitions' first and last runs (two rows a partition)
joins such pieces into one group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusforge.llm.common import cut, quoted, stash

FIRST, MIDDLE, LAST = 0, 1, 2
#: Characters of the text that lead the sort key. Only the key's form depends on it; texts are compared whole.
LEAD_CHARS = 24

_SUMMARY = T.StructType(
    [
        T.StructField("x_row", T.BooleanType()),
        T.StructField("x_pid", T.IntegerType()),
        T.StructField("x_edge", T.IntegerType()),
        T.StructField("x_id", T.LongType()),
        T.StructField("x_keep", T.LongType()),
        T.StructField("x_size", T.LongType()),
        T.StructField("x_head", T.BooleanType()),
        T.StructField("x_sha", T.StringType()),
        T.StructField("x_text", T.StringType()),
    ]
)


class _Run:
    """A run of equal texts that is still open."""

    def __init__(self, edge: int, batch: pa.RecordBatch, at: int):
        self.edge, self.text, self.sha = edge, batch.column("x_text")[at], batch.column("x_sha")[at].as_py()
        self.head = batch.column("x_id")[at].as_py()
        self.ids: list[pa.Array] = []
        self.size = 0


def _mark_runs(carried: list[str], schema: pa.Schema) -> Callable:
    """Arrow function over sorted rows: each run's rows (with ``carried``, its first row only), and a summary of the
    partition's first and last run. Memory: one batch, and the identifiers of the run that is open."""

    def made(n: int, **values) -> pa.RecordBatch:
        columns = [v.cast(f.type) if isinstance(v := values.get(f.name), pa.Array) else pa.repeat(pa.scalar(v, f.type), n) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def over(batches):
        pid = TaskContext.get().partitionId()
        run: _Run | None = None

        def closed(run: _Run):
            if run.edge != MIDDLE:
                yield made(1, x_row=False, x_pid=pid, x_edge=run.edge, x_keep=run.head, x_size=run.size, x_text=run.text.as_py())
            if not carried:
                head = pa.array(np.arange(run.size) == 0)
                yield made(run.size, x_row=True, x_pid=pid, x_edge=run.edge, x_id=pa.concat_arrays(run.ids), x_keep=run.head, x_size=run.size, x_head=head, x_sha=run.sha)

        def extend(run: _Run, batch, low: int, high: int) -> None:
            run.size += high - low
            if not carried:
                run.ids.append(batch.column("x_id").slice(low, high - low))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, texts = batch.column("x_id"), batch.column("x_text")
            new = np.ones(n, bool)
            new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = run is None or run.text != texts[0]
            starts = np.flatnonzero(new)
            if carried and len(starts):
                edges = np.full(len(starts), MIDDLE, np.int32)
                edges[0] = FIRST if run is None else MIDDLE
                picked = batch.take(pa.array(starts))
                yield made(len(starts), x_row=True, x_pid=pid, x_edge=pa.array(edges), x_id=picked.column("x_id"), x_head=True, **{c: picked.column(c) for c in carried})
            if run is not None:
                extend(run, batch, 0, starts[0] if len(starts) else n)
            if not len(starts):
                continue
            at = 0
            if run is None:
                run = _Run(FIRST, batch, 0)
                at = 1
                extend(run, batch, 0, starts[1] if len(starts) > 1 else n)
            if at == len(starts):
                continue
            yield from closed(run)
            low, high = starts[at], starts[-1]
            if high > low:  # runs that begin and end in this batch
                sizes = np.diff(starts[at:])
                heads = np.repeat(starts[at:-1], sizes)
                if not carried:
                    yield made(
                        high - low, x_row=True, x_pid=pid, x_edge=MIDDLE, x_id=ids.slice(low, high - low), x_keep=ids.take(pa.array(heads)),
                        x_size=pa.array(np.repeat(sizes, sizes)), x_head=pa.array(new[low:high]), x_sha=batch.column("x_sha").slice(low, high - low),
                    )
            run = _Run(MIDDLE, batch, int(high))
            extend(run, batch, high, n)
        if run is not None:
            if run.edge == MIDDLE:
                run.edge = LAST
            yield from closed(run)

    return over


def _chains(marked: DataFrame) -> DataFrame | None:
    """Groups that span partitions: (x_pid, x_edge) of each piece, with the group's first partition, keeper and size."""
    spark = marked.sparkSession
    edges = marked.where(~F.col("x_row"))
    # Two rows a partition at most, without texts.
    known = sorted((r.x_pid, r.x_edge, r.x_keep, r.x_size) for r in edges.select("x_pid", "x_edge", "x_keep", "x_size").collect())
    pieces: dict[int, dict[int, tuple]] = {}
    for pid, edge, keep, size in known:
        pieces.setdefault(pid, {})[edge] = (keep, size)
    order = sorted(pieces)
    if len(order) < 2:
        return None
    follows = spark.createDataFrame([(a, max(pieces[a]), b) for a, b in zip(order, order[1:])], "a int, a_edge int, b int")
    left = edges.select(F.col("x_pid").alias("a"), F.col("x_edge").alias("a_edge"), F.col("x_text").alias("a_text"))
    right = edges.where(F.col("x_edge") == FIRST).select(F.col("x_pid").alias("b"), F.col("x_text").alias("b_text"))
    linked = {r.a for r in follows.join(left, ["a", "a_edge"]).join(right, "b").where(F.col("a_text") == F.col("b_text")).select("a").collect()}
    rows, chain = [], []

    def close() -> None:
        if len(chain) > 1:
            keep, size = pieces[chain[0][0]][chain[0][1]][0], sum(pieces[p][e][1] for p, e in chain)
            rows.extend((p, e, chain[0][0], keep, size) for p, e in chain)
        chain.clear()

    for pid in order:
        if not (chain and chain[-1][0] in linked):
            close()
        chain.append((pid, FIRST))
        if LAST in pieces[pid]:
            close()
            chain.append((pid, LAST))
    close()
    if not rows:
        return None
    return spark.createDataFrame(rows, "x_pid int, x_edge int, g_pid int, g_keep long, g_size long")


def _sorted(df: DataFrame, text: Column, id_col: str, keep: str, carry: Sequence[str]) -> DataFrame:
    keyed = df.select(
        F.col(quoted(id_col)).cast("long").alias("x_id"),
        text.alias("x_text"),
        *[F.col(quoted(c)).alias(f"c_{i}") for i, c in enumerate(carry)],
    ).select("*", F.sha2(F.col("x_text"), 256).alias("x_sha"), F.substring("x_text", 1, LEAD_CHARS).alias("x_lead"))
    by_id = F.col("x_id").asc_nulls_last() if keep == "min" else F.col("x_id").desc_nulls_last()
    keyed = keyed.repartitionByRange(F.col("x_lead"), F.col("x_sha"), by_id)
    return keyed.sortWithinPartitions(F.col("x_lead"), F.col("x_sha"), F.col("x_text"), by_id).drop("x_lead")


def _text(df: DataFrame, text_col: str, normalize: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return normalize(text) if normalize else text


def exact_duplicates(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep: str = "min", normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after ``normalize`` (none: as they are); null counts as empty, and empty texts are
    equal to each other. Of a group the row with the smallest identifier stays (``keep="max"``: the largest). A null
    identifier yields to any other; of rows that repeat both text and identifier exactly one has ``kept``. An empty
    table gives an empty result, and further columns of ``df``, whatever their names, are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    ordered = _sorted(df, _text(df, text_col, normalize), id_col, keep, ())
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in _SUMMARY])
    marked = cut(ordered.mapInArrow(_mark_runs([], schema), _SUMMARY))
    rows = marked.where("x_row").select("x_pid", "x_edge", "x_id", "x_keep", "x_size", "x_head", "x_sha")
    chains = _chains(marked)
    if chains is None:
        return rows.select(F.col("x_id").alias("doc_id"), F.col("x_keep").alias("keep_id"), F.col("x_size").alias("group_size"), F.col("x_head").alias("kept"), F.col("x_sha").alias("text_sha256"))
    # At most two rows a partition, so its size is bounded by the number of tasks.
    whole = F.col("g_pid").isNull()
    return rows.join(F.broadcast(chains), ["x_pid", "x_edge"], "left").select(
        F.col("x_id").alias("doc_id"),
        F.when(whole, F.col("x_keep")).otherwise(F.col("g_keep")).alias("keep_id"),
        F.when(whole, F.col("x_size")).otherwise(F.col("g_size")).alias("group_size"),
        (F.col("x_head") & (whole | (F.col("g_pid") == F.col("x_pid")))).alias("kept"),
        F.col("x_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep: str = "min", normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with ``df``'s columns as they were. The texts are shuffled once.

    The cases are those of ``exact_duplicates``.
    """
    spark_schema = T.StructType([*_SUMMARY, *[T.StructField(f"c_{i}", f.dataType) for i, f in enumerate(df.schema)]])
    carried = [f"c_{i}" for i in range(len(df.columns))]
    ordered = _sorted(df, _text(df, text_col, normalize), id_col, keep, df.columns)
    schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in spark_schema])
    marked = stash(ordered.mapInArrow(_mark_runs(carried, schema), spark_schema), "exact-dedup")
    rows = marked.where("x_row")
    chains = _chains(marked)
    if chains is not None:
        rows = rows.join(F.broadcast(chains), ["x_pid", "x_edge"], "left").where(F.col("g_pid").isNull() | (F.col("g_pid") == F.col("x_pid")))
    return rows.select(*[F.col(c).alias(name) for c, name in zip(carried, df.columns)])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

"""Orders of chromosome and marker labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_key(label: str) -> tuple:
    """Digit runs compare as numbers, other runs without case."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", str(label)) if p)


def natural_key_column(label: Column, width: int = 12) -> Column:
    """A string that sorts labels naturally: digit runs padded to ``width``."""
    runs = F.regexp_extract_all(F.lower(label.cast("string")), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, width, "0")).otherwise(F.concat(F.lit("~"), r))), "")


def length_rank(labels: DataFrame, column: str = "chrom", out: str = "chrom_rank") -> DataFrame:
    """Each label of a table of labels with its rank by (length, text), from 1. Labels are few: one row each."""
    each = labels.select(F.col(column).cast("string").alias(column)).distinct()
    return each.withColumn(out, F.row_number().over(Window.orderBy(F.length(column), column)).cast("long"))


def length_ranks(labels: list[str]) -> dict[str, int]:
    return {label: i + 1 for i, label in enumerate(sorted({str(x) for x in labels}, key=lambda x: (len(x), x)))}


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, so that numbers that rest on its partitions stay: in the checkpoint folder that executors share,
    or in the cache where none is set (one machine)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df.persist()
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def positional_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the given order, through one range shuffle and counts per partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    tagged = settled(tagged)
    counts = {r["_part"]: r["n"] for r in tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, at = {}, 0
    for part in sorted(counts):
        first[part], at = at, at + counts[part]
    offsets = F.create_map(*[F.lit(x) for kv in first.items() for x in kv]) if first else F.lit(None)
    within = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    indexed = tagged.withColumn(name, (within + (offsets[F.col("_part")] if first else F.lit(0))).cast("long"))
    return indexed.drop("_part", "_row")

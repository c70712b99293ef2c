"""Result files: association tables and a run's summary, written and read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_association(results: DataFrame, path: str, *, separator: str = "\t", compression: str | None = None) -> None:
    """A delimited table with a header; what was not tested is empty."""
    plain = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in results.dtypes]
    writer = results.select(*plain).write.mode("overwrite").option("header", True).option("sep", separator)
    (writer.option("compression", compression) if compression else writer).csv(path)


def read_association(spark: SparkSession, path: str, *, separator: str = "\t") -> DataFrame:
    return spark.read.csv(path, header=True, sep=separator, inferSchema=True)


def summary_text(rows: Sequence[dict]) -> str:
    """Lines for people, one for each trait and method."""
    out = []
    for r in rows:
        head = f"{r.get('Trait')} {r.get('Method')}:"
        if r.get("Significant_Hits") is None:
            out.append(f"{head} {r.get('Info')}")
            continue
        inflation = "" if r.get("Lambda_GC") is None else f", lambda {r['Lambda_GC']:.3f}"
        out.append(f"{head} {r['Significant_Hits']} hits at {r['Threshold']:.3g} among {r['N_Markers']} markers and {r['N_Samples']} samples{inflation}")
    return "\n".join(out)


def write_summary(spark: SparkSession, rows: Sequence[dict], path: str) -> None:
    spark.createDataFrame([(summary_text(rows),)], "value string").coalesce(1).write.mode("overwrite").text(path)

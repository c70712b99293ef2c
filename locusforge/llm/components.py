"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.common import cut


#: Links that a task hands to the next round at most about.
LINKS_A_TASK = 50_000


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _least_neighbour(links)
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % (1 << 40)).alias("s")).first()
    return row.n, row.x, row.s


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``links(u, v)``; the component is its smallest node.

    Each round is two joins whose aggregates are combined before the shuffle; lineage is cut after each. Self links and
    repeated links do no harm; links with a null end are ignored; no links give an empty result.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # Links do not get more: what is few goes on in few files.
        following = cut(_small_star(_large_star(now)).coalesce(max(1, -(-mark[0] // LINKS_A_TASK))))
        before, mark, now = mark, _mark(following), following
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

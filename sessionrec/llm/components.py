"""Connected components of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionrec.llm.common import Scratch


#: Edges from which a round's parts are written, each, before they are joined.
WRITTEN = 1_000_000


def _large_star(edges: DataFrame, held) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = held(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "a")
    return both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, held) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = held(down.groupBy("u").agg(F.min("v").alias("m")), "c")
    moved = down.join(least.select(F.col("u").alias("_u"), "m"), F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root: the smallest node that links lead to, for each node that has a link (longs a, b).

    Alternating stars: each round links a node's neighbours to the least of them, which takes
    about log n rounds whatever the shape. Edges stay on the executors; each round is written
    and its count and checksum tell when nothing changes. Of many edges the least neighbours are
    written too before they are joined back: Spark splits the partitions of a join of two plain
    shuffles where a node has very many edges.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before, k = scratch.write(edges, f"{name}0"), None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, k = now, k + 1
        held = (lambda df, part, k=k: scratch.write(df, f"{name}{k}{part}")) if now[0] >= WRITTEN else (lambda df, part: df)
        edges = scratch.write(_small_star(held(_large_star(edges, held), "b"), held), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}", *(f"{name}{k}{part}" for part in "abc"))

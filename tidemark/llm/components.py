"""Connected components by alternating large and small stars, one shared table per round.

Each round links every node's larger neighbours to its smallest one, then every node and its smaller neighbours to
the smallest; edges never grow in number and end as stars around the smallest node of each component. Minima are
combined before the shuffle, and the joins back to the edges are between two shuffled sides, so adaptive execution
splits a node with very many neighbours. The driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written_once


def _larger_to_smallest(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # a and b are larger than the smallest here, so the pair stays a pair
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    rest = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(rest).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` of every node in ``edges``: label is the smallest node it is connected with.

    Edges with a null end and loops count for nothing; repeated and reversed edges count once; no edges give an
    empty result.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    before = None
    while True:
        now = written_once(_smaller_to_smallest(_larger_to_smallest(now)), "components")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == seen or not seen[0]:
            break
        before = seen
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)

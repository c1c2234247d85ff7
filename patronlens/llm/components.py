"""Connected components by alternating star steps over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.store import forget, keep


def _pairs(high, low):
    return F.col(high).alias("src"), F.col(low).alias("dst")


def _large_star(stars: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = stars.unionByName(stars.select(*_pairs("dst", "src")))
    least = both.groupBy("src").agg(F.min("dst").alias("least"))
    least = least.withColumn("least", F.least("src", "least"))
    return both.join(least, "src").where("dst > src").select(*_pairs("dst", "least")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = stars.groupBy("src").agg(F.min("dst").alias("least"))
    moved = stars.join(least, "src").where("dst > least").select(*_pairs("dst", "least"))
    return moved.unionByName(least.select(*_pairs("src", "least"))).distinct()


def _sign(stars: DataFrame) -> tuple:
    row = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> tuple[DataFrame, str]:
    """``node, component`` for every node of ``links`` (src, dst longs), and the path that holds them.

    The component is the smallest node that can be reached. Every round is written to the shared
    folder, so the plan stays short and a lost executor costs one round. Rows never outgrow the
    links. Self-links, repeated links and links with a null are allowed and change nothing.
    """
    spark = links.sparkSession
    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    clean = links.where("src <> dst").select(high.alias("src"), low.alias("dst")).distinct()
    stars, path = keep(clean, "stars")
    sign = _sign(stars)
    while sign[0]:
        new, new_path = keep(_small_star(_large_star(stars)), "stars")
        forget(spark, path)
        stars, path, before, sign = new, new_path, sign, _sign(new)
        if sign == before:
            break
    nodes = stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    heads = stars.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return nodes.unionByName(heads), path

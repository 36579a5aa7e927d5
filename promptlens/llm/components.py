"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.common import free, stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, any order, repeats allowed) -> (node, component),
    component the smallest node reachable; only nodes that have a link to
    another node. Each step is written to the checkpoint folder; the number
    of steps grows with the logarithm of the longest path."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m"))
        small = small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        before, edges = edges, stored(small, "edges")
        free(before)
        was, mark = mark, _mark(edges)
        if mark == was:
            break
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    told = stored(found.union(roots), "components")
    free(edges)
    return told


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")),
                  F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)

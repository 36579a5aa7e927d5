"""DataFrame-level helpers shared by operators: distributed row index and
exact grouped median. One plan each, whatever the size of the input.

Neither moves rows through the driver or a whole group through one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the checkpoint folder and read back: what made
    it (a provider's calls, say) is not run again by later readers."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def with_row_index(df: DataFrame, order_cols: list, name: str = "row_index",
                   num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order.

    The rows are range-partitioned, sorted and written once to the checkpoint
    folder with their partition and their place in it; a row's position is
    that place plus the sizes of the earlier partitions (one row per
    partition, so that table may be broadcast). The written table keeps the
    partitioning fixed for every later reader and for retried tasks.
    ``order_cols`` must be a total order.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tag = "_at_" + uuid.uuid4().hex[:8]
    placed = (df.repartitionByRange(_num_partitions(df, num_partitions), *cols).sortWithinPartitions(*cols)
              .withColumn(tag, F.monotonically_increasing_id()))
    placed = written(placed, "row-index")
    # the id holds the partition above bit 33 and the place below
    placed = placed.withColumn("_b", F.shiftright(tag, 33)).withColumn("_pos", F.col(tag).bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off"))
    out = placed.join(F.broadcast(offsets), "_b")
    return out.withColumn(name, (F.col("_off") + F.col("_pos")).cast("long")).drop("_b", "_pos", "_off", tag)


def value_counts(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, _v, _n, _at): how often each value occurs in each group, nulls
    left out, written once in the order of (keys, _v), where ``_at`` numbers
    the slices of that order. Slices hold about as many distinct values each,
    so neither a hot value or group nor one far extreme makes a large one."""
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.repartitionByRange(_num_partitions(df, None), *keys, "_v").sortWithinPartitions(*keys, "_v")
    return written(dealt.withColumn("_at", F.shiftright(F.monotonically_increasing_id(), 33)), "value-counts")


def grouped_summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, mean, std (population), min, max and exact median (mean of the
    two middle values) of ``value`` per group, nulls left out.

    Everything comes from the written :func:`value_counts`, so the input is
    read for them and for the borders of their slices only. A group's running
    total over its slices (a row each) tells in which one or two the middle
    places lie; only these are ordered by value, slice by slice.
    """
    gk = list(keys or [])
    if not gk:
        df, gk = df.withColumn("_g", F.lit(0)), ["_g"]
    counts = value_counts(df, value, gk)
    group = Window.partitionBy(*gk).orderBy("_at")
    slices = counts.groupBy(*gk, "_at").agg(F.sum("_n").alias("_in"))
    slices = slices.select(*gk, "_at", (F.sum("_in").over(group) - F.col("_in")).alias("_before"),
                           F.col("_in"), F.sum("_in").over(Window.partitionBy(*gk)).alias("_total"))
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    middle = slices.where((F.col("_before") <= hi) & (F.col("_before") + F.col("_in") > lo))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in gk]
    near = counts.alias("x").join(middle.alias("y"), [*same, F.col("x._at") == F.col("y._at")]).select(
        *[F.col(f"x.{k}") for k in gk], F.col("x._at").alias("_at"), "_v", "_n", "_before", "_total")
    upto = F.sum("_n").over(Window.partitionBy(*gk, "_at").orderBy("_v")) + F.col("_before")
    near = near.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    holds = lambda place: ((F.col("_from") <= place) & (F.col("_upto") > place)).cast("int")
    median = near.groupBy(*gk).agg((F.sum(F.col("_v") * (holds(lo) + holds(hi))) / 2).alias("median"))
    n = F.sum("_n")
    moments = counts.groupBy(*gk).agg(n.alias("n"), (F.sum(F.col("_v") * F.col("_n")) / n).alias("mean"),
                                      F.min("_v").alias("min"), F.max("_v").alias("max"))
    centred = counts.alias("x").join(moments.alias("y"), same).select(*[F.col(f"x.{k}") for k in gk], "_n", (F.col("_v") - F.col("mean")).alias("_d"))
    spread = centred.groupBy(*gk).agg(F.sqrt(F.sum(F.col("_n") * F.col("_d") * F.col("_d")) / F.sum("_n")).alias("std"))
    out = moments
    for part in (spread, median):
        part = part.select(*[F.col(k).alias(f"_{k}") for k in gk], part.columns[-1])
        out = out.join(part, [out[k].eqNullSafe(part[f"_{k}"]) for k in gk]).drop(*[f"_{k}" for k in gk])
    return out.select(*(keys or []), "n", "mean", "std", "min", "max", "median")


def grouped_median(df: DataFrame, value: str, keys: list[str] | None = None, out: str = "median") -> DataFrame:
    """Exact median per group, see :func:`grouped_summary`."""
    return grouped_summary(df, value, keys).select(*(keys or []), F.col("median").alias(out))

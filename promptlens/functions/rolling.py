"""Exact rolling range aggregates over (t - width, t] per key, without a
window that puts a whole key in one task.

Time is cut into buckets of width / n, and n buckets make a span of one width.
A window that ends at t in bucket b holds three parts:

- its own bucket up to t (peers of t included, like a SQL RANGE frame);
- the n - 1 whole buckets before, from per-bucket totals. They lie in the span
  of b and the one before it, so each total is also carried into the next span
  and a window over (key, span) sees at most 2 n totals;
- what is later than t - width in bucket b - n. As width is n buckets, those
  events, moved forward by width, fall into bucket b: they are later than t.

Events, moved events and the sum of the buckets between meet in one window over
(key, bucket); the rows carry their other columns along, so nothing is joined.
A hot key is split by time, however long its log is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per window, the first that divides its width; more for windows of
#: a day and longer.
BUCKETS = (12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
DAY_BUCKETS = 288
DAY = 86_400_000_000


def _buckets(width: int) -> int:
    return next(n for n in ((DAY_BUCKETS, *BUCKETS) if width >= DAY else BUCKETS) if width % n == 0)


def rolling_range(df: DataFrame, keys: list[str], ts: str, width: int, value: str | None = None,
                  with_oldest: bool = True) -> DataFrame:
    """``df`` with ``win_count``, ``win_sum`` (of ``value``) and, optionally,
    ``win_oldest`` (smallest ts) over (ts - width, ts] within ``keys``."""
    n = _buckets(width)
    size = width // n
    v = F.coalesce(F.col(value).cast("long"), F.lit(0)) if value else F.lit(0)
    rest = [c for c in df.columns if c not in keys]
    events = df.select(*keys, F.struct(*rest).alias("_row"), F.col(ts).cast("long").alias("_t"), v.cast("long").alias("_v"))
    events = events.withColumn("_b", F.expr(f"(_t - pmod(_t, {size})) div {size}"))

    # whole buckets between: totals of a span and, carried on, of the one before it
    totals = events.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"), F.min("_t").alias("_m"))
    totals = totals.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_on")).withColumn("_span", F.expr(f"(_b - pmod(_b, {n})) div {n} + _on"))
    span = Window.partitionBy(*keys, "_span").orderBy("_b").rangeBetween(-(n - 1), -1)
    between = totals.select(*keys, "_b", "_on", *(f(c).over(span).alias(c) for f, c in ((F.sum, "_c"), (F.sum, "_s"), (F.min, "_m")))).where("_on = 0")

    # own bucket (kind 0), moved events of the bucket n before (1), sums between (2)
    both = events.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_kind"))
    none = F.lit(None).cast("long")
    both = both.select(*keys, F.when(F.col("_kind") == 0, F.col("_row")).alias("_row"), (F.col("_t") + F.col("_kind") * width).alias("_t"), "_v",
                       (F.col("_b") + F.col("_kind") * n).alias("_b"), "_kind", none.alias("_c"), none.alias("_s"), none.alias("_m"))
    sums = between.select(*keys, F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), (F.col("_b") * size).alias("_t"), none.alias("_v"),
                          "_b", F.lit(2).alias("_kind"), "_c", "_s", "_m")
    place = Window.partitionBy(*keys, "_b").orderBy("_t")
    own, later = place.rangeBetween(Window.unboundedPreceding, Window.currentRow), place.rangeBetween(1, Window.unboundedFollowing)
    whole = place.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = lambda kind, x, w, f=F.sum: f(F.when(F.col("_kind") == kind, x)).over(w)
    zero = lambda x: F.coalesce(x, F.lit(0))
    told = both.union(sums).select(
        *keys, "_row", "_kind",
        *(zero(part(0, x, own)) + zero(part(1, x, later)) + zero(F.max(c).over(whole)) for x, c in ((F.lit(1), "_c"), (F.col("_v"), "_s"))),
        F.coalesce(part(1, F.col("_t") - width, later, F.min), F.min("_m").over(whole), part(0, F.col("_t"), own, F.min)),
    ).toDF(*keys, "_row", "_kind", "win_count", "win_sum", "win_oldest").where("_kind = 0")
    out = [F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns]
    return told.select(*out, "win_count", "win_sum", *(["win_oldest"] if with_oldest else []))

"""Derived views staged once per application as parquet tables in the shared
checkpoint folder.

``pairs`` (global row index), ``corpus`` (a join), ``candidates`` (a top-k
join) and the scored candidate pool are read by many queries and, inside one
query, several times. Building them once and reading the written table cuts
the lineage (a lost executor re-reads files instead of recomputing the
joins) and keeps every consumer on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptlens.session import scratch_path

_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    path = _STAGED.get(key)
    if path is None:
        path = scratch_path(spark, f"view-{name}")
        # consumers do per-row CPU work (top-k kernels, providers, array
        # expressions), so a small staged view must not collapse to one file;
        # the fan-out is the one the session is set up with for its data
        parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        build().repartition(parts).write.mode("overwrite").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(path)

"""Versioned vector table: one write per upsert, atomic versions, range fetch."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from promptlens.session import scratch_path
from promptlens.sources import vectortable as VT

ROWS = "id string, v long"


def table(spark, **kw):
    first = spark.createDataFrame([(f"k{i}", i) for i in range(200)], ROWS)
    t = VT.VectorTable(spark, scratch_path(spark, "vt")).create(first.schema, "id", **({"buckets": 16} | kw))
    t.upsert(first)
    return t


def rows(df):
    return {(r["id"], r["v"]) for r in df.collect()}


def test_upserts_make_versions_and_readers_keep_theirs(spark):
    t = table(spark)
    before = t.read()
    assert t.upsert(spark.createDataFrame([("k1", -1), ("new", 7)], ROWS)) == 3
    want = {(f"k{i}", i) for i in range(200)}
    assert rows(before) == want == rows(t.read(2))
    assert rows(t.read()) == want - {("k1", 1)} | {("k1", -1), ("new", 7)}
    assert t.read(1).count() == 0 and t.versions() == [1, 2, 3]


def test_a_small_batch_writes_its_buckets_only_and_once(spark):
    t = table(spark)
    old = t.version()
    t.upsert(spark.createDataFrame([("k3", 0)], ROWS))
    new = t.version()
    moved = [b for b in new.parts if new.parts[b] != old.parts.get(b)]
    assert len(moved) == 1 and len(new.parts) == len(old.parts)
    writes = sorted(os.listdir(f"{t.root}/data"))
    assert len(writes) == 2  # one folder per upsert, nothing staged beside it
    assert [os.path.basename(p) for p in glob.glob(f"{t.root}/data/{writes[1]}/bucket=*")] == [f"bucket={moved[0]}"]


def test_a_writer_that_dies_before_the_switch_changes_nothing(spark, monkeypatch):
    t = table(spark)
    batch = spark.createDataFrame([("k5", 500)], ROWS)

    def dies(self, version):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(VT.VectorTable, "_put", dies)
        with pytest.raises(OSError):
            t.upsert(batch)
    assert t.versions() == [1, 2] and ("k5", 5) in rows(t.read())
    assert t.upsert(batch) == 3 and ("k5", 500) in rows(t.read())
    assert len(os.listdir(f"{t.root}/data")) == 3
    freed = t.expire(keep=1)  # what the dead writer left goes, too
    assert len(freed) == 2 and ("k5", 500) in rows(t.read()) and t.read().count() == 200


def test_two_writers_of_one_version(spark, monkeypatch):
    t = table(spark)
    other = VT.VectorTable(spark, t.root)
    stale = t.version()
    other.upsert(spark.createDataFrame([("k6", 60)], ROWS))
    monkeypatch.setattr(VT.VectorTable, "version", lambda self, number=None: stale)
    with pytest.raises(VT.WriteConflict):
        t.upsert(spark.createDataFrame([("k7", 70)], ROWS))
    monkeypatch.undo()
    assert ("k6", 60) in rows(t.read()) and ("k7", 7) in rows(t.read())


def test_replays_orders_null_keys_and_clearing(spark):
    t = table(spark)
    b = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 1), (None, 4, 1)], ROWS + ", o long")
    assert t.upsert(b, order="o", source="s", batch_id=0) == 3
    assert t.upsert(b, order="o", source="s", batch_id=0) == 3
    assert t.upsert(b, order="o", source="other", batch_id=0) == 4
    assert {r for r in rows(t.read()) if r[0] in ("a", None)} == {("a", 2), (None, 4)}
    assert t.read().count() == 202
    assert t.upsert(spark.createDataFrame([], ROWS)) == 5 and t.read().count() == 202
    t.upsert(spark.createDataFrame([("only", 1)], ROWS), replace_all=True)
    assert rows(t.read()) == {("only", 1)}
    with pytest.raises(ValueError):
        VT.VectorTable(spark, scratch_path(spark, "vt-none")).read()


def test_fetch_by_range_opens_few_files_and_pushes_the_filter(spark):
    n = 4000
    df = spark.range(n).select(F.concat(F.lit("train-"), F.col("id").cast("string")).alias("id"),
                               (F.col("id") - 1000).alias("index"), F.col("id").alias("v"))
    t = VT.VectorTable(spark, scratch_path(spark, "vt-range")).create(df.schema, "id", 500, "range", "index")
    t.upsert(df.repartition(7))
    got = t.fetch(700, 760)
    assert sorted(r["index"] for r in got.collect()) == list(range(700, 760))
    assert len(got.inputFiles()) == 1 and len(t.read().inputFiles()) == 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(index,700)" in plan and "LessThan(index,760)" in plan
    assert [r["index"] for r in t.fetch(-1000, -990).orderBy("index").collect()] == list(range(-1000, -990))
    assert t.fetch(5, 5).count() == 0 and t.fetch(10_000, 10_001).count() == 0
    # only the row groups whose statistics meet the range are read
    import pyarrow.parquet as pq
    one = glob.glob(f"{t.root}/data/*/bucket=1/*.parquet")[0]
    stats = pq.ParquetFile(one).metadata.row_group(0).column(1).statistics
    assert (stats.min, stats.max) == (500, 999)

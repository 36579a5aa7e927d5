"""Readers and writers: prompt/output CSV, embedding files (json / jsonl /
csv), hash-keyed cache, training tables, vector table with keyed upserts.

Everything is a Spark reader or writer; nothing is read into the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.operators.incremental import last_wins

PAIRS_SCHEMA = T.StructType([
    T.StructField("original_index", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("output", T.StringType())])

CACHE_SCHEMA = T.StructType([
    T.StructField("text_hash", T.StringType()),
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("embedding_dim", T.IntegerType())])

VECTOR_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("metadata", T.StructType([
        T.StructField("output", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("tokens", T.IntegerType()),
        T.StructField("type", T.StringType())])),
    T.StructField("index", T.LongType())])

REQUIRED_TRAINING_FIELDS = ["embedding", "prompt", "output"]
HASH_BUCKET_CHARS = 2  # 256 buckets from the first two hex digits of the hash


# ----------------------------------------------------------------- CSV pairs
def write_pairs_csv(df: DataFrame, path: str) -> None:
    (df.select("original_index", "prompt", "output").write.mode("overwrite")
     .option("header", True).option("escape", '"').option("quoteAll", True).csv(path))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; quoted multi-line text; an empty field is null. Such
    a file cannot be split, so its rows are dealt over all tasks once read."""
    pairs = (spark.read.schema(PAIRS_SCHEMA).option("header", True).option("multiLine", True)
             .option("escape", '"').csv(path))
    return pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


# ----------------------------------------------------------------- embeddings
def read_embeddings(spark: SparkSession, path: str, key: str = "embedding",
                    schema: T.StructType | None = None) -> DataFrame:
    """Dispatch on suffix: .json (one JSON document), .jsonl (one object per
    line), anything else CSV. Rows without ``key`` are dropped; a vector
    given as JSON text is parsed to ``ARRAY<DOUBLE>``. Vectors with null, NaN
    or infinite components stay: ``vectors.validate_dims`` counts them and
    ``vectors.invalid_dims`` lists them. A .json document and a CSV file with
    line breaks in fields are one task each to read; the rows are dealt anew
    afterwards, so that what follows is not."""
    low = path.rstrip("/").lower()
    if low.endswith(".jsonl"):
        r = spark.read.schema(schema) if schema else spark.read
        df = r.json(path)
    elif low.endswith(".json"):
        r = spark.read.schema(schema) if schema else spark.read
        df = r.option("multiLine", True).json(path)
    else:
        r = spark.read.schema(schema) if schema else spark.read.option("inferSchema", False)
        df = r.option("header", True).option("escape", '"').csv(path)
    if not low.endswith(".jsonl"):
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    if isinstance(df.schema[key].dataType, T.StringType):
        df = df.withColumn(key, F.from_json(F.col(key), "array<double>"))
    else:
        df = df.withColumn(key, F.transform(key, lambda x: x.cast("double")))
    return df.where(F.col(key).isNotNull())


# ----------------------------------------------------------------- cache
def hash_bucket(col: str = "text_hash"):
    return F.substring(F.col(col), 1, HASH_BUCKET_CHARS)


def write_cache(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Hash-keyed cache; parquet is partitioned by hash bucket so a keyed
    upsert rewrites only the buckets it touches."""
    x = df.select("text_hash", "vec_id", "embedding",
                  F.size("embedding").cast("int").alias("embedding_dim"))
    if fmt == "jsonl":
        x.write.mode("overwrite").json(path)
    else:
        # a bucket is one task's, so it becomes one file and not one per task
        dealt = x.withColumn("bucket", hash_bucket()).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_cache(spark: SparkSession, path: str, order: str = "vec_id") -> DataFrame:
    """Missing path -> empty cache; on a duplicate hash the row with the
    largest ``order`` wins."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    if path.rstrip("/").lower().endswith(".jsonl"):
        df = spark.read.schema(CACHE_SCHEMA).json(path)
    else:
        df = spark.read.parquet(path).select(*[f.name for f in CACHE_SCHEMA.fields])
    return last_wins(df, "text_hash", order)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ----------------------------------------------------------------- training
def write_training(df: DataFrame, path: str, fmt: str = "jsonl") -> None:
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.json(path)


def read_training(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.json(path)
    return df


def usable_training(df: DataFrame) -> DataFrame:
    """Rows that have both an embedding and a prompt."""
    return df.where(F.col("embedding").isNotNull() & F.col("prompt").isNotNull())


def required_fields_report(df: DataFrame) -> DataFrame:
    """Counts over the whole table of rows missing each required field."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in REQUIRED_TRAINING_FIELDS],
                  F.count_if(F.col("embedding").isNotNull() & F.col("prompt").isNotNull()).alias("usable"))


# ----------------------------------------------------------------- vector table
def vector_records(df: DataFrame, kind: str | None = None, kind_col: str | None = None,
                   index: str = "original_index") -> DataFrame:
    """``id = '<type>-<index>'`` with a metadata struct; ``index`` is carried
    as a number too, so that ranges of it are found without parsing ids."""
    typ = F.col(kind_col) if kind_col else F.lit(kind)
    return df.select(
        F.concat(typ, F.lit("-"), F.col(index).cast("string")).alias("id"),
        F.col("embedding").alias("values"),
        F.struct(F.col("output"), F.col("prompt"), F.col("tokens").cast("int").alias("tokens"),
                 typ.alias("type")).alias("metadata"),
        F.col(index).cast("long").alias("index"))


def hash_records(cache: DataFrame, rows: DataFrame, text: str = "output", prompt: str = "prompt") -> DataFrame:
    """A record per cached text: id is its hash; the text and a prompt of it are
    found in ``rows`` (text_hash, text, prompt), '' where there is none."""
    one = rows.groupBy("text_hash").agg(F.min(text).alias("_text"), F.min(prompt).alias("_prompt"))
    known = cache.join(one, "text_hash", "left")
    empty = F.lit("")
    return known.select(F.col("text_hash").alias("id"), F.col("embedding").alias("values"), F.struct(
        F.coalesce("_text", empty).alias("text"), F.coalesce("_prompt", empty).alias("prompt"), F.col("text_hash")).alias("metadata"))


def fetch_vectors(table: DataFrame, id_lo: int, id_hi: int, kind: str) -> DataFrame:
    """Records of ``kind`` whose index is in [id_lo, id_hi); only existing ids
    come back; metadata is flattened. Both filters reach the Parquet reader
    (see :meth:`vectortable.VectorTable.fetch` for a table laid out by index)."""
    x = table.where((F.col("metadata.type") == kind) & (F.col("index") >= id_lo) & (F.col("index") < id_hi))
    return x.select("id", "index", F.col("values").alias("embedding"),
                    "metadata.prompt", "metadata.output", "metadata.tokens", "metadata.type")


def format_training(fetched: DataFrame) -> DataFrame:
    return fetched.select("embedding", "prompt", "output", "tokens", "id")


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object per line (the single-array form needs one writer and
    is not offered)."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(path)

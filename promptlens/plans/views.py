"""Bindings of the operators' input shapes to the driver's tables.

Each view exists twice, side by side: a DataFrame builder (what the job runs)
and the same definition in SQL (what the DuckDB oracle runs). Every view reads
whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions.frames import with_row_index
from promptlens.functions.timecols import epoch_micros
from promptlens.functions.vector import as_double

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- pairs
def pairs(spark, d) -> DataFrame:
    from promptlens.plans.stage import staged
    return staged(spark, d, "pairs", lambda: build_pairs(spark, d))


def build_pairs(spark, d) -> DataFrame:
    """(original_index, conv_id, turn, prompt, output): each user turn with the
    assistant turn that follows it (null when the next turn is not the
    assistant's). Joined on the composite key (conv_id, turn) rather than a
    window over conv_id, so one long conversation does not land in one task."""
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = (c.where(F.col("role") == "assistant")
         .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")))
    j = u.join(a, ["conv_id", "turn"], "left")
    j = with_row_index(j, ["conv_id", "turn"], "original_index")
    return j.select("original_index", "conv_id", "turn", "prompt", "output")


PAIRS_SQL = """pairs AS (
  SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS original_index,
         u.conv_id, u.turn, u.text AS prompt, a.text AS output
  FROM conversations u
  LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


# ---------------------------------------------------------------- emb / corpus
def emb(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", as_double("embedding").alias("embedding"))


EMB_SQL = """emb AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS embedding
  FROM embeddings)"""


def corpus(spark, d) -> DataFrame:
    from promptlens.plans.stage import staged
    return staged(spark, d, "corpus", lambda: build_corpus(spark, d))


def build_corpus(spark, d) -> DataFrame:
    p = pairs(spark, d)
    e = emb(spark, d)
    return (p.join(e, p.original_index == e.vec_id)
            .select("original_index", "prompt", "output", "embedding", "label"))


CORPUS_SQL = """corpus AS (
  SELECT p.original_index, p.prompt, p.output, e.embedding, e.label
  FROM pairs p JOIN emb e ON p.original_index = e.vec_id)"""


# ---------------------------------------------------------------- docs / cache
def docs(spark, d) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("original_index"), F.col("text").alias("output"),
                    T.text_hash("text").alias("text_hash"), "lang", "source")


DOCS_SQL = """docs AS (
  SELECT doc_id AS original_index, text AS output, md5(text) AS text_hash, lang, source
  FROM documents)"""


def cache(spark, d) -> DataFrame:
    """Hash-keyed embedding cache: one vector per text hash (the vector of
    the lowest document id that owns one)."""
    dd = docs(spark, d)
    e = emb(spark, d)
    j = dd.join(e, dd.original_index == e.vec_id)
    first = j.groupBy("text_hash").agg(F.min("original_index").alias("vec_id"))
    return first.join(e.select("vec_id", "embedding"), "vec_id").select(
        "text_hash", "vec_id", "embedding",
        F.size("embedding").alias("embedding_dim"))


CACHE_SQL = """cache AS (
  SELECT f.text_hash, f.vec_id, e.embedding, len(e.embedding) AS embedding_dim
  FROM (SELECT d.text_hash, min(d.original_index) AS vec_id
        FROM docs d JOIN emb e ON d.original_index = e.vec_id GROUP BY 1) f
  JOIN emb e ON f.vec_id = e.vec_id)"""


# ---------------------------------------------------------------- results
def results(spark, d) -> DataFrame:
    dd = docs(spark, d)
    lab = table(spark, d, "labels")
    j = dd.join(lab, dd.original_index == lab.doc_id, "left")
    return j.select("original_index", "output", (F.col("quality") == 1).alias("success"),
                    F.coalesce(F.col("toxic"), F.lit(0)).alias("toxic"))


RESULTS_SQL = """results AS (
  SELECT d.original_index, d.output, l.quality = 1 AS success, coalesce(l.toxic, 0) AS toxic
  FROM docs d LEFT JOIN labels l ON d.original_index = l.doc_id)"""


# ---------------------------------------------------------------- reqlog
def reqlog(spark, d) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(
        "event_id",
        epoch_micros(ev, "ts").alias("us"),
        F.col("user_id").alias("client"),
        F.col("event_type").alias("endpoint"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        (F.col("event_type") != "error").alias("success"),
        "value")


REQLOG_SQL = """reqlog AS (
  SELECT event_id, epoch_us(ts) AS us, user_id AS client, event_type AS endpoint,
         CAST(json_extract(props, '$.k') AS BIGINT) AS tokens,
         event_type <> 'error' AS success, value
  FROM events)"""


# ---------------------------------------------------------------- requests
def requests(spark, d) -> DataFrame:
    """One request per document; vector (if any) from ``embeddings``; the
    batch is all documents of one (source, lang)."""
    x = table(spark, d, "documents")
    e = table(spark, d, "embeddings")
    sizes = x.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("batch_size"))
    j = x.join(e, x.doc_id == e.vec_id, "left")
    j = j.join(sizes, ["source", "lang"])
    return j.select(F.col("doc_id").alias("request_id"), F.size("embedding").alias("dims"),
                    "text", "batch_size")


REQUESTS_SQL = """requests AS (
  SELECT d.doc_id AS request_id, len(e.embedding) AS dims, d.text,
         count(*) OVER (PARTITION BY d.source, d.lang) AS batch_size
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


# ---------------------------------------------------------------- textcases
# Fixed literal text cases (hand-derived expectations in the tests).
TEXT_CASES = [
    "What is Spark?",
    "Candle light",
    "Create a list: a, b",
    "Hi. There!",
    "1. one\n2. two",
    "x\n- item",
    "- item",
    "away from home",
    "However",
    "it works, therefore",
    "",
    None,
]
TEXT_CASE_BASE = 1_000_000


def textcases(spark, d) -> DataFrame:
    """pairs rows plus the literal cases (ids from 1,000,000)."""
    p = pairs(spark, d).select("original_index", "prompt", "output")
    # literal rows as one JVM-side array literal (no Python-side data)
    rows = F.array(*[F.struct(F.lit(TEXT_CASE_BASE + i).cast("long").alias("original_index"),
                              F.lit(t).cast("string").alias("prompt"),
                              F.lit(t).cast("string").alias("output"))
                     for i, t in enumerate(TEXT_CASES)])
    lits = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    return p.unionByName(lits)


def _sql_str(t):
    if t is None:
        return "NULL"
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


TEXTCASES_SQL = "textcases AS (\n  SELECT original_index, prompt, output FROM pairs\n  UNION ALL\n  SELECT * FROM (VALUES " + ",\n    ".join(
    f"({TEXT_CASE_BASE + i}::BIGINT, {_sql_str(t)}::VARCHAR, {_sql_str(t)}::VARCHAR)"
    for i, t in enumerate(TEXT_CASES)) + ") v(original_index, prompt, output))"


# ---------------------------------------------------------------- SQL prelude
VIEW_SQL = {
    "pairs": (PAIRS_SQL, []),
    "emb": (EMB_SQL, []),
    "corpus": (CORPUS_SQL, ["pairs", "emb"]),
    "docs": (DOCS_SQL, []),
    "cache": (CACHE_SQL, ["docs", "emb"]),
    "results": (RESULTS_SQL, ["docs"]),
    "reqlog": (REQLOG_SQL, []),
    "requests": (REQUESTS_SQL, []),
    "textcases": (TEXTCASES_SQL, ["pairs"]),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` (a SELECT, possibly starting with its own WITH list
    entries via ``extra``) with the CTEs for ``names`` and their inputs."""
    order: list[str] = []

    def visit(n):
        for dep in VIEW_SQL[n][1]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [VIEW_SQL[n][0] for n in order]
    return ctes


def _bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` returns HUGEINT; wrap every call in a BIGINT
    cast so result types equal Spark's ``count_if`` (LONG)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _bigint_counts(sql[j + len(key):k])
        out.append(sql[i:j] + "CAST(" + key + inner + ") AS BIGINT)")
        i = k + 1


def oracle(sql_body: str, views: list[str], ctes: list[str] | None = None) -> str:
    """Build one statement: WITH <views>, <extra ctes> <sql_body>."""
    parts = with_views("", *views) + list(ctes or [])
    sql = sql_body if not parts else "WITH " + ",\n".join(parts) + "\n" + sql_body
    return _bigint_counts(sql)

"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are the runs of ASCII letters and digits and of non-ASCII characters,
A-Z lower-cased. A window is ``WINDOW`` consecutive words of a benchmark item;
an item of fewer words (but not none) is one window. A document word inside
any occurrence of a window is hit.

1. Both sides keep the minimum ``GRAM``-gram hash of every ``WINDOW - GRAM +
   1`` consecutive ones. Texts that share ``WINDOW`` words share such a
   fingerprint, so no span of that length is missed. Items shorter than a
   window enter with the hash of all their words, documents then with all
   hashes of those lengths.
2. The fingerprints are joined; documents with a common one are candidates.
3. Hits are extended: in candidates every position of a benchmark fingerprint
   gives a diagonal (document place minus item place); along it the words
   themselves are compared and the fully equal windows kept.

Only benchmark fingerprints meet documents, never document with document; the
join is left to Spark, which broadcasts the benchmark side if it is small.

Defined results: null text has no words; a row without text or words is not
contaminated; items without an id or words are ignored; rows of one item_id
count as one item; repeated documents are rows of their own; an empty table of
either kind works. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm.common import ASCII_LOWER, ASCII_UPPER, small, stored, table

GRAM, WINDOW = 5, 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(lowered: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def exact_words(text: str) -> Column:
    """Words with only A-Z lower-cased."""
    return _split(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def folded_words(text: str) -> Column:
    """As many words, lower-cased in full: what agrees exactly agrees here
    too, and it is several times cheaper. For finding candidates. The only
    letter whose lower case depends on what surrounds it is the capital sigma,
    so its three forms are one (U+03A3, U+03C2, U+03C3)."""
    return _split(F.replace(F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3")), F.lit("\u03a3"), F.lit("\u03c3")))


def _runs(array: str | Column, n: int) -> Column:
    """Structs of ``n`` consecutive elements."""
    size = F.size(array)
    shifted = [F.slice(array, i + 1, size) for i in range(n)]
    return F.slice(F.arrays_zip(*shifted), F.lit(1), F.greatest(size - (n - 1), F.lit(0)))


def gram_hashes(words: str, n: int) -> Column:
    return F.transform(_runs(words, n), lambda x: F.xxhash64(x))


def winnowed(hashes: str, width: int) -> Column:
    """Distinct minima of every ``width`` consecutive hashes."""
    least = lambda x: F.least(*(x[str(i)] for i in range(width)))
    return F.array_distinct(F.transform(_runs(hashes, width), least))


def _fingerprints(texts: DataFrame, gram: int, window: int, short: list[int]) -> DataFrame:
    """``texts`` (with ``text``) plus n_words and fps."""
    hashed = texts.withColumn("_w", folded_words("text")).drop("text")
    hashed = hashed.withColumn("_g", gram_hashes("_w", gram))
    more = [gram_hashes("_w", n) for n in short]
    fps = winnowed("_g", window - gram + 1)
    return hashed.select(*[c for c in hashed.columns if c[0] != "_" or c == "_h"],
                         F.size("_w").cast("long").alias("n_words"),
                         (F.array_distinct(F.concat(fps, *more)) if more else fps).alias("fps"))


def _places(words: str, gram: int, short: list[int]) -> Column:
    """(place, hash) of every gram of the lengths in use."""
    return F.concat(*(F.transform(gram_hashes(words, n), lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
                      for n in sorted({gram, *short})))


def contamination(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text), ``benchmark`` (item_id, text): one row per
    document with n_words, n_hit, n_items, items (sorted) and ``_h``, the hash
    of its text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    items = stored(items.distinct().withColumn("iw", exact_words("text")).filter(F.size("iw") > 0), "benchmark-items")
    # at most window - 1 lengths
    short = [r[0] for r in items.filter(F.size("iw") < window).select(F.size("iw")).distinct().collect()]
    long_fps = _fingerprints(items.filter(F.size("iw") >= window).select("text"), gram, window, [])
    short_fps = items.filter(F.size("iw") < window).withColumn("_w", folded_words("text"))
    wanted = long_fps.select(F.explode("fps").alias("hash"))
    for n in short:
        wanted = wanted.union(short_fps.filter(F.size("iw") == n).select(F.explode(gram_hashes("_w", n))))
    wanted = stored(wanted.distinct(), "benchmark-fingerprints")

    # 1, 2: candidates, with every document's number of words
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.xxhash64("text").alias("_h"), "text")
    met = (_fingerprints(rows, gram, window, short)
           .select("row", "doc_id", "_h", "n_words", F.explode_outer("fps").alias("hash"))
           .join(wanted.withColumn("met", F.lit(True)), "hash", "left"))
    known = stored(met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("_h").alias("_h"), F.first("n_words").alias("n_words"),
        F.coalesce(F.max("met"), F.lit(False)).alias("met")), "document-words")

    # 3: extend
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["_h"].eqNullSafe(b["_h"])
    picked = stored(known.filter("met").select("doc_id", "_h").distinct(), "picked")
    texts = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    texts = texts.join(small(picked), same(texts, picked), "left_semi").dropDuplicates(["doc_id", "_h"])
    texts = stored(texts.select("doc_id", "_h", exact_words("text").alias("w")), "candidates")
    item_places = items.withColumn("grams", _places("iw", gram, short)).select("item_id", "text", F.explode("grams").alias("g"))
    item_places = item_places.select("item_id", F.xxhash64("text").alias("ih"), F.col("g.hash").alias("hash"), F.col("g.place").alias("q"))
    # exact words on both sides here, so the hashes agree as the words do
    places = texts.withColumn("grams", _places("w", gram, short)).select("doc_id", "_h", F.explode("grams").alias("g"))
    diagonals = (places.select("doc_id", "_h", F.col("g.hash").alias("hash"), F.col("g.place").alias("p"))
                 .join(item_places, "hash").select("doc_id", "_h", "item_id", "ih", (F.col("p") - F.col("q")).alias("d")).distinct())
    words = items.select("item_id", F.xxhash64("text").alias("ih"), "iw")
    both = diagonals.join(words, ["item_id", "ih"])
    both = both.join(texts.select(F.col("doc_id").alias("t_id"), F.col("_h").alias("t_h"), "w"),
                     F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("_h").eqNullSafe(F.col("t_h")))
    size = F.least(F.size("iw"), F.lit(window))
    both = both.withColumn("low", F.greatest(F.lit(0), -F.col("d"))).withColumn(
        "n", F.least(F.size("iw"), F.size("w") - F.col("d")) - F.col("low"))
    both = both.filter(F.col("n") >= size).withColumn("equal", F.zip_with(
        F.slice("iw", F.col("low") + 1, F.col("n")), F.slice("w", F.col("low") + F.col("d") + 1, F.col("n")), lambda a, b: a == b))
    starts = F.filter(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.forall(F.slice("equal", i, size), lambda e: e))
    spans = both.select("doc_id", "_h", "item_id", size.alias("size"), F.explode(F.transform(
        starts, lambda i: i + F.col("low") + F.col("d"))).alias("at"))
    # one document's windows: bounded by its own length
    hits = spans.groupBy("doc_id", "_h").agg(
        F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "size")),
               lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = hits.select(F.col("doc_id").alias("t_id"), F.col("_h").alias("t_h"), "n_hit", "items")
    return (known.join(hits, F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("_h").eqNullSafe(F.col("t_h")), "left")
            .select("doc_id", "_h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), ''),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dm AS (SELECT doc_id, w, m FROM d JOIN ms ON len(w) >= m),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM dm, unnest(range(1, len(w) - m + 2)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, g)),
pos AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, m)) AS t(j) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

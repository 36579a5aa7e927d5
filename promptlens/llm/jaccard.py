"""Near duplicates by word shingles: T-occurrence search with DivideSkip.

A document's set holds the hashes of its distinct shingles of ``SHINGLE``
words; two documents link when 100 * intersection >= 75 * union, that is when
they share T = ceil(3 (|x| + |y|) / 7) shingles.

DivideSkip splits the inverted lists of a set into long ones and short ones.
To share T shingles two documents must share one of their |x| - ceil(3|x|/4) +
1 rarest, so only these short lists are merged (Spark sorts and merges the
postings by shingle and joins the documents of a list); the lists left out,
the longest, are never read through: a candidate is probed for their shingles
by binary search in its sorted set, if the short lists it occurs in and all
long ones together reach T. Which lists are long is told by a share of the
documents: shingles that recur in it come last, the more often the later. The
sample orders the lists and has no influence on the result.

Groups are not expanded into pairs:
- documents with equal sets are one class, a node, shown by one of its rows;
- first every document of a list is checked against the list's most central
  document, the one that shares most of its short lists (a star), if they meet
  in enough lists; the links found are joined to components;
- then only pairs of *different* components that meet in one of the first
  |x| - T + 1 lists of both are checked, so what is one component costs no
  pair; of a list's components the one with most documents is only met by the
  others;
- before a pair's sets are brought together, their bitmaps tell, a sixteenth of
  the bytes, whether they can share T shingles.
Lists expected to be long are dealt over salts, each with a star of its own.

Every pair that can link meets in a short list, and is skipped only when it is
in one component already, so the components are exact.

Defined results: null and blank texts have the empty set, n_shingles 0, and
link with nothing; a text of fewer than ``SHINGLE`` words has one shingle; a
null id takes part like any other, and takes the smallest id of its component,
null if no row of it has one; rows that share an id stay rows of their own,
each linked by its own text. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlens.llm.common import free, parted, small, stored, table
from promptlens.llm.components import components

SHINGLE = 5
#: Share of the documents that orders the lists, from how many of them a
#: shingle counts as recurring, and recurring shingles that are kept.
SAMPLE_SHARE, SAMPLE_SEEN, SAMPLE_ENTRIES = 1 / 8, 2, 1 << 18
#: Documents of a list per salt.
LIST_PER_SALT = 5000
#: Places over which the partners of one document are dealt.
SALTS = 16
#: Share of the needed common short lists from which a star is checked.
STAR_SHARE = 0.25
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= 100_000:
            self.clear()
        self[word] = value
        return value


_HASHES = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, "i8")
    w = np.fromiter(map(_HASHES.__getitem__, words), "u8", n)
    k = min(n, SHINGLE)
    h = np.full(n - k + 1, k, "u8")
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _ODD + w[i: n - k + 1 + i]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.unique(h.view("i8"))


def needed(a, b):
    """Shared shingles that make sets of a and b link."""
    return -(-3 * (a + b) // 7)


@dataclass(frozen=True)
class Order:
    """Recurring shingles of the sample, sorted, and in how many of its
    documents each is; documents per sampled one."""
    hot: np.ndarray
    heat: np.ndarray
    per: float = 1.0

    def short_lists(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted set of a text, the rarest of it, one of which every
        partner must share, and how often the sample holds each of these."""
        found = shingles(text)
        if not len(found):
            return found, found, np.zeros(0, "i4")
        seen = np.zeros(len(found), "i4")
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, found), len(self.hot) - 1)
            seen = np.where(self.hot[at] == found, self.heat[at], 0)
        keep = len(found) - (3 * len(found) + 3) // 4 + 1
        order = np.argsort(seen, kind="stable")[:keep]
        return found, found[order], seen[order]


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Binary-probe the longer sorted set for the shorter's shingles."""
    if len(a) > len(b):
        a, b = b, a
    t = needed(len(a), len(b))
    if not len(a) or len(a) < t:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) >= t


def sampled_order(docs: DataFrame) -> Order:
    """The recurring shingles of a fixed share of the documents, so that a list
    of a given length is known as long at every size; the most frequent ones,
    if there are more than ``SAMPLE_ENTRIES``."""
    def found(batches):
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(shingles(text.as_py()))})
        _HASHES.clear()

    drawn = docs.filter(F.pmod(F.xxhash64("h", F.lit(5)), F.lit(1 << 20)) < int(SAMPLE_SHARE * (1 << 20)))
    often = stored(drawn.select("text").mapInArrow(found, "shingle long").groupBy("shingle").count()
                   .filter(F.col("count") >= SAMPLE_SEEN), "sample")
    # the least count whose shingles are no more than the table holds: a row per count
    least, room = SAMPLE_SEEN, SAMPLE_ENTRIES
    for r in often.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).collect():
        room -= r["n"]
        if room < 0:
            least = r["count"] + 1
            break

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({c: pa.array([batch.column(i).to_numpy().astype("<i8").tobytes()], pa.binary())
                                              for i, c in enumerate(("shingles", "counts"))})

    # packed, as rows of their own would take the driver many times their bytes
    rows = often.filter(F.col("count") >= least).select("shingle", "count").mapInArrow(packed, "shingles binary, counts binary").collect()
    free(often)
    hot, heat = (np.frombuffer(b"".join(r[i] for r in rows), "<i8") for i in (0, 1))
    order = np.argsort(hot)
    return Order(hot[order], np.minimum(heat[order], 2 ** 31 - 1).astype("i4"), 1 / SAMPLE_SHARE)


def enough(a: str, b: str, common: str) -> Column:
    """Whether a pair of sets of sizes a and b that has met in ``common`` short
    lists can share T shingles: the set whose short lists end first in the
    order of lists can share no more than its long lists besides."""
    total = F.ceil(3 * (F.col(a) + F.col(b)) / 7)
    long_lists = F.greatest(*(F.ceil(3 * F.col(x) / 4) - 1 for x in (a, b)))
    return F.col(common) >= total - long_lists


def bitmap(found: np.ndarray) -> bytes:
    """Presence bits of a set by the low bits of its hashes, two to four bits a
    shingle; a bitmap twice as long folds onto a shorter one."""
    size = max(8, 2 << max(0, len(found) - 1).bit_length())
    bits = np.zeros(size, "?")
    bits[found & (size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """Whether sets of these sizes and bitmaps can share T shingles: a bit that
    only one of them has is a shingle that the other lacks."""
    x, y = np.frombuffer(a, "u1"), np.frombuffer(b, "u1")
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2:]
    only = lambda p, q: int(np.bitwise_count(p & ~q).sum())
    return min(na - only(x, y), nb - only(y, x)) >= needed(na, nb)


def _probable(pairs: DataFrame, sketches: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose bitmaps let them link; ``sketches``: node, n, bits."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = stored(pairs, name)
    met = side("a").join(small(pairs), "a").join(side("b"), "b").select("a", "b", "na", "bits_a", "nb", "bits_b")

    def check(batches):
        for batch in batches:
            columns = batch.to_pydict()
            keep = [may_link(*row) for row in zip(*(columns[c] for c in ("na", "bits_a", "nb", "bits_b")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(check, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, doc_id, h, copies, ...) with the text of its row, once
    each; rows whose id and text are repeated are made one first."""
    def met(rows: DataFrame, some: DataFrame) -> DataFrame:
        some = some.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), *[c for c in some.columns if c not in ("doc_id", "h", "copies")])
        return rows.join(some, rows["doc_id"].eqNullSafe(some["_id"]) & (rows["h"] == some["_h"])).drop("doc_id", "h", "_id", "_h")

    one, more = wanted.filter("copies = 1"), wanted.filter("copies > 1")
    ids = more.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    several = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]) & (docs["h"] == ids["_h"]), "left_semi").dropDuplicates(["doc_id", "h"])
    return met(docs, small(one)).union(met(several, more))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that link. The sets of a and of its partners
    are brought to one place, over salts if there are many, and a's set is
    probed there; every set travels once per pair."""
    pairs = stored(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")), name)
    wanted = pairs.select(F.col("b").alias("node"), F.col("a").alias("centre"), "salt").union(
        pairs.select("a", "a", "salt").distinct())
    wanted = stored(wanted.join(nodes, "node"), f"{name}-sets")

    def build(batches):
        for batch in parted(batches):
            found = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("centre", "salt", "node")), pa.array(found, pa.binary())],
                ["centre", "salt", "node", "shingles"])
        _HASHES.clear()

    def check(batches):
        at, centres = None, []
        for batch in batches:
            good: list[tuple[int, int]] = []
            for centre, salt, own, data in zip(*(batch.column(c).to_pylist() for c in ("centre", "salt", "node", "shingles"))):
                found = np.frombuffer(data, "i8")
                if (centre, salt) != at:
                    at, centres = (centre, salt), []
                if own == centre:
                    centres.append(found)
                elif any(links(c, found) for c in centres):
                    good.append((centre, own))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in good], pa.int64()), "b": pa.array([x for _, x in good], pa.int64())})

    sets = (_texts(docs, wanted).select("centre", "salt", "node", "text")
            .mapInArrow(build, "centre long, salt int, node long, shingles binary"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(parts, "centre", "salt").sortWithinPartitions("centre", "salt", F.col("node") != F.col("centre"))
    found = stored(dealt.mapInArrow(check, "a long, b long").distinct(), f"{name}-links")
    free(pairs, wanted)
    return found


def grouped(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, h (hash of the text), n_shingles,
    component_id, first: one row per row. ``first`` marks rows of the class
    that stands for its component (the smallest id, then the smallest hash)
    whose id and text are that class's; they are alike in both."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    shared = spark.sparkContext.broadcast(sampled_order(docs))

    def index(batches):
        order = shared.value
        for batch in parted(batches):
            rows = ([], [], [], [], [])
            for text in batch.column("text"):
                found, rare, seen = order.short_lists(text.as_py())
                rows[4].append(bitmap(found))
                rows[0].append(len(found))
                rows[1].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                rows[2].append(rare)
                rows[3].append(seen)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()),
                 pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.binary())],
                ["doc_id", "h", "n", "digest", "rare", "seen", "bits"])
        _HASHES.clear()  # workers are kept for later stages, which need the memory

    kinds = "doc_id long, h long, n long, digest binary, rare array<long>, seen array<int>, bits binary"
    indexed = stored(docs.mapInArrow(index, kinds).withColumn("row", F.monotonically_increasing_id()), "sets")
    per = shared.value.per
    shared.destroy()  # what it was for is written
    # a class is shown by its row with the smallest id; ``copies`` counts rows that may be the same
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row"))
    classes = stored(indexed.filter("n > 0").groupBy("digest").agg(lead.alias("lead"), F.count(F.lit(1)).alias("copies"))
                     .select("digest", F.col("lead.doc_id").alias("doc_id"), F.col("lead.h").alias("h"), F.col("lead.row").alias("node"), "copies"), "classes")
    nodes = classes.select("node", "doc_id", "h", "copies")
    sketches = indexed.select(F.col("row").alias("node"), "n", "bits")

    # Short lists of the classes, dealt over salts where they are long.
    own = classes.select(F.col("node").alias("_node"))
    reps = indexed.join(small(own), F.col("row") == F.col("_node"), "left_semi")
    postings = reps.select(F.col("row").alias("node"), F.col("n").cast("int").alias("n"), F.posexplode(F.arrays_zip("rare", "seen")).alias("place", "r")).select(
        F.col("r.rare").alias("shingle"), "node", "n", "place",
        F.ceil(F.col("r.seen") * F.lit(per) / LIST_PER_SALT).cast("int").alias("salts"))
    postings = postings.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("node"), F.col("salts").cast("long"))).otherwise(F.lit(0).cast("long")).cast("int"))
    part = Window.partitionBy("shingle", "salt")
    short = stored(postings.withColumn("df", F.count(F.lit(1)).over(part)).filter("df > 1 or salts > 1").drop("df"), "short-lists")
    # The fewer of its short lists a document shares, the farther it is from the middle of its group.
    held = short.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    lists = short.join(held, "node").withColumn("apart", (1000 - F.floor(4000 * F.col("shared") / F.col("n"))).cast("int"))
    lists = stored(lists, "central-lists")
    free(short)
    rows = lists.withColumn("first", F.min(F.struct("apart", "node", "n")).over(part))
    # one row per salt of the long lists
    heads = rows.filter("salts > 1").select("shingle", "first").distinct()
    crowns = heads.groupBy("shingle").agg(F.min("first").alias("crown"))
    stars = rows.select(F.col("first.node").alias("a"), F.col("first.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    stars = stars.union(heads.join(crowns, "shingle").select("crown.node", "crown.n", "first.node", "first.n"))
    fits = 4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")
    stars = stars.filter(F.col("a") != F.col("b")).filter(fits).groupBy("a", "b", "na", "nb").agg((F.count(F.lit(1)) / STAR_SHARE).alias("met"))
    stars = stars.filter(enough("na", "nb", "met")).select("a", "b").distinct()
    first = _verified(docs, nodes, _probable(stars, sketches, "star-pairs"), "stars")
    label = components(first)

    # Pairs of different components that meet in a short list.
    told = (lists.select("shingle", "node", "n", "place").join(label.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
            .select("shingle", "node", "n", "place", F.coalesce("component", "node").alias("component")))
    told = stored(told, "labelled-lists")
    free(lists, label)
    sizes = told.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = told.join(most.select("shingle", F.col("most.component").alias("major")), "shingle")
    minor = met.filter("component <> major").select("shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("component").alias("ca"))
    every = met.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("component").alias("cb"), "major")
    total = F.ceil(3 * (F.col("na") + F.col("nb")) / 7)
    other = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
    # One of the first |x| - T + 1 lists of either is among those of the other. All of it is the join's own condition,
    # so only rows of lists at the very top of both come out
    met = minor.join(every, (minor["shingle"] == every["shingle"]) & other & fits
                     & (F.col("pa") <= F.col("na") - total) & (F.col("pb") <= F.col("nb") - total))
    across = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = _verified(docs, nodes, _probable(across, sketches, "met"), "across")
    free(told)

    label = components(first.union(second))
    free(first, second)
    # the component's smallest id, and the class that has it
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "node")
    label = classes.join(label.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).select("node", "component", place.alias("place"))
    heads = label.groupBy("component").agg(F.min("place").alias("head"))
    label = label.join(heads, "component").select("node", F.col("head.doc_id").alias("least"), F.col("head.node").alias("head"))
    linked = classes.join(label.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"), F.col("h").alias("_h"),
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        (F.coalesce("head", "node") == F.col("node")).alias("_head"))
    alike = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    slim = stored(indexed.select("doc_id", "h", "n", "digest"), "slim-sets")
    free(indexed)
    return slim.join(linked, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | F.coalesce(F.col("_head") & alike, F.lit(False))).alias("first"))


def similar(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_shingles, component_id, one row
    per row."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""

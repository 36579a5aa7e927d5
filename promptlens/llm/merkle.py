"""Merkle manifest of a dataset with nested-interval labels.

Every row is a leaf. The leaves of a source, in ascending id order, form a tree
of fan-out three, and the roots of the sources form the tree above them. A node
is labelled by the interval of leaf ranks that it covers, ``[lo, hi)``; it lies
below another one if that one's interval contains its own.

1. Leaves are hashed where the texts lie; only digests travel. One range sort
   by (source, id) gives every leaf its tree and its rank, also where one source
   holds most of the rows: a range is a slice of ranks, not a source.
2. Level by level, the nodes that fall into one interval of the next width
   become one node, which keeps the labels of what it covers (three at most).
   Each level is a third of the one below and is written once.
3. From the top down, each level meets the next one in buckets of (tree, start
   of the wider interval) where the wider interval contains the narrower one.
   What the parent covers less the node's own interval are its siblings; they
   are put before the path that the parent has already got.

No bucket holds more than three nodes and their parent; a path has as many
steps as there are levels. Verifying a row folds its digest along its path.

Defined results: a null value counts as ``-``; a null source is a source of its
own and comes first, null ids come first in their source; rows of one id are
ordered by their digests, equal rows are leaves of their own; a source with one
row has that leaf as root; a table without rows gives no rows; further columns
are ignored. A row whose id is null is never tampered with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm.common import small, stored, table

FAN_OUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf digest of each row of ``docs`` (binary); ``text`` stands in for
    the column of that name."""
    def part(name: str) -> Column:
        value = text if text is not None and name == "text" else docs[name]
        value = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.unhex(F.sha2(F.concat(*(part(name) for name in FIELDS)), 256))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (stored; source, doc_id, digest, ...) with ``tree``, the rank
    of the source, ``lo``, the rank in the source, and ``n``, the leaves of the
    source."""
    spark = leaves.sparkSession
    columns = leaves.columns

    def number(batches):
        here, tree, place, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            source = batch.column("source")
            # a flag before the value tells null from the empty text
            value = pc.binary_join_element_wise(pc.if_else(source.is_null(), "0", "1"), source.fill_null(""), "")
            new = np.r_[last is None or value[0].as_py() != last,
                        pc.not_equal(value[1:], value[:-1]).to_numpy(zero_copy_only=False)].astype(bool)
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            lo = np.where(start < 0, at + place, at - start)
            trees = tree + np.cumsum(new)
            last, tree, place = value[-1].as_py(), int(trees[-1]), int(lo[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, here, "i4")), pa.array(trees.astype("i8")), pa.array(lo.astype("i8"))],
                [*columns, "range", "in_range", "place"])

    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("row")]
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema)
    placed = stored(leaves.repartitionByRange(count, *order).sortWithinPartitions(*order)
                    .mapInArrow(number, f"{kinds}, range int, in_range long, place long"), "merkle-placed")
    # Only the first source of a range can have begun in an earlier one, so a row per range tells where each begins.
    ends = (placed.groupBy("range", "in_range").agg(F.count("*").alias("rows"), F.first("source").alias("source"))
            .groupBy("range").agg(F.max("in_range").alias("most"),
                                  F.min_by("source", "in_range").alias("first"),
                                  F.max_by(F.struct("source", "rows"), "in_range").alias("last")).collect())
    offsets, tree, rows, last = [], -1, 0, None
    for end in sorted(ends, key=lambda end: end["range"]):
        goes_on = tree >= 0 and end["first"] == last
        tree0, place0 = (tree, rows) if goes_on else (tree + 1, 0)
        offsets.append((end["range"], tree0, place0))
        tree, last = tree0 + end["most"], end["last"]["source"]
        rows = end["last"]["rows"] + (place0 if end["most"] == 0 else 0)
    offset = F.broadcast(spark.createDataFrame(offsets, "range int, tree0 long, place0 long"))
    told = placed.join(offset, "range").select(
        *columns, (F.col("tree0") + F.col("in_range")).alias("tree"),
        (F.col("place") + F.when(F.col("in_range") == 0, F.col("place0")).otherwise(0)).alias("lo"))
    sizes = stored(told.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    return stored(told.join(small(sizes), "tree").withColumn("hi", F.col("lo") + 1), "merkle-leaves")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of all trees by level, leaves first: tree, n, lo, hi, digest
    and, above the leaves, ``run``, the nodes that it is made of."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    found, width = [leaves], 1
    while width < most:
        several = found[-1].filter(F.col("n") > width)  # trees with one node are complete
        width *= FAN_OUT
        start = F.col("lo") - F.col("lo") % width
        run = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        nodes = (several.groupBy("tree", "n", start.alias("at")).agg(run.alias("run"))
                 .select("tree", "n", F.col("at").alias("lo"), F.least(F.col("at") + width, "n").alias("hi"),
                         F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: _hex(x["digest"])), ""), 256)).alias("digest"),
                         "run"))
        found.append(stored(nodes, f"merkle-level-{len(found)}"))
    return found


PATH = "array<struct<before: binary, after: binary>>"


def paths(nodes: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``path``, for each step up the siblings before and after,
    and ``top``, the digest of their tree's root. ``above`` (tree, path) goes on
    the path of each root."""
    def joined(part: Column) -> Column:
        return F.aggregate(part, F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["digest"]))

    told = None
    for level in range(len(nodes) - 1, -1, -1):
        here, wider = nodes[level], FAN_OUT ** (level + 1)
        roots = here.filter(F.col("hi") - F.col("lo") == F.col("n")).withColumn("top", F.col("digest"))
        roots = roots.withColumn("path", F.lit(None)) if above is None else roots.join(above, "tree")
        roots = roots.withColumn("path", F.coalesce(F.col("path").cast(PATH), F.array().cast(PATH)))
        if told is None:
            told = roots
            continue
        up = told.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                         F.col("run").alias("p_run"), F.col("path").alias("p_path"), "top")
        contained = ((F.col("tree") == F.col("p_tree")) & (F.col("lo") - F.col("lo") % wider == F.col("p_lo"))
                     & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
        step = F.struct(joined(F.filter("p_run", lambda x: x["hi"] <= F.col("lo"))).alias("before"),
                        joined(F.filter("p_run", lambda x: x["lo"] >= F.col("hi"))).alias("after"))
        met = (here.filter(F.col("hi") - F.col("lo") < F.col("n")).join(up, contained)
               .withColumn("path", F.concat(F.array(step), "p_path")))
        told = roots.select(*here.columns, "top", "path").union(met.select(*here.columns, "top", "path"))
    return told


def folded(leaf: Column, path: str | Column = "path") -> Column:
    """The root (hex) that ``leaf`` (hex) leads to along ``path``."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(_hex(step["before"]), node, _hex(step["after"])), 256))


def proof(path: str | Column = "path") -> Column:
    """One digest (hex) of all siblings on ``path``."""
    return F.sha2(F.array_join(F.transform(path, lambda step: _hex(F.concat(step["before"], step["after"]))), ""), 256)


def manifest(docs: DataFrame, claimed: Column | None = None) -> tuple[DataFrame, str | None]:
    """Rows of ``docs`` as leaves of the manifest, and its root (hex; None
    without rows): doc_id, source, digest, claimed, top, path. ``claimed`` is
    the digest of what is to be verified later, the leaf's own if left out."""
    own = digest(docs)
    leaves = stored(docs.select(F.col("doc_id"), F.col("source").cast("string"), own.alias("digest"),
                                (own if claimed is None else claimed).alias("claimed"),
                                F.monotonically_increasing_id().alias("row")), "merkle-digests")
    of_sources = levels(ranked(leaves))
    tops = None
    for nodes in of_sources:
        roots = nodes.filter(F.col("hi") - F.col("lo") == F.col("n")).select("tree", "digest")
        tops = roots if tops is None else tops.union(roots)
    tops = stored(tops, "merkle-tops")
    count = tops.count()
    of_all = levels(stored(tops.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("lo"),
                                       (F.col("tree") + 1).alias("hi"), "digest"), "merkle-sources"))
    root = of_all[-1].select(_hex(F.col("digest"))).first() if count else None
    above = stored(paths(of_all).select(F.col("lo").alias("tree"), "path"), "merkle-source-paths")
    return paths(of_sources, above).select("doc_id", "source", "digest", "claimed", "top", "path"), root and root[0]


def verify(leaves: DataFrame, root: str | None) -> DataFrame:
    """Rows of :func:`manifest` with what each one's claimed digest leads to."""
    told = leaves.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("top")).alias("subroot"),
                         F.lit(root).cast("string").alias("root"), proof().alias("proof_sha256"),
                         folded(_hex(F.col("claimed"))).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` against the manifest, those of even crc32 with
    the line feeds of their text taken out."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.col("text").cast("string")
    claimed = F.when(tampered, digest(docs, F.replace(text, F.lit("\n"), F.lit("")))).otherwise(digest(docs))
    return verify(*manifest(docs, claimed))


OP11_SQL = """
WITH RECURSIVE
bits(i, c, k) AS (
  SELECT CAST(range AS UBIGINT), CAST(range AS UBIGINT), 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
part AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
         replace(text, chr(10), '') AS cut,
         list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
           list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS UBIGINT))),
           lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS BIGINT)])) AS crc
  FROM documents, crc),
leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, CAST(4294967295 AS UBIGINT)) % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claimed
  FROM part),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS lo,
         count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS row FROM leaf),
low(tree, n, w, k, digest) AS (
  SELECT tree, n, CAST(1 AS BIGINT), lo, leaf FROM placed
  UNION ALL
  SELECT tree, n, w * 3, k // 3, sha256(string_agg(digest, '' ORDER BY k)) FROM low WHERE n > w GROUP BY tree, n, w, k // 3),
tops AS (SELECT tree, digest, count(*) OVER () AS n FROM low WHERE w >= n),
high(n, w, k, digest) AS (
  SELECT n, CAST(1 AS BIGINT), tree, digest FROM tops
  UNION ALL
  SELECT n, w * 3, k // 3, sha256(string_agg(digest, '' ORDER BY k)) FROM high WHERE n > w GROUP BY n, w, k // 3),
step AS (
  SELECT p.row, 0 AS part, l.w,
         coalesce(string_agg(l.digest, '' ORDER BY l.k) FILTER (l.k < p.lo // l.w), '') AS before,
         coalesce(string_agg(l.digest, '' ORDER BY l.k) FILTER (l.k > p.lo // l.w), '') AS after
  FROM placed p JOIN low l ON l.tree = p.tree AND l.n > l.w AND l.k // 3 = p.lo // l.w // 3 GROUP BY p.row, l.w
  UNION ALL
  SELECT p.row, 1, h.w,
         coalesce(string_agg(h.digest, '' ORDER BY h.k) FILTER (h.k < p.tree // h.w), ''),
         coalesce(string_agg(h.digest, '' ORDER BY h.k) FILTER (h.k > p.tree // h.w), '')
  FROM placed p JOIN high h ON h.n > h.w AND h.k // 3 = p.tree // h.w // 3 GROUP BY p.row, h.w),
steps AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY part, w) AS i FROM step),
fold(row, i, node) AS (
  SELECT row, CAST(0 AS BIGINT), claimed FROM placed
  UNION ALL
  SELECT s.row, s.i, sha256(s.before || f.node || s.after) FROM fold f JOIN steps s ON s.row = f.row AND s.i = f.i + 1),
ended AS (SELECT row, max_by(node, i) AS node FROM fold GROUP BY row),
proofs AS (SELECT row, string_agg(before || after, '' ORDER BY i) AS siblings FROM steps GROUP BY row)
SELECT p.doc_id, p.leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(s.siblings, '')) AS proof_sha256,
       e.node AS folded_root, e.node = r.digest AS verified
FROM placed p JOIN tops t ON t.tree = p.tree JOIN (SELECT digest FROM high WHERE w >= n) r ON true
JOIN ended e ON e.row = p.row LEFT JOIN proofs s ON s.row = p.row
"""

"""Corpus pipeline: documents to packed training sequences.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps, with the columns of ``docs`` (the last one
returns the packed pieces). ``run`` writes each stage's result to the shared
checkpoint folder and hands the next stage the reread table.

Defined results: empty tables pass through every stage; null and blank texts
are rejected by the first; rows with a null id take part everywhere (their
duplicates are found by text); extra columns stay as they are, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm import binpack, decontaminate, jaccard, langid, pii, tokens
from promptlens.llm.common import small, stored, table

#: Letters from which on an ambiguous text is rejected: short texts are
#: ambiguous by nature, long ones only if they are in no learned language.
AMBIGUOUS_LETTERS = 200


def _carried(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), id, h (hash of the text): names of the
    stages' own never meet those of the documents."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("h"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and long texts whose two nearest
    codewords lie close together; a null lang becomes the predicted one."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    # the other columns go along under numbers, so that none is taken for a result
    own = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    told = langid.predict(docs.select(*(docs[c].alias(name) for c, name in own.items())), model, list(own.values()))
    lost = F.col("lang_pred") == langid.UNDETERMINED if model.langs else ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model.langs:
        lost |= F.col("ambiguous") & (F.length(F.regexp_replace("text", r"\P{L}", "")) >= AMBIGUOUS_LETTERS)
    lang = F.coalesce(F.col(own["lang"]), F.when(F.col("lang_pred") != langid.UNDETERMINED, F.col("lang_pred")))
    return told.filter(~lost).select(*((lang if c == "lang" else F.col(name)).alias(c) for c, name in own.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest
    id. Rows count as the same only if their texts are near duplicates: another
    text under the same id, or under none, stays. Of rows with the same id and
    text the first by all their columns stays; texts without words all stay."""
    found = jaccard.grouped(docs.select("doc_id", "text"))
    kept = found.filter("first").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("words"))
    kept = stored(kept.select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"), ((F.col("rows") == 1) | (F.col("words") == 0)).alias("whole")), "kept-ids")
    rows = _carried(docs)
    same = rows["id"].eqNullSafe(kept["kept_id"]) & (rows["h"] == kept["kept_h"])
    once = rows.join(kept.filter("whole"), same, "left_semi")
    again = rows.join(kept.filter(~F.col("whole")), same, "left_semi")
    again = again.groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.select("row.*").union(again.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = stored(found.filter("n_hit > 0").select(F.col("doc_id").cast("long").alias("hit_id"), F.col("_h").alias("hit_h")).distinct(), "contaminated")
    rows = _carried(docs)
    return rows.join(small(hit), rows["id"].eqNullSafe(hit["hit_id"]) & (rows["h"] == hit["hit_h"]), "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by [KIND]; n_chars follows the text."""
    clean = pii.redact(docs, pii.learn(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return binpack.pack_documents(docs, tokens.default_path(), end_id=0)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Learned stages cannot be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

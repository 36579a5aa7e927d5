"""The corpus pipeline against planted documents, stage by stage."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from promptlens.llm import langid

EN = "the cat of this house and that dog with is for are there were people".split()
DE = "der hund und die katze nicht mit einem haus über straße für sich wenn".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and benchmark, and what is planted in them."""
    rng = random.Random(11)
    prose = lambda words, n: " ".join(rng.choice(words) + (str.upper(rng.choice("abc")) if rng.random() < .3 else "") for _ in range(n))
    rows = [(i, prose(EN if i % 3 else DE, rng.randrange(30, 80)), "en" if i % 3 else "de") for i in range(60)]
    item = prose(EN, 15)
    near = rows[7][1].split()
    near[3] = "changed"
    rows += [(100, rows[5][1], "en"), (101, rows[5][1], "en"), (102, " ".join(near), "en"), (5, rows[5][1], "en"),
             (110, prose(EN, 20) + " " + item + " " + prose(EN, 20), "en"),
             (120, prose(EN, 25) + " mail jo@ex.org or 9.8.7.6", "en"), (121, prose(DE, 30), None),
             (130, None, "en"), (131, "", "de"), (132, "12 %% 34", None), (None, prose(EN, 40), "en")]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*r, "src0", len(r[1] or ""), "extra") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, hash string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages_remove_what_is_planted_and_nothing_else(spark, corpus):
    path, rows, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept, texts = {}, {}
    for name, stage in C.STAGES:
        before = docs
        docs = C.stored(stage(spark, docs, path), f"test-{name}")
        if name == "packing":
            continue
        assert docs.columns == columns and docs.schema == before.schema
        kept[name] = sorted((r["doc_id"] for r in docs.collect()), key=str)
        texts[name] = {r["doc_id"]: r for r in docs.collect()}
    every = [r[0] for r in rows]
    left = [i for i in every if i not in (130, 131, 132)]
    assert kept["language"] == sorted(left, key=str) and texts["language"][121]["lang"] == "de"
    left = [i for i in left if i not in (100, 101, 102)]
    left.remove(5)  # one of its two rows
    assert kept["near_duplicates"] == sorted(left, key=str)
    left.remove(110)
    assert kept["decontamination"] == sorted(left, key=str) == kept["personal_data"]
    text = texts["personal_data"][120]
    assert text["text"].endswith("mail [EMAIL] or [IP]") and text["n_chars"] == len(text["text"])
    for i in left:
        if i != 120:
            assert texts["personal_data"][i]["text"] == next(r[1] for r in rows if r[0] == i)
    assert sorted({r["doc_id"] for r in docs.collect()}, key=str) == sorted(set(left), key=str)
    fill = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert fill <= 2048


def test_run_gives_the_last_stage(spark, corpus):
    path, rows, _ = corpus
    got = C.run(spark, path)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.select("doc_id").distinct().count() == 60 + 3
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]


@pytest.mark.parametrize("name", ["score", "ambiguous", "lang_pred", "__key", "__id", "__h", "row", "id", "h", "first", "n", "node", "hit_id", "kept_h", "c0", "spans"])
def test_extra_columns_may_have_any_name(spark, corpus, name):
    path, rows, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumnRenamed("hash", name)
    stages = dict(C.STAGES)
    picked = [k for k in ("language", "near_duplicates", "decontamination", "personal_data") if k != "near_duplicates" or name in ("__key", "h", "node")]
    for stage in picked:
        got = stages[stage](spark, docs, path)
        assert got.columns == docs.columns and got.schema[name] == docs.schema[name]
        assert {r[0] for r in got.select(name).distinct().collect()} == {"extra"}


def test_texts_of_repeated_and_missing_ids_stay(spark):
    """Only near copies go: another text under the same id is no copy."""
    long = "one two three four five six seven eight nine ten eleven twelve".split()
    a, b = " ".join(long * 3 + ["end"]), " ".join(reversed(long * 2))
    near = a + " more"
    rows = [(0, near, "x"), (1, a, "x"), (1, b, "x"), (None, a, "x"), (None, "a text of its own that nobody has", "x"),
            (7, "twice the same row and text here", "s2"), (7, "twice the same row and text here", "s1"), (8, None, "x"), (8, None, "x"), (9, "  ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, C.near_duplicates(spark, docs, "").collect()), key=str)
    want = [(0, near, "x"), (1, b, "x"), (None, "a text of its own that nobody has", "x"), (7, "twice the same row and text here", "s1"),
            (8, None, "x"), (8, None, "x"), (9, "  ", "x")]
    assert got == sorted(want, key=str)


def test_empty_tables_pass(spark, corpus, tmp_path):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_unlabelled_documents_are_kept(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "%%", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in C.language(spark, docs, "").collect()] == [(1, "some words", None)]
    assert langid.fit(docs).langs == [] and re.match("u", langid.UNDETERMINED)

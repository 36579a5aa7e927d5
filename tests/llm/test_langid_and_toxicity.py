"""Language ID (op 1) and toxicity (op 5)."""

import random

import numpy as np
from pyspark.sql import functions as F

from promptlens.llm import langid, toxicity
from promptlens.llm.common import table

DATA = "/root/testdata/sf0.01"


def test_grams_are_those_of_a_plain_loop():
    data = langid.letters("Ab, c! É9")
    assert data == b" ab c \xc3\xa9 "
    want = []
    for n in langid.ORDERS:
        for i in range(len(data) - n + 1):
            h = 0
            for b in data[i:i + n]:
                h = (h * 257 + b) % 2 ** 32
            want.append(((h + n) * 2654435761 % 2 ** 32) >> 16)
    assert langid.grams(data).tolist() == want


def test_codewords_differ():
    for k in (2, 3, 4, 7, 8, 20):
        code = langid.codewords(k)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= (2 ** (k - 2) if k <= 7 else 15)
    assert len(langid.codewords(0)) == 0 and langid.codewords(1).shape == (1, 1)


def test_langid_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "de"),
            (5, "12 %%", "en"), (None, "the dog", None), (2, "the cat", "en"), (7, "the " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(docs, model, ["doc_id", "text"]).collect()}
    assert len(got) == len(rows)
    for key in ((3, None), (4, ""), (5, "12 %%")):
        assert got[key]["lang_pred"] == "und" and got[key]["score"] == 0
    assert got[None, "the dog"]["lang_pred"] == "en" and got[2, "der Hund und die Katze"]["lang_pred"] == "de"
    assert got[7, "the " * 40_000]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    empty = docs.limit(0)
    none = langid.fit(empty)
    assert langid.predict(empty, none, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}
    one = langid.fit(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(docs, one, ["doc_id"]).collect()} == {"und", "en"}


def test_langid_held_out_accuracy(spark):
    got = langid.op1_language_id(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and (held["lang"] == held["lang_pred"]).mean() >= 0.97


def lexicon():
    return toxicity.Lexicon({"grobn*": 2.0, "vile": 3.0})


def score(text):
    return toxicity.clauses(text, lexicon())


def test_grammar():
    assert score(None) == score("") == score("a clean text. of no harm") == []
    assert score("what a vile thing") == [3.0]
    assert score("you are vile")[0] > score("so vile")[0] > score("he said so vile")[0]
    assert score("not vile")[0] < score("so vile")[0] and score("not in any way at all vile") == score("so vile")
    assert score("i will kill you")[0] > score("they kill time")[0]
    assert len(score("vile. clean. vile!\nvile")) == 3
    assert score("GROBNARD***") == [2.0] and score("grobn") == [] and score("no. vile") == [3.0]


def test_words_part_at_any_space_and_at_marks():
    plain = score("you idiot")
    assert len(plain) == 1
    for text in ("you\tidiot", "you\u00a0idiot", "you\r\x0bidiot"):
        assert score(text) == plain, text
    assert len(score("IDIOT!you")) == 1 and len(score("so:idiot,you")) == 1


def test_composition_is_the_product_of_the_machines():
    machines = [toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.threatening()]
    rng = random.Random(3)
    for _ in range(50):
        states, state = [0] * 4, 0
        for _ in range(30):
            symbol = rng.randrange(toxicity.END)
            steps = [m.step(s, symbol) for m, s in zip(machines, states)]
            states = [s for s, _ in steps]
            state, weight = toxicity.GRAMMAR[state, symbol]
            assert np.isclose(weight, np.prod([w for _, w in steps]))


def test_toxicity_learns_words_not_copies(spark):
    rng = random.Random(5)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            text[rng.randrange(1, 40)] = rng.choice(["blarg", "snorkiness"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000 + i, "repeated uniquex phrase " + words[i]) for i in range(30)]
    labels += [(1000 + i, 1) for i in range(30)] + [(0, None), (None, 1), (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(f.startswith("blarg") for f in model.learned) and any(f.startswith("snork") for f in model.learned)
    assert not any(f.startswith("unique") for f in model.learned)
    more = docs.union(spark.createDataFrame([(None, None, "x"), (5000, "", "x"), (5001, "word " * 50_000 + "blarg", "x")], docs.schema))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(more, model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == more.count()
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300))
    assert got[None] == got[5000] < 0.5


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.learned == {} and toxicity.score(docs, model, ["doc_id"]).count() == 0
    some = spark.createDataFrame([(1, "you are an idiot"), (2, "hello")], docs.schema)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(some, toxicity.learn(some, labels), ["doc_id"]).collect()}
    assert got[1] > got[2]


def test_toxicity_query(spark):
    got = toxicity.op5_toxicity(spark, DATA).join(table(spark, DATA, "labels"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["toxic"] == held["predicted"]).mean() >= 0.93

"""Language identification by error-correcting output codes.

Every language gets a codeword of +1/-1 bits (all distinct splits of the
languages where they are few, the best of some seeded random codes else). One
binary classifier per bit, naive Bayes over hashed byte n-grams of the lower-
cased letters, predicts that bit from the whole text. Decoding is loss-
weighted: each bit's loss counts by how often the bit was right on the
training sample, the nearest codeword wins, and a text whose two nearest
codewords lie close together is flagged ambiguous.

Learning uses at most ``max_train_docs`` texts per language (a documented
bound, drawn by a hash of the id); prediction reads every whole text.

Defined results: ``und`` with score 0 for null text and text without a letter,
and for every text if no row has a language to learn from; null ids predict
like others; equal losses go to the alphabetically first language. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm.common import id_remainder, table, text_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MAX_TRAIN_DOCS = 6000
SMOOTHING = 0.1
#: Two nearest codewords closer than this (probability of the winner) are ambiguous.
CLEAR = 0.9
UNDETERMINED = "und"
_PLAIN = bytes(b if chr(b).islower() or b > 127 else 32 for b in range(256))


def letters(text: str) -> bytes:
    """Lower-cased letters and non-ASCII bytes, words apart by one space."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "


def grams(data: bytes) -> np.ndarray:
    """Hashed byte n-grams of all orders."""
    b = np.frombuffer(data, "u1").astype("u4")
    out, h = [], np.zeros(len(b), "u4")
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(b) - n + 1] * np.uint32(257) + b[n - 1:]) if n <= len(b) else h[:0]
        if n in ORDERS:
            mixed = (h + np.uint32(n)) * np.uint32(2654435761)
            out.append(mixed >> np.uint32(32 - (BUCKETS.bit_length() - 1)))
    return np.concatenate(out)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords: every split of the languages for k up to 7, else random
    bits, the draw with the largest least distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        splits = [[1 if i == 0 or (s >> (i - 1)) & 1 else -1 for i in range(k)] for s in range(2 ** (k - 1) - 1)]
        return np.array(splits, "f8").T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, 15 * int(np.ceil(np.log2(k)))))
        apart = ((code[:, None] != code[None]).sum(2) + np.eye(k, dtype=int) * 10 ** 6).min()
        if apart > far and (np.abs(code.sum(0)) < k).all():
            best, far = code, apart
    return best


class Model:
    """Bit classifiers, codewords and bit weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
        cols = [np.zeros(BUCKETS)] if len(langs) < 2 else [
            np.log(p[bit > 0].mean(0)) - np.log(p[bit < 0].mean(0)) for bit in self.code.T]
        self.weights = np.ascontiguousarray(np.array(cols).T, dtype="f4")
        self.trust = np.full(self.code.shape[1], 1 / self.code.shape[1])

    def margins(self, data: bytes) -> np.ndarray:
        """Log odds of the bits, damped by the root of the number of n-grams,
        as neighbouring n-grams repeat each other's evidence."""
        g = grams(data)
        return self.weights[g].sum(0, dtype="f8") / np.sqrt(len(g))

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return (np.logaddexp(0, -self.code * margins) * self.trust).sum(1)

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        loss = self.losses(self.margins(letters(text))) * len(self.trust)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmin(loss))
        return self.langs[best], float(p[best]), bool(p[best] < CLEAR)


def fit(labelled: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang): at most about
    ``max_train_docs`` texts of each language, by a hash of the id."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().withColumn("keep", F.least(F.lit(1.0), F.lit(float(max_train_docs)) / F.col("count")))
    drawn = (rows.join(F.broadcast(sizes), "lang")  # one row per language
             .filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < F.col("keep") * (1 << 20))
             .select("lang", "text"))

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, "i8")
                seen[lang] += np.bincount(grams(letters(text.as_py())), minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "bucket": pa.array([at], pa.list_(pa.int64())),
                                              "n": pa.array([n[at]], pa.list_(pa.int64()))})

    held = drawn.mapInArrow(count, "lang string, bucket array<long>, n array<long>")
    # At most languages x buckets rows come back: the size of the model.
    found = (held.select("lang", F.explode(F.arrays_zip("bucket", "n")).alias("g"))
             .groupBy("lang", F.col("g.bucket").alias("bucket")).agg(F.sum("g.n").alias("n")).toPandas())
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        mine = found[found["lang"] == lang]
        counts[i, mine["bucket"].to_numpy()] = mine["n"].to_numpy()
    model = Model(langs, counts)
    if len(langs) < 2:
        return model
    shared = spark.sparkContext.broadcast(model)

    def right(batches):
        good, n = np.zeros(model_bits), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                bits = shared.value.code[shared.value.langs.index(lang)]
                good += shared.value.margins(letters(text.as_py())) * bits > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "good": pa.array([good], pa.list_(pa.float64()))})

    model_bits = model.code.shape[1]
    told = drawn.filter(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).mapInArrow(right, "n long, good array<double>")
    bits = told.select("n", F.posexplode("good")).groupBy("pos").agg((F.sum("col") / F.sum("n")).alias("p")).collect()
    trust = np.zeros(model_bits)
    for r in bits:
        trust[r["pos"]] = max((r["p"] or 0.5) - 0.5, 0.01)
    model.trust = trust / trust.sum() if trust.sum() else model.trust
    return model


def predict(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """``carried`` columns of ``docs``, then lang_pred, score, ambiguous, for
    every whole ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(batches):
        for batch in batches:
            for a, b in text_batches(batch, "text"):
                part = batch.slice(a, b - a)
                told = [shared.value.decide(t.as_py()) for t in part.column("text")]
                kept = [part.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64()),
                     pa.array([x[2] for x in told], pa.bool_())], [*carried, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)
    wide = docs.select(*carried, *([] if "text" in carried else ["text"]))
    return wide.mapInArrow(decide, f"{schema}, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = docs.select("doc_id", "text", (id_remainder("doc_id", 3) == 1).alias("held_out"))
    model = fit(docs.filter(id_remainder("doc_id", 3) != 1))
    return predict(held, model, ["doc_id", "held_out"])

"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps each word to a symbol (insult, threat, target,
negation, reported speech, intent, plain) with a weight. Small clause machines
(negation scope, reported speech, target, threat with intent) are composed
into one weighted automaton that reads the symbols of a clause; each insult or
threat leaves the clause with the product of the machines' weights. A text's
score is a logistic function of its clauses' scores, not of isolated words.

Insult words and stems (``stem*``) with their weights are learned from labelled
rows: those whose presence in toxic texts is far above that in clean ones, and
which follow many different words, so that what a group of copies repeats is
not taken for an insult.
Learning uses at most ``max_train_docs`` texts of either label (documented
bound, drawn by a hash of the id); scoring reads every whole text.

Defined results: null and empty texts score like a text without a match; of
labels that repeat an id the largest counts, null labels and ids do not take
part in learning; without both labels only the built-in words are used. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm.common import id_remainder, parted, table

PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, END = range(8)

# Function words and built-in insults and threats.
WORDS = {
    TARGET: "you your yours yourself u he she him her they them their these those this that",
    NEGATION: "not no never neither nor without isn't aren't wasn't don't doesn't won't can't nicht kein keine ne pas nunca",
    REPORT: "said says say called calls wrote writes quoted quotes claimed claims reported reports alleged",
    INTENT: "will shall gonna going want wanna must should hope ll i'll we'll",
    THREAT: "kill hurt destroy burn stab shoot murder beat crush punish",
    INSULT: "idiot moron stupid scum trash loser worthless pathetic disgusting",
}
MAX_TRAIN_DOCS = 6000
STEMS = range(3, 8)
#: Learned features: toxic texts that hold it at least, the least share of toxic
#: among (equally weighted) texts that hold it, different words before it.
MIN_TEXTS, MIN_PURITY, MIN_CONTEXTS = 5, 0.97, 8
NEGATION_SCOPE = 3
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: White space besides blanks and line feeds, and marks between two words.
_ODD_SPACE = re.compile(r"[^\S \n]+")
_GLUED = re.compile(r"(?<=[^\W\d_])([!?;,:]+)(?=[^\W\d_])")
_LETTERS = re.compile(r"[^\W\d_]+")
_LONGEST = 48


# -- automata -----------------------------------------------------------------

@dataclass(frozen=True)
class Machine:
    """Weighted automaton over symbols: arcs (state, symbol) -> (state,
    weight). A missing arc stays in its state with weight 1."""

    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, 1.0))


def negation(scope: int = NEGATION_SCOPE) -> Machine:
    """After a negation, insults within ``scope`` words are turned round."""
    arcs = {(s, NEGATION): (scope, 1.0) for s in range(scope + 1)}
    for s in range(1, scope + 1):
        arcs |= {(s, x): (s - 1, 1.0) for x in (PLAIN, TARGET, REPORT, INTENT)}
        arcs |= {(s, x): (s - 1, 0.2) for x in (INSULT, THREAT)}
    return Machine(arcs)


def reported() -> Machine:
    """After a verb of saying, what follows in the clause is someone else's."""
    return Machine({(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.5), (1, THREAT): (1, 0.5)})


def targeted() -> Machine:
    """A person addressed before the insult makes it weigh more."""
    return Machine({(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.5), (1, THREAT): (1, 1.5)})


def threatening() -> Machine:
    """A threat word counts in full after a word of intent only."""
    return Machine({(0, THREAT): (0, 0.1), (0, INTENT): (1, 1.0), (1, THREAT): (1, 2.0)})


def compose(*machines: Machine) -> dict:
    """The product automaton, reached states only: (state, symbol) ->
    (state, product of weights); states are numbered, 0 is the start."""
    start = (0,) * len(machines)
    number, todo, table_ = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for symbol in range(END):
            steps = [m.step(s, symbol) for m, s in zip(machines, state)]
            target = tuple(s for s, _ in steps)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            table_[number[state], symbol] = (number[target], math.prod(w for _, w in steps))
    return table_


GRAMMAR = compose(negation(), reported(), targeted(), threatening())


# -- lexicon ------------------------------------------------------------------

def features(words: set[str]) -> set[str]:
    """Whole words and, as ``stem*``, their beginnings."""
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Lexicon(dict):
    """chunk of text -> 0 (plain), or (symbol, weight, ends the clause).
    Entries are computed when missed; the cache is emptied when full."""

    def __init__(self, learned: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.learned, self.limit = learned, limit
        self.fixed = {w: (symbol, 1.0) for symbol, words in WORDS.items() for w in words.split()}
        self.lengths = sorted({len(f) - 1 for f in learned if f.endswith("*")})

    def __reduce__(self):
        return Lexicon, (self.learned, self.limit)

    def symbol(self, word: str):
        if word in self.learned:
            return INSULT, self.learned[word]
        best = max((self.learned[word[:n] + "*"] for n in self.lengths
                    if len(word) > n and word[:n] + "*" in self.learned), default=None)
        return (INSULT, best) if best is not None else self.fixed.get(word, (PLAIN, 0.0))

    def __missing__(self, chunk: str):
        symbol, weight = self.symbol(_EDGES.sub("", chunk))
        ends = chunk == "\n" or chunk[-1:] in ".!?;"
        value = (symbol, weight, ends) if symbol or ends else 0
        if len(chunk) <= _LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = value
        return value


def clauses(text: str | None, lexicon: Lexicon) -> list[float]:
    """Scores of the clauses that hold an insult or a threat."""
    if not text:
        return []
    if _ODD_SPACE.search(text):
        text = _ODD_SPACE.sub(" ", text)
    text = _GLUED.sub(r"\1 ", text.lower().replace("\n", " \n "))
    read = list(map(lexicon.__getitem__, text.split(" ")))
    if not any(x and x[0] in (INSULT, THREAT) for x in read):
        return []
    out, state, score, seen = [], 0, 0.0, False
    for x in read:
        symbol, weight, ends = x or (PLAIN, 0.0, False)
        state, factor = GRAMMAR[state, symbol]
        if symbol in (INSULT, THREAT):
            score += weight * factor
            seen = True
        if ends:
            if seen:
                out.append(score)
            state, score, seen = 0, 0.0, False
    return out + [score] * seen


def summary(scores: list[float]) -> tuple[float, float]:
    return max(scores, default=0.0), math.log1p(sum(max(s, 0.0) for s in scores))


@dataclass(frozen=True)
class Model:
    learned: dict
    intercept: float = -3.0
    slopes: tuple = (2.0, 1.0)

    def score(self, text: str | None, lexicon: Lexicon) -> float:
        z = self.intercept + sum(a * b for a, b in zip(self.slopes, summary(clauses(text, lexicon))))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


# -- learning -----------------------------------------------------------------

def _sample(docs: DataFrame, labels: DataFrame, max_train_docs: int) -> DataFrame:
    """(text, toxic) of at most about ``max_train_docs`` labelled texts of
    either label. The drawn ids are bounded by that, so they are broadcast."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = known.groupBy("toxic").count().collect()  # two rows
    keep = F.lit(False)
    for r in sizes:
        share = int(min(1.0, max_train_docs / r["count"]) * (1 << 20))
        keep |= (F.col("toxic") == r["toxic"]) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(known.filter(keep)), "doc_id").select("text", "toxic")


def _words(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


def _counts(texts: DataFrame, among: set[str] | None) -> DataFrame:
    """Texts per feature; only features of ``among`` where it is given."""
    shared = texts.sparkSession.sparkContext.broadcast(among)

    def count(batches):
        n, only = Counter(), shared.value
        for batch in batches:
            for text in batch.column("text"):
                found = features(_words(text.as_py()))
                n.update(found if only is None else found & only)
        if n:
            yield pa.RecordBatch.from_pydict({"feature": list(n), "n": list(n.values())})

    return texts.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _contexts(texts: DataFrame, among: set[str]) -> DataFrame:
    """Different words found before each feature of ``among``."""
    shared = texts.sparkSession.sparkContext.broadcast(among)

    def pairs(batches):
        found = set()
        for batch in batches:
            for text in batch.column("text"):
                words = _LETTERS.findall((text.as_py() or "").lower())
                for before, word in zip(["", *words], words):
                    found.update((f, before) for f in features({word}) & shared.value)
        if found:
            yield pa.RecordBatch.from_pydict({"feature": [f for f, _ in found], "before": [b for _, b in found]})

    return (texts.select("text").mapInArrow(pairs, "feature string, before string").distinct()
            .groupBy("feature").agg(F.count(F.lit(1)).alias("n")))


def _distinct(scored: dict[str, float], texts: dict[str, int]) -> dict[str, float]:
    """Drop a stem when a longer feature explains nearly all its texts, and a
    feature when a kept shorter stem weighs about as much."""
    explained = set()
    for f in scored:
        core = f.rstrip("*")
        for n in STEMS:
            stem = core[:n] + "*"
            if stem != f and n <= len(core) and stem in scored and texts[f] >= 0.95 * texts[stem]:
                explained.add(stem)
    chosen: dict[str, float] = {}
    for f in sorted(set(scored) - explained, key=lambda f: (len(f.rstrip("*")), f)):
        core = f.rstrip("*")
        if all(chosen.get(core[:n] + "*", 0) < 0.8 * scored[f] for n in STEMS if n <= len(core)):
            chosen[f] = scored[f]
    return chosen


def learn(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    spark = docs.sparkSession
    sample = _sample(docs, labels, max_train_docs)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({})
    # Words of at most max_train_docs texts that recur in them: bounded by the sample.
    often = {r["feature"]: r["n"] for r in _counts(sample.filter("toxic = 1"), None).filter(F.col("n") >= MIN_TEXTS).collect()}
    clean = {r["feature"]: r["n"] for r in _counts(sample.filter("toxic = 0"), set(often)).collect()}
    scored = {}
    for f, n in often.items():
        p, q = (n + 0.5) / (sizes[1] + 1), (clean.get(f, 0) + 0.5) / (sizes[0] + 1)
        # a share this high must not be the luck of few texts
        if p / (p + q) >= MIN_PURITY and n * math.log(p / q) >= 3 * MIN_TEXTS:
            scored[f] = math.log(p / q)
    told = _contexts(sample.filter("toxic = 1"), set(scored)).filter(F.col("n") >= MIN_CONTEXTS)
    scored = {r["feature"]: scored[r["feature"]] for r in told.select("feature").collect()}
    chosen = _distinct(scored, often)

    shared = spark.sparkContext.broadcast(chosen)

    def summaries(batches):
        lexicon = Lexicon(shared.value)
        for batch in batches:
            rows = [summary(clauses(t.as_py(), lexicon)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(2))],
                ["toxic", "most", "total"])

    told = sample.mapInArrow(summaries, "toxic int, most double, total double").toPandas()
    x = np.column_stack([np.ones(len(told)), told[["most", "total"]].to_numpy()])
    y = told["toxic"].to_numpy()
    w = np.where(y == 1, len(y) / 2 / max(1, (y == 1).sum()), len(y) / 2 / max(1, (y == 0).sum())) ** 0.5
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        beta += np.linalg.solve(hess, x.T @ (w * (y - p)) - 0.1 * beta)
    return Model(chosen, float(beta[0]), tuple(float(b) for b in beta[1:]))


def score(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """``carried`` columns of ``docs``, then score, for every whole ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches):
        lexicon = Lexicon(shared.value.learned)
        for batch in parted(batches):
            values = [shared.value.score(t.as_py(), lexicon) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(values, pa.float64())],
                                             [*carried, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)
    wide = docs.select(*carried, *([] if "text" in carried else ["text"]))
    return wide.mapInArrow(tell, f"{schema}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    train = docs.filter(id_remainder("doc_id", 5) != 0)
    model = learn(train, labels.filter(id_remainder("doc_id", 5) != 0))
    scored = score(docs.withColumn("held_out", id_remainder("doc_id", 5) == 0), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

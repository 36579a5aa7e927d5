"""Text metrics over a table of text pairs and diversity over candidate
groups.

Pairs follow the evaluator's contract ``metric(text1, text2)`` with
text1 = generated prompt and text2 = reference prompt:

* Jaccard / word overlap on lower-cased word sets (null if a set is empty)
* BLEU-4: reference = text1 tokens, hypothesis = text2 tokens; clipped
  n-gram precision n=1..4, equal weights, brevity penalty, smoothing
  method 1 (0.1 numerator when zero), 0 without any unigram match
* ROUGE-1/2 F: hypothesis = text1, reference = text2; sentences split on
  '.', white space normalised, distinct n-grams, case kept
* ROUGE-L F: summary-level union LCS (per-pair dynamic programme in an
  Arrow batch; the only per-pair Python code)

Tokeniser: lower-case + white space (no NLTK here).
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.functions import text as T

BLEU_EPSILON = 0.1
ROUGE_EPS = 1e-8
#: Characters of text whose words or n-grams one task counts.
CHARS_PER_TASK = 1 << 20


def _dealt(df: DataFrame, keys, *texts: str) -> DataFrame:
    """keys and texts, dealt by the keys into partitions of about
    ``CHARS_PER_TASK``: the words and n-grams of a key are then counted where
    its texts are, so texts are shuffled instead of n-grams, and what a task
    counts does not grow with the input."""
    chars = df.agg(sum(F.coalesce(F.sum(F.length(t)), F.lit(0)) for t in texts)).first()[0]
    n = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / CHARS_PER_TASK))
    return df.select(*keys, *texts).repartition(n, *keys)


def jaccard_pairs(df: DataFrame, key, t1: str = "text1", t2: str = "text2") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    a = F.array_distinct(T.lower_words(t1))
    b = F.array_distinct(T.lower_words(t2))
    x = df.select(*keys, a.alias("_a"), b.alias("_b"))
    inter = F.size(F.array_intersect("_a", "_b"))
    union = F.size(F.array_union("_a", "_b"))
    ok = (F.size("_a") > 0) & (F.size("_b") > 0)
    return x.select(*keys,
                    F.when(ok, inter / union).alias("jaccard"),
                    F.when(ok, inter / F.least(F.size("_a"), F.size("_b"))).alias("word_overlap"))


# ----------------------------------------------------------------- BLEU
def _gram_rows(df: DataFrame, keys, texts: list[str], ns=(1, 2, 3, 4)) -> DataFrame:
    """keys, place of the text in ``texts``, n and gram: a row per n-gram."""
    x = df.select(*keys, *[T.lower_words(t).alias(f"_t{i}") for i, t in enumerate(texts)])
    arr = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("n"), T.ngrams(f"_t{i}", n).alias("g"))
                    for i in range(len(texts)) for n in ns])
    y = x.select(*keys, F.explode(arr).alias("_s"))
    return y.select(*keys, F.col("_s.at").alias("_at"), F.col("_s.n").alias("n"), F.explode("_s.g").alias("gram"))


def bleu_pairs(df: DataFrame, key, t1: str = "text1", t2: str = "text2") -> DataFrame:
    """Sentence BLEU-4 per pair, by n-gram counting (linear in text length,
    no per-pair Python). Both sides' n-grams go through one explode and one
    ``groupBy(pair, n, gram)`` that counts each side; a second aggregate per
    pair sums the clipped matches and the lengths. The texts are dealt by pair
    before, so n-grams are not shuffled. Null when either side has no token."""
    keys = [key] if isinstance(key, str) else list(key)
    g = (_gram_rows(_dealt(df, keys, t1, t2), keys, [t1, t2]).groupBy(*keys, "n", "gram")
         .agg(F.count_if(F.col("_at") == 1).alias("hc"), F.count_if(F.col("_at") == 0).alias("rc")))
    clip = g.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("n") == n, F.least("hc", "rc"))).alias(f"m{n}") for n in (1, 2, 3, 4)])
    base = df.select(*keys, F.size(T.lower_words(t1)).alias("r_len"),
                     F.size(T.lower_words(t2)).alias("c_len"))
    x = base.join(clip, keys, "left")
    logs = []
    for n in (1, 2, 3, 4):
        m = F.coalesce(F.col(f"m{n}"), F.lit(0))
        denom = F.greatest(F.col("c_len") - n + 1, F.lit(1))
        p = F.when(m > 0, m).otherwise(F.lit(BLEU_EPSILON)) / denom
        logs.append(F.log(p))
    geo = F.exp(sum(logs) / 4.0)
    bp = F.when(F.col("c_len") > F.col("r_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("r_len") / F.col("c_len")))
    m1 = F.coalesce(F.col("m1"), F.lit(0))
    score = (F.when((F.col("r_len") == 0) | (F.col("c_len") == 0), F.lit(None).cast("double"))
             .when(m1 == 0, F.lit(0.0)).otherwise(bp * geo))
    return x.select(*keys, score.alias("bleu"))


# ----------------------------------------------------------------- ROUGE
def rouge_words(t) -> "F.Column":
    """Words of the ROUGE tokeniser: split on '.', drop empty pieces,
    normalise white space, then split each sentence on a single space."""
    c = F.col(t) if isinstance(t, str) else t
    sents = F.filter(F.split(c, r"\.", -1), lambda s: F.length(s) > 0)
    norm = F.transform(sents, lambda s: F.array_join(T.words(s), " "))
    return F.flatten(F.transform(norm, lambda s: F.split(s, " ", -1)))


def _bigrams(w):
    return F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1),
                                             lambda i: F.concat(F.element_at(w, i), F.lit(" "),
                                                                F.element_at(w, i + 1)))
                  ).otherwise(F.array().cast("array<string>"))


def _f(overlap, n_hyp, n_ref):
    p = F.when(n_hyp == 0, F.lit(0.0)).otherwise(overlap / n_hyp)
    r = F.when(n_ref == 0, F.lit(0.0)).otherwise(overlap / n_ref)
    return F.lit(2.0) * ((p * r) / (p + r + F.lit(ROUGE_EPS)))


def rouge_pairs(df: DataFrame, key, t1: str = "text1", t2: str = "text2") -> DataFrame:
    """ROUGE-1 and ROUGE-2 F (hypothesis = text1, reference = text2)."""
    keys = [key] if isinstance(key, str) else list(key)
    x = df.select(*keys, rouge_words(t1).alias("_h"), rouge_words(t2).alias("_r"))
    h1, r1 = F.array_distinct("_h"), F.array_distinct("_r")
    h2, r2 = F.array_distinct(_bigrams(F.col("_h"))), F.array_distinct(_bigrams(F.col("_r")))
    y = x.select(*keys, h1.alias("h1"), r1.alias("r1"), h2.alias("h2"), r2.alias("r2"))
    return y.select(*keys,
                    _f(F.size(F.array_intersect("h1", "r1")), F.size("h1"), F.size("r1")).alias("rouge_1"),
                    _f(F.size(F.array_intersect("h2", "r2")), F.size("h2"), F.size("r2")).alias("rouge_2"))


def _sentences(text: str) -> list[list[str]]:
    return [" ".join(s.split()).split(" ") for s in text.split(".") if len(s) > 0]


#: Occurrences from which a word's bit mask is kept.
_OFTEN = 16


def _lcs_positions(ref: list[str], hyp: list[str]) -> set[int]:
    """Positions (in ``ref``) of one longest common subsequence, the one that a
    walk back from the end finds that goes up in ``ref`` where it can.

    A row of the length table is a bit vector over ``hyp`` with a 0 where the
    length grows, and follows from the row before by an addition. Every root-th
    row is kept; the walk rebuilds the rows between two of them when it gets
    there, so memory is about 2 sqrt(n) m bits."""
    n, m = len(ref), len(hyp)
    if n == 0 or m == 0:
        return set()
    places: dict[str, list[int]] = {}
    for j, w in enumerate(hyp):
        places.setdefault(w, []).append(j)
    often = {w: sum(1 << j for j in at) for w, at in places.items() if len(at) >= _OFTEN}
    full = (1 << m) - 1

    def rows(first: int, last: int, row: int) -> list[int]:
        """Rows ``first`` + 1 to ``last`` after ``row``."""
        out = []
        for w in ref[first:last]:
            mask = often[w] if w in often else sum(1 << j for j in places.get(w, ()))
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
            out.append(row)
        return out

    step = max(1, int(n ** 0.5))
    kept = {0: full}
    for first in range(0, n, step):
        last = min(n, first + step)
        kept[last] = rows(first, last, kept[first])[-1]
    out, i, j = set(), n, m
    first, block = n, []
    grown = lambda row, j: j - (row & ((1 << j) - 1)).bit_count()  # noqa: E731  the length in the first j columns
    while i > 0 and j > 0:
        if i <= first:  # rows first .. first + step, the walk is below the last one
            first = (i - 1) // step * step
            block = [kept[first], *rows(first, min(n, first + step), kept[first])]
        if ref[i - 1] == hyp[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif not block[i - first] >> (j - 1) & 1 or grown(block[i - 1 - first], j) == grown(block[i - first], j):
            i -= 1
        else:
            j -= 1
    return out


def rouge_l(hyp_text: str | None, ref_text: str | None) -> float | None:
    if hyp_text is None or ref_text is None:
        return None
    hyp, ref = _sentences(hyp_text), _sentences(ref_text)
    if not hyp or not ref:
        return None
    m = len({w for s in ref for w in s})
    n = len({w for s in hyp for w in s})
    llcs = 0
    for r in ref:
        union: set[int] = set()
        for h in hyp:
            union |= _lcs_positions(r, h)
        llcs += len(union)
    p = llcs / n if n else 0.0
    r_ = llcs / m if m else 0.0
    return 2.0 * ((p * r_) / (p + r_ + ROUGE_EPS))


def rouge_l_pairs(df: DataFrame, key, t1: str = "text1", t2: str = "text2") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    x = df.select(*keys, F.col(t1).alias("_h"), F.col(t2).alias("_r"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields
                       if f.name in keys) + ", rouge_l double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vals = [rouge_l(h, r) for h, r in zip(pdf["_h"], pdf["_r"])]
            out = pdf[keys].copy()
            out["rouge_l"] = vals
            yield out

    return x.mapInPandas(run, schema)


# ----------------------------------------------------------------- diversity
def vocab_diversity(df: DataFrame, group: str, text: str = "prompt") -> DataFrame:
    w = _dealt(df, [group], text).select(group, F.explode(T.lower_words(text)).alias("w"))
    g = w.groupBy(group).agg(F.count_distinct("w").alias("vocabulary_size"),
                             F.count(F.lit(1)).alias("_total"))
    base = df.select(group).distinct()
    x = base.join(g, group, "left")
    return x.select(group, F.coalesce("vocabulary_size", F.lit(0)).alias("vocabulary_size"),
                    F.coalesce(F.try_divide(F.col("vocabulary_size"), F.col("_total")),
                               F.lit(0.0)).alias("type_token_ratio"))


def length_diversity(df: DataFrame, group: str, text: str = "prompt") -> DataFrame:
    x = df.select(group, T.word_count(text).alias("n"))
    return x.groupBy(group).agg(F.avg("n").alias("avg_length"),
                                F.stddev_pop("n").alias("length_std"),
                                (F.max("n") - F.min("n")).cast("long").alias("length_range"))


def distinct_ngrams(df: DataFrame, group: str, text: str = "prompt", ns=(1, 2, 3)) -> DataFrame:
    """distinct n-grams / total n-grams per group and n; 0 when none."""
    g = _gram_rows(_dealt(df, [group], text), [group], [text], ns)
    agg = g.groupBy(group, "n").agg(F.count_distinct("gram").alias("_d"),
                                    F.count(F.lit(1)).alias("_t"))
    base = df.select(group).distinct().select(group, F.explode(F.array(*[F.lit(n) for n in ns])).alias("n"))
    x = base.join(agg, [group, "n"], "left")
    return x.select(group, F.col("n").cast("long").alias("n"),
                    F.coalesce(F.try_divide(F.col("_d"), F.col("_t")), F.lit(0.0)).alias("distinct_n"))


def pairwise_jaccard(df: DataFrame, group: str, member: str, text: str = "prompt") -> DataFrame:
    """Mean / population std of Jaccard over member pairs of a group whose
    word sets are both non-empty.

    Only pairs that share a token are materialised (an inverted-index
    self-join on (group, token)); all other eligible pairs contribute 0 and
    are counted arithmetically as k(k-1)/2. Groups are candidate sets of a
    fixed size n, so a pair list never exceeds n(n-1)/2 per group."""
    sets = df.select(group, member, F.array_distinct(T.lower_words(text)).alias("_s"))
    sets = sets.where(F.size("_s") > 0)
    sizes = sets.select(group, member, F.size("_s").alias("_n"))
    toks = sets.select(group, member, F.explode("_s").alias("tok"))
    a = toks.select(group, F.col(member).alias("_a"), "tok")
    b = toks.select(group, F.col(member).alias("_b"), "tok")
    inter = (a.join(b, [group, "tok"]).where(F.col("_a") < F.col("_b"))
             .groupBy(group, "_a", "_b").agg(F.count(F.lit(1)).alias("_i")))
    sa = sizes.select(group, F.col(member).alias("_a"), F.col("_n").alias("_na"))
    sb = sizes.select(group, F.col(member).alias("_b"), F.col("_n").alias("_nb"))
    j = inter.join(sa, [group, "_a"]).join(sb, [group, "_b"])
    jac = j.select(group, (F.col("_i") / (F.col("_na") + F.col("_nb") - F.col("_i"))).alias("_j"))
    sums = jac.groupBy(group).agg(F.sum("_j").alias("_s1"), F.sum(F.col("_j") * F.col("_j")).alias("_s2"))
    k = sizes.groupBy(group).agg(F.count(F.lit(1)).alias("_k"))
    x = k.where(F.col("_k") >= 2).join(sums, group, "left")
    npairs = F.col("_k") * (F.col("_k") - 1) / 2
    mean = F.coalesce(F.col("_s1"), F.lit(0.0)) / npairs
    var = F.greatest(F.coalesce(F.col("_s2"), F.lit(0.0)) / npairs - mean * mean, F.lit(0.0))
    return x.select(group, mean.alias("avg_pairwise_similarity"), F.sqrt(var).alias("similarity_std"))


def diversity(df: DataFrame, group: str, member: str, text: str = "prompt") -> DataFrame:
    """All diversity metrics per group having more than one candidate."""
    multi = df.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).select(group)
    x = df.join(multi, group, "left_semi")
    dn = distinct_ngrams(x, group, text).groupBy(group).pivot("n", [1, 2, 3]).agg(F.first("distinct_n"))
    dn = dn.select(group, *[F.col(str(n)).alias(f"distinct_{n}grams") for n in (1, 2, 3)])
    return (vocab_diversity(x, group, text)
            .join(length_diversity(x, group, text), group)
            .join(pairwise_jaccard(x, group, member, text), group, "left")
            .join(dn, group))

"""Text metric, diversity and evaluation-aggregate queries (P-21, M-01..M-06,
A-18..A-25, E-02, J-04, J-08, U-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.functions.frames import written
from promptlens.operators import evaluate as EV
from promptlens.operators import textsim as TS
from promptlens.operators import vectors as OV
from promptlens.plans import sqlfrag as S
from promptlens.plans import views as V
from promptlens.plans.registry import register

N_CANDIDATES = 5


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


# ----------------------------------------------------------------- views
def candidates(spark, d, n: int = N_CANDIDATES):
    """(target_id, slot, prompt, similarity): the n prompts retrieved for
    every prompt-owning vector, leave-one-out. Groups have exactly n rows."""
    from promptlens.plans.stage import staged
    return staged(spark, d, f"candidates-{n}", lambda: build_candidates(spark, d, n))


def build_candidates(spark, d, n: int = N_CANDIDATES):
    c = V.corpus(spark, d)
    nn = OV.topk_similar(c, c, k=n, target_key="original_index", corpus_key="original_index")
    prompts = c.select(F.col("original_index").alias("vec_id"), "prompt")
    return nn.join(prompts, "vec_id").select("target_id", F.col("rank").alias("slot"), "prompt",
                                             "similarity")


CAND_SQL = f"""candidates AS (
  SELECT target_id, rank AS slot, prompt, sim AS similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(sim, 9) DESC, vec_id) AS rank
    FROM (SELECT a.original_index AS target_id, b.original_index AS vec_id, b.prompt,
                 {S.cosine('a.embedding', 'b.embedding')} AS sim
          FROM corpus a JOIN corpus b ON a.original_index <> b.original_index) s) r
  WHERE rank <= {N_CANDIDATES})"""


def gen(spark, d):
    """(target_id, text1 = generated prompt (best candidate), text2 =
    reference prompt of the target)."""
    cand = candidates(spark, d).where(F.col("slot") == 1)
    ref = V.corpus(spark, d).select(F.col("original_index").alias("target_id"),
                                    F.col("prompt").alias("text2"))
    return cand.select("target_id", F.col("prompt").alias("text1")).join(ref, "target_id")


GEN_SQL = """gen AS (
  SELECT c.target_id, c.prompt AS text1, p.prompt AS text2
  FROM candidates c JOIN corpus p ON c.target_id = p.original_index WHERE c.slot = 1)"""

_CV = ["corpus"]
_CC = [CAND_SQL]
_CG = [CAND_SQL, GEN_SQL]


# ----------------------------------------------------------------- P-21
@register("ngrams", V.oracle(f"""
SELECT target_id, slot, n::BIGINT AS n, unnest(CASE WHEN len(t) >= n THEN list_transform(range(1, len(t) - n + 2),
         lambda i: array_to_string(t[i:i + n - 1], ' ')) ELSE [] END) AS gram
FROM (SELECT target_id, slot, {S.lower_words('prompt')} AS t FROM candidates), (VALUES (1), (2), (3)) v(n)""", _CV, _CC))
def q_ngrams(spark, d):
    c = candidates(spark, d)
    tok = T.lower_words("prompt")
    arr = F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(tok, n).alias("g")) for n in (1, 2, 3)])
    x = c.select("target_id", "slot", F.explode(arr).alias("s"))
    return x.select("target_id", "slot", F.col("s.n").cast("long").alias("n"),
                    F.explode("s.g").alias("gram"))


# ----------------------------------------------------------------- M-01/02
@register("jaccard_pairs", V.oracle(f"""
SELECT target_id,
  CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS jaccard,
  CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) END AS word_overlap
FROM (SELECT target_id, list_distinct({S.lower_words('text1')}) AS a, list_distinct({S.lower_words('text2')}) AS b FROM gen)""",
                                    _CV, _CG))
def q_jaccard_pairs(spark, d):
    return _r6(TS.jaccard_pairs(gen(spark, d), "target_id"), ["jaccard", "word_overlap"])


# ----------------------------------------------------------------- M-03
def _bleu_sql():
    grams = []
    for side, col in (("r", "text1"), ("h", "text2")):
        grams.append(f"""{side}g AS (
  SELECT target_id, n, gram, count(*) AS c FROM (
    SELECT target_id, n, unnest(CASE WHEN len(t) >= n THEN list_transform(range(1, len(t) - n + 2),
             lambda i: array_to_string(t[i:i + n - 1], ' ')) ELSE [] END) AS gram
    FROM (SELECT target_id, {S.lower_words(col)} AS t FROM gen), (VALUES (1), (2), (3), (4)) v(n)) x
  GROUP BY ALL)""")
    clip = """clip AS (
  SELECT hg.target_id, hg.n, sum(least(hg.c, coalesce(rg.c, 0))) AS m
  FROM hg LEFT JOIN rg USING (target_id, n, gram) GROUP BY ALL)"""
    base = f"""bb AS (
  SELECT g.target_id, len({S.lower_words('g.text1')}) AS r_len, len({S.lower_words('g.text2')}) AS c_len,
    coalesce((SELECT m FROM clip WHERE clip.target_id = g.target_id AND n = 1), 0) AS m1,
    coalesce((SELECT m FROM clip WHERE clip.target_id = g.target_id AND n = 2), 0) AS m2,
    coalesce((SELECT m FROM clip WHERE clip.target_id = g.target_id AND n = 3), 0) AS m3,
    coalesce((SELECT m FROM clip WHERE clip.target_id = g.target_id AND n = 4), 0) AS m4
  FROM gen g)"""
    return grams + [clip, base]


def _p(n):
    return f"(CASE WHEN m{n} > 0 THEN m{n} ELSE 0.1 END) / greatest(c_len - {n} + 1, 1)"


@register("bleu_pairs", V.oracle(f"""
SELECT target_id, round(CASE WHEN r_len = 0 OR c_len = 0 THEN NULL WHEN m1 = 0 THEN 0.0
  ELSE (CASE WHEN c_len > r_len THEN 1.0 ELSE exp(1 - r_len / c_len) END)
       * exp((ln({_p(1)}) + ln({_p(2)}) + ln({_p(3)}) + ln({_p(4)})) / 4.0) END, 6) AS bleu
FROM bb""", _CV, _CG + _bleu_sql()))
def q_bleu_pairs(spark, d):
    return _r6(TS.bleu_pairs(gen(spark, d), "target_id"), ["bleu"])


# ----------------------------------------------------------------- M-04/05
def _rouge_words_sql(x):
    return (f"flatten(list_transform(list_filter(string_split({x}, '.'), lambda s: length(s) > 0), "
            f"lambda s: string_split(array_to_string({S.words('s')}, ' '), ' ')))")


def _bigrams_sql(w):
    return (f"CASE WHEN len({w}) >= 2 THEN list_transform(range(1, len({w})), "
            f"lambda i: {w}[i] || ' ' || {w}[i + 1]) ELSE [] END")


def _f_sql(o, h, r):
    p = f"(CASE WHEN {h} = 0 THEN 0.0 ELSE {o} / {h} END)"
    rr = f"(CASE WHEN {r} = 0 THEN 0.0 ELSE {o} / {r} END)"
    return f"2.0 * (({p} * {rr}) / ({p} + {rr} + 1e-8))"


_ROUGE_CTE = f"""rw AS (
  SELECT target_id, {_rouge_words_sql('text1')} AS h, {_rouge_words_sql('text2')} AS r FROM gen),
rs AS (
  SELECT target_id, list_distinct(h) AS h1, list_distinct(r) AS r1,
         list_distinct({_bigrams_sql('h')}) AS h2, list_distinct({_bigrams_sql('r')}) AS r2 FROM rw)"""


@register("rouge_pairs", V.oracle(f"""
SELECT target_id,
  round({_f_sql('len(list_intersect(h1, r1))', 'len(h1)', 'len(r1)')}, 6) AS rouge_1,
  round({_f_sql('len(list_intersect(h2, r2))', 'len(h2)', 'len(r2)')}, 6) AS rouge_2
FROM rs""", _CV, _CG + [_ROUGE_CTE]))
def q_rouge_pairs(spark, d):
    return _r6(TS.rouge_pairs(gen(spark, d), "target_id"), ["rouge_1", "rouge_2"])


# ROUGE-L in SQL: the LCS table row by row in a recursive CTE (each row the
# running max of max(L[i-1][j], L[i-1][j-1] + match)), the same backtrack
# path by a second recursive CTE, then the per-reference-sentence union.
def _rl_sents(x):
    return (f"list_transform(list_filter(string_split({x}, '.'), lambda s: length(s) > 0), "
            f"lambda s: string_split(array_to_string({S.words('s')}, ' '), ' '))")

ROUGE_L_CTES = [
f"""rl_p AS (SELECT target_id, {_rl_sents('text1')} AS hs, {_rl_sents('text2')} AS rs FROM gen)""",
"""rl_pairs AS (
  SELECT p.target_id, b.b, a.a, p.rs[b.b] AS r, p.hs[a.a] AS h
  FROM rl_p p, LATERAL (SELECT unnest(range(1, len(p.rs) + 1)) AS b) b,
       LATERAL (SELECT unnest(range(1, len(p.hs) + 1)) AS a) a)""",
"""rl_dp AS (
  WITH RECURSIVE dp(target_id, b, a, r, h, i, rowv, rowsv) AS (
    SELECT target_id, b, a, r, h, 0, list_transform(range(0, len(h) + 1), lambda x: 0),
           [list_transform(range(0, len(h) + 1), lambda x: 0)]
    FROM rl_pairs
    UNION ALL
    SELECT target_id, b, a, r, h, i + 1, nr, list_append(rowsv, nr) FROM (
      SELECT *, list_concat([0], list_transform(range(1, len(h) + 1),
               lambda j: list_max(list_transform(range(1, j + 1),
                 lambda q: greatest(rowv[q + 1], rowv[q] + CASE WHEN h[q] = r[i + 1] THEN 1 ELSE 0 END))))) AS nr
      FROM dp WHERE i < len(r)) z)
  SELECT target_id, b, a, r, h, rowsv FROM dp WHERE i = len(r))""",
"""rl_bt AS (
  WITH RECURSIVE bt(target_id, b, a, r, h, t, i, j, pos) AS (
    SELECT target_id, b, a, r, h, rowsv, len(r), len(h), []::INT[] FROM rl_dp
    UNION ALL
    SELECT target_id, b, a, r, h, t,
      CASE WHEN r[i] = h[j] THEN i - 1 WHEN t[i][j + 1] >= t[i + 1][j] THEN i - 1 ELSE i END,
      CASE WHEN r[i] = h[j] THEN j - 1 WHEN t[i][j + 1] >= t[i + 1][j] THEN j ELSE j - 1 END,
      CASE WHEN r[i] = h[j] THEN list_append(pos, i - 1) ELSE pos END
    FROM bt WHERE i > 0 AND j > 0)
  SELECT target_id, b, a, pos FROM bt WHERE i = 0 OR j = 0)""",
"""rl_union AS (
  SELECT target_id, b, len(list_distinct(flatten(list(pos)))) AS u FROM rl_bt GROUP BY 1, 2)""",
"""rl AS (
  SELECT p.target_id, len(list_distinct(flatten(p.rs))) AS m, len(list_distinct(flatten(p.hs))) AS n,
         coalesce((SELECT sum(u) FROM rl_union x WHERE x.target_id = p.target_id), 0) AS llcs,
         len(p.hs) > 0 AND len(p.rs) > 0 AS ok
  FROM rl_p p)""",
]
ROUGE_L_SELECT = """
SELECT target_id, CASE WHEN ok THEN round(2.0 * ((pp * rr) / (pp + rr + 1e-8)), 6) END AS rouge_l FROM (
  SELECT target_id, ok, CASE WHEN n > 0 THEN llcs / n ELSE 0.0 END AS pp, CASE WHEN m > 0 THEN llcs / m ELSE 0.0 END AS rr
  FROM rl)"""


@register("rouge_l_pairs", V.oracle(ROUGE_L_SELECT, _CV, _CG + ROUGE_L_CTES))
def q_rouge_l_pairs(spark, d):
    return _r6(TS.rouge_l_pairs(gen(spark, d), "target_id"), ["rouge_l"])


# ----------------------------------------------------------------- diversity
@register("vocab_diversity", V.oracle(f"""
SELECT target_id, count(DISTINCT w) AS vocabulary_size,
       round(coalesce(count(DISTINCT w) / nullif(count(w), 0), 0.0), 6) AS type_token_ratio
FROM (SELECT target_id, unnest({S.lower_words('prompt')}) AS w FROM candidates) GROUP BY 1""", _CV, _CC))
def q_vocab_diversity(spark, d):
    return _r6(TS.vocab_diversity(candidates(spark, d), "target_id"), ["type_token_ratio"])


@register("length_diversity", V.oracle(f"""
SELECT target_id, round(avg(n), 6) AS avg_length, round(stddev_pop(n), 6) AS length_std,
       (max(n) - min(n))::BIGINT AS length_range
FROM (SELECT target_id, {S.word_count('prompt')} AS n FROM candidates) GROUP BY 1""", _CV, _CC))
def q_length_diversity(spark, d):
    return _r6(TS.length_diversity(candidates(spark, d), "target_id"), ["avg_length", "length_std"])


DISTINCT_SQL = f"""dng AS (
  SELECT target_id, n, unnest(CASE WHEN len(t) >= n THEN list_transform(range(1, len(t) - n + 2),
           lambda i: array_to_string(t[i:i + n - 1], ' ')) ELSE [] END) AS gram
  FROM (SELECT target_id, {S.lower_words('prompt')} AS t FROM candidates), (VALUES (1), (2), (3)) v(n)),
dn AS (
  SELECT t.target_id, v.n::BIGINT AS n,
         coalesce((SELECT count(DISTINCT gram) / nullif(count(*), 0) FROM dng
                   WHERE dng.target_id = t.target_id AND dng.n = v.n), 0.0) AS distinct_n
  FROM (SELECT DISTINCT target_id FROM candidates) t, (VALUES (1), (2), (3)) v(n))"""


@register("distinct_ngrams", V.oracle("""
SELECT target_id, n, round(distinct_n, 6) AS distinct_n FROM dn""", _CV, _CC + [DISTINCT_SQL]))
def q_distinct_ngrams(spark, d):
    return _r6(TS.distinct_ngrams(candidates(spark, d), "target_id"), ["distinct_n"])


_PJ = f"""pjs AS (
  SELECT target_id, slot, list_distinct({S.lower_words('prompt')}) AS s FROM candidates),
pj AS (
  SELECT a.target_id, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j
  FROM pjs a JOIN pjs b ON a.target_id = b.target_id AND a.slot < b.slot
  WHERE len(a.s) > 0 AND len(b.s) > 0),
pja AS (
  SELECT target_id, avg(j) AS avg_pairwise_similarity, stddev_pop(j) AS similarity_std FROM pj GROUP BY 1)"""


@register("pairwise_jaccard", V.oracle("""
SELECT target_id, round(avg_pairwise_similarity, 6) AS avg_pairwise_similarity,
       round(similarity_std, 6) AS similarity_std FROM pja""", _CV, _CC + [_PJ]))
def q_pairwise_jaccard(spark, d):
    return _r6(TS.pairwise_jaccard(candidates(spark, d), "target_id", "slot"),
               ["avg_pairwise_similarity", "similarity_std"])


_DIV = f"""div AS (
  SELECT v.target_id, v.vocabulary_size, v.type_token_ratio, l.avg_length, l.length_std, l.length_range,
         p.avg_pairwise_similarity, p.similarity_std,
         (SELECT distinct_n FROM dn WHERE dn.target_id = v.target_id AND n = 1) AS distinct_1grams,
         (SELECT distinct_n FROM dn WHERE dn.target_id = v.target_id AND n = 2) AS distinct_2grams,
         (SELECT distinct_n FROM dn WHERE dn.target_id = v.target_id AND n = 3) AS distinct_3grams
  FROM (SELECT target_id, count(DISTINCT w) AS vocabulary_size,
               coalesce(count(DISTINCT w) / nullif(count(w), 0), 0.0) AS type_token_ratio
        FROM (SELECT target_id, unnest({S.lower_words('prompt')}) AS w FROM candidates) GROUP BY 1) v
  JOIN (SELECT target_id, avg(n) AS avg_length, stddev_pop(n) AS length_std, (max(n) - min(n))::BIGINT AS length_range
        FROM (SELECT target_id, {S.word_count('prompt')} AS n FROM candidates) GROUP BY 1) l USING (target_id)
  LEFT JOIN pja p USING (target_id))"""

_DIV_COLS = ["type_token_ratio", "avg_length", "length_std", "avg_pairwise_similarity",
             "similarity_std", "distinct_1grams", "distinct_2grams", "distinct_3grams"]


@register("diversity", V.oracle("SELECT target_id, vocabulary_size, length_range, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _DIV_COLS) + " FROM div", _CV, _CC + [DISTINCT_SQL, _PJ, _DIV]))
def q_diversity(spark, d):
    r = TS.diversity(candidates(spark, d), "target_id", "slot")
    return _r6(r.select("target_id", "vocabulary_size", "length_range", *_DIV_COLS), _DIV_COLS)


# ----------------------------------------------------------------- A-20/A-21


TEXT_METRIC_ROWS = f"""
  SELECT 'text_bleu' AS metric, b.bleu AS value FROM (SELECT target_id, CASE WHEN r_len = 0 OR c_len = 0 THEN NULL WHEN m1 = 0 THEN 0.0
    ELSE (CASE WHEN c_len > r_len THEN 1.0 ELSE exp(1 - r_len / c_len) END)
       * exp((ln({_p(1)}) + ln({_p(2)}) + ln({_p(3)}) + ln({_p(4)})) / 4.0) END AS bleu FROM bb) b
  UNION ALL SELECT 'text_rouge_1', {_f_sql('len(list_intersect(h1, r1))', 'len(h1)', 'len(r1)')} FROM rs
  UNION ALL SELECT 'text_rouge_2', {_f_sql('len(list_intersect(h2, r2))', 'len(h2)', 'len(r2)')} FROM rs
  UNION ALL SELECT 'text_jaccard', CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END
    FROM (SELECT list_distinct({S.lower_words('text1')}) AS a, list_distinct({S.lower_words('text2')}) AS b FROM gen)
  UNION ALL SELECT 'text_word_overlap', CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) END
    FROM (SELECT list_distinct({S.lower_words('text1')}) AS a, list_distinct({S.lower_words('text2')}) AS b FROM gen)
  UNION ALL SELECT 'text_rouge_l', rouge_l FROM ({ROUGE_L_SELECT.replace('round(', '(').replace(', 6)', ')')})"""
TEXT_METRIC_CTES = _CG + _bleu_sql() + [_ROUGE_CTE] + ROUGE_L_CTES
SUMMARY_SQL = ("SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, "
               "round(median(value), 6) AS median FROM ({rows}) WHERE value IS NOT NULL GROUP BY 1")


@register("eval_text_metrics", V.oracle(SUMMARY_SQL.format(rows=TEXT_METRIC_ROWS), _CV, TEXT_METRIC_CTES))
def q_eval_text_metrics(spark, d):
    rows = EV.long(EV.text_metrics(written(gen(spark, d), "pairs"), ["target_id"]), "text_", EV.TEXT_METRICS)
    return _r6(EV.summary(rows).select("metric", "mean", "std", "median"), ["mean", "std", "median"])


DIV_METRIC_ROWS = " UNION ALL ".join(f"SELECT 'diversity_{c}' AS metric, {c}::DOUBLE AS value FROM div"
                                     for c in EV.DIVERSITY_METRICS)
DIV_METRIC_CTES = _CC + [DISTINCT_SQL, _PJ, _DIV]


@register("eval_diversity", V.oracle(SUMMARY_SQL.format(rows=DIV_METRIC_ROWS), _CV, DIV_METRIC_CTES))
def q_eval_diversity(spark, d):
    rows = EV.long(TS.diversity(candidates(spark, d), "target_id", "slot"), "diversity_", EV.DIVERSITY_METRICS)
    return _r6(EV.summary(rows).select("metric", "mean", "std", "median"), ["mean", "std", "median"])

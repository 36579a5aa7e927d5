"""Vector queries (P-19/20, V-01..V-04, F-01, F-06, A-11, J-05, J-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlens.functions import vector as VX
from promptlens.operators import ann as ANN
from promptlens.operators import vectors as OV
from promptlens.plans import sqlfrag as S
from promptlens.plans import views as V
from promptlens.plans.registry import register

EXPECTED_DIM = 64  # test tables carry 64-wide vectors; the service used 1024


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def topk_sql(targets: str, corpus: str, k: int, min_sim: float | None = None,
             extra_views=("emb",), select="target_id, vec_id, rank, round(sim, 6) AS similarity") -> str:
    cond = f"AND {S.cosine('a.embedding', 'b.embedding')} >= {min_sim}" if min_sim is not None else ""
    return V.oracle(f"""
SELECT {select} FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(sim, 9) DESC, vec_id) AS rank
  FROM (SELECT a.vec_id AS target_id, b.vec_id AS vec_id, {S.cosine('a.embedding', 'b.embedding')} AS sim
        FROM {targets} a JOIN {corpus} b ON a.vec_id <> b.vec_id {cond}) s) r
WHERE rank <= {k}""", list(extra_views))


@register("topk_similar", topk_sql("emb", "emb", 5))
def q_topk_similar(spark, d):
    e = V.emb(spark, d)
    return _r6(OV.topk_similar(e, e, k=5), ["similarity"])


TOPK_MIN_SIM = 0.3


@register("topk_threshold", topk_sql("emb", "emb", 5, TOPK_MIN_SIM))
def q_topk_threshold(spark, d):
    e = V.emb(spark, d)
    return _r6(OV.topk_similar(e, e, k=5, min_sim=TOPK_MIN_SIM), ["similarity"])


def topk_with_prompts(spark, d):
    """Flagship: every vector's 5 nearest prompt-owning vectors, with the
    prompt text of each neighbour."""
    e = V.emb(spark, d)
    c = V.corpus(spark, d)
    nn = OV.topk_similar(e, c, k=5, corpus_key="original_index")
    prompts = c.select(F.col("original_index").alias("vec_id"), "prompt")
    return _r6(nn.join(prompts, "vec_id").select("target_id", "rank", "vec_id", "prompt", "similarity"),
               ["similarity"])


_CORPUS_VEC = "cvec AS (SELECT original_index AS vec_id, prompt, embedding FROM corpus)"


@register("topk_prompts", V.oracle(f"""
SELECT target_id, rank, vec_id, prompt, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(sim, 9) DESC, vec_id) AS rank
  FROM (SELECT a.vec_id AS target_id, b.vec_id, b.prompt, {S.cosine('a.embedding', 'b.embedding')} AS sim
        FROM emb a JOIN cvec b ON a.vec_id <> b.vec_id) s) r
WHERE rank <= 5""", ["corpus"], [_CORPUS_VEC]))
def q_topk_prompts(spark, d):
    return topk_with_prompts(spark, d)


@register("embedding_norms", V.oracle(f"""
SELECT vec_id, round({S.norm('embedding')}, 6) AS norm FROM emb""", ["emb"]))
def q_embedding_norms(spark, d):
    e = V.emb(spark, d)
    return e.select("vec_id", F.round(VX.l2_norm("embedding"), 6).alias("norm"))


@register("cosine_pairs", V.oracle(f"""
SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({S.cosine('a.embedding', 'b.embedding')}, 6) AS similarity
FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1""", ["emb"]))
def q_cosine_pairs(spark, d):
    e = V.emb(spark, d)
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("ea"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("eb"))
    j = a.join(b, b.b_id == a.a_id + 1)
    return j.select("a_id", "b_id", F.round(VX.cosine("ea", "eb"), 6).alias("similarity"))


@register("embedding_stats", V.oracle("""
SELECT count(DISTINCT vec_id) AS n_vectors, max(dims) AS dims, round(avg(x), 6) AS mean_value,
       round(stddev_pop(x), 6) AS std_value, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value
FROM (SELECT vec_id, len(embedding) AS dims, unnest(embedding) AS x FROM emb)""", ["emb"]))
def q_embedding_stats(spark, d):
    r = OV.embedding_stats(V.emb(spark, d))
    return _r6(r, ["mean_value", "std_value", "min_value", "max_value"])


@register("validate_dims", V.oracle(f"""
SELECT count(*) > 0 AND count_if(coalesce(len(embedding) <> {EXPECTED_DIM}, true)) = 0 AS valid,
       count(*) AS total, count_if(coalesce(len(embedding) <> {EXPECTED_DIM}, true)) AS invalid_count,
       {EXPECTED_DIM} AS expected_dim
FROM emb""", ["emb"]))
def q_validate_dims(spark, d):
    return OV.validate_dims(V.emb(spark, d), EXPECTED_DIM)


@register("invalid_dims", V.oracle(f"""
SELECT d.doc_id AS request_id, len(e.embedding) AS dims
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
WHERE coalesce(len(e.embedding) <> {EXPECTED_DIM}, true)""", []))
def q_invalid_dims(spark, d):
    docs = V.table(spark, d, "documents")
    e = V.table(spark, d, "embeddings")
    x = docs.join(e, docs.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("request_id"), "embedding")
    return OV.invalid_dims(x, EXPECTED_DIM, "request_id").select(
        "request_id", F.col("dims").cast("long").alias("dims"))


_ADJ = """adj AS (
  SELECT a.vec_id, b.vec_id AS next_id, {cos} AS similarity
  FROM (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS i FROM emb) a
  JOIN (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS i FROM emb) b
    ON b.i = a.i + 1)""".format(cos=S.cosine("a.embedding", "b.embedding"))


@register("adjacent_cosine", V.oracle("""
SELECT vec_id, next_id, round(similarity, 6) AS similarity FROM adj""", ["emb"], [_ADJ]))
def q_adjacent_cosine(spark, d):
    return _r6(OV.adjacent_cosine(V.emb(spark, d)), ["similarity"])


@register("vector_report", V.oracle(f"""
SELECT count(DISTINCT vec_id) AS n_vectors, max(dims) AS dims, round(avg(x), 6) AS mean_value,
       round(stddev_pop(x), 6) AS std_value, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value,
       (SELECT count_if(coalesce(len(embedding) <> {EXPECTED_DIM}, true)) = 0 AND count(*) > 0 FROM emb) AS dims_valid,
       (SELECT count_if(coalesce(len(embedding) <> {EXPECTED_DIM}, true)) FROM emb) AS invalid_count,
       (SELECT round(avg(similarity), 6) FROM adj) AS mean_adjacent_cosine
FROM (SELECT vec_id, len(embedding) AS dims, unnest(embedding) AS x FROM emb)""", ["emb"], [_ADJ]))
def q_vector_report(spark, d):
    r = OV.vector_report(V.emb(spark, d), EXPECTED_DIM)
    return _r6(r, ["mean_value", "std_value", "min_value", "max_value", "mean_adjacent_cosine"])


# ----------------------------------------------------------------- approximate
def _centres(name: str, n: str) -> str:
    """The first ``n`` vectors in md5 order, each moved to the mean direction
    of the sampled vectors nearest to it."""
    return f"""{name}0 AS (SELECT i AS cell, v FROM ord, counts WHERE i <= {n}),
{name}a AS (
  SELECT s.vec_id, s.v, p.cell FROM drawn s CROSS JOIN {name}0 p
  QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY round(list_dot_product(s.v, p.v), 9) DESC, p.cell) = 1),
{name}m AS (
  SELECT cell, list(x ORDER BY d) AS m FROM (
    SELECT cell, d, sum(x) AS x FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {name}a) GROUP BY cell, d)
  GROUP BY cell),
{name} AS (
  SELECT c.cell, CASE WHEN m IS NULL THEN c.v ELSE list_transform(m, lambda x: x / {S.norm('m')}) END AS v
  FROM {name}0 c LEFT JOIN {name}m ON {name}m.cell = c.cell)"""


def ann_ctes(corpus: str = "emb", key: str = "vec_id", targets: str = "emb", target_key: str = "vec_id",
             seed: int = 42) -> str:
    """CTE ``scored`` (target_id, vec_id, similarity): all rows of the cells
    that each target probes. States the tree of :mod:`promptlens.operators.ann`."""
    unit = lambda x: f"list_transform({x}, lambda x: x / nullif({S.norm(x)}, 0))"
    return f"""nv AS (SELECT {key} AS vec_id, {unit('embedding')} AS v FROM {corpus}),
tv AS (SELECT {target_key} AS target_id, {unit('embedding')} AS v FROM {targets}),
counts AS (
  SELECT n, c, CAST(ceil(sqrt(c)) AS BIGINT) AS t, least(1.0, {ANN.SAMPLE_PER_CELL} * c / n) AS share
  FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS c FROM nv)),
ord AS (SELECT vec_id, v, md5('{seed}|' || CAST(vec_id AS VARCHAR)) AS h, row_number() OVER (ORDER BY h, vec_id) AS i FROM nv),
drawn AS (
  SELECT vec_id, v FROM ord, counts
  WHERE share >= 1 OR CAST('0x' || substr(h, 1, 8) AS BIGINT) < CAST(floor(share * 4294967296) AS BIGINT)),
{_centres('tops', 't')},
{_centres('cells', 'c')},
tree AS (
  SELECT c.cell, c.v, t.cell AS top FROM cells c CROSS JOIN tops t
  QUALIFY row_number() OVER (PARTITION BY c.cell ORDER BY round(list_dot_product(c.v, t.v), 9) DESC, t.cell) = 1),
every AS (SELECT 0 AS side, vec_id AS id, v FROM nv UNION ALL SELECT 1, target_id, v FROM tv),
visit AS (
  SELECT e.side, e.id, e.v, t.cell AS top FROM every e CROSS JOIN tops t
  QUALIFY row_number() OVER (PARTITION BY e.side, e.id ORDER BY round(list_dot_product(e.v, t.v), 9) DESC, t.cell) <= {ANN.VISITED}),
near AS (
  SELECT x.side, x.id, x.cell, row_number() OVER w AS place, max(sim) OVER (PARTITION BY x.side, x.id) - sim AS off
  FROM (SELECT v.side, v.id, t.cell, round(list_dot_product(v.v, t.v), 9) AS sim FROM visit v JOIN tree t ON t.top = v.top) x
  WINDOW w AS (PARTITION BY x.side, x.id ORDER BY sim DESC, x.cell)),
scored AS (
  SELECT p.target_id, p.vec_id, list_dot_product(tv.v, nv.v) AS similarity FROM (
    SELECT DISTINCT t.id AS target_id, c.id AS vec_id
    FROM near t JOIN near c ON c.cell = t.cell AND c.side = 0 AND t.side = 1 AND c.id <> t.id
      AND c.place <= {ANN.SPILL} AND c.off <= {ANN.MARGIN}
    JOIN counts ON t.place <= greatest(1, CAST(floor(counts.c * {ANN.PROBED}) AS BIGINT))) p
  JOIN tv ON tv.target_id = p.target_id JOIN nv ON nv.vec_id = p.vec_id)"""


_FOUND = """found AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank
  FROM scored QUALIFY rank <= 5)"""
_EXACT5 = """best AS (
  SELECT a.vec_id AS target_id, b.vec_id, row_number() OVER (
    PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) AS rank
  FROM nv a JOIN nv b ON a.vec_id <> b.vec_id QUALIFY rank <= 5)"""


@register("topk_approx", V.oracle("SELECT target_id, vec_id, rank, round(similarity, 6) AS similarity FROM found",
                                  ["emb"], [ann_ctes(), _FOUND]))
def q_topk_approx(spark, d):
    """V-04 approximate mode: a quarter of the cells of a two-level tree."""
    e = V.emb(spark, d)
    return _r6(ANN.topk_approx(e, e, k=5), ["similarity"])


@register("topk_approx_threshold", V.oracle(
    f"SELECT target_id, vec_id, rank, round(similarity, 6) AS similarity FROM found WHERE similarity >= {TOPK_MIN_SIM}",
    ["emb"], [ann_ctes(), _FOUND]))
def q_topk_approx_threshold(spark, d):
    """F-06 on the approximate search."""
    e = V.emb(spark, d)
    return _r6(ANN.topk_approx(e, e, k=5, min_sim=TOPK_MIN_SIM), ["similarity"])


@register("ann_recall", V.oracle("""SELECT round(count(f.vec_id) / count(*), 6) AS recall
FROM best b LEFT JOIN found f ON f.target_id = b.target_id AND f.vec_id = b.vec_id""", ["emb"], [ann_ctes(), _FOUND, _EXACT5]))
def q_ann_recall(spark, d):
    """recall@5 of the approximate mode against the exact operator."""
    e = V.emb(spark, d)
    return _r6(ANN.recall_at_k(ANN.topk_approx(e, e, k=5), OV.topk_similar(e, e, k=5)), ["recall"])

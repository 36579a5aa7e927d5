"""Registered queries against their DuckDB oracle at sf0.001 (the driver runs
all of them at sf0.01; tools/check_oracle.py does the same locally)."""

import duckdb
import pytest

from conftest import SF_SMALL

FAST = ["profile_counts", "profile_distinct", "text_lengths", "prompt_types", "output_flags",
        "prompt_starters", "topk_similar", "hash_embed", "cache_misses", "embed_incremental",
        "data_splits", "jaccard_pairs", "bleu_pairs", "rouge_pairs", "pairwise_jaccard",
        "rate_limit_rpm", "rate_limit_tokens", "validate_requests", "mutate_swap", "crossover", "rouge_l_pairs",
        "candidate_pool", "evaluate_generated", "stream_dedupe", "vector_upsert"]


@pytest.fixture(scope="module")
def con():
    from promptlens.plans.views import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    from tools.check_oracle import rows_of
    from tools.check_oracle import _TYPES
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert {f.name: _TYPES.get(f.dataType.simpleString()) for f in sdf.schema.fields} == \
        {c: str(t) for c, t in zip(rel.columns, rel.types)}
    pdf = sdf.toPandas()
    odf = rel.df()
    c1, r1 = rows_of(pdf)
    c2, r2 = rows_of(odf)
    assert c1 == c2
    assert r1 == r2


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["target_id", "rank", "vec_id", "prompt", "similarity"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["rate_limit_rpm", "stream_requests"])
def test_time_queries_ignore_session_zone(spark, con, name):
    import __spark_entry__ as E
    from tools.check_oracle import rows_of
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        pdf = E.queries()[name](spark, SF_SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows_of(pdf) == rows_of(con.execute(E.oracle_sql()[name]).df())

"""DuckDB SQL fragments mirroring the column helpers (oracle side only)."""

from __future__ import annotations

from promptlens.functions import text as T


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def lower_words(x: str) -> str:
    return words(f"lower({x})")


def word_count(x: str) -> str:
    return f"len({words(x)})"


def sentence_count(x: str) -> str:
    return f"len(regexp_split_to_array({x}, '[.!?]+'))"


def prefix_any(x: str, options) -> str:
    return f"regexp_matches(lower({x}), '^(" + "|".join(options) + ")')"


def is_question(x: str) -> str:
    return prefix_any(x, T.QUESTION_WORDS)


def is_instruction(x: str) -> str:
    return prefix_any(x, T.INSTRUCTION_WORDS)


def is_code(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{T.CODE_PATTERN}'), false)"


def is_list(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{T.LIST_PATTERN}'), false)"


def is_explanation(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{T.EXPLANATION_PATTERN}'), false)"


def ngrams(tok: str, n: int) -> str:
    """n-grams of a token list; [] when shorter than n."""
    return (f"CASE WHEN len({tok}) >= {n} THEN list_transform(range(1, len({tok}) - {n} + 2), "
            f"lambda i: array_to_string({tok}[i:i + {n} - 1], ' ')) ELSE [] END")


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def norm(a: str) -> str:
    return f"sqrt(list_dot_product({a}, {a}))"


def cosine(a: str, b: str) -> str:
    return f"coalesce({dot(a, b)} / nullif({norm(a)} * {norm(b)}, 0), 0.0)"


def hash_embed_cte(name: str, src: str, key: str, text: str, dim: int = 64) -> str:
    """CTE ``name(key, bucket, value)``: sparse hashed bag-of-words vector of
    ``text`` for every row of ``src`` (same rule as the default provider)."""
    return f"""{name}_raw AS (
  SELECT {key}, bucket, sum(sgn) AS v FROM (
    SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS bucket,
           CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sgn
    FROM (SELECT {key}, unnest({lower_words(text)}) AS w FROM {src}) t) h
  GROUP BY 1, 2),
{name} AS (
  SELECT {key}, bucket, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY {key})), 0) AS value
  FROM {name}_raw WHERE v <> 0)"""

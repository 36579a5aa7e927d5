"""Column expressions over text (all JVM-side, inside whole-stage codegen).

Every helper takes and returns a ``Column`` so it composes into one
projection; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the profiled dataset's rules (kept verbatim, in
# their natural order).
QUESTION_WORDS = ["what", "how", "why", "when", "where", "which", "who", "can",
                  "do", "is", "are", "will", "would", "should"]
INSTRUCTION_WORDS = ["create", "write", "describe", "explain", "generate", "make",
                     "provide", "give", "list", "tell"]
CODE_PATTERN = "```|def |class |import |from |function"
LIST_PATTERN = r"^\d+\.|^-|^\*"
EXPLANATION_PATTERN = "because|therefore|thus|however|moreover"
SENTENCE_SPLIT = "[.!?]+"
PRICE_PER_MILLION_TOKENS = 0.02
# ---------------------------------------------------------------------------

# Python ``str.split()`` semantics: runs of Unicode white space, no empty pieces.
_WS = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(t) -> Column:
    """Tokens of ``str.split()``; null text gives null."""
    return F.array_remove(F.split(_c(t), _WS), "")


def lower_words(t) -> Column:
    return words(F.lower(_c(t)))


def char_len(t) -> Column:
    return F.length(_c(t))


def word_count(t) -> Column:
    return F.when(_c(t).isNotNull(), F.size(words(t)))


def sentence_count(t) -> Column:
    """Pieces of a split on ``[.!?]+`` including a trailing empty piece."""
    return F.when(_c(t).isNotNull(), F.size(F.split(_c(t), SENTENCE_SPLIT, -1)))


def first_word(t) -> Column:
    """Lower-cased first token, '' when there is none, null for null text."""
    return F.when(_c(t).isNotNull(),
                  F.coalesce(F.get(lower_words(t), 0), F.lit("")))


def _prefix_regex(options) -> str:
    return "^(" + "|".join(options) + ")"


def is_question(t) -> Column:
    return F.lower(_c(t)).rlike(_prefix_regex(QUESTION_WORDS))


def is_instruction(t) -> Column:
    return F.lower(_c(t)).rlike(_prefix_regex(INSTRUCTION_WORDS))


def has_context(t) -> Column:
    return F.coalesce(_c(t).contains(":"), F.lit(False))


def is_code(t) -> Column:
    return F.coalesce(_c(t).rlike(CODE_PATTERN), F.lit(False))


def is_list(t) -> Column:
    return F.coalesce(_c(t).rlike(LIST_PATTERN), F.lit(False))


def is_explanation(t) -> Column:
    return F.coalesce(_c(t).rlike(EXPLANATION_PATTERN), F.lit(False))


def classify_prompt(t) -> Column:
    return (F.when(is_question(t), F.lit("question"))
            .when(is_instruction(t), F.lit("instruction"))
            .otherwise(F.lit("other")))


def token_estimate(t) -> Column:
    """``max(1, int(words * 0.75))``."""
    return F.greatest(F.lit(1), F.floor(word_count(t) * F.lit(0.75)).cast("int"))


def request_tokens(t, kind: str = "embed") -> Column:
    base = word_count(t) * F.lit(2)
    return base + F.lit(500) if kind == "chat" else base


def cost_estimate(tokens) -> Column:
    return _c(tokens).cast("double") / F.lit(1e6) * F.lit(PRICE_PER_MILLION_TOKENS)


def text_hash(t) -> Column:
    return F.md5(_c(t))


def ngrams(tokens, n: int) -> Column:
    """All windows of ``n`` tokens joined by a space; [] when too short."""
    tok = _c(tokens)
    return F.when(F.size(tok) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(tok) - n + 1),
                              lambda i: F.array_join(F.slice(tok, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))

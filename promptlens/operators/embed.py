"""Text -> vector through a pluggable batch provider (``mapInPandas``).

A provider is opened once per task and called on Arrow batches; a hosted
model client would sit behind the same two methods. The default provider is
deterministic and offline: a signed hashed bag of words,

    token  = words of ``lower(text).split()``
    bucket = int(md5(token)[0:8], 16) mod dim
    sign   = +1 if int(md5(token)[8], 16) is even else -1
    vector = per-bucket sum of signs, L2-normalised

Rows fail alone: a failing text gets ``success = false`` and an ``error``;
transient failures are retried (3 attempts, backoff 1 s then 2 s).
"""

from __future__ import annotations

import hashlib
import time
from typing import Iterator, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.functions import text as TX

MAX_ATTEMPTS = 3
BACKOFF_SECONDS = (1.0, 2.0)


class EmbeddingProvider(Protocol):
    dim: int

    def open(self) -> None: ...

    def embed(self, texts: list[str]) -> list[tuple[list[float] | None, int, str | None]]:
        """-> per text (vector or None, tokens_used, error or None)."""
        ...


class TransientError(Exception):
    """Raised by a provider for failures worth retrying."""


def token_estimate(text: str) -> int:
    return max(1, int(len(text.split()) * 0.75))


class HashProvider:
    """Deterministic signed hashed bag of words (no network)."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._memo: dict[str, tuple[int, float]] = {}

    def open(self) -> None:
        self._memo = {}

    def _bucket(self, w: str) -> tuple[int, float]:
        hit = self._memo.get(w)
        if hit is None:
            h = hashlib.md5(w.encode("utf-8")).hexdigest()
            hit = (int(h[:8], 16) % self.dim, 1.0 if int(h[8], 16) % 2 == 0 else -1.0)
            if len(self._memo) < 200_000:
                self._memo[w] = hit
        return hit

    def vector(self, text: str) -> np.ndarray:
        v = np.zeros(self.dim, dtype=np.float64)
        for w in text.lower().split():
            b, s = self._bucket(w)
            v[b] += s
        n = np.sqrt(np.dot(v, v))
        return v / n if n > 0 else v

    def embed(self, texts):
        out = []
        for t in texts:
            if t is None or t.strip() == "":
                out.append((None, 0, "empty text"))
            else:
                out.append((self.vector(t).tolist(), token_estimate(t), None))
        return out


def _one(call, text):
    """A text by itself: transient failures are retried, whatever else the
    provider raises fails this text at once."""
    for attempt in range(MAX_ATTEMPTS):
        try:
            return call([text])[0]
        except TransientError as e:
            error = f"failed after {MAX_ATTEMPTS} attempts: {e}"
        except Exception as e:  # noqa: BLE001  the provider is foreign code
            return None, 0, f"{type(e).__name__}: {e}"
        if attempt < MAX_ATTEMPTS - 1:
            time.sleep(BACKOFF_SECONDS[min(attempt, len(BACKOFF_SECONDS) - 1)])
    return None, 0, error


def call_with_retries(call, texts):
    """``call(texts)``, a provider's method, for the batch in one call; if that
    fails, for each text by itself, so that one bad text costs no other its
    result."""
    try:
        found = call(texts)
        if len(found) == len(texts):
            return found
    except Exception:  # noqa: BLE001  told apart text by text below
        pass
    return [_one(call, t) for t in texts]


def embed_texts(df: DataFrame, text_col: str, provider: EmbeddingProvider | None = None,
                out: str = "embedding") -> DataFrame:
    """Append ``embedding ARRAY<DOUBLE>, tokens_used INT, success BOOLEAN,
    error STRING`` to every row (all other columns are carried)."""
    provider = provider or HashProvider()
    fields = list(df.schema.fields) + [
        T.StructField(out, T.ArrayType(T.DoubleType()), True),
        T.StructField("tokens_used", T.IntegerType(), True),
        T.StructField("success", T.BooleanType(), True),
        T.StructField("error", T.StringType(), True)]
    schema = T.StructType(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.open()
        for pdf in batches:
            texts = [None if (isinstance(x, float) or x is None) else x for x in pdf[text_col].tolist()]
            res = call_with_retries(provider.embed, texts)
            pdf = pdf.copy()
            pdf[out] = [r[0] for r in res]
            pdf["tokens_used"] = np.array([r[1] for r in res], dtype=np.int32)
            pdf["success"] = [r[2] is None for r in res]
            pdf["error"] = [r[2] for r in res]
            yield pdf

    return df.mapInPandas(run, schema)


def _hash_code(word: Column, dim: int) -> Column:
    """16 * bucket, plus the hex digit that tells the sign, of a word."""
    h = F.md5(word.cast("binary"))
    if 256 % dim == 0:  # then digits 7 and 8 tell the bucket, and 9 the sign
        return F.conv(F.substring(h, 7, 3), 16, 10).cast("int") % (16 * dim)
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim
    return (16 * bucket + F.conv(F.substring(h, 9, 1), 16, 10).cast("long")).cast("int")


def hash_score(text: Column, unit_target: Column, dim: int = 64) -> Column:
    """Cosine of a unit (or zero) vector and the default provider's vector of
    ``text``, as a JVM expression: the words' codes are sorted, so that equal
    buckets follow each other, and folded once into the product and the norm.
    0.0 where the provider has no vector (no words) or there is no target."""
    def step(a: Column, code: Column) -> Column:
        # of the bucket so far: its sum; a word s adds 2 * sum * s + 1 to the square
        before = F.when(a["bucket"] == F.shiftright(code, 4), a["run"]).otherwise(F.lit(0))
        return F.when(code % 2 == 0, F.struct(
            F.shiftright(code, 4).alias("bucket"), (before + 1).alias("run"), (a["squares"] + (2 * before + 1)).alias("squares"),
            (a["product"] + F.get(unit_target, F.shiftright(code, 4))).alias("product"))).otherwise(F.struct(
                F.shiftright(code, 4).alias("bucket"), (before - 1).alias("run"), (a["squares"] - (2 * before - 1)).alias("squares"),
                (a["product"] - F.get(unit_target, F.shiftright(code, 4))).alias("product")))

    zero = F.lit(0.0)
    start = F.struct(F.lit(-1).alias("bucket"), F.lit(0).alias("run"), zero.alias("squares"), zero.alias("product"))
    codes = F.sort_array(F.transform(TX.words(F.lower(text)), lambda w: _hash_code(w, dim)))
    score = F.aggregate(codes, start, step, lambda a: F.try_divide(a["product"], F.sqrt(a["squares"])))
    return F.coalesce(score, zero)


def sparse_vector(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """(key, bucket, value) for every non-zero component."""
    x = df.select(key, F.posexplode(vec).alias("bucket", "value"))
    return x.where(F.col("value") != 0).select(key, F.col("bucket").cast("long").alias("bucket"),
                                               "value")

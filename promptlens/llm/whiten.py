"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers x = floor(64 c) + 1000000. Their sums S are exact, and a
centred row is x - S/n, taken as (x - q) - r/n with S = n q + r, so that no
digit is lost to the offset.

The centred rows, an n x d matrix X that lies in blocks over the cluster, is
bidiagonalised: X v_j = alpha_j u_j + beta_{j-1} u_{j-1} and
X' u_j = alpha_j v_j + beta_j v_{j+1}. One sweep over the blocks forms
w = X v_j - beta u_{j-1} row by row and adds up |w|^2 and X' w; a block's u
values are formed anew from the coefficients of u in X (d numbers each), so that
no long vector is stored, and a lost executor costs its blocks once more. Both
bases are reorthogonalised in full at each step: v against all earlier v, u by
its products with all earlier u. Where a step finds nothing new (beta or alpha
vanishes), it goes on with a vector orthogonal to all v so far, so that repeated
eigenvalues and copies are found as well. The singular values of the small
bidiagonal matrix are the deviations, times sqrt(n); its right vectors, carried
over to the v, are the components.

The driver keeps the bases, d numbers a step and at most d steps. The sums of a
sweep come back from at most ``COLLECTED`` tasks, whatever the number of blocks.

Defined results: rows whose vector is null or holds null or non-finite entries
take no part; entries beyond 2**61 / 64 are clipped to it; repeated rows count
each and null ids are kept; vectors of another dimension are a fit list of their
own; components whose deviation is within rounding of zero (all copies, fewer
rows than dimensions) do not exist; without usable rows there are no rows; a
deviation beyond the long range is that range's end; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm.common import stored, table
from promptlens.llm.topk import usable

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Bytes of a block of rows, about.
BLOCK_BYTES = 1 << 21
#: Tasks from which the sums of a sweep come to the driver.
COLLECTED = 64
#: A deviation counts as zero below this share of the largest one.
ZERO = 1e-10
#: A wanted deviation is settled when its residual is below this share of the largest.
SETTLED = 1e-15
_LIMIT = 2.0 ** 61
_MOST = 2 ** 63 - 1
BLOCKS = "ids binary, known binary, x binary, rows int"
WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _pack(dim: int):
    """Arrow batches (vec_id, embedding of ``dim`` floats) as blocks."""
    size = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                c = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
                x = np.clip(np.floor(SCALE * c), -_LIMIT, _LIMIT).astype("<i8") + OFFSET
                ids = part.column("vec_id")
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                    "known": pa.array([ids.is_valid().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                    "x": pa.array([x.tobytes()], pa.binary()), "rows": pa.array([len(x)], pa.int32())})

    return pack


def _each(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for value in batch.column("x"):
            yield np.frombuffer(value.as_buffer(), "<i8").reshape(-1, dim)


def _total(blocks: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``work(block)`` (doubles) over all blocks: added up by task, then
    in ``COLLECTED`` tasks, then here."""
    def add(batches):
        total = np.zeros(shape)
        for x in _each(batches, dim):
            total += work(x)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def join(batches):
        total = np.zeros(shape)
        for batch in batches:
            for value in batch.column("total"):
                total += np.frombuffer(value.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.select("x").mapInArrow(add, "total binary")
    if sums.rdd.getNumPartitions() > COLLECTED:
        sums = sums.repartition(COLLECTED).mapInArrow(join, "total binary")
    return sum((np.frombuffer(r[0]).reshape(shape) for r in sums.collect()), np.zeros(shape))


class Centre:
    """Exact sums of a fit list: n, S by dimension and the trace of V."""

    def __init__(self, n: int, sums: list[int], squares: list[int]):
        self.n, self.sums = n, sums
        self.q = np.array([s // n for s in sums], dtype="i8")
        self.r = np.array([s % n for s in sums], dtype="i8")
        self.spread = sum(n * s2 - s * s for s, s2 in zip(sums, squares))  # n**2 trace(V)
        self.trace = self.spread / n ** 2

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.q).astype("f8") - self.r / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """sum((n x - S)**2) of each row, exactly."""
        most = int(np.abs(x - self.q).max(initial=0)) * self.n + self.n
        if most * most * max(1, x.shape[1]) <= _MOST:
            return ((self.n * (x - self.q) - self.r) ** 2).sum(axis=1)
        wide = (x - self.q).astype(object) * self.n - self.r.astype(object)
        return np.array([min(_MOST, int(v)) for v in (wide * wide).sum(axis=1)], dtype="i8")


#: Exact sums travel as limbs of so many bits; the last one carries the sign.
LIMB, LIMBS = 40, 5


def centre(blocks: DataFrame, dim: int) -> Centre:
    """Sums and sums of squares, exact whatever their size: a task adds
    integers, Spark adds their limbs."""
    def limbs(value: int) -> list[int]:
        told = []
        for _ in range(LIMBS - 1):
            value, low = divmod(value, 1 << LIMB)
            told.append(low)
        return [*told, value]

    def add(batches):
        n, one, two = 0, [0] * dim, [0] * dim
        for x in _each(batches, dim):
            n += len(x)
            low = x - OFFSET
            if int(np.abs(low).max(initial=0)) < 2 ** 20:
                first, second = low.sum(axis=0).tolist(), (low * low).sum(axis=0).tolist()
            else:
                wide = low.astype(object)
                first, second = wide.sum(axis=0).tolist(), (wide * wide).sum(axis=0).tolist()
            one = [a + b for a, b in zip(one, first)]
            two = [a + b for a, b in zip(two, second)]
        values = [n, *one, *two]
        columns = list(zip(*map(limbs, values)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)],
                                         ["at", *(f"l{i}" for i in range(LIMBS))])

    names = [f"l{i}" for i in range(LIMBS)]
    told = blocks.select("x").mapInArrow(add, "at int, " + ", ".join(f"{c} long" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names))
    found = {r["at"]: sum(r[c] << (LIMB * i) for i, c in enumerate(names)) for r in told.collect()}
    n = found[0]
    ones, twos = [found[1 + i] for i in range(dim)], [found[1 + dim + i] for i in range(dim)]
    return Centre(n, [s + n * OFFSET for s in ones], [t + 2 * OFFSET * s + n * OFFSET ** 2 for s, t in zip(ones, twos)])


def bidiagonalise(sweep: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]], dim: int, most: int,
                  wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of X.

    ``sweep(v, a)`` gives |w|^2 and X'w of w = X (v - a); ``a`` holds the
    coefficients of beta u_{j-1} in X. ``most`` bounds the rank.
    """
    random = np.random.default_rng(20)
    basis, coefficients, images = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    alphas: list[float] = []
    betas: list[float] = []

    def fresh() -> np.ndarray:
        v = random.standard_normal(dim)
        for _ in range(3):
            v -= basis @ (basis.T @ v)
            v /= np.linalg.norm(v)
        return v

    v, beta, top = fresh(), 0.0, 0.0
    while True:
        a = beta * coefficients[:, -1] if alphas and beta else np.zeros(dim)
        square, image = sweep(v, a)
        here = v - a
        for _ in range(2):  # u against all earlier u: their products with w
            c = coefficients.T @ image
            here, image, square = here - coefficients @ c, image - images @ c, square - float(c @ c)
        alpha = float(np.sqrt(max(square, 0.0)))
        top = max(top, alpha, beta)
        basis = np.column_stack([basis, v])
        if alpha > ZERO * top:
            coefficients = np.column_stack([coefficients, here / alpha])
            images = np.column_stack([images, image / alpha])
            rest = image / alpha - alpha * v
        else:
            alpha, rest = 0.0, np.zeros(dim)
            coefficients = np.column_stack([coefficients, np.zeros(dim)])
            images = np.column_stack([images, np.zeros(dim)])
        alphas.append(alpha)
        k = len(alphas)
        for _ in range(3):  # v against all earlier v
            rest = rest - basis @ (basis.T @ rest)
        beta = float(np.linalg.norm(rest))
        if beta <= ZERO * top:
            beta = 0.0
        small = np.diag(alphas) + np.diag(betas, 1) if betas else np.diag(alphas)
        left, deviations, right = np.linalg.svd(small)
        sure = beta * np.abs(left[-1, :wanted]) <= SETTLED * max(top, 1e-300)
        settled = k >= 2 * wanted and beta and bool(sure.all())
        if k == dim or (settled and k > wanted) or (top == 0.0):
            return deviations, basis @ right.T
        betas.append(beta)
        v = rest / beta if beta else fresh()


def fit(blocks: DataFrame, dim: int, wanted: int = COMPONENTS) -> tuple[Centre, np.ndarray, np.ndarray]:
    """Exact centre of the fit list, eigenvalues of V, falling, and components
    (columns), ``wanted`` at most."""
    middle = centre(blocks, dim)

    def sweep(v: np.ndarray, a: np.ndarray) -> tuple[float, np.ndarray]:
        def work(x: np.ndarray) -> np.ndarray:
            rows = middle.rows(x)
            w = rows @ v - rows @ a
            return np.r_[float(w @ w), w @ rows]

        told = _total(blocks, dim, work, (dim + 1,))
        return float(told[0]), told[1:]

    if not middle.spread:
        return middle, np.zeros(0), np.zeros((dim, 0))
    deviations, components = bidiagonalise(sweep, dim, middle.n, wanted)
    there = min(wanted, int((deviations > ZERO * deviations[0]).sum()))
    return middle, deviations[:there] ** 2 / middle.n, components[:, :there]


def identity_error(blocks: DataFrame, dim: int, middle: Centre, values: np.ndarray, components: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    k, scaled = len(values), components / np.sqrt(values)
    mean = _total(blocks, dim, lambda x: (middle.rows(x) @ scaled).sum(axis=0), (k,)) / middle.n

    def products(x: np.ndarray) -> np.ndarray:
        w = middle.rows(x) @ scaled - mean
        return w.T @ w

    return float(np.abs(_total(blocks, dim, products, (k, k)) / middle.n - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """``vectors`` (vec_id, embedding) as one row per usable vector and
    component, see the module's text."""
    spark = vectors.sparkSession
    kept = (vectors.filter(F.col("embedding").isNotNull() & usable("embedding") & (F.size("embedding") > 0))
            .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")))
    dims = sorted(r[0] for r in kept.groupBy(F.size("embedding")).count().collect())
    told = None
    for dim in dims:
        blocks = stored(kept.filter(F.size("embedding") == dim).mapInArrow(_pack(dim), BLOCKS), "whiten-blocks")
        middle, values, components = fit(blocks, dim, wanted)
        k, error = len(values), identity_error(blocks, dim, middle, values, components) if len(values) else 0.0
        share = values / middle.trace if k else values
        scaled = components / np.sqrt(values)

        def rows(batches, dim=dim, middle=middle, k=k, error=error, share=share, scaled=scaled):
            for batch in batches:
                for ids, known, x in zip(*(batch.column(c) for c in ("ids", "known", "x"))):
                    x = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dim)
                    far = middle.deviations(x)
                    ids = np.repeat(np.frombuffer(ids.as_buffer(), "<i8"), k)
                    null = np.repeat(~np.frombuffer(known.as_buffer(), "?"), k)
                    m = len(x)
                    yield pa.RecordBatch.from_pydict({
                        "vec_id": pa.array(ids, mask=null), "component": pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), m)),
                        "n": pa.array(np.full(m * k, middle.n, "i8")), "deviation": pa.array(np.repeat(far, k)),
                        "whitened": pa.array((middle.rows(x) @ scaled).ravel()), "explained": pa.array(np.tile(share, m)),
                        "identity_error": pa.array(np.full(m * k, error))})

        part = blocks.select("ids", "known", "x").mapInArrow(rows, WHITENED)
        told = part if told is None else told.union(part)
    return spark.createDataFrame([], WHITENED) if told is None else told


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

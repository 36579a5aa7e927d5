"""Language-model scoring with a log-frequency Bloom filter.

n-grams (n = 1, 2) of all training texts are counted; those seen ``MIN_COUNT``
times or more, so all, enter a Bloom filter with their quantised log count: a gram of
level q is inserted as (gram, 1) ... (gram, q). A worker estimates a count by
repeated membership probes, level after level until one misses. Probabilities
are smoothed with a Dirichlet prior of ``PRIOR`` pseudo-counts from the order
below: P(w | u) = (c(uw) + PRIOR P(w)) / (c(u) + PRIOR), P(w) = (c(w) + 1) /
(N + V + 1).

Stages, all on Spark: texts become chunks of word numbers (one pass, the words
of a chunk once); the chunks' words are summed by word, giving every chunk the
exact training counts of its words; the chunks' n-grams, held-out ones with a
count of 0, go to their hash bucket, already summed per chunk. A bucket sums
them, builds its own segment of the filter, probes it for every gram sent and
answers each chunk with the levels. The filter grows with the grams: a segment
is as large as its bucket needs, the number of buckets follows the tokens, and
no task or driver ever holds more than one segment.

Words are runs of anything but ASCII white space, A-Z lower-cased; a text ends
with an end token, which is also the history of the first token.

Defined results: null and empty texts are the end token alone; without a
training text the base is log10(1 / 1) = 0 and so is the score; null ids are
rows like others (their remainder is that of the empty text). Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm.common import id_remainder, stored, table

CHUNK_TOKENS = 1 << 20
#: Tokens whose probabilities are computed at once, grams probed at once.
PROBED_TOKENS = 1 << 18
BUCKET_TOKENS = 1 << 20
MIN_COUNT = 1
LEVEL_BASE = 1.3
PROBES = 8
PRIOR = 200.0
LEVELS = 127
CHUNKS = ("chunk long, doc_ids array<long>, held array<boolean>, ends array<long>, low binary, high binary, "
          "words array<string>, n_train array<long>")
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_ODD = np.uint64(0x9E3779B97F4A7C15)


# -- chunks -------------------------------------------------------------------

def _chunk(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, held, tokens). Word numbers are by falling frequency, so
    their high halves are nearly all zero."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    ends = np.cumsum([len(t) for _, _, t in rows])
    ids = np.concatenate([np.fromiter(map(numbers.__getitem__, t), "i8", len(t)) for _, _, t in rows])
    train = np.repeat([not held for _, held, _ in rows], np.diff(np.r_[0, ends]))
    order = np.argsort(-np.bincount(ids, minlength=len(numbers)), kind="stable")
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    ids = place[ids].astype("<u4")
    words = np.array(list(numbers), dtype=object)[order]
    return pa.RecordBatch.from_pydict({
        "chunk": [number], "doc_ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
        "held": pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())),
        "ends": pa.array([ends], pa.list_(pa.int64())),
        "low": pa.array([(ids & 0xFFFF).astype("<u2").tobytes()], pa.binary()),
        "high": pa.array([(ids >> 16).astype("<u2").tobytes()], pa.binary()),
        "words": pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
        "n_train": pa.array([np.bincount(ids[train], minlength=len(words))], pa.list_(pa.int64()))})


def chunks(docs: DataFrame, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as chunks of about ``tokens`` tokens."""

    def build(batches):
        rows, n, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text, held in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                          batch.column("held_out").to_pylist()):
                found = (text.as_py() or "").encode().lower().split()
                rows.append((doc_id, held, [*found, b""]))
                n += len(found) + 1
                if n >= tokens:
                    yield _chunk(number, rows)
                    rows, n, number = [], 0, number + 1
        if rows:
            yield _chunk(number, rows)

    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(build, CHUNKS)


def _numbers(row: dict) -> np.ndarray:
    return np.frombuffer(row["low"], "<u2").astype("i8") | np.frombuffer(row["high"], "<u2").astype("i8") << 16


# -- n-grams ------------------------------------------------------------------

def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), "u8", len(words))


def unigram(h: np.ndarray) -> np.ndarray:
    return _mixed(h + np.uint64(1))


def bigram(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _mixed(before * _ODD + h)


def histories(ids: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """The token before each; the end token before a text's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.r_[0, ends[:-1]]] = end
    return before


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_base(count)), at most LEVELS."""
    return np.minimum(1 + np.floor(np.log(counts) / np.log(LEVEL_BASE) + 1e-9), LEVELS).astype("u1")


def level_counts() -> np.ndarray:
    """The count a level stands for, 0 for none: the middle of the whole
    numbers that are quantised to it."""
    lo = np.ceil(LEVEL_BASE ** np.arange(LEVELS) - 1e-9)
    hi = np.maximum(np.ceil(LEVEL_BASE ** np.arange(1, LEVELS + 1) - 1e-9) - 1, lo)
    return np.r_[0.0, (lo + hi) / 2]


def _pack5(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view("u1").reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), "u1")
    out[:, :5] = np.frombuffer(data, "u1").reshape(-1, 5)
    return out.view("<u8").ravel()


def chunk_grams(r: dict, buckets: int) -> tuple[np.ndarray, ...]:
    """A chunk's distinct pairs (history << 32 | word), the place of each
    token's pair in them, and of the grams (pairs, then words) in the order in
    which they are sent: that order, hashes, training counts, buckets."""
    ids, ends = _numbers(r), np.array(r["ends"])
    h, end = word_hashes(r["words"]), r["words"].index("")
    token = histories(ids, ends, end) << 32 | ids
    del ids
    by_pair = np.argsort(token).astype("u4")
    token = token[by_pair]
    first = np.r_[True, token[1:] != token[:-1]]
    pair, back = token[first], np.empty(len(token), "u4")
    back[by_pair] = np.cumsum(first, dtype="u4") - np.uint32(1)
    del token, by_pair, first
    train = np.repeat(~np.array(r["held"]), np.diff(np.r_[0, ends]))
    n = np.r_[np.bincount(back[train], minlength=len(pair)), np.array(r["n_train"])]
    with np.errstate(over="ignore"):
        grams = np.r_[bigram(h[pair >> 32], h[pair & 0xFFFFFFFF]), unigram(h)]
    bucket = ((grams >> np.uint64(40)) % np.uint64(buckets)).astype("u4")
    order = np.argsort(bucket.astype("i8") * 3 + np.minimum(n, 2), kind="stable").astype("u4")
    return pair, back, order, grams[order], n[order], bucket[order]


def gram_levels(coded: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, levels (a byte each) of every chunk's n-grams, in the
    order of :func:`chunk_grams`."""

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: v[0] for c, v in batch.slice(i, 1).to_pydict().items()}
                grams, n, bucket = chunk_grams(r, buckets)[3:]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([r["chunk"]], pa.int64()), "bucket": pa.array([b], pa.int64()),
                        "unseen": pa.array([int((n[part] == 0).sum())], pa.int64()),
                        "grams": pa.array([_pack5(grams[part])], pa.binary()),
                        "more": pa.array([n[part][n[part] > 1].astype("<u4").tobytes()], pa.binary())})

    def answer(key, sent):
        n, sizes = [], []
        for unseen, g, more in zip(sent.column("unseen").to_pylist(), sent.column("grams"), sent.column("more")):
            more = np.frombuffer(more.as_py(), "<u4").astype("i8")
            sizes.append(len(g.as_buffer()) // 5)
            n += [np.zeros(unseen, "i8"), np.ones(sizes[-1] - unseen - len(more), "i8"), more]
        grams, n = _unpack5(b"".join(g.as_py() for g in sent.column("grams"))), np.concatenate(n)
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        first = np.r_[True, ranked[1:] != ranked[:-1]]
        grams, total = ranked[first], np.add.reduceat(n[order], np.flatnonzero(first))
        seen = total >= MIN_COUNT
        level = levels(total[seen])
        size = segment_size(int(level.sum(dtype="i8")))
        filt = LogFrequencyFilter(np.packbits(segment(grams[seen], level, size), bitorder="little"), size, 1)
        found = np.concatenate([filt.levels(grams[k:k + PROBED_TOKENS]) for k in range(0, len(grams), PROBED_TOKENS)]).astype("u1")
        told = np.empty(len(order), "u1")
        told[order] = found[np.cumsum(first) - 1]
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({"chunk": sent.column("chunk"), "bucket": sent.column("bucket"),
                         "levels": pa.array([part.tobytes() for part in np.split(told, cuts)], pa.binary())})

    sent = coded.select("chunk", "words", "n_train", "ends", "held", "low", "high").mapInArrow(
        send, "chunk long, bucket long, unseen long, grams binary, more binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, levels binary")


def segment_size(inserted: int) -> int:
    """Bits for so many insertions (a gram counts once a level)."""
    return max(64, int(np.ceil(inserted * PROBES / np.log(2) / 8)) * 8)


def segment(grams: np.ndarray, level: np.ndarray, size: int) -> np.ndarray:
    """The bits of a segment, a byte each."""
    bits = np.zeros(size, "u1")
    for q in range(1, int(level.max(initial=0)) + 1):
        part = grams[level >= q]
        for probe in range(PROBES):
            bits[LogFrequencyFilter.places(part, q, probe, size)] = 1
    return bits


class LogFrequencyFilter:
    """Segments of ``size`` bits, one per bucket, in one bit array."""

    def __init__(self, bits: np.ndarray, size: int, buckets: int):
        self.bits, self.size, self.buckets = bits, size, buckets

    @staticmethod
    def places(grams: np.ndarray, level: np.ndarray | int, probe: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (grams & np.uint64((1 << 40) - 1)) * _ODD + np.asarray(level).astype("u8") * np.uint64(0xD1B54A32D192ED03)
            return _mixed(h + np.uint64(probe) * np.uint64(0x8CB92BA72F3D8DD7)) % np.uint64(size)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Levels by repeated probes: those still present go on to the next."""
        out = np.zeros(len(grams), "i8")
        at = np.arange(len(grams))
        base = (grams >> np.uint64(40)) % np.uint64(self.buckets) * np.uint64(self.size)
        for level in range(1, LEVELS + 1):
            for probe in range(PROBES):
                bit = base[at] + self.places(grams[at], level, probe, self.size)
                at = at[(self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype("u1")) & 1 == 1]
            if not len(at):
                break
            out[at] = level
        return out


# -- scoring ------------------------------------------------------------------

def score(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``docs`` (doc_id, text, held_out) -> SCORES and train_tokens."""
    coded = stored(chunks(docs), "chunks", "zstd")
    words = coded.select("chunk", F.posexplode(F.arrays_zip("words", "n_train"))).select(
        "chunk", F.col("pos").alias("word_no"), F.col("col.words").alias("word"), F.col("col.n_train").alias("n"))
    # the words' totals are summed before the shuffle, so a word that is in every chunk is no hot key
    totals = stored(words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "word-totals", "zstd")
    known = stored(words.join(totals, "word").select("chunk", "word_no", "c"), "known-words", "zstd")
    totals = totals.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, distinct = totals["n"] or 0, totals["v"] or 0

    tokens = coded.agg(F.sum(F.element_at("ends", -1)).alias("n")).first()["n"] or 0
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    answers = stored(gram_levels(coded, buckets), "gram-levels", "zstd")
    # a chunk's known words and its grams' levels: at most CHUNK_TOKENS and twice that
    lists = known.groupBy("chunk").agg(F.collect_list(F.struct("word_no", "c")).alias("known"))
    parts = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "levels")).alias("parts"))
    told = coded.join(parts, "chunk").join(lists, "chunk", "left")

    def tell(batches):
        stands = level_counts()
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                r = {c: one.column(c)[0].as_py() for c in ("doc_ids", "held", "ends", "low", "high", "words", "parts")}
                r["n_train"] = one.column("n_train")[0].values.to_numpy()
                pair, back, order = chunk_grams(r, buckets)[:3]
                level = np.empty(len(order), "u1")
                level[order] = np.frombuffer(b"".join(p["levels"] for p in sorted(r["parts"], key=lambda p: p["bucket"])), "u1")
                both, single = level[:len(pair)], stands[level[len(pair):]]
                del order
                ids, ends = _numbers(r), np.array(r["ends"])
                starts = np.r_[0, ends[:-1]]
                c = np.zeros(len(r["words"]), "i8")
                if one.column("known")[0].is_valid:
                    flat = one.column("known")[0].values
                    c[flat.field("word_no").to_numpy()] = flat.field("c").to_numpy()
                base = np.log10(c + 1.0) - np.log10(n_all + distinct + 1.0)
                p1, p = (single + 1.0) / (n_all + distinct + 1.0), np.empty(len(pair))
                for k in range(0, len(pair), PROBED_TOKENS):
                    part = slice(k, k + PROBED_TOKENS)
                    u, w = pair[part] >> 32, pair[part] & 0xFFFFFFFF
                    # a pair is not seen more often than either of its words
                    n = np.minimum(stands[both[part]], np.minimum(np.maximum(single[u], 1), np.maximum(single[w], 1)))
                    p[part] = np.log10((n + prior * p1[w]) / (single[u] + prior))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(r["doc_ids"], pa.int64()), "held_out": pa.array(r["held"], pa.bool_()),
                    "n_tokens": ends - starts, "n_known": np.add.reduceat((c > 0)[ids].astype("i8"), starts),
                    "base_score": np.add.reduceat(base[ids], starts), "score": np.add.reduceat(p[back], starts)})
                del pair, back, p, ids, r, one

    return told.mapInArrow(tell, SCORES).withColumn("train_tokens", F.lit(n_all).cast("long"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder("doc_id", 7) == 2).alias("held_out"))
    return score(docs)

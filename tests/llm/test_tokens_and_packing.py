"""Token files (op 3) and best-fit packing (op 6)."""

import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptlens.llm import binpack, bitpack, tokens
from promptlens.session import scratch_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id long, text string, start string"  # an extra column with a clashing name
TEXTS = ["", None, "Hello, world! it's 12 o'clock", "naïve ÉCOLE Å İx ΟΔΟΣ é ́x", "a  b\n\nc\t\r d\x1ce\xa0f",
         "<|endoftext|> x<|startoftext|>y", "日本語 テスト 한국어", "word " * 3000, "x" * 5000, "%%% &&& don't we'll 'tis"]


def reference_ids(text, end):
    enc = tokens.encoder(tokens.default_path())
    return np.array(enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_cached_ids_equal_the_library(text):
    enc = tokens.encoder(tokens.default_path())
    assert enc.by_word
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded():
    enc = tokens.Encoder(tokens.default_path(), cache_entries=10)
    text = " ".join(f"word{i}" for i in range(100))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(enc._words) <= 10


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.data())
def test_pack_round_trip_and_random_access(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2 ** width - 1), max_size=60)), "<u4")
    packed = bitpack.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert bitpack.unpack(packed, width, a, b).tolist() == ids[a:b].tolist()


def test_pack_refuses_wide_ids():
    with pytest.raises(ValueError):
        bitpack.pack(np.array([8]), 3)
    assert bitpack.bit_width(49408) == 16 and bitpack.bit_width(2) == 1


def test_file_round_trip(spark):
    rows = [(i * 3 % 31, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (7, "again", "x"), (7, "again", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = scratch_path(spark, "t-ids")
    bitpack.write_ids(docs, path, tokens.default_path(), end_id=2, ids_per_block=50, shards=3)
    got = sorted(bitpack.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0
    want = sorted((r[0] if r[0] is not None else -1, zlib.crc32(reference_ids(r[1], 2).tobytes())) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids_crc32"]) for r in got) == want
    whole = {r["start"]: r["ids"] for r in bitpack.read_documents(spark, path, with_ids=True).collect()}
    flat = [i for s in sorted(whole) for i in whole[s]]
    part = sorted((r["position"], r["id"]) for r in bitpack.read_range(spark, path, 37, 4000).collect())
    assert part == [(i, flat[i]) for i in range(37, 4000)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    path = scratch_path(spark, "t-empty")
    bitpack.write_ids(docs, path, tokens.default_path(), end_id=2)
    assert bitpack.read_documents(spark, path).count() == 0
    assert binpack.pack_documents(docs, tokens.default_path()).count() == 0


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms), sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_sweep_is_best_fit_decreasing(lengths):
    runs = sorted({n: lengths.count(n) for n in lengths}.items())
    plan = binpack.sweep(runs, 20)
    used = {}
    for length, count in runs:
        segments = sorted(s for s in plan.tolist() if s[0] == length)
        for r in range(count):
            _, rank, first, each, offset = max(s for s in segments if s[1] <= r)
            used.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 20
    n, rooms = best_fit_decreasing(lengths, 20)
    assert len(used) == n and sorted(20 - sum(x for _, x in p) for p in used.values()) == rooms


def test_packed_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "x"), (5, "copy", "x"), (5, "copy", "x")]
    got = binpack.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), tokens.default_path(), 0, 128).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, _ in rows[:-3]:
        ids = reference_ids(text, 0)
        parts = sorted((r for r in by_doc[doc_id]), key=lambda r: r["piece"])
        if doc_id == 5:
            continue
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["length"] for r in parts[:-1]] == [128] * (len(parts) - 1) and sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert len(by_doc[None]) == 1 and len(by_doc[5]) == 2 + len(reference_ids(TEXTS[5], 0)) // 128 + 1
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 128
    assert len(bins) == best_fit_decreasing([r["length"] for r in got], 128)[0]

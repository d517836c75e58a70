"""Operator 11: the contract, the solver against a slow one, plans of any histogram, and edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import nnls_packing as nnls
from plumbline.llm import queries as q

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokens(texts):
    model = Tokenizer.from_file(PATH)
    return [np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for t in texts]


def hold(rows, ids, capacity):
    """rows: (document's key, start, length, crc, doc_tokens, sequence, offset); ids: key -> bytes."""
    parts, bins = {}, {}
    for k, start, length, crc, total, sequence, offset in rows:
        assert 1 <= length <= capacity and total == len(ids[k]) // 4
        assert crc == zlib.crc32(ids[k][4 * start : 4 * (start + length)])
        parts.setdefault(k, []).append((start, length))
        bins.setdefault(sequence, []).append((offset, length))
    assert parts.keys() == ids.keys()
    for k, v in parts.items():
        at = 0
        for start, length in sorted(v):
            assert start == at
            at += length
        assert at == len(ids[k]) // 4
    short = 0
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity and not at & at - 1  # full, or a power of two: no padding
        short += at < capacity
    assert short <= capacity.bit_length()
    return len(bins)


def test_query_keeps_its_contract(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [tuple(r) for r in q.op11_packing(spark, SF).collect()]
    hold(rows, dict(zip(docs, tokens(docs.values()))), 1024)
    parts = {}
    for r in rows:
        parts[r[0]] = parts.get(r[0], 0) + 1
    whole = {r[0] for r in rows if r[4] <= 1024}
    assert sum(parts[k] > 1 for k in whole) < 0.2 * len(whole)  # most short documents stay in one piece


ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\n\n\n b\n", "x\t\ty  ", "don't  'stop", "e  f", "<|endoftext|> and  <|endoftext|>", "nul\0 nul", "é語𝄞 𝄞", "z" * 5000, "word " * 9000, "\r\n \r\n", "tab\t x", "a\x1c b"]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice([" ", " ", "\n", "\t", "ab", "The", "'s", "12", "é", ".", ",%%", "x&b", "Wh?", "  ", "<|"]) for _ in range(60)) for _ in range(500)]
    encode = nnls.encoder(PATH, words=50)
    assert encode.__name__ == "by_words"
    assert [encode(t) + bytes(4) for t in texts] == tokens(texts)
    words = public_tokenizers.path("word_bpe_49k.json")  # parts words elsewhere
    model = Tokenizer.from_file(words)
    assert list(map(nnls.encoder(words), texts)) == [np.array(model.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_edges(spark):
    texts = [None, *ODD]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, length int, part int")
    from pyspark.sql import functions as F

    for capacity in (8, 1024):
        out = nnls.pack(df, PATH, capacity=capacity)
        rows = out.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
        hold([tuple(r) for r in rows], dict(enumerate(tokens(texts))), capacity)
    assert nnls.pack(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, "x")], "doc_id long, text string")
    rows = nnls.pack(twice, PATH).collect()
    assert sum(r["length"] for r in rows) == sum(len(t) // 4 for t in tokens(["one two", "one two", "x"]))
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def slow_plan_check(histogram, capacity, made, cap=10**9):
    """Follow every piece of a small histogram."""
    length = np.repeat(np.arange(capacity + 1), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram.tolist()]) if len(length) else np.zeros(0, dtype=np.int64)
    got = [[] for _ in length]
    filled = {}
    for row, at, size, sequence, offset in nnls.places(made, length.astype(np.int64), rank.astype(np.int64)):
        for r, a, n, s, o in zip(row.tolist(), at.tolist(), size.tolist(), sequence.tolist(), offset.tolist()):
            got[r].append((a, n))
            filled.setdefault(s, []).append((o, n))
    for n, v in zip(length.tolist(), got):
        assert sum(x for _, x in v) == n and [a for a, _ in v] == np.cumsum([0] + [x for _, x in v])[:-1].tolist()
    assert sorted(filled) == list(range(made.sequences))
    short = 0
    for v in filled.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity and not at & at - 1
        short += at < capacity
    assert short <= capacity.bit_length()


@pytest.mark.parametrize("seed", range(12))
def test_plans_of_any_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = [16, 64, 256][seed % 3]
    histogram = rng.integers(0, [2, 40, 400][seed // 4], capacity + 1) * (rng.random(capacity + 1) < [1.0, 0.3, 0.05, 0.9][seed % 4])
    histogram[0] = 0
    slow_plan_check(histogram, capacity, nnls.plan(histogram, capacity, depth=1 + seed % 3))


def test_plans_of_few_lengths_and_huge_counts():
    for lengths in ([600], [1], [1023], [1024], [600, 700, 800], [3], [511, 513], [341, 342]):
        histogram = np.zeros(1025, dtype=np.int64)
        histogram[lengths] = 10**9 + 7
        made = nnls.plan(histogram)
        assert len(made.length) < 5000
        assert 1024 * made.sequences >= int(histogram @ np.arange(1025)) > 1024 * (made.sequences - 11)
    assert nnls.plan(np.zeros(1025, dtype=np.int64)).sequences == 0
    with pytest.raises(ValueError):
        nnls.plan(np.zeros(1001, dtype=np.int64), 1000)


def slow_nnls(a, h):
    """Projected gradient with a safe step, long enough."""
    x, step = np.zeros(a.shape[1]), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20_000):
        x = np.maximum(0, x - step * (a.T @ (a @ x - h)))
    return x


def test_solver_equals_a_slow_one():
    ways = nnls.combinations(24)
    assert len(set(map(tuple, ways.tolist()))) == len(ways) and (ways.sum(1) == 24).all() and (np.diff(ways, axis=1) <= 0).all()
    assert len(ways) == 1 + 12 + sum(1 for a in range(1, 24) for b in range(1, a + 1) if 1 <= 24 - a - b <= b)
    for seed in range(3):
        h = np.random.default_rng(seed).integers(0, 50, 25).astype(float)
        h[0] = 0
        a = np.stack([np.bincount(w[w > 0], minlength=25) for w in ways], 1).astype(float)
        best = np.square(a @ slow_nnls(a, h) - h).sum()
        got = np.square(a @ nnls.solve(ways, h, rounds=5000, small=1e-12) - h).sum()
        assert got <= best * 1.01 + 1e-6

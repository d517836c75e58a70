"""Operator 12 against all pairs of words, and its edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import spelling

A_Z = {c: c + 32 for c in range(65, 91)}


def slow_words(rows, least=7, n_least=2):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(A_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= n_least}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def slow_variants(words, ratio=10):
    form, out = {}, set()
    beside = {w: [v for v in words if near(v, w)] for w in words}
    for w, vs in beside.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(beside[w]), words.get(form[w])))
    return out


def test_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Großmutter großmutter GROSSMUTTER"), (5, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ"), (None, "however however"), (6, "won't can-not abcdefg1abcdefg"), (7, "x×÷aaaaa x×÷aaaaa"), (7, "repeated rows"), (7, "repeated rows"), (8, "aaaaaaaa " * 20_000), (9, "ĀĀĀĀĀĀĀ 𝄞abcdefg")]
    rows += [(100 + i, "misspelling Consequence consequence wonderful") for i in range(200)]  # some lose a letter
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS i", "3 AS h", "'x' AS word")
    got = {r["word"]: r["n"] for r in spelling.count_words(df).collect()}
    assert got == slow_words(rows)
    assert any(len(w) == 10 and near(w, "misspelling") for w in got)


@pytest.mark.parametrize("seed, ratio", [(1, 10), (2, 2)])
def test_equals_all_pairs(spark, seed, ratio):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abàé𝄞") for _ in range(rng.randint(1, 7))) for _ in range(120)] + ["aaaa", "aaaaa", "aaaaaa", "a", "", "abab", "ababa", "babab"]
    words = {w: rng.choice([1, 2, 3, 20, 20, 40, 400, 4000, 40_000]) for w in base}
    for w in list(words)[:40]:  # chains of forms
        words.setdefault(w + "b", words[w] * ratio)
        words.setdefault(w + "bb", words[w] * ratio**2)
    df = spark.createDataFrame(list(words.items()), "word string, n long").selectExpr("*", "1 AS rest", "2 AS near", "3 AS e")
    got = [tuple(r) for r in spelling.variants(df, ratio=ratio).collect()]
    assert len(got) == len(words)
    assert set(got) == slow_variants(words, ratio)


def test_crowd_about_one_word(spark):
    words = {"consequence": 10**6} | {f"consequenc{chr(c)}": 3 for c in range(0x100, 0x300)} | {f"consequence{chr(c)}": 3 for c in range(0x100, 0x300)}
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()} == slow_variants(words)


def test_edges(spark):
    kind = "word string, n long"
    assert spelling.variants(spark.createDataFrame([], kind)).count() == 0
    rows = [("abcdefg", 1), ("abcdefg", 4), (None, 9), ("abcdefh", 0), ("abcdefi", None), ("abcdef", 50)]
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, kind)).collect()} == slow_variants({"abcdefg": 5, "abcdef": 50})
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], kind), ratio=1)
    assert spelling.count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0

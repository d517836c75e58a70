"""Operators 4, 7, 8 and 9 against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from plumbline.llm import decontaminate, line_dedup, packing, simhash
from plumbline.llm import queries as q

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "One", "one two", "É b C\x0bd e", "a\x1cb c d\x85e f", "x " * 3000, "same line that is long enough\n" * 3, "Same LINE that is long enough  \nother"]


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---- 4: SimHash


def slow_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=2):
    ids, parent = sorted(fps), {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_query_equals_brute_force(spark):
    fps = {i: slow_fingerprint(t) for i, t in documents(spark)}
    want = {(i, f"{fps[i]:016x}", c) for i, c in slow_components(fps).items()}
    assert {tuple(r) for r in q.op4_simhash(spark, SF).collect()} == want


def test_simhash_odd_texts(spark):
    rows = list(enumerate(ODD))
    got = {r["doc_id"]: r["fp"] % 2**64 for r in simhash.simhash(frame(spark, rows)).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in rows}
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    out = simhash.simhash_components(frame(spark, rows + rows))  # repeated rows stay
    assert out.count() == 2 * len(rows)


def test_wider_groups_for_more_fingerprints():
    assert [simhash.best_parts(n) for n in (0, 10**5, 10**7, 10**9, 10**11)] == [3, 3, 3, 2, 2]


@pytest.mark.parametrize("limit, parts", [(0, None), (3, None), (10_000, None), (10_000, 2)])
def test_links_lose_nothing(spark, limit, parts):
    rng = random.Random(limit)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for center in list(fps)[:4]:  # crowds of near copies, chains included
        for _ in range(60):
            center ^= 1 << rng.randrange(64)
            fps.add(center)
            fps.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [(x - (x >> 63 << 64),) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    found = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, limit=limit, parts=parts).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    number = dict(enumerate(sorted(fps)))
    want = slow_components(number)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {x: root(x) for x in fps} == {number[i]: number[c] for i, c in want.items()}


def test_allocation_is_least_and_covers():
    rng = np.random.default_rng(1)
    exact, widths, density = rng.integers(0, 500, (50, 3)).astype(float), [22, 21, 21], [3.0, 40.0, 8.0]
    taken, cost = simhash.allocate(exact, widths, density, 2)
    assert (taken.sum(1) == 2 - 3 + 1).all()
    for r in range(50):
        def price(i, t):
            n = len(simhash._flips(widths[i], t)) if t >= 0 else 0
            return 0 if t < 0 else n + exact[r, i] + (n - 1) * density[i]

        options = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
        assert np.isclose(cost[r], min(sum(price(i, t) for i, t in enumerate(o)) for o in options))


# ---- 7: decontamination


def slow_contamination(docs, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - span + 1) if w else 0):
            windows[tuple(w[at : at + span])].add(i)
    sizes, out = {len(k) for k in windows}, {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    found |= own
        ids = sorted(map(str, found))
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_query_equals_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in q.op7_decontaminate(spark, SF).collect()}
    assert got == slow_contamination(documents(spark), items)


@pytest.mark.parametrize("block_bytes", [1 << 25, 60])
def test_contamination_odd_texts_and_blocks(spark, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice("abcde")  # noqa: E731  few words: chance hits, repeats and overlaps
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 9, 10, 11, 25, 40, 40])] + [(90, None), (91, "..."), (92, "one")]
    docs = list(enumerate(ODD)) + [(100 + i, " ".join(word() for _ in range(300)) + " " + items[i][1] + ", " + items[i][1].upper()) for i in range(7)]
    out = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["item_ids"])) for r in out.collect()}
    want = slow_contamination(docs, items)
    assert {d: (n, h, len(i)) for d, (n, h, i) in got.items()} == {d: w[:3] for d, w in want.items()}
    assert {d: hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest() for d, (_, _, i) in got.items()} == {d: w[3] for d, w in want.items()}


def test_contamination_empty_and_clashing_names(spark):
    docs = frame(spark, [(1, "a b")]).selectExpr("*", "7 AS n_hit", "'x' AS Item_Ids")
    out = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "n_hit", "Item_Ids", "n_words", "n_hit_", "hit_bits", "item_ids_"]
    assert [tuple(r) for r in out.collect()] == [(1, "a b", 7, "x", 2, 0, None, [])]


def test_winnowing_keeps_one_in_each_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    p = decontaminate.winnow(h, 6)
    for i in range(495):
        low = i + 5 - int(np.argmin(h[i : i + 6][::-1]))
        assert low in p


# ---- 8: line dedup


def slow_lines(docs):
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(ASCII)
    owners = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            owners[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(k := key(x)) >= 20 and len(owners[k]) >= 3 and max(owners[k]) != d)]
        out[d] = (len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_line_dedup_query_equals_brute_force(spark):
    got = {r[0]: tuple(r)[1:] for r in q.op8_line_dedup(spark, SF).collect()}
    assert got == slow_lines(documents(spark))


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_line_dedup_odd_texts(spark, batches):
    docs = list(enumerate(ODD + ["é" * 19, "É" * 20, "É" * 20, "É" * 20 + " ", "é" * 20, ODD[-1], "\n".join(["z" * 25, "z" * 25, "q"])] + ["z" * 25] * 3))
    out = line_dedup.dedup_lines(frame(spark, docs), batches=batches)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out.collect()}
    assert got == slow_lines(docs)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_null_and_repeated_ids_and_clashing_names(spark):
    line = "x" * 30
    docs = frame(spark, [(None, line), (None, "a"), (5, line), (5, line), (4, line + "\nb"), (9, "c")]).selectExpr("*", "1 AS id", "2 AS gone", "3 AS h1", "4 AS Kept_Text")
    out = line_dedup.dedup_lines(docs, batches=3)
    assert out.columns == ["doc_id", "text", "id", "gone", "h1", "Kept_Text", "kept_text_", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["kept_text_"], r["n_dropped"]) for r in out.collect()), key=repr)
    assert got == sorted([(None, "", 1), (None, "a", 0), (5, line, 0), (5, line, 0), (4, "b", 1), (9, "c", 0)], key=repr)


def test_runs_compact_by_level_and_find_what_is_new(spark):
    runs = line_dedup.LineRuns(spark, fanout=3)
    for b in reversed(range(7)):
        run = runs.add(spark.createDataFrame([(b, 1, 1), (b, 2, b)], "doc_id long, h1 long, h2 long"))
        # the batch alone, merged with what is there: what earlier batches hold is neither counted nor placed anew
        assert {tuple(r) for r in run.collect()} == {(1, 1, 1, 6 if b == 6 else None), (2, b, 1, b)}
    assert [len(x) for x in runs.levels] == [1, 2]
    seen = {(r["h1"], r["h2"]): (r["n_docs"], r["last"]) for r in runs.view().collect()}
    assert seen == {(1, 1): (7, 6)} | {(2, b): (1, b) for b in range(7)}
    new = runs.unseen(spark.createDataFrame([(9, 1, 1), (9, 2, 6), (9, 2, 7)], "doc_id long, h1 long, h2 long"))
    assert [tuple(r) for r in new.select("h1", "h2").collect()] == [(2, 7)]


# ---- 9: packing


def test_packing_null_ids_and_tokenizers_without_word_ends(spark, tmp_path):
    from tokenizers import Tokenizer, models

    docs = frame(spark, [(None, "a b"), (2**60 + 1, None), (2**60 + 1, "c")])
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")
    got = sorted(((r["doc_id"], r["length"]) for r in packing.pack(parts, keep=["doc_id", "piece"]).collect()), key=repr)
    assert [d for d, _ in got] == [2**60 + 1, 2**60 + 1, None] and got[0][1] == 1
    odd = Tokenizer(models.WordLevel({"[UNK]": 0, "a b": 1, "a": 2, "b": 3}, unk_token="[UNK]"))  # spaces are no ends here
    odd.save(str(tmp_path / "odd.json"))
    assert list(np.frombuffer(packing._tokeniser(str(tmp_path / "odd.json"))("a b"), "<u4")) == [1]


def test_packing_query(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: model.encode(t or "", add_special_tokens=False).ids + [0] for d, t in documents(spark)}
    rows, bins = q.op9_packing(spark, SF).collect(), defaultdict(list)
    assert {(r["doc_id"], r["piece"]) for r in rows} == {(d, p) for d, x in ids.items() for p in range(-(-len(x) // 2048))}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and r["length"] == len(part)
        assert r["length"] == 2048 or r["start"] + r["length"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.03 * -(-sum(map(len, ids.values())) // 2048) + 2


def test_tokenising_by_words_equals_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, encode = Tokenizer.from_file(path), packing._tokeniser(path)
    odd = [t for t in ODD if t] + ["áb. C'est It's I'LL.  X<|endoftext|>y \x1cq\x85z ÀÉ.. ΑΣ. 12.5% a.b,c 日本。 x İ. Ⅷ. don't! <|startoftext|>. <|ENDOFTEXT|>.", "A.", "'S.", "É. é,", "%%%", "á."]
    for text in odd + [t for _, t in documents(spark)[:60]]:
        assert encode(text) == np.array(model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_sum_of_squares_places_as_stated():
    rng = random.Random(2)
    lengths = [rng.randint(1, 20) for _ in range(300)]
    where, offset = packing.sum_of_squares(np.array(lengths), 20)
    level, squares = {}, lambda lv: sum(n * n for n in np.bincount([20 - x for x in lv.values() if x < 20], minlength=21).tolist())
    for s, b, o in zip(lengths, where.tolist(), offset.tolist()):
        options = {c: squares({**level, c: x + s}) for c, x in [*level.items(), (len(level), 0)] if x + s <= 20}
        assert options[b] == min(options.values()) and o == level.get(b, 0)
        level[b] = o + s


def test_packing_edges(spark):
    parts = packing.pieces(frame(spark, list(enumerate(ODD)) + [(0, None)]), public_tokenizers.path("word_bpe_49k.json"), capacity=64)
    out = packing.pack(parts, keep=["doc_id", "piece"], capacity=64)
    assert out.count() == parts.count() and out.where("doc_id = 0").count() == 2
    assert packing.pack(frame(spark, []).selectExpr("doc_id", "1L AS length"), keep=["doc_id"]).count() == 0
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(frame(spark, [(1, "")]).selectExpr("doc_id", "0L AS length"), keep=["doc_id"]).collect()

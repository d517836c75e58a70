"""The pipeline's stages, each against brute force on its own input."""

import random
import re

import pytest

import corpus_pipeline as pipe
from plumbline.llm.near_copies import near_duplicates
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in w]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def groups_of(texts):
    """What goes by brute force: of each connected component of near copies all but the smallest id."""
    ids, least = sorted(texts), {d: d for d in texts}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    sets = {d: shingles(t) for d, t in texts.items()}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {d for d in ids if root(d) < d}


def near_copies(rng, base, n):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def went(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS fp", "3 AS c")
    out = [r["doc_id"] for r in near_duplicates(df, **options).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("few", [0])
def test_near_duplicates_equal_definition(spark, few):
    rng = random.Random(few)
    base = [" ".join(f"v{rng.randrange(10**5)}" for _ in range(n)) for n in (8, 60, 120, 200)]
    made = [None, "", " \n", *base, *near_copies(rng, base[2], 60), *near_copies(rng, base[3], 30), *near_copies(rng, base[1], 20), base[1].upper(), base[1], base[0] + " x"]
    rng.shuffle(made)
    texts = dict(enumerate(made))
    owed = groups_of(texts)
    assert len(owed) > 50 and went(spark, texts, broadcast_ids=few) == owed


@pytest.mark.parametrize("sample", [10])
def test_appended_cut_and_edited_copies_all_go(spark, sample):
    rng = random.Random(21)
    word = lambda: rng.choice("the of and to in".split()) if rng.random() < 0.3 else f"v{rng.randrange(3000)}"
    base = [[word() for _ in range(rng.choice((50, 200, 600, 1500)))] for _ in range(60)]
    made = [" ".join(b) for b in base]
    for b in base:
        n = len(b)
        made.append(" ".join(b + [word() for _ in range(n * 24 // 100)]))
        made.append(" ".join(b[: n - n * 18 // 100]))
        made.append(" ".join(word() if rng.random() < 0.018 else w for w in b))
    texts = dict(enumerate(made))
    owed = groups_of(texts)
    assert len(owed) > 110 and went(spark, texts, sample=sample) == owed


def test_chains_and_crowds_are_groups(spark):
    """a ~ b ~ c with a unlike c are one group, alone and beside crowds; a crowd of copies too unlike each other is none."""
    rng = random.Random(31)
    base = [f"c{i}" for i in range(400)]
    chain = [" ".join(base[at : at + 300]) for at in (0, 25, 50)]
    assert jaccard(*chain[:2]) >= 0.8 and jaccard(*chain[1:]) >= 0.8 and jaccard(chain[0], chain[2]) < 0.8
    drift = near_copies(rng, " ".join(base[:300]), 80) + near_copies(rng, chain[2], 80)
    edited = [" ".join(w if rng.random() > e / 200 else f"x{rng.randrange(10**6)}" for w in base[:150]) for e in range(12) for _ in range(12)]
    for more in ([], drift, edited):
        texts = dict(enumerate(chain + more))
        assert went(spark, texts) == groups_of(texts) >= {1, 2}


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (1, "A b  c d e f g"), (3, "a b c d e f g"), (7, None), (8, " "), (None, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in near_duplicates(df).collect()} == {3, 8}
    assert near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates(df.where("doc_id = 1")).count() == 0


def test_stages_on_their_own_input(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipe.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == pipe.COLUMNS
            assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, after = map(text, seen["toxicity"])
    assert set(after) < set(before) and all(before[d] == t for d, t in after.items())
    before, after = map(text, seen["line_dedup"])
    assert set(before) == set(after) and before != after
    before, after = map(text, seen["near_dedup"])
    assert set(before) - set(after) == groups_of(before)
    from test_text_ops import slow_contamination

    before, after = map(text, seen["decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {d for d, w in slow_contamination(list(before.items()), items).items() if not w[4]}
    assert {r["doc_id"] for r in docs.collect()} == set(after)


def test_run_equals_its_stages_and_survives_nulls(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a fine text", None, "s", 11), (4, "A fine  text", "en", None, 12)]
    for name, df in {
        "documents": spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS score", "2 AS n_hit", "3 AS kept_text"),
        "labels": spark.createDataFrame([(1, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, None)], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert sorted(r["doc_id"] for r in pipe.run(spark, str(tmp_path)).collect()) == [1, 3]


def test_shingles_that_a_sample_misses_come_last(spark):
    from plumbline.llm import near_copies as nc

    rng = random.Random(11)
    said = " ".join(f"said{i}" for i in range(25))  # a passage that texts of different groups share
    texts = {i: " ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) + " " + said + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) for i in range(120)}
    texts |= {200 + i: texts[i] + " and more" for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "__id long, __t string")
    none = nc._usual(df.limit(0), 5, 8_000, 100)

    def meetings(order):
        keys = nc._features(df, 5, 0.8, order).select("id", F.explode("keys").alias("key"))
        return keys.groupBy("key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]

    counted = nc._crowded(df, 5, 0.8, none, 2, 1000)
    assert 10 * meetings(counted) < meetings(none)
    assert went(spark, texts) == went(spark, texts, crowd=10**6) == groups_of(texts) == {200 + i for i in range(5)}

"""Near-dedup of documents: SimHash candidates first, exact shingle candidates for what fingerprints cannot see."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Tables, components
from .simhash import BITS, _tokens, links

#: 64-bit words of a text's parity map.
MAP = 8


def _shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle."""
    h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)
    width, n = min(words, len(h)), max(1, len(h) - words + 1)
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _fingerprint(h: np.ndarray) -> int:
    """SimHash of distinct shingles: a bit is 1 if it is set in over half of their hashes."""
    counts = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def _parity(h: np.ndarray) -> np.ndarray:
    """For each of 64 * MAP cells whether an odd number of the hashes falls there."""
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % (BITS * MAP), minlength=BITS * MAP) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _usual(texts: DataFrame, words: int, sample: int, most: int) -> pd.Series:
    """About how many documents have the shingles that several documents of a sample share, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("__t"):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_hashes(_tokens(t.as_py()), words).view(np.int64))], names=["h"])

    every = max(1, min(64, texts.count() // sample))
    some = texts.where(F.pmod(F.xxhash64("__id"), F.lit(every)) == 0).select("__t")
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    return counts.orderBy(F.desc("n"), "h").limit(most).toPandas().set_index("h")["n"] * every


def _crowded(texts: DataFrame, words: int, least: float, known: pd.Series, crowd: int, most: int) -> pd.Series:
    """`known` with the shingles that over `crowd` prefixes in its order share, which a sample is too small to show."""
    usual, number = _in_order(known), _number(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(h := _ordered(_shingle_hashes(_tokens(t.as_py()), words), *usual))[: number(len(h))] for t in batch.column("__t")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))], names=["h"])

    counts = texts.select("__t").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    found = counts.orderBy(F.desc("n"), "h").limit(most).toPandas().set_index("h")["n"]
    return pd.concat([known, found]).groupby(level=0).max()


def _in_order(known: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of usual shingles and the place of each in the order of all shingles, from 1, the rarer first."""
    hashes = known.index.to_numpy(dtype=np.int64).view(np.uint64)
    place = np.empty(len(hashes), dtype=np.int64)
    place[np.lexsort((hashes, known.to_numpy()))] = np.arange(1, len(hashes) + 1)
    at = np.argsort(hashes)
    return hashes[at], place[at]


def _ordered(h: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The sorted hashes in the order of all shingles: unusual ones by hash, then the usual ones."""
    if not len(known):
        return h
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return h[np.argsort(np.where(known[i] == h, place[i], 0), kind="stable")]


def _number(least: float) -> Callable[[int], int]:
    """How many of n shingles are in a prefix."""
    return lambda n: n - math.ceil(least * n - 1e-9) + 1


def _features(texts: DataFrame, words: int, least: float, known: pd.Series) -> DataFrame:
    """(id, digest, fp, n, m0 .., keys): what each text is known by.

    digest tells texts apart that differ in more than case and white space; fp is the SimHash fingerprint and m0 .. the parity
    map of the n distinct shingles; keys are the first n - ceil(least n) + 1 of them in one order for all texts.  Two sets
    with a Jaccard similarity of `least` or more share at least ceil(least n) of either, so they share one of these keys,
    whatever the order.  Usual shingles come last in it.
    """
    usual, number = _in_order(known), _number(least)
    maps = [f"m{i}" for i in range(MAP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, sizes, odd, keys = [], [], [], [], []
            for t in batch.column("__t"):
                tokens = _tokens(t.as_py())
                digests.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                h = _shingle_hashes(tokens, words)
                prints.append(_fingerprint(h))
                odd.append(_parity(h))
                h = _ordered(h, *usual)
                sizes.append(len(h))
                keys.append(h[: number(len(h))].view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            table = np.array(odd, dtype=np.int64).reshape(-1, MAP)
            columns = [batch.column("__id"), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(table[:, i]) for i in range(MAP)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "fp", "n", *maps, "keys"])

    return texts.mapInArrow(run, f"id long, digest binary, fp long, n int, {', '.join(m + ' long' for m in maps)}, keys array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets of word shingles have a Jaccard similarity of `least` or more."""

    def shingles(text: str | None) -> set[int]:
        t = _tokens(text)
        return {hash(s) for s in zip(*(t[i:] for i in range(words)))} if len(t) > words else {hash(tuple(t))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column("__tb"), batch.column("__ta"))):
                if b[i] != last:
                    last, own = b[i], shingles(x.as_py())
                other = shingles(y.as_py())
                both = len(own & other)
                if both >= least * (len(own) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    left, right = (texts.select(F.col("__id").alias(k), F.col("__t").alias("__t" + k)) for k in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 2, sample: int = 8_000, usual: int = 100_000, crowd: int = 8, crowded: int = 1_000_000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(id_col long) of the documents that go: all but the smallest id of each group of near copies.

    Two texts are near copies if their sets of `words`-word shingles have a Jaccard similarity of `least` or more; a group is
    a connected component of that relation.  The result is the same whatever the order of the work below, the size of a
    group or the bounds: every link comes from comparing two whole texts, and no pair of near copies stays unlinked.

    1. Equal texts (but for case and white space) are one node, the smallest id.
    2. SimHash: fingerprints of the shingles within `radius` bits are linked by the generalised pigeonhole (`links`).  The
       smallest id of each class found is compared with the others, so a class costs its size and no pairs.
    3. Near copies at 0.8 may differ in more bits than any search by bits can bear.  So texts that share a shingle of
       their prefixes (see `_features`), which every pair of near copies does, meet as well: under each shared shingle the
       text with the fewest rare shingles is the pivot, and each text is compared with the pivot it meets most often.
    4. What is left are pairs of different groups.  Under each shared shingle the texts outside its largest group meet
       the others; those whose sizes, places of the shingle or parity maps rule the similarity out go unread, and of any
       two groups the likeliest pair is compared first, then 4, 16, 64 ... more until the groups are one or all are.
    Null and blank texts are equal texts.  Rows without an id are left alone; rows that share an id must share their
    text, and go or stay together; no rows give no rows.
    """
    made = Tables(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t"))
    few = lambda df: F.broadcast(df) if df.count() <= broadcast_ids else df
    bound, maps = F.lit(least / (1 + least)), [f"m{i}" for i in range(MAP)]

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are near copies; only texts of pairs are shuffled, each time read from `docs`."""
        ends = made.put(pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct())
        own = texts.join(few(ends), "__id", "left_semi")
        out = made.put(_similar(pairs, own.dropDuplicates(["__id"]) if repeated else own, words, least))
        made.drop(ends)
        return out

    def possible(n: Column, p: Column, m: Column, q: Column) -> Column:
        """Whether texts of n and m shingles, with the shared one at places p and q, can be similar: the rest must do."""
        return (F.least(n, m) >= F.lit(least - 1e-9) * F.greatest(n, m)) & (F.least(n - p, m - q) >= bound * (n + m) - F.lit(1e-6))

    order = _crowded(texts, words, least, _usual(texts, words, sample, usual), crowd, crowded)
    hashed = made.put(_features(texts, words, least, order))
    nodes = made.put(hashed.groupBy("digest").agg(F.min("id").alias("id")).select("id").distinct())
    copies = made.put(hashed.select("id").distinct().join(few(nodes), "id", "left_anti"))
    repeated = hashed.count() > hashed.select("id").distinct().count()
    unique = hashed.join(few(copies), "id", "left_anti")
    unique = made.put(unique.dropDuplicates(["id"])) if repeated else unique

    # SimHash
    prints = made.put(unique.select("id", "fp"))
    near = components(links(prints.select("fp").distinct(), radius=radius)).select(F.col("node").alias("fp"), "component")
    classed = made.put(prints.join(near, "fp", "left").select("id", F.coalesce("component", "fp").alias("c")))
    first = classed.groupBy("c").agg(F.min("id").alias("b"), F.count("*").alias("k")).where("k > 1").select("c", "b")
    stars = made.put(classed.join(first, "c").where("id <> b").select(F.col("id").alias("a"), "b"))
    found = verified(stars)

    # pivots under the shared shingles
    keys = unique.select("id", "n", F.size("keys").alias("size"), F.posexplode("keys").alias("p", "key"))
    shared = made.put(keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    listed = made.put(keys.join(shared, "key"))
    rare = listed.groupBy("id").agg((F.first("size") - F.count("*")).alias("rare"))
    first = listed.join(rare, "id").groupBy("key").agg(F.min(F.struct("rare", "id", "n", "p")).alias("b"))
    met = listed.join(first, "key").where((F.col("id") != F.col("b.id")) & possible(F.col("n"), F.col("p"), F.col("b.n"), F.col("b.p")))
    met = met.groupBy(F.col("id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("k"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("b"))
    pivots = made.put(best.join(stars, ["a", "b"], "left_anti"))
    found = made.put(found.union(verified(pivots)))

    # pairs of different groups
    groups = made.put(components(found).select(F.col("node").alias("id"), F.col("component").alias("g")))
    member = made.put(listed.join(groups, "id", "left").select("key", "id", "n", "p", F.coalesce("g", "id").alias("g")))
    made.drop(listed)
    size = member.groupBy("key", "g").agg(F.count("*").alias("k"))
    main = made.put(size.groupBy("key").agg(F.max_by("g", F.struct("k", "g")).alias("main"), F.count("*").alias("groups")).where("groups > 1").select("key", "main"))
    member = made.put(member.join(main, "key"))
    outside = member.where("g <> main").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("g").alias("ga"))
    inside = member.select(F.col("key").alias("same"), "main", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("g").alias("gb"))
    each = (F.col("ga") != F.col("gb")) & ((F.col("gb") == F.col("main")) | (F.col("a") > F.col("b")))
    pairs = outside.join(inside, (F.col("key") == F.col("same")) & each & possible(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")))
    pairs = pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.first(F.when(F.col("a") > F.col("b"), F.col("ga")).otherwise(F.col("gb"))).alias("ga"), F.first(F.when(F.col("a") > F.col("b"), F.col("gb")).otherwise(F.col("ga"))).alias("gb"), F.first(F.col("na") + F.col("nb")).alias("n"))
    tested = made.put(stars.union(pivots).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    pairs = made.put(pairs.join(tested, ["a", "b"], "left_anti"))
    known = unique.select("id", *maps)
    for end in "ab":
        pairs = pairs.join(known.select(F.col("id").alias(end), *[F.col(m).alias(m + end) for m in maps]), end)
    odd = sum((F.bit_count(F.col(m + "a").bitwiseXOR(F.col(m + "b"))) for m in maps), F.lit(0))
    # sets of n shingles in all with that similarity differ in at most n (1 - least) / (1 + least), and so do their maps
    todo = made.put(pairs.select("a", "b", F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), odd.alias("odd"), "n").where(F.col("odd") <= F.lit((1 - least) / (1 + least)) * F.col("n") + F.lit(1e-6)).drop("n"))
    more = 1
    while not todo.isEmpty():
        order = F.row_number().over(Window.partitionBy("ga", "gb").orderBy("odd", "a", "b"))
        chosen = made.put(todo.withColumn("r", order).where(F.col("r") <= more).select("a", "b"))
        links_now = verified(chosen)
        found = made.put(found.union(links_now))
        joined = todo.join(links_now, ["a", "b"], "left_semi").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        merged = made.put(components(joined).where("node <> component"))
        rest = todo.join(chosen, ["a", "b"], "left_anti")
        for end in ("ga", "gb"):
            rest = rest.join(merged.select(F.col("node").alias(end), F.col("component").alias("now")), end, "left").withColumn(end, F.coalesce("now", end)).drop("now")
        todo, more = made.put(rest.where("ga <> gb").select("a", "b", F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), "odd")), 4 * more
    last = components(found).where("node <> component").select(F.col("node").alias("id"))
    gone = made.put(copies.unionByName(last).select(F.col("id").alias(id_col)))
    made.drop_all(gone)
    return gone


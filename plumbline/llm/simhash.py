"""SimHash fingerprints and their links by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tables, components

BITS = 64
#: Words hashed at a time, which bounds a worker's memory for texts of any length.
STRIDE = 1 << 16


def _tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _fingerprint(text: str | None, words: int) -> int:
    tokens = _tokens(text)
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STRIDE):
        part = tokens[at : min(at + STRIDE, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if n > 1 or len(tokens) == words else [b" ".join(tokens)]
        hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp long): bit i is set if it is set in over half of the XXH64 hashes (seed 42) of the shingles.

    Shingles of `words` words count with repeats.  A text of fewer words is one shingle; null, empty and blank texts have
    fingerprint zero.  Repeated rows stay.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([_fingerprint(t.as_py(), words) for t in batch.column("t")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(fps, pa.int64())], names=["k", "fp"])

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", id_col)


def bit_groups(fps: DataFrame, parts: int) -> list[list[int]]:
    """Split the 64 bit positions into `parts` groups of nearly equal size, correlated bits together.

    Correlations come from all fingerprints: each task adds up one 64 x 64 matrix, and 64 rows reach the driver.
    Correlated bits carry less information side by side than apart, so the other groups become more selective.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS + 1))
        for batch in batches:
            x = np.unpackbits(batch["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total[:, :BITS] += x.T @ x
            total[:, BITS] += len(x)
        yield pd.DataFrame({"bit": range(BITS), "v": list(total)})

    rows = fps.select("fp").mapInPandas(moments, "bit int, v array<double>").select("bit", F.posexplode("v").alias("j", "x")).groupBy("bit", "j").agg(F.sum("x").alias("x")).collect()
    m = np.zeros((BITS, BITS + 1))
    for r in rows:
        m[r["bit"], r["j"]] = r["x"]
    n = max(1.0, m[0, BITS])
    p = np.diag(m[:, :BITS]) / n
    cov = m[:, :BITS] / n - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(best := max(sorted(free), key=lambda b: corr[b, group].sum()))
            free.discard(best)
        groups.append(sorted(group))
    return groups


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed together."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out.view(np.int64)


def _flips(width: int, radius: int) -> np.ndarray:
    """Masks of at most `radius` bits out of `width`, none first."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << i) for m in masks for i in range(width)}
    return np.array(sorted(masks, key=lambda m: (m.bit_count(), m)), dtype=np.uint64).view(np.int64)


def allocate(exact: np.ndarray, widths: list[int], density: list[float], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of each partition for each fingerprint, and the estimated cost.

    exact[:, i]: fingerprints that share partition i's value; density[i]: expected number with another given value.
    The cost of threshold t >= 0 in a partition is its probes plus the estimated candidates they meet; threshold -1
    (no probe) is free.  Thresholds must add up to radius - parts + 1, which by the generalised pigeonhole principle
    meets every fingerprint within `radius`.  Dynamic programming over partitions and sums finds the least total.
    """
    n, parts = exact.shape
    low, high = -parts, radius
    best = np.full((n, high - low + 1), np.inf)
    best[:, -low] = 0.0
    choice = np.zeros((parts, n, high - low + 1), dtype=np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for t in range(-1, radius + 1):
            if t > widths[i]:
                break
            probes = len(_flips(widths[i], t)) if t >= 0 else 0
            cost = np.zeros(n) if t < 0 else probes + exact[:, i] + (probes - 1) * density[i]
            shifted = np.full_like(best, np.inf)
            if t < 0:
                shifted[:, :-1] = best[:, 1:]
            else:
                shifted[:, t:] = best[:, : best.shape[1] - t]
            total = shifted + cost[:, None]
            better = total < new
            new[better] = total[better]
            choice[i][better] = t
        best = new
    at = np.full(n, radius - parts + 1 - low)
    cost, taken = best[np.arange(n), at], np.zeros((n, parts), dtype=np.int8)
    for i in reversed(range(parts)):
        taken[:, i] = choice[i][np.arange(n), at]
        at = at - taken[:, i]
    return taken, cost


def best_parts(n: int, radius: int = 2) -> int:
    """How many bit groups cost least for n distinct fingerprints whose values were spread evenly.

    Few groups are wide, so that a value is shared by few, but need more probes; many groups need few probes, each of
    which meets more.  The costs are those of `allocate`, with the same thresholds for all.
    """

    def cost(parts: int) -> float:
        width = BITS // parts
        _, c = allocate(np.full((1, parts), n / 2.0**width), [width] * parts, [n / 2.0**width] * parts, radius)
        return float(c[0])

    return min(range(2, radius + 2), key=cost)


def links(fps: DataFrame, *, radius: int = 2, parts: int | None = None, limit: int = 2 * (BITS + 1)) -> DataFrame:
    """Links (a, b), a < b, whose closure joins all distinct fingerprints that differ in at most `radius` bits.

    fps: one row for each distinct fingerprint (fp long).  Every fingerprint is indexed by the value of each bit group;
    it probes the groups within the thresholds that `allocate` gives it, and every fingerprint met is verified.  The
    number of groups follows the number of fingerprints (`best_parts`) if it is not given.

    A fingerprint whose probes would meet over `limit` others (near copies by the thousand share most bits in every
    group) takes the allocation with one partition of all 64 bits instead: it is listed under every value within
    radius / 2 bits of its own.  Two listed under one value differ in at most `radius` bits, and any two that do
    share such a value, so one star for each value gives their links and no pairs within a group are written.  Those that
    probe also meet those that are listed, so no link is lost.  A value is listed by at most as many as it has
    neighbours within radius / 2 bits: 65 at radius 2, whatever the data hold.  `radius` must be even.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    parts, made = parts or best_parts(fps.count(), radius), Tables(fps.sparkSession)
    groups = bit_groups(fps, parts)
    widths = [len(g) for g in groups]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for i, g in enumerate(groups):
                yield pd.DataFrame({"fp": batch["fp"], "part": np.int32(i), "value": _gather(fp, g)})

    indexed = made.put(fps.mapInPandas(index, "fp long, part int, value long"))
    sizes = made.put(indexed.groupBy("part", "value").agg(F.count("*").alias("n")))
    square = F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")
    shared = {r["part"]: r["x"] for r in sizes.groupBy("part").agg(square.alias("x")).collect()}  # one row a part
    density = [shared.get(i, 0.0) for i in range(parts)]
    counted = indexed.join(sizes, ["part", "value"]).groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = {(i, t): _flips(widths[i], t) for i in range(parts) for t in range(radius + 1)}
        for batch in batches:
            own = batch["fp"].to_numpy()
            fp = own.view(np.uint64)
            taken, cost = allocate(batch[[f"n{i}" for i in range(parts)]].to_numpy(dtype=float), widths, density, radius)
            listed = cost > limit
            yield pd.DataFrame({"fp": own[listed], "part": np.int32(-1), "value": np.int64(0)})
            for (i, t), m in masks.items():
                rows = np.flatnonzero((taken[:, i] == t) & ~listed)
                if len(rows):
                    values = _gather(fp[rows], groups[i])[:, None] ^ m[None, :]
                    yield pd.DataFrame({"fp": np.repeat(own[rows], len(m)), "part": np.int32(i), "value": values.ravel()})

    probes = made.put(counted.mapInPandas(probe, "fp long, part int, value long"))
    # what the probes really meet, for estimates may be wrong where a neighbouring value is crowded
    met = probes.where("part >= 0").join(sizes, ["part", "value"])
    crowded = met.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * limit).select("fp")
    listed = made.put(crowded.union(probes.where("part = -1").select("fp")).distinct())
    light = made.put(met.join(listed, "fp", "left_anti").select("part", "value", F.col("fp").alias("q")))
    asked = light.select("part", "value").distinct()
    found = (
        light.join(indexed.join(asked, ["part", "value"], "left_semi"), ["part", "value"])
        .where((F.col("q") != F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius))
        .select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b"))
    )

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = _flips(BITS, radius // 2)
        for batch in batches:
            fp = batch["fp"].to_numpy()
            yield pd.DataFrame({"fp": np.repeat(fp, len(near)), "value": (fp[:, None] ^ near[None, :]).ravel()})

    stars = listed.mapInPandas(around, "fp long, value long").groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    out = made.put(found.union(stars).distinct())
    made.drop_all(out)
    return out


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, parts: int | None = None) -> DataFrame:
    """(id_col long, fp long, component_id long): documents linked through fingerprints at most `radius` bits apart.

    component_id is the smallest id reachable, the document's own included.  Equal fingerprints are one node, so copies
    are never paired.  Blank documents share fingerprint zero and are linked like any other; rows without an id are linked
    too, but give no component its name; repeated rows stay; an empty table gives no rows.
    """
    made = Tables(docs.sparkSession)
    fps = made.put(simhash(docs, id_col=id_col, text_col=text_col, words=words))
    nodes = made.put(fps.groupBy("fp").agg(F.min(id_col).alias("first")))
    joined = components(links(nodes.select("fp"), radius=radius, parts=parts))
    least = nodes.join(joined, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    whole = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(whole, "fp").select(id_col, "fp", "component_id")

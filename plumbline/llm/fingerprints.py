"""Document fingerprints by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import fresh, partitions

#: Slots of a signature are computed in rows of WIDTH, which keeps generated code small enough to be compiled well.
SLOTS, WIDTH = 64, 16
#: Hex digits that a slot's sample takes in a fingerprint.
DIGITS = 6
#: A sample is missed once in e^SURE; a text's slot without any is zero, so equal texts still agree.
SURE = 30.0


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def terms(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with `out`, array<struct<h long, lw double, share double>>: each distinct word's hash, the
    log of its count, and SURE times its share of all words.

    Words are what white space parts, lower-cased; counts come from runs in the sorted hashes.  Null and blank texts
    have none.
    """
    s, at = fresh(df, "__hashes", "__starts")
    df = df.withColumn(s, F.sort_array(F.transform(_words(F.coalesce(text_col, F.lit(""))), lambda w: F.xxhash64(w))))
    n = F.size(s)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(at, F.filter(index, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))))
    count = lambda i, j: (F.coalesce(F.get(at, j + 1), n) - i).cast("double")
    weigh = F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("h"), F.log(count(i, j)).alias("lw"), (SURE * count(i, j) / n).alias("share")))
    return df.withColumn(out, weigh).drop(s, at)


def _seed(i: int) -> int:
    """The i-th of a fixed row of random longs."""
    return xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) - (1 << 63)


def _sample(h: Column, slot: int, log_weight: Column, share: Column) -> Column:
    """One slot's sample of a weighted term: its rank above 24 bits that identify it; the least rank wins.

    With r and c from Gamma(2, 1) and b uniform, all fixed by term and slot: t = floor(ln(w) / r + b), and
    ln(a) = ln(c) - r (t - b + 1).  Two weights of a term share (term, t) consistently, and the term with the least a is the
    same in two documents with their generalised Jaccard similarity as probability.

    The least a of a text is exponential with the total weight W as rate, so it exceeds SURE / W once in e^SURE slots.
    Terms that are sure to have a larger a need no logarithms: a w = c q^x for q = exp(-r) and some x in 0 to 1, with
    x = 1 - b if w is 1; and c = -ln(p) >= 1 - p, q^x >= q / (x + (1 - x) q), the latter least for x = 1.
    """
    u, v = F.xxhash64(h.bitwiseXOR(F.lit(_seed(2 * slot)))), F.xxhash64(h.bitwiseXOR(F.lit(_seed(2 * slot + 1))))

    def uniform(x: Column, low: int, bits: int) -> Column:
        return (F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * 2.0**-bits

    q, p, b = uniform(u, 0, 21) * uniform(u, 21, 21), uniform(v, 0, 32) * uniform(v, 32, 32), uniform(u, 42, 22)
    r = -F.log(q)
    t = F.floor(log_weight / r + b)
    rank = F.log(-F.log(p)) - r * (t.cast("double") - b + 1.0)  # within -70 and 5
    name = u.bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFF))
    less = F.when(log_weight == 0.0, b).otherwise(0.0)  # 1 - x
    return F.when((1.0 - p) * q <= share * (1.0 - less + less * q), F.shiftleft(((rank + 100.0) * float(1 << 31)).cast("long"), 24).bitwiseOR(name))


def signatures(df: DataFrame, keys: list[str], terms_col: str, out: str) -> DataFrame:
    """keys and `out`: SLOTS samples as hex text, DIGITS digits each; without terms all zeros.

    Rows with equal keys are one set of terms, so keys should name a row.  A row's terms are sampled and reduced within
    its task; a frame that is partitioned by some of the keys is not shuffled at all.
    """
    groups, slots = SLOTS // WIDTH, [f"__m{j}" for j in range(WIDTH)]
    rows = df.select(*keys, F.explode_outer(terms_col).alias("__t")).select(*keys, F.col("__t.h").alias("__h"), F.col("__t.lw").alias("__lw"), F.col("__t.share").alias("__share"))
    salts = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(_seed(1000 + g)).alias("x")) for g in range(groups)])
    rows = rows.select(*keys, "__h", "__lw", "__share", F.explode(salts).alias("__s"))
    rows = rows.select(*keys, "__lw", "__share", F.col("__s.g").alias("__g"), F.col("__h").bitwiseXOR(F.col("__s.x")).alias("__h"))
    least = rows.groupBy(*keys, "__g").agg(*[F.min(_sample(F.col("__h"), j, F.col("__lw"), F.col("__share"))).alias(m) for j, m in enumerate(slots)])
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.coalesce(F.col(m).bitwiseAND(F.lit(0xFFFFFF)), F.lit(0)))), DIGITS, "0") for m in slots])
    parts = F.array_sort(F.collect_list(F.struct("__g", digits.alias("s"))))
    return least.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots of two fingerprints: an estimate of the texts' generalised Jaccard similarity."""
    at = F.sequence(F.lit(1), F.lit(SLOTS * DIGITS), F.lit(DIGITS))
    return F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(DIGITS)) == F.substr(b, i, F.lit(DIGITS)))).cast("double") / SLOTS


def _below(cuts: list, x: Column) -> Column:
    """How many of the sorted cuts are below x: a search through blocks of them, then through one block."""
    if not cuts:
        return F.lit(0)
    size = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    before = F.size(F.filter(F.array(*[F.lit(b[-1]) for b in blocks]), lambda c: c < x))  # blocks wholly below
    block = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), F.least(before, F.lit(len(blocks) - 1)))
    return F.least(before, F.lit(len(blocks) - 1)) * size + F.size(F.filter(block, lambda c: c < x))


def with_next(df: DataFrame, id_col: str, *, spread: int = 4) -> tuple[DataFrame, str, str, Window]:
    """df dealt into runs of ids, for windows that reach each row's successor in descending order of the id.

    Returns the frame with columns for the run and for whether a row is a copy, and the window.  Runs are cut at quantiles of
    all ids, `spread` for each shuffle partition; the first row of each run is also copied, as the last row, into the
    run that precedes it, and the very first into the last run.  So `lead` needs no single ordered partition.
    """
    run, copy = fresh(df, "__run", "__copy")
    n = partitions(df.sparkSession) * spread
    cuts = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    df = df.withColumn(run, _below(cuts, F.coalesce(F.col(id_col), F.lit(min(cuts, default=0)))))
    # one row a run: its last id, and the run where that row is copied to
    (top, target) = fresh(df, "__top", "__target")
    order = Window.orderBy(run)
    tops = df.groupBy(run).agg(F.max(id_col).alias(top)).select(top, F.coalesce(F.lead(run).over(order), F.first(run).over(order)).alias(target))
    df = df.join(F.broadcast(tops), F.col(id_col).eqNullSafe(F.col(top)), "left")  # n rows at most
    own = F.struct(F.col(run).alias("r"), F.lit(0).alias("c"))
    places = F.when(F.col(target).isNotNull(), F.array(own, F.struct(F.col(target).alias("r"), F.lit(1).alias("c")))).otherwise(F.array(own))
    columns = [c for c in df.columns if c not in (run, top, target)]
    df = df.select(*columns, F.explode(places).alias("__place")).select("*", F.col("__place.r").alias(run), F.col("__place.c").alias(copy)).drop("__place")
    return df, run, copy, Window.partitionBy(run).orderBy(copy, F.desc(id_col))


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited one: id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    Edited: the last floor(n_chars / 2) code points give way to as many first ones, or all, of the next document in
    descending order of the id (after the last: the first).  A null text counts as empty; texts without words have the
    fingerprint of zeros and are like each other; the text of a repeated id follows its like in an order by hash; a single
    document is its own successor; rows without an id come after all others; no rows give no rows.  One shuffle moves the texts; all else happens in its partitions.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, run, copy, _ = with_next(base, "id")
    order = Window.partitionBy(run).orderBy(copy, F.desc("id"), F.xxhash64("text"))
    rows = dealt.withColumn("rn", F.row_number().over(order)).withColumn("after", F.coalesce(F.lead("text").over(order), F.lit("")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.char_length("text") - half), F.substr("after", F.lit(1), half)))
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    keys = [run, "rn", copy, "id", "n_chars", "sha"]
    texts = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("x")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("x")))).alias("v"))
    texts = terms(texts.select(*keys, F.col("v.which").alias("which"), F.col("v.x").alias("x")), "x", "terms").drop("x")
    signed = signatures(texts, [*keys, "which"], "terms", "fp")
    both = signed.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    both = both.withColumn("nfp", F.lead("fp").over(Window.partitionBy(run).orderBy("rn"))).where(F.col(copy) == 0)
    return both.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )

"""What filters remove, alone and after one another: survivors of every subset of filters by a subset-zeta transform."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Tables, fresh

#: Words in the sense of the five rules below.
WORD_GAP = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
#: A part's mask counts are a row of 2^n numbers and its orders n! rows of n steps.
MOST = 7


def rules(text: Column) -> dict[str, Column]:
    """The failure conditions that a text tells by itself; a null text counts as empty.

    A: under 50 words; B: distinct words below 65 in 100; C: capitals A-Z above 5 in 100 code points; D: one of #$%&*|.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * n, "C": 100 * capitals > 5 * F.char_length(text), "D": text.rlike(MARKS)}


def bits(conditions: dict[str, Column]) -> Column:
    """The conditions that hold as one number: the i-th is bit i; null counts as not failing."""
    out = F.lit(0)
    for i, c in enumerate(conditions.values()):
        out = out + F.when(c, F.lit(1 << i)).otherwise(F.lit(0))
    return out


def with_copies(rows: DataFrame, *, id_col: str, same_col: str, mask_col: str, bit: int) -> DataFrame:
    """rows with `bit` set in mask_col where a row with a smaller id has the same `same_col`.

    The least id of each `same_col` is a minimum that is combined before its shuffle; only those met under two ids are joined
    back, and AQE splits a value that very many rows have.  A null id is neither smaller nor larger than another, and
    equal ids are not smaller than each other; null values of same_col are never the same.
    """
    least, most, same = fresh(rows, "__least", "__most", "__same")
    met = rows.groupBy(F.col(same_col).alias(same)).agg(F.min(id_col).alias(least), F.max(id_col).alias(most)).where(F.col(least) < F.col(most))
    mark = F.when(F.col(id_col) > F.col(least), F.col(mask_col).bitwiseOR(F.lit(1 << bit))).otherwise(F.col(mask_col))
    joined = rows.join(met.select(same, least), F.col(same_col) == F.col(same), "left")
    return joined.select(*[mark.alias(c) if c == mask_col else F.col(c) for c in rows.columns])


def subset_sums(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """df with arrays of 2^n counts by mask turned into sums over all subsets of each mask: the zeta transform.

    One pass for each bit adds to a mask with the bit what the mask without it has; a pass is a projection of its own, so
    that its input is not worked out over and over.
    """

    def passed(counts: str, bit: int) -> Column:
        return F.transform(counts, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) != 0, x + F.get(counts, i.bitwiseXOR(F.lit(bit)))).otherwise(x))

    for b in range(n):
        df = df.withColumns({c: passed(c, 1 << b) for c in columns})
    return df


def orders(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, filter number, mask of the filters before it) of every order of the filters."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, f, before))
            before |= 1 << f
    return out


def interactions(counts: DataFrame, names: str, *, part_col: str, mask_col: str = "mask", n_col: str = "n", labels: dict[str, str] | None = None) -> DataFrame:
    """One row for each part, order of the filters and step, from counts by part and mask of failing filters.

    counts: any number of rows (part_col, mask_col, n_col, a 0/1 column for each value of `labels`): bit i of a mask says
    that names[i] fails.  labels maps an output column to the column that marks what it counts.  Masks outside 0 to 2^n - 1
    are an error; null counts, marks and masks count as 0; a null part is a part; no rows give no rows.

    Returns (part_col, filter_order, step, kept, removed, redundant, unique_fails, a count lost for each label, shapley).
    A part's counts by mask are one array; its subset sums are the documents that fail within a set of filters, so the
    survivors of a set are the sum at its complement, and all else is a difference of survivors.
    """
    n, labels = len(names), labels or {}
    if not 0 < n <= MOST or len(set(names)) < n:
        raise ValueError(f"1 to {MOST} filters with one letter each")
    full, kinds = (1 << n) - 1, ["all", *labels]
    mask = F.coalesce(F.col(mask_col), F.lit(0))
    mask = F.when(mask.between(0, full), mask).otherwise(F.raise_error(F.lit("a mask names no such filter")).cast("int"))
    weigh = {"all": F.lit(1)} | {k: F.coalesce(F.col(c).cast("int"), F.lit(0)) for k, c in labels.items()}
    rows = counts.select(F.col(part_col).alias("p"), mask.alias("m"), *[(F.coalesce(F.col(n_col), F.lit(0)) * w).cast("long").alias(f"w_{k}") for k, w in weigh.items()])
    by_mask = [F.array(*[F.coalesce(F.sum(F.when(F.col("m") == s, F.col(f"w_{k}"))), F.lit(0)) for s in range(full + 1)]).alias(f"f_{k}") for k in kinds]
    out = subset_sums(rows.groupBy("p").agg(*by_mask), [f"f_{k}" for k in kinds], n)
    kept = lambda k, s: F.get(F.col(f"f_{k}"), F.lit(full).bitwiseXOR(s))

    def total(f: int) -> Column:
        # a set comes before a filter in |S|! (n - 1 - |S|)! orders
        terms = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (kept("all", F.lit(s)) - kept("all", F.lit(s | 1 << f))) for s in range(full + 1) if not s >> f & 1]
        return sum(terms[1:], terms[0])

    steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(b).alias("before")) for o, s, f, b in orders(names)])
    out = out.withColumn("t", F.array(*map(total, range(n)))).withColumn("x", F.explode(steps))
    before, one = F.col("x.before"), F.col("x.bit")
    after = before.bitwiseOR(one)
    removed = kept("all", before) - kept("all", after)
    return out.select(
        F.col("p").alias(part_col),
        F.col("x.o").alias("filter_order"),
        F.col("x.s").cast("int").alias("step"),
        kept("all", after).alias("kept"),
        removed.alias("removed"),
        (kept("all", F.lit(0)) - kept("all", one) - removed).alias("redundant"),
        (kept("all", F.lit(full).bitwiseXOR(one)) - kept("all", F.lit(full))).alias("unique_fails"),
        *[(kept(k, before) - kept(k, after)).alias(k) for k in labels],
        F.get("t", F.col("x.f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five rules' interactions by part: rules A to D on each whole text, and E, a text that a smaller id has too.

    Returns (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley); good_lost counts
    documents with quality 1 in labels (doc_id, quality, toxic), toxic_lost those with toxic 1.  A null text counts as empty, a
    null part as the empty string; several labels of one id count once, by the largest; labels without an id are of no document;
    rows that share an id count each.  Texts are read once: what goes on is an id, a digest, a mask and the part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("same"), bits(rules(text)).alias("mask"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = with_copies(Tables(docs.sparkSession).put(rows), id_col="id", same_col="same", mask_col="mask", bit=4).drop("same")
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]).where("quality = 1 or toxic = 1")
    rows = rows.join(marks, F.col("id") == F.col("label_id"), "left")
    counts = rows.groupBy("part", "mask", "quality", "toxic").agg(F.count("*").alias("n"))
    return interactions(counts, "ABCDE", part_col="part", labels={"good_lost": "quality", "toxic_lost": "toxic"})

"""Keys, references and sets of two relations."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .closure import Tables, cut


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, and how many; null keys are equal to each other."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def blank_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNull() | (F.trim(key) == ""))


def missing_references(child: DataFrame, parent: DataFrame, on: str | list[str]) -> DataFrame:
    """Child rows without a parent: an anti-join; null references count as missing."""
    return child.join(parent.select(on).distinct(), on, "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only, "left" or "right"; one shuffle of distinct keys from either side."""
    a = left.select(key).distinct().withColumn("__l", F.lit(True))
    b = right.select(key).distinct().withColumn("__r", F.lit(True))
    both = a.join(b, key, "full_outer").where(F.col("__l").isNull() | F.col("__r").isNull())
    return both.select(key, F.when(F.col("__l"), "left").otherwise("right").alias("side"))


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """columns and `surplus` (left minus right, never 0): both sides are counted before the shuffle."""
    a = left.select(*columns, F.lit(1).cast("long").alias("__n"))
    b = right.select(*columns, F.lit(-1).cast("long").alias("__n"))
    return a.unionByName(b).groupBy(*columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def exactly_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left keys with the number of right rows that match, where it is not one."""
    counts = right.groupBy(on).agg(F.count("*").alias("n"))
    return left.select(on).distinct().join(counts, on, "left").select(on, F.coalesce("n", F.lit(0).cast("long")).alias("n")).where("n <> 1")


def last_wins(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row a key: the values of the row that comes last."""
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place where each is first seen."""
    return df.groupBy(key).agg(F.min(order).alias("first_at"))


def next_numbers(taken: DataFrame, new: DataFrame, *, number: str, order: list[str], least: int = 1) -> DataFrame:
    """New rows numbered on from the highest number taken, in order.

    Rows are numbered within a few hundred ranges of the order columns and the ranges' sizes are added up, so no single
    task sorts them all.
    """
    top = F.coalesce(F.max(F.regexp_extract(F.col(number).cast("string"), r"(\d+)$", 1).try_cast("long")), F.lit(least - 1))
    start = max(taken.agg(top).first()[0], least - 1)
    return numbered(new, order).withColumn("number", F.col("row_no") + F.lit(start)).drop("row_no")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with row_no from 1 over the whole order, without a window over all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges' bounds come from a sample, so ranges are dealt once: those that are counted are those that are numbered
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    within = Window.partitionBy("__p").orderBy(*order)
    local = ranged.withColumn("__i", F.row_number().over(within))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))  # one row a range
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return local.join(F.broadcast(before), "__p").withColumn("row_no", F.col("__i") + F.col("__before")).drop("__p", "__i", "__before")


def unique_names(df: DataFrame, name: str, order: list[str], separator: str = "-") -> DataFrame:
    """df with unique_name: in order, a name that is free is kept, and one that is not gets the least free number from 2 on."""
    none = df.sparkSession.createDataFrame([], f"`{name}` string")
    return free_names(df, none, name, order, separator=separator)


def free_names(new: DataFrame, taken: DataFrame, name: str, order: list[str], *, folder: list[str] | None = None, separator: str = "-", suffixes: bool = False) -> DataFrame:
    """new with unique_name: each name in turn as it is if that is free in its folder, else with the least free number from 2 on.

    taken: names (folder, name) that are there before; a name given becomes taken.  With `suffixes` the number goes before a
    file name's suffixes ("a.b.xml" becomes "a-2.b.xml").  Equal rows of `order` go in any order; null names stay null and take
    nothing; folders are columns of both sides, and null is a folder.

    The result is that of going through the rows one after another, but no folder or name is gone through in one task.  Only
    rows that repeat a name, or find it taken, want a number; the j-th of them gets the j-th number that is not blocked, by
    the gaps between blocked ones.  A number is blocked if it was taken before, or if a row asked for just that name ("a-3") before
    the wanting rows had come so far; how far they have come is told by ranks in the order, which come from ranges of rows and not from
    a pass over a name.  One scan over the numbers asked for, of each name for itself, settles that.  Names that end in one
    number more are settled in the next round, since only names with one less can take from them.
    """
    spark, folder = new.sparkSession, folder or []
    tables = Tables(spark)
    split = (lambda c: F.when(c.endswith("."), F.struct(c.alias("stem"), F.lit("").alias("end"))).otherwise(F.struct(F.regexp_extract(c, r"^(\.*[^.]*)", 1).alias("stem"), F.regexp_replace(c, r"^\.*[^.]*", "").alias("end")))) if suffixes else (lambda c: F.struct(c.alias("stem"), F.lit("").alias("end")))
    number = rf"^(.*){re.escape(separator)}([2-9]|[1-9][0-9]{{1,17}})$"

    def known(df: DataFrame, *more: str) -> DataFrame:
        """place (folder and suffixes), stem, up and k (the name that this is a numbered form of, and its number), level."""
        x = df.select(*more, F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(folder)], split(F.col(name))["end"].alias("end")).alias("place"), split(F.col(name))["stem"].alias("stem"))
        x = x.withColumns({"up": F.regexp_extract("stem", number, 1), "k": F.regexp_extract("stem", number, 2).try_cast("long")})
        tail = F.length("stem") - F.length(F.regexp_replace("stem", rf"(?:{re.escape(separator)}(?:[2-9]|[1-9][0-9]{{1,17}}))+$", ""))
        level = F.when(F.col("k").isNull(), 0).otherwise(F.size(F.split(F.substring("stem", F.length("stem") - tail + 1, tail), re.escape(separator))) - 1)
        return x.withColumn("level", level.cast("int"))

    key = ["place", "stem"]
    ids = tables.put(new.withColumn("__id", F.monotonically_increasing_id()))
    asked = known(ids.where(F.col(name).isNotNull()), "__id", *order)
    rows = tables.put(numbered(asked, [*order, "__id"]).select("__id", F.col("row_no").alias("at"), *key, "up", "k", "level"))
    there = tables.put(known(taken.where(F.col(name).isNotNull())).distinct())
    names = rows.groupBy(*key, "up", "k", "level").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    names = tables.put(names.join(there.select(*key, F.lit(True).alias("old")), key, "left").withColumn("old", F.coalesce("old", F.lit(False))))
    nth = tables.put(_places(rows.select("__id", *key, "at"), key, "at"))
    given = ids.select("__id").limit(0).withColumn("unique_name", F.lit(None).cast("string"))
    kept = tables.put(names.where("level = 0").select(*key, (~F.col("old")).alias("kept")))
    for level in range((names.agg(F.max("level")).first()[0] if not names.isEmpty() else -1) + 1):
        want = names.join(kept, key).select(*key, "kept", "first", (F.col("n") - F.col("kept").cast("int")).alias("wants"))
        want = tables.put(want)
        numbers = there.where(F.col("k").isNotNull()).select("place", F.col("up").alias("stem"), "k")
        # rows that ask for a number by name, and how many of those that want one came before
        direct = names.where((F.col("level") == level + 1) & ~F.col("old")).select("place", F.col("up").alias("stem"), "k", F.col("first").alias("at"))
        both = _places(rows.select(*key, "at").join(direct.select(*key).distinct(), key, "left_semi").unionByName(direct, allowMissingColumns=True), key, "at")
        among = F.row_number().over(Window.partitionBy(*key).orderBy("at")) - 1
        came = both.where("k IS NOT NULL").withColumn("came", F.col("nth") - among).select(*key, "k", "at", "came")
        came = came.join(want, key, "left").select(*key, "k", "at", (F.col("came") - F.when(F.col("kept") & (F.col("first") < F.col("at")), 1).otherwise(0)).alias("came"))
        old = numbers.join(came.select(*key).distinct(), key, "left_semi").select(*key, "k", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("came"))
        won = tables.put(came.unionByName(old).groupBy(*key).applyInPandas(_won, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in came.select(*key, "k").schema)))
        blocked = numbers.unionByName(won).distinct().join(want.where("wants > 0").select(*key), key, "left_semi")
        # between two blocked numbers lie the numbers of rows after + 1 to upto
        w = Window.partitionBy(*key).orderBy("k")
        runs = blocked.withColumn("i", F.row_number().over(w)).withColumn("upto", F.col("k") - 1 - F.col("i"))
        runs = runs.withColumn("after", F.coalesce(F.lag("upto").over(w), F.lit(0).cast("long"))).select(*key, "i", "upto", "after")
        last = runs.groupBy(*key).agg(F.max("upto").alias("after"), F.max("i").alias("i"))
        end = want.where("wants > 0").join(last, key, "left").select(*key, (F.coalesce("i", F.lit(0)) + 1).alias("i"), F.col("wants").alias("upto"), F.coalesce("after", F.lit(0).cast("long")).alias("after"))
        parts = runs.join(want.select(*key, "wants"), key).select(*key, "i", F.least("upto", "wants").alias("upto"), "after").unionByName(end).where("upto > after")
        plan = parts.select(*key, F.explode(F.sequence(F.col("after") + 1, F.col("upto"))).alias("j"), "i").select(*key, "j", (F.col("j") + F.col("i")).alias("number"))
        turn = nth.join(want.select(*key, "kept"), key).select("__id", *key, (F.col("nth") + F.when(F.col("kept"), 0).otherwise(1)).alias("j"))
        full = F.concat("stem", F.when(F.col("number").isNotNull(), F.concat(F.lit(separator), F.col("number").cast("string"))).otherwise(""), "place.end")
        given = given.unionByName(tables.put(turn.join(plan, [*key, "j"], "left").select("__id", full.alias("unique_name"))))
        onward = names.where(F.col("level") == level + 1).join(won.select("place", F.col("stem").alias("up"), "k", F.lit(True).alias("won")), ["place", "up", "k"], "left")
        kept = tables.put(onward.select(*key, (~F.col("old") & F.coalesce("won", F.lit(False))).alias("kept")))
    return ids.join(given, "__id", "left").drop("__id")


def _places(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """rows with nth long: their place among those of their key by `at`, from 0, by ranks over all rows and not in one pass."""
    ranked = numbered(rows, [*key, at])
    low = ranked.groupBy(*key).agg(F.min("row_no").alias("__low"))
    return ranked.join(low, key).withColumn("nth", F.col("row_no") - F.col("__low")).drop("row_no", "__low")


def _won(asked: pd.DataFrame) -> pd.DataFrame:
    """The numbers of one name that rows got who asked for them: those that had not been reached by then.

    asked: k and, for rows that ask, the time and how many rows wanted any number before; null times are numbers taken before.
    Of the free numbers up to k, those that others won by then are not to be had; k is reached if as many rows came as are left.
    """
    old = sorted(asked["k"][asked["at"].isna()])
    times, got = [], []
    for r in asked[asked["at"].notna()].sort_values("k").itertuples():
        free = r.k - 1 - bisect.bisect_right(old, r.k) - bisect.bisect_left(times, r.at)
        if r.came < free:
            bisect.insort(times, r.at)
            got.append(r.Index)
    return asked.loc[got, ["place", "stem", "k"]]


def homogeneity(df: DataFrame, batch: str, *columns: str, key: str | None = None) -> DataFrame:
    """For each batch: rows, how many values each column has, and whether all have one (and the key none twice)."""
    counts = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0null"))).alias(f"n_{c}") for c in columns]
    keys = [F.count_distinct(key).alias("n_keys")] if key else []
    out = df.groupBy(batch).agg(F.count("*").alias("n_rows"), *counts, *keys)
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(f"n_{c}") == 1)
    return out.withColumn("homogeneous", same & (F.col("n_keys") == F.col("n_rows") if key else F.lit(True)))


def required(features: DataFrame, rules: DataFrame, subject: str, feature: str, item: str, *, broadcast_rules: int = 100_000, partitions: int | None = None) -> DataFrame:
    """(subject, item): what each subject's features ask for, by rules (feature, item); once each.

    A rule whose feature is null is for every subject that has a row, a null feature included.  Up to broadcast_rules rules go to
    the subjects, which stay where they are: features are few, and by feature all subjects would meet in a few tasks.  partitions
    as for coverage.
    """
    kind = features.schema[feature].dataType
    own = features.select(subject, F.explode(F.array(F.col(feature), F.lit(None).cast(kind))).alias("__f"))
    if rules.limit(broadcast_rules + 1).count() <= broadcast_rules:
        rules = F.broadcast(rules)
    else:
        own = own.distinct()
    return _dealt(own.join(rules, F.col("__f").eqNullSafe(F.col(feature))).select(subject, item), subject, partitions).distinct()


def _dealt(df: DataFrame, subject: str, partitions: int | None) -> DataFrame:
    return df if partitions is None else df.repartition(partitions, subject)


def coverage(asked: DataFrame, given: DataFrame, subject: str, item: str, *, partitions: int | None = None) -> DataFrame:
    """For each subject that is asked for something: n_asked, n_given (of what is asked), missing, surplus (sorted arrays), complete.

    Which subjects have all that is asked of them is a division; what is asked depends on the subject, and subjects and
    items never meet otherwise than by equality: both sides are one column of marks, grouped by (subject, item) and then by
    subject.  Repeated rows count once, and null items and subjects are none.

    A task holds the marks of its share of subjects.  With `partitions` subjects are dealt to that many shares once, as they come, so
    what a task holds is theirs to bound; without it rows are combined first and the session's number of shares holds.
    """
    mark = lambda df, a, g: df.where(F.col(subject).isNotNull() & F.col(item).isNotNull()).select(subject, item, F.lit(a).alias("__a"), F.lit(g).alias("__g"))
    both = _dealt(mark(asked, 1, 0).unionByName(mark(given, 0, 1)), subject, partitions).groupBy(subject, item).agg(F.max("__a").alias("__a"), F.max("__g").alias("__g"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(item))))
    a, g = F.col("__a") == 1, F.col("__g") == 1
    out = both.groupBy(subject).agg(F.sum("__a").alias("n_asked"), F.sum(F.when(a & g, 1).otherwise(0)).alias("n_given"), listed(a & ~g).alias("missing"), listed(g & ~a).alias("surplus"))
    return out.where("n_asked > 0").withColumn("complete", F.col("n_asked") == F.col("n_given"))

"""Half-open ranges: cover, islands, splits, running offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cover_breaks(df: DataFrame, item: str, order: str, start: str, end: str, *, length: str | None = None, first_only: bool = False) -> DataFrame:
    """Where an item's ranges, in order, do not follow each other from 0 on: (item, order, start, end, expected).

    A break is a range that does not start where the one before ended (the first: at 0) or does not end after its start;
    with `length`, also a last range that does not end there.  first_only keeps each item's first break.  Items are
    partitions of the window, so they are checked in parallel.
    """
    w = Window.partitionBy(item).orderBy(order)
    rows = df.withColumn("expected", F.coalesce(F.lag(end).over(w), F.lit(0)).cast("long"))
    bad = (F.col(start) != F.col("expected")) | (F.col(end) <= F.col(start)) | F.col(start).isNull() | F.col(end).isNull()
    if length:
        bad = bad | (F.lead(order).over(w).isNull() & (F.col(end) != F.col(length)))
    out = rows.withColumn("__bad", bad).where("__bad").select(item, order, start, end, "expected")
    if first_only:
        out = out.groupBy(item).agg(F.min_by(F.struct(order, start, end, "expected"), order).alias("__b")).select(item, "__b.*")
    return out


def islands(df: DataFrame, item: list[str], order: str, value: list[str]) -> DataFrame:
    """Maximal runs of neighbouring rows with equal values: item, value, first, last, n."""
    w = Window.partitionBy(*item).orderBy(order)
    changed = F.lit(False)
    for v in value:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    rows = df.withColumn("__new", (changed | (F.row_number().over(w) == 1)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = rows.groupBy(*item, "__island").agg(*[F.first(v).alias(v) for v in value], F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return out.drop("__island")


def offset_islands(df: DataFrame, item: list[str], offset: str) -> DataFrame:
    """Runs of consecutive offsets: (item, start, end), end not included; repeated offsets count once."""
    rows = df.select(*item, offset).distinct()
    w = Window.partitionBy(*item).orderBy(offset)
    rows = rows.withColumn("__g", F.col(offset) - F.row_number().over(w))
    return rows.groupBy(*item, "__g").agg(F.min(offset).alias("start"), (F.max(offset) + 1).alias("end")).drop("__g")


def expand(df: DataFrame, start: str, end: str, name: str = "offset") -> DataFrame:
    """One row for each offset of a range."""
    return df.where(F.col(end) > F.col(start)).withColumn(name, F.explode(F.sequence(F.col(start).cast("long"), F.col(end).cast("long") - 1)))


def running_offsets(df: DataFrame, item: str, order: str, length: str) -> DataFrame:
    """df with `start` and `end` long: where each row lies if an item's rows are laid end to end."""
    w = Window.partitionBy(item).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("end", F.sum(F.col(length).cast("long")).over(w)).withColumn("start", F.col("end") - F.col(length))


def split_intervals(outer: DataFrame, inner: DataFrame, item: str, start: str, end: str) -> DataFrame:
    """An item's outer ranges cut at every boundary of its inner ranges: (item, start, end) of the pieces.

    Boundaries are one column of points for each item; a piece is two neighbours with an outer range over them.  Inner and
    outer never meet in a theta join: what covers a point is counted by a running sum of starts and ends.
    """
    points = lambda df, s, e: df.select(item, F.col(start).cast("long").alias("at"), F.lit(s).alias("d")).unionByName(df.select(item, F.col(end).cast("long").alias("at"), F.lit(e).alias("d")))
    marks = points(outer, 1, -1).unionByName(points(inner, 0, 0)).groupBy(item, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(item).orderBy("at")
    pieces = marks.withColumn("open", F.sum("d").over(w)).withColumn("next", F.lead("at").over(w))
    return pieces.where("open > 0 AND next IS NOT NULL").select(item, F.col("at").alias(start), F.col("next").alias(end))


def covering(points: DataFrame, ranges: DataFrame, item: str, at: str, start: str, end: str, *carry: str) -> DataFrame:
    """Each point with the range of its item that covers it (the latest to start), or nulls.

    Points and starts are merged in one ordered pass over the item instead of a range join.
    """
    cols = [F.lit(None).cast("long").alias("__s"), F.lit(None).cast("long").alias("__e"), *[F.lit(None).cast(ranges.schema[c].dataType).alias(c) for c in carry]]
    a = points.select(item, F.col(at).cast("long").alias("__at"), F.lit(1).alias("__k"), F.struct(*points.columns).alias("__row"), *cols)
    b = ranges.select(item, F.col(start).cast("long").alias("__at"), F.lit(0).alias("__k"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"), *carry)
    w = Window.partitionBy(item).orderBy("__at", "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = a.unionByName(b).withColumn("__r", F.last(F.when(F.col("__k") == 0, F.struct("__s", "__e", *carry)), ignorenulls=True).over(w)).where("__k = 1")
    inside = F.col("__at") < F.col("__r.__e")
    return got.select("__row.*", F.when(inside, F.col("__r.__s")).alias(start), F.when(inside, F.col("__r.__e")).alias(end), *[F.when(inside, F.col(f"__r.{c}")).alias(c) for c in carry])


def grid_faults(cells: DataFrame, item: str, row: str, column: str, row_span: str, column_span: str, rows: str, columns: str) -> DataFrame:
    """Places of a table's grid that its spanning cells cover not once: (item, r, c, n), with n 0 for holes and null bounds for places outside."""
    places = cells.withColumn("r", F.explode(F.sequence(F.col(row), F.col(row) + F.col(row_span) - 1))).withColumn("c", F.explode(F.sequence(F.col(column), F.col(column) + F.col(column_span) - 1)))
    covered = places.groupBy(item, "r", "c").agg(F.count("*").alias("n"))
    size = cells.groupBy(item).agg(F.max(rows).alias("__rows"), F.max(columns).alias("__columns"))
    full = size.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("__rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("__columns") - 1)))
    full = full.select(item, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.lit(True).alias("__in"))
    covered = covered.select(item, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "n")
    out = full.join(covered, [item, "r", "c"], "full_outer").select(item, "r", "c", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("__in", F.lit(False)).alias("inside"))
    return out.where("n <> 1 OR NOT inside")


def dense_points(points: DataFrame, item: str, index: str, value: str, length: str | None = None) -> DataFrame:
    """(item, values, contiguous): indexed points as one array, nulls where an index is missing.

    The array ends at `length` (a column) or at the highest index; contiguous tells that no index is missing or given twice.
    """
    size = F.max(length).cast("int") if length else (F.max(index) + 1).cast("int")
    got = points.groupBy(item).agg(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))).alias("__p"), size.alias("__n"))
    at = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.get(F.filter("__p", lambda p: p["i"] == i), 0)["v"])
    once = (F.size("__p") == F.col("__n")) & (F.size(F.array_distinct(F.transform("__p", lambda p: p["i"]))) == F.col("__n"))
    return got.select(item, F.when(F.col("__n") > 0, at).alias("values"), once.alias("contiguous"))

"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Tables, fresh, materialise

RUN = "h1 long, h2 long, n_docs long, last long"


def _key(line: bytes, least: int) -> bytes | None:
    """A line's key, or None for a line whose key is shorter than `least` code points."""
    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least:
        return None
    return key


def _digest(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    high, low = h >> 64, h & (1 << 64) - 1
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


def line_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(id_col long, h1 long, h2 long): the 128-bit hashes of the distinct keys of each document's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {_digest(k) for line in (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n") if (k := _key(line, least)) is not None}
                ids += [i] * len(own)
                hashes += own
            for at in range(0, len(ids), 1 << 16):
                part = hashes[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + (1 << 16)], pa.int64()), pa.array([h[0] for h in part], pa.int64()), pa.array([h[1] for h in part], pa.int64())], names=["i", "h1", "h2"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "i long, h1 long, h2 long").withColumnRenamed("i", id_col)


class LineRuns:
    """Levelled runs of line hashes: (h1, h2, n_docs, last), at most one row for each hash in a run.

    A run is dealt by hash and sorted within its partitions, and kept in the shared checkpoint folder.  A new batch of
    documents is a run of level 0; when a level holds `fanout` runs they are merged into one of the next level, so a
    hash is rewritten once a level and lookups read at most fanout - 1 runs a level.  Batches must not share documents and
    come by descending ids: then the batch in which a hash is new holds its last document, which a merge anti-join of the
    batch with the runs tells.  A hash that was seen before only adds its documents; what the runs say of it stays.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _merged(parts: list[DataFrame]) -> DataFrame:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def _sorted(self, run: DataFrame) -> DataFrame:
        return materialise(run.sortWithinPartitions("h1", "h2"))

    def add(self, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """Add a batch: rows (id_col, h1, h2), distinct within a document.  Returns (h1, h2, n_docs, last): its run.

        last is the batch's largest id with a hash that no earlier batch has, and null for other hashes.
        """
        own = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max(id_col).alias("last"))
        new = self.unseen(own).select("h1", "h2", "last")
        run = self._sorted(own.drop("last").join(new, ["h1", "h2"], "left") if self.levels else own)
        self._put(0, run)
        return run

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            parts, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._sorted(self._merged(parts)))

    def view(self) -> DataFrame:
        """All runs merged: one row for each hash."""
        parts = [run for level in self.levels for run in level]
        return self._merged(parts) if parts else self.spark.createDataFrame([], RUN)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows whose hash is in no run yet: a merge anti-join with each run in turn."""
        for level in self.levels:
            for run in level:
                keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20, n_docs: int = 3, batches: int = 6, keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of docs (all by default) with kept_text string, n_lines long, n_dropped long.

    A text is split at line feeds (null or empty: one empty line).  A line's key is the line without ASCII white space
    at both ends and with A-Z lower-cased.  Keys of at least `least` code points that occur in at least `n_docs`
    documents lose all their lines except in the document with the largest id that holds them; other lines stay, in
    order.  A row without an id counts as a document before all others; rows that share an id count each, and keep and
    lose the same lines; an empty table gives no rows; names that docs already has get an underscore.

    Documents are added to the runs in `batches` ranges of ids, the largest first; the result does not depend on it.
    """
    spark, keep, made = docs.sparkSession, keep or docs.columns, Tables(docs.sparkSession)
    gone_id, gone = fresh(docs, "gone_id", "gone")
    keys = made.put(line_keys(docs, id_col=id_col, text_col=text_col, least=least).withColumnRenamed(id_col, "id"))
    ids = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0]
    runs, above = LineRuns(spark), F.lit(True)
    for cut in [*sorted(set(ids or []), reverse=True), None]:
        runs.add(keys.where(above & (F.col("id") > cut if cut is not None else F.lit(True))), "id")
        above = F.coalesce(F.col("id") <= cut, F.lit(True))
    common = made.put(runs.view().where(F.col("n_docs") >= n_docs).select("h1", "h2", "last"))
    # one row for each common line and document but the last: the documents' rows are merged with the runs by hash
    lost = keys.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    lost = lost.withColumnRenamed("id", gone_id)
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col(gone_id)), "left").select(*docs.columns, gone)
    new = fresh(docs, "kept_text", "n_lines", "n_dropped")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{new[0]}` string, `{new[1]}` long, `{new[2]}` long"

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            for text, out in zip(batch.column(text_col), batch.column(gone)):
                lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                left = lines
                if out := {(x["h1"], x["h2"]) for x in out.as_py() or ()}:
                    left = [x for x in lines if (k := _key(x, least)) is None or _digest(k) not in out]
                texts.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
                totals.append(len(lines))
                dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=[*keep, *new])

    return joined.mapInArrow(drop, schema)

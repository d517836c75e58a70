"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tables, fresh, kept

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features beside whole words.
STEMS = (4, 5, 6)
#: Distinct words whose features a worker keeps.
KNOWN = 200_000
#: Texts whose unknown words are looked up at once.
AT_ONCE = 256


def _letters() -> np.ndarray:
    """For each code point itself if it can stand in a word, else a space."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, ord(" "), dtype=np.uint32)
    own = np.frombuffer("".join(_WORD.findall(every)).encode("utf-32-le"), dtype=np.uint32)
    table[own] = own
    return table


_ASCII = bytes(c if _WORD.fullmatch(chr(c)) else ord(" ") for c in range(128)) + bytes(128)


def words(text: str | None) -> list[str]:
    """The words of the lower-cased text, as _WORD finds them, by a table of code points."""
    low = (text or "").lower()
    if low.isascii():
        return low.encode("ascii").translate(_ASCII).decode("ascii").split()
    table = kept("letters", _letters, "")
    return table[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tobytes().decode("utf-32-le").split()


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(word[:n] + "*" for n in STEMS if len(word) >= n))


class _Known(dict):
    """word -> the indexes of its features, among those of the model."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = tuple(i for f in word_features(word) if (i := self.index.get(f)) is not None)
        return found


def features(text: str | None, known: _Known) -> np.ndarray:
    """The indexes of the model's features that the text has, each once, in order."""
    found = set()
    found.update(*map(known.__getitem__, set(words(text))))
    return np.array(sorted(found), dtype=np.int32)


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float
    token: str = ""  # names the index in workers, which keep what they know of words between tasks

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.weights[r].sum() for r in rows]) + self.bias if rows else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, *, start: np.ndarray | None = None, epochs: int = 400, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier with the least non-negative PU risk for the logistic loss.

    With l(z) = log(1 + exp(-z)), the risk is prior * mean_P l(z) + max(0, mean_U l(-z) - prior * mean_P l(-z)).  The second
    term estimates the risk on negatives and cannot be negative; where the estimate is, which is overfitting to the
    positives, it has no gradient.  Steps are Adam's, over all
    rows, and become shorter to the end.
    """
    flat_p, flat_u = (np.concatenate(x or [np.empty(0, np.int32)]) for x in (positive, unlabelled))
    rows_p, rows_u = (np.repeat(np.arange(len(x)), [len(r) for r in x]) for x in (positive, unlabelled))
    w = np.zeros(n_features + 1) if start is None else np.append(start, 0.0)
    w[-1] = np.log(prior / (1 - prior)) if start is None else w[-1]
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def back(flat: np.ndarray, rows: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(flat, g[rows], n_features), g.sum())

    for t in range(1, epochs + 1):
        zp = np.bincount(rows_p, w[flat_p], len(positive)) + w[-1]
        zu = np.bincount(rows_u, w[flat_u], len(unlabelled)) + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = prior * back(flat_p, rows_p, -sigmoid(-zp) / len(positive))
        down = back(flat_u, rows_u, sigmoid(zu) / len(unlabelled)) - prior * back(flat_p, rows_p, sigmoid(zp) / len(positive))
        grad = up + down if negative >= 0 else up
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (1 - t / (epochs + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(f, n): in how many texts each feature occurs; counted within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = Counter()
            for text in batch.column(0):
                total.update({f for w in set(words(text.as_py())) for f in word_features(w)})
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["f", "n"])

    return texts.select(F.col(text_col).alias("t")).mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


class _Hashed(dict):
    """word -> the places of its features in a sorted array of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def learn(self, new: list[str]) -> None:
        """All of the words at once: one search in the hashes, which would cost more for each word than all else."""
        own = [word_features(w) for w in new]
        ends = np.cumsum([0, *map(len, own)])
        wanted = np.fromiter((xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass"), 42) for fs in own for f in fs), np.uint64, ends[-1]).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        hit = self.hashes[at] == wanted
        ends, places = np.concatenate(([0], np.cumsum(hit)))[ends].tolist(), at[hit].tolist()
        self.update((w, tuple(places[i:j])) for w, i, j in zip(new, ends, ends[1:]))

    def found(self, texts: list[str | None]) -> np.ndarray:
        """The places of the features that the texts have, each once for each text."""
        some = [set(words(t)) for t in texts]
        if len(self) >= KNOWN:
            self.clear()
        if new := set().union(*some) - self.keys():
            self.learn(list(new))
        flat = [self[w] for own in some for w in own]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        text = np.repeat(np.repeat(np.arange(len(some)), list(map(len, some))), sizes)
        places = np.fromiter(chain.from_iterable(flat), np.int64, sizes.sum())
        each = np.sort(text * len(self.hashes) + places)  # np.unique hashes, and is slower
        return each[np.diff(each, prepend=-1) != 0] % len(self.hashes)


def _hash_counts(texts: DataFrame, text_col: str, hashes: np.ndarray) -> DataFrame:
    """(h, n): in how many texts the features with each of the sorted hashes occur; counted within tasks first."""
    shared, token = texts.sparkSession.sparkContext.broadcast(hashes), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = kept("features", lambda: _Hashed(shared.value), token), np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                np.add.at(total, known.found(batch.column(0).slice(i, AT_ONCE).to_pylist()), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[part]), pa.array(total[part])], names=["h", "n"])

    return texts.select(F.col(text_col).alias("t")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, max_labelled: int = 10_000, features_at_once: int = 2_000_000, min_positives: int = 2, min_z: float = 4.0) -> Model | None:
    """Fit on confirmed toxic documents and unlabelled ones; None if no labelled document is toxic.

    Of the labels given (hold rows out before), at most `max_labelled` toxic ones and at most `max_labelled` of any label
    are taken, by least hash of the id; the latter's labels are used for nothing but the class prior (unless that is given),
    and their texts are the unlabelled side.  Candidate features (words, word beginnings) are those of at least `min_positives` of
    the toxic texts; over all documents it is counted how many have each, in one pass for each `features_at_once` of them, which
    workers know by sorted 64-bit hashes, and a feature stays if it is in over `min_z` standard deviations more toxic texts than their share of the corpus
    explains.  max_labelled bounds the labelled rows; nothing else is sampled or dropped.  Null labels and labels without an id
    count as missing; documents without an id are counted, and have no label.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) == 1).cast("int").alias("__y")).groupBy("__id").agg(F.max("__y").alias("__y"))
    prior_row = known.agg(F.avg("__y"), F.count("*")).first()
    if not prior_row[1] or not prior_row[0]:
        return None
    prior = min(float(prior_row[0]), 0.95) if prior is None else prior
    order = F.xxhash64("__id")
    toxic = known.where("__y = 1").orderBy(order, "__id").limit(max_labelled)
    mixed = known.orderBy(order, "__id").limit(max_labelled)
    chosen = toxic.withColumn("__p", F.lit(1)).unionByName(mixed.withColumn("__p", F.lit(0)))  # at most 2 * max_labelled rows
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "__id").select("__p", "t")
    tables = Tables(spark)
    able = tables.put(_counts(sample.where("__p = 1"), "t").where(F.col("n") >= min_positives).withColumn("h", F.xxhash64("f")))
    n_docs = docs.count()
    n_toxic = sample.where("__p = 1").count()
    if not n_toxic:
        return None
    share, kept_features = n_toxic / max(n_docs, n_toxic), []
    blocks = max(1, -(-able.count() // features_at_once))
    corpus = F.greatest(F.coalesce("__n", F.lit(0)), F.col("n")).cast("double")
    z = (F.col("n") - corpus * share) / F.sqrt(corpus * share * (1 - share) + 1e-9)
    for block in range(blocks):
        own = able.where(F.pmod("h", F.lit(blocks)) == block)
        hashes = np.sort(own.select("h").distinct().toArrow().column("h").to_numpy())  # about features_at_once numbers
        if len(hashes):
            counted = _hash_counts(docs, text_col, hashes).withColumnRenamed("n", "__n")
            kept_features += [(-r["n"], r["f"]) for r in own.join(counted, "h", "left").where(z >= min_z).select("f", "n").collect()]
    tables.drop_all()
    index = {f: n for n, (_, f) in enumerate(sorted(kept_features))}
    shared = spark.sparkContext.broadcast(index)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Known(shared.value)
        for batch in batches:
            yield pd.DataFrame({"p": batch["__p"], "x": [features(t, cache) for t in batch["t"]]})

    taken = sample.mapInPandas(rows, "p int, x array<int>").collect()
    split = [[np.array(r["x"], dtype=np.int32) for r in taken if r["p"] == p] for p in (1, 0)]
    weights, bias = fit_nnpu(split[0], split[1], len(index), prior)
    return Model(index, weights, bias, uuid.uuid4().hex)


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of docs (all by default) with `score` double, from 0 to 1: higher is likelier toxic.

    Null and empty texts have the score of a text without features.  Without a model every score is 0.  Repeated
    rows stay; a clashing name gets an underscore.
    """
    keep = keep or docs.columns
    (name,) = fresh(docs, "score")
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("features", lambda: _Known(shared.value.index), shared.value.token)
        for batch in batches:
            scores = shared.value.score([features(t.as_py(), known) for t in batch.column(text_col)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, name])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether an id's rows are held out of training: a fifth of the ids, by crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0

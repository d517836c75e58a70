"""Document quality: a classifier's evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Tables, fresh

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_MARKS = b"!?.,;:'\"()-"
NAMES = ("log_bytes", "upper", "digits", "symbols", "marks", "exclaims", "word_bytes", "unique", "line_words", "repeated_lines", "symbol_words")


def measures(text: str | None) -> list[float]:
    """Shares and sizes that tell prose from junk; zeros for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n = raw.split(), len(raw)
    if not words:
        return [0.0] * len(NAMES)
    share = lambda drop: (n - len(raw.translate(None, drop))) / n
    lines = [x for x in raw.split(b"\n") if x]
    odd = sum(w[-1] in _SYMBOLS or len(w) == 1 and w[0] in _SYMBOLS for w in words)
    return [float(np.log1p(n)), share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_MARKS), raw.count(b"!") / n, n / len(words), len(set(words)) / len(words) ** 0.8, len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), odd / len(words)]


@dataclass
class Classifier:
    """Logistic regression over binned measures; `base` is the share of good documents it was trained with."""

    edges: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, w) in enumerate(zip(self.edges, self.weights)):
            z += w[np.searchsorted(e, x[:, j], side="right")]
        return z


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 16, epochs: int = 400, rate: float = 0.1, decay: float = 1e-3) -> Classifier:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    at, offset = [], 0
    for j, e in enumerate(edges):
        at.append(offset + np.searchsorted(e, x[:, j], side="right"))
        offset += len(e) + 1
    flat = np.array(at)
    base = float(np.clip(y.mean(), 0.02, 0.98))
    w, b = np.zeros(offset), float(np.log(base / (1 - base)))
    m, v = np.zeros(offset + 1), np.zeros(offset + 1)
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(w[flat].sum(axis=0) + b, -40, 40)))
        g = (p - y) / len(y)
        grad = np.append(np.bincount(flat.ravel(), np.tile(g, len(flat)), offset) + decay * w / len(flat), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    sizes = np.cumsum([len(e) + 1 for e in edges])[:-1]
    return Classifier(edges, np.split(w, sizes), float(b), base)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Classifier | None:
    """Fit on at most `max_labelled` labelled documents, by least hash of the id; None without labels of both kinds.

    Null labels are missing; of labels that contradict each other the lower one counts.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).groupBy("__id").agg(F.min("__y").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["__y"], "x": [measures(t) for t in batch["t"]]})

    rows = sample.select("__y", "t").mapInPandas(run, "y int, x array<double>").collect()  # at most max_labelled rows of numbers
    y = np.array([r["y"] == 1 for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    return fit(np.array([r["x"] for r in rows]), y)


def evidence(docs: DataFrame, model: Classifier | None, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of docs (all by default) and `evidence` double: log p(text | good) / p(text | bad), 0 without a model.

    Null and empty texts are measured as zeros; repeated rows stay; a clashing name gets an underscore.
    """
    keep = keep or docs.columns
    (name,) = fresh(docs, "evidence")
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = np.log(shared.value.base / (1 - shared.value.base))
        for batch in batches:
            x = np.array([measures(t.as_py()) for t in batch.column(text_col)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.logit(x) - prior, pa.float64())], names=[*keep, name])

    return docs.mapInArrow(run, schema)


def _strength(sites: DataFrame, mean: Column | str, total: str, n: str) -> float:
    """Pseudo-counts of the Beta prior between a level's sites and their parents' means, by the method of moments.

    Between-site variance is the variance of site means around their priors less what sampling explains; the smaller it
    is, the more a site is drawn to its parent.  Bounded to 1 .. 1000.
    """
    m = F.col(total) / F.col(n)
    mu = F.col(mean) if isinstance(mean, str) else mean
    row = sites.agg(F.sum(F.col(n) * (m - mu) ** 2), F.sum(mu * (1 - mu)), F.sum(F.col(n) * mu * (1 - mu)), F.sum(n)).first()
    if not row[3] or not row[2]:
        return 1000.0
    between = max((row[0] - row[1]) / row[3], 1e-9)
    return float(np.clip(row[2] / row[3] / between - 1, 1.0, 1000.0))


def posteriors(scored: DataFrame, *, host_col: str, path_col: str, base: float, evidence_col: str = "evidence", broadcast_rows: int = 100_000) -> DataFrame:
    """scored with site_mean and posterior double: the chance that a document is good, given its text and its site.

    Each document counts as good with the chance that its evidence gives at the base rate.  Hosts are drawn to the
    mean of all documents, paths to their host's, by Beta priors whose strength is estimated from the spread between
    sites; a document's own chance is left out of its path's and host's sums.  Sums are grouped with partial
    aggregation, so a host may hold any share of the rows; the site table joins back by broadcast up to
    `broadcast_rows` sites, else by a join that AQE splits where one site is large.  Null hosts and paths are sites of
    their own; null evidence counts as none; a site with one document has its parent's mean; repeated rows are documents
    each; no rows give no rows; names that scored has get an underscore.
    """
    mean_col, out_col, p, h, q, n, total_p, hn, hs = fresh(scored, "site_mean", "posterior", "p", "h", "q", "n", "s", "hn", "hs")
    logit0 = float(np.log(base / (1 - base)))
    bounded = lambda x: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))
    rows = scored.withColumn(p, 1 / (1 + F.exp(-bounded(F.coalesce(F.col(evidence_col), F.lit(0.0)) + logit0))))
    paths = Tables(scored.sparkSession).put(rows.groupBy(F.col(host_col).alias(h), F.col(path_col).alias(q)).agg(F.count("*").alias(n), F.sum(p).alias(total_p)))
    hosts = paths.groupBy(h).agg(F.sum(n).alias(hn), F.sum(total_p).alias(hs))
    total = hosts.agg(F.sum(hs), F.sum(hn), F.count("*")).first()
    mu = float(np.clip(total[0] / total[1], 1e-6, 1 - 1e-6)) if total[1] else base
    k1 = _strength(hosts, F.lit(mu), hs, hn)
    sites = paths.join(hosts, paths[h].eqNullSafe(hosts[h])).drop(hosts[h])
    k2 = _strength(sites.withColumn("m", (k1 * mu + F.col(hs)) / (k1 + F.col(hn))), "m", total_p, n)
    sites = F.broadcast(sites) if paths.count() <= broadcast_rows else sites
    joined = rows.join(sites, F.col(host_col).eqNullSafe(F.col(h)) & F.col(path_col).eqNullSafe(F.col(q)))
    host = (k1 * mu + F.col(hs) - F.col(p)) / (k1 + F.col(hn) - 1)
    site = (k2 * host + F.col(total_p) - F.col(p)) / (k2 + F.col(n) - 1)
    out = joined.withColumn(mean_col, F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site)))
    odds = F.coalesce(F.col(evidence_col), F.lit(0.0)) + F.log(F.col(mean_col) / (1 - F.col(mean_col)))
    return out.withColumn(out_col, 1 / (1 + F.exp(-bounded(odds)))).select(*scored.columns, mean_col, out_col)

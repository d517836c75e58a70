"""Benchmark decontamination by winnowed k-gram fingerprints."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import fresh, kept

#: Bytes of benchmark text that one pass holds in every worker.  A larger benchmark takes more passes over the documents.
BLOCK_BYTES = 32 << 20
#: Distinct words whose hashes a worker keeps.
WORDS = 150_000
#: Bytes that are no part of a word, after lower-casing, become spaces.
_SPACES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()
    known = kept("word hashes", _Hashes)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def kgrams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ words[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash, the rightmost of equals, of each `window` neighbouring ones (or of all, if fewer)."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    window = min(window, n)
    m = n - window + 1
    best, at = hashes[:m].copy(), np.arange(m)
    for i in range(1, window):
        lower = hashes[i : i + m] <= best
        best = np.where(lower, hashes[i : i + m], best)
        at = np.where(lower, np.arange(i, i + m), at)
    return np.unique(at)


class _Block:
    """The benchmark items of one block: their words' hashes end to end, and their winnowed fingerprints, sorted."""

    def __init__(self, items: list[tuple[object, str | None]], span: int, k: int):
        self.span, self.k, self.window = span, k, span - k + 1
        hashed = [(i, h) for i, t in items if len(h := word_hashes(t))]
        self.ids = [i for i, _ in hashed]
        self.words = np.concatenate([h for _, h in hashed] or [np.empty(0, np.uint64)])
        self.start = np.cumsum([0] + [len(h) for _, h in hashed])
        prints, at, short = [], [], {}
        for n, (_, h) in enumerate(hashed):
            if len(h) < span:  # the whole item is one window, found by its own hash
                short.setdefault(len(h), {}).setdefault(int(kgrams(h, len(h))[0]), []).append(n)
            else:
                g = kgrams(h, k)
                p = winnow(g, self.window)
                prints.append(g[p])
                at.append(p + self.start[n])
        prints = np.concatenate(prints or [np.empty(0, np.uint64)])
        order = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[order], np.concatenate(at or [np.empty(0, np.int64)])[order]
        self.short = {n: (np.array(sorted(x), dtype=np.uint64), x) for n, x in short.items()}

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window of any item, and the numbers of those items."""
        n, span = len(words), self.span
        edge, found = np.zeros(n + 1, dtype=np.int32), set()
        for m, (keys, owners) in self.short.items():
            g = kgrams(words, m)
            for p in np.flatnonzero(np.isin(g, keys)):
                edge[p] += 1
                edge[p + m] -= 1
                found.update(owners[int(g[p])])
        g = kgrams(words, self.k)
        p = winnow(g, self.window)
        low, high = np.searchsorted(self.prints, g[p], "left"), np.searchsorted(self.prints, g[p], "right")
        # an alignment is known by where the document's first word would lie in the block's words
        seen = {}
        for d, a, b in zip(p[low < high], low[low < high], high[low < high]):
            for q in self.at[a:b].tolist():
                item = int(np.searchsorted(self.start, q, "right")) - 1
                first = int(d) - q
                if d < seen.get((item, first), -1):
                    continue  # lies in a span that this alignment has been extended over
                # extend: all equal words around the hit, within the item and the document
                i, j = int(d), q
                end = min(n - i, int(self.start[item + 1]) - j)
                back = min(i, j - int(self.start[item]))
                ahead = words[i : i + end] != self.words[j : j + end]
                behind = words[i - back : i][::-1] != self.words[j - back : j][::-1]
                after = int(ahead.argmax()) if ahead.any() else end
                before = int(behind.argmax()) if behind.any() else back
                seen[item, first] = i + max(after, 1)
                if before + after >= span:
                    edge[i - before] += 1
                    edge[i + after] -= 1
                    found.add(item)
        return np.cumsum(edge[:-1]) > 0, found


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of docs (all by default) with n_words long, n_hit long, hit_bits binary, item_ids array.

    An item's windows are its runs of `span` consecutive words; an item of fewer words is one window.  A document word
    inside any occurrence of a window is hit; hit_bits has one bit for each word, the first in each byte's lowest, and
    is null if none is.  item_ids lists the distinct items found, in no order.  Both sides keep the least k-gram hash of
    each span - k + 1 neighbouring ones, so two texts that share `span` words share a fingerprint; the fingerprints are
    joined and each hit is extended over all equal words around it, which also tells chance hits.

    The benchmark is held in every worker, in blocks of at most about `block_bytes` of text (an item is never split), which
    also bounds what passes through the driver at once; documents pass through once for each block and are not shuffled.  Null or empty texts have no words; items without
    words match nothing; repeated items count as often as they have distinct ids; an empty benchmark hits nothing.
    Names of new columns that docs already has get an underscore.
    """
    spark, keep = docs.sparkSession, keep or docs.columns
    size = benchmark.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    new = fresh(docs, "n_words", "n_hit", "hit_bits", "item_ids")
    item_type = benchmark.schema[item_col].dataType.simpleString()
    out, run = docs, uuid.uuid4().hex
    for number in range(blocks):
        mine = benchmark.where(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == number) if blocks > 1 else benchmark
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in mine.select(item_col, item_text_col).distinct().collect()])
        passed = docs.columns if number + 1 < blocks else keep
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed) + f", `{new[0]}` long, `{new[1]}` long, `{new[2]}` binary, `{new[3]}` array<{item_type}>"

        def mark(batches: Iterator[pa.RecordBatch], shared=shared, passed=passed, number=number, token=f"{run} {number}") -> Iterator[pa.RecordBatch]:
            block = kept("benchmark", lambda: _Block(shared.value, span, k), token)  # built once a worker
            for batch in batches:
                made = [[], [], [], []]
                before = zip(*(batch.column(c).to_pylist() for c in new[2:])) if number else ((None, ()) for _ in range(batch.num_rows))
                for text, (old, items) in zip(batch.column(text_col), before):
                    words = word_hashes(text.as_py())
                    hit, found = block.hits(words)
                    if old:
                        hit |= np.unpackbits(np.frombuffer(old, np.uint8), bitorder="little")[: len(words)].astype(bool)
                    n = int(hit.sum())
                    for column, value in zip(made, (len(words), n, np.packbits(hit, bitorder="little").tobytes() if n else None, list({*items, *(block.ids[i] for i in found)}))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in passed), pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.binary()), pa.array(made[3], pa.list_(to_arrow_type(benchmark_type)))],
                    names=[*passed, *new],
                )

        benchmark_type = benchmark.schema[item_col].dataType
        out = out.mapInArrow(mark, schema)
    return out

"""Sum-of-squares packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, kept

#: Pieces that one packing task takes together.  The waste of a group is a few open sequences, whatever its size.
GROUP = 16384
#: A Python worker keeps the token ids of the words it met among the last WORDS to 2 * WORDS new ones, if not told otherwise.
WORDS = 500_000
#: Pieces that a worker holds before it passes them on.
AT_ONCE = 1024
#: Marks that end a word in prose.  A run of them after a letter is a token of its own for this kind of tokenizer, which
#: also lower-cases.
MARKS = ".,;:!?%*$#&|"


def _tokeniser(path: str, words: int = WORDS):
    """text -> ids as little-endian uint32 bytes.

    Where white space always ends a token, a text is encoded word by word and each word's bytes are kept.  Only
    plain spaces and line breaks part words; other white space stays inside and is left to the tokenizer.  Where a tokenizer
    also lower-cases and takes a run of marks for a token, words are parted further.  Which of this holds is tried out on
    loading; a tokenizer without these traits encodes whole texts.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    plain = lambda text: array("I", model.encode(text, add_special_tokens=False).ids).tobytes()
    tried = ["Some words", "of", "THE text,", "(1999)", "a.b", "don't", "x", "Été", "end."]
    if any(plain(a + gap + b) != plain(a) + plain(b) for gap in " \n" for a in tried for b in tried):
        return plain
    parted = all(plain(w.upper() + m) == plain(w) + plain(m) for w in ("word", "a", "consequences") for m in (*MARKS, "...", "?!", ".,"))

    class Known(dict):
        older: dict[str, bytes] = {}

        def __missing__(self, word: str) -> bytes:
            if (ids := self.older.get(word)) is None:
                core = word.rstrip(MARKS)
                if parted and core[-1:].isalpha() and len(core[-1].lower()) == 1 and "<|" not in word and (len(core) < len(word) or word.isascii() and not word.islower()):
                    # letters, then one run of marks: two tokens' worth, in whatever case
                    ids = self[core.lower() if core.isascii() else core] + self[word[len(core) :]]
                else:
                    ids = plain(word)
            if len(self) >= words:
                self.older = dict(self)
                self.clear()
            self[word] = ids
            return ids

    known = Known({"": b""})
    return lambda text: b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, known_words: int = WORDS) -> DataFrame:
    """Cut every document's ids, closed by end_id, into pieces of at most `capacity`.

    Returns (id_col, piece int, start long, length long, ids binary): ids are little-endian unsigned 32-bit.  A null or
    empty text is the one id end_id.  Workers keep the ids of known_words to twice as many words: fewer take less memory and
    more time, and change no result.  Rows that repeat a document give its pieces again; no rows give no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size, last = 4 * capacity, np.asarray([end_id], dtype="<u4").tobytes()

    def made(keys: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        row, piece, ids = zip(*rows)
        columns = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array([i * capacity for i in piece], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["k", "piece", "start", "length", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept("tokens", lambda: _tokeniser(tokenizer, known_words), (tokenizer, known_words))
        for batch in batches:
            rows = []
            for n, text in enumerate(batch.column("t")):
                ids = encode(text.as_py() or "") + last
                for i, at in enumerate(range(0, len(ids), size)):
                    rows.append((n, i, ids[at : at + size]))
                    if len(rows) >= AT_ONCE:
                        yield made(batch.column("k"), rows)
                        rows = []
            if rows:
                yield made(batch.column("k"), rows)

    return (
        docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
        .mapInArrow(cut, f"k {kind}, piece int, start long, length long, ids binary")
        .withColumnRenamed("k", id_col)
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Place lengths, in the order given, into bins: (bin number, offset) of each.

    A piece goes where the sum over residual gaps of the squared number of open bins with that gap becomes smallest;
    a new bin counts as an open place too, full bins count for nothing; ties go to the smaller gap.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    where, offset, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # growth of the sum for each old gap g in s..capacity: count[g] falls by one, count[g - s] rises by one
        rise = 2 * count[: capacity + 1 - s] + 1
        rise[0] = 0  # full bins are not counted
        growth = np.where(count[s:] > 0, rise + 1 - 2 * count[s:], never)
        growth[-1] = rise[-1]
        gap = s + int(growth.argmin())
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def pack(parts: DataFrame, *, keep: list[str], length_col: str = "length", order: list[str] | None = None, capacity: int = 2048, rows: int | None = None, group: int = GROUP) -> DataFrame:
    """Give every piece a sequence and a place in it: `keep` columns, length_col, sequence_id long, offset long.

    Pieces are dealt evenly, by a hash of the `order` columns (those of `keep` if not given), to ceil(rows / group)
    groups; each group is packed for itself, longest first, equal lengths by the order columns, so a lost task repeats
    its result.  A group holds about `group` pieces, however many there are; pieces of length `capacity` are sequences
    by themselves.  `rows` is the number of pieces, or near it, counted if not given.
    Lengths below 1 or above capacity, and null ones, are errors; no rows give no rows.
    """
    order = order or keep
    total = parts.count() if rows is None else rows
    groups = max(1, math.ceil(total / group))
    g, b, o = fresh(parts, "pack_group", "pack_bin", "pack_offset")
    checked = parts.select(*keep, F.when(F.col(length_col).between(1, capacity), F.col(length_col)).otherwise(F.raise_error(F.lit(f"lengths must be 1 to {capacity}")).cast("long")).cast("long").alias(length_col))
    dealt = checked.withColumn(g, F.pmod(F.xxhash64(*order), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + f", `{b}` long, `{o}` long"

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(length_col, "descending"), *((c, "ascending") for c in order)])
        lengths = rows.column(length_col).to_numpy()
        full = int((lengths == capacity).sum())
        where, offset = sum_of_squares(lengths[full:], capacity)
        bins = np.append(np.arange(full, dtype=np.int64), where + full)
        return rows.append_column(b, pa.array(bins)).append_column(o, pa.array(np.append(np.zeros(full, dtype=np.int64), offset)))

    packed = dealt.groupBy(g).applyInArrow(place, schema)
    return packed.select(*keep, length_col, (F.col(b) * F.lit(groups) + F.col(g)).alias("sequence_id"), F.col(o).alias("offset"))

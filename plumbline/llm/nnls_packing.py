"""Histogram packing: repeat counts of shallow length combinations by non-negative least squares, the rest greedily.

Documents may be cut anywhere.  The plan is made on the histogram of piece lengths alone, at most `capacity` numbers however
large the corpus is; pieces then find their places by the number that they have among pieces of their length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Tables, kept

#: A Python worker keeps the ids of the WORDS to 2 * WORDS words that it met last.
WORDS = 500_000
#: Marks that end a word; a run of them after a letter is no part of it.
MARKS = ".,;:!?%*$#&|"
#: Pieces that a worker holds before it passes them on.
AT_ONCE = 1024
#: Ranks of pieces of one length stay below this.
RANKS = 1 << 50


# ---- token ids


def encoder(path: str, words: int = WORDS) -> Callable[[str], bytes]:
    """text -> ids of a tokenizers file, without special tokens added, as little-endian uint32 bytes.

    Tokenizers that part texts before a space and around other white space, as byte-level ones do, are given a text word by
    word, and each word's ids are kept.  A run of marks after a letter is looked up by itself, and a new word of plain letters
    goes to the tokenizer's model without the steps before it.  Whether all that gives the same ids is tried out on loading;
    other tokenizers, and texts that may hold a special token or a NUL, are encoded whole.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    plain = lambda text: array("I", model.encode(text, add_special_tokens=False).ids).tobytes()

    class Known(dict):
        older: dict[str, bytes] = {}

        def __missing__(self, word: str) -> bytes:
            ids = self.older.get(word)
            if ids is None:
                core = word.rstrip(MARKS)
                if len(core) < len(word) and core[-1:].isalpha():
                    ids = self[core] + self[word[len(core) :]]
                elif word.isascii() and word.lstrip(" ").isalpha() and " " not in word[1:]:
                    ids = array("I", [t.id for t in merges("Ġ" + word[1:] if word[0] == " " else word)]).tobytes()
                else:
                    ids = plain(word)
            if len(self) >= words:
                self.older = dict(self)
                self.clear()
            if len(word) < 40:
                self[word] = ids
            return ids

    known, merges = Known({"": b""}), model.model.tokenize
    runs, mixed = re.compile(r"\s+|\S+"), re.compile(r"\s\s")

    def by_words(text: str) -> bytes:
        if "<|" in text or "\0" in text:
            return plain(text)
        if not mixed.search(text):
            parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        else:
            # the last of several white spaces goes with the word if it is a space, and stands alone if not
            parts, found = [], runs.findall(text)
            for i, run in enumerate(found):
                if not run[0].isspace():
                    parts.append(" " + run if i and found[i - 1][-1] == " " else run)
                elif i + 1 == len(found):
                    parts.append(run)
                else:
                    parts += [run[:-1]] if run[-1] == " " else [run[:-1], run[-1]]
        return b"".join(map(known.__getitem__, parts))

    tried = ["Some words", "of", "THE text,", "(1999)", "a.b", "don't", "'s", "x", "Été", "end.", "語", "Why?!", "A%&b,", "c.,;:!?%*$#&|", "été...", "x1.", "internationally"]
    gaps = [" ", "\n", "  ", " \n", "\n ", "\n\n", "\t", "   \n\n  ", " ", "\r\n"]
    same = all(by_words(t) == plain(t) for gap in gaps for a in tried for b in tried for t in (a + gap + b, gap + a, a + gap))
    known.clear()
    known[""] = b""
    return by_words if same else plain


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, known_words: int = WORDS) -> DataFrame:
    """Each document's ids, closed by end_id, in pieces of `capacity` and one shorter rest.

    Returns (id_col, doc_tokens long, start long, length long, ids binary, part int, at long): at is the number, from 0, that a
    piece has among the pieces of its length in its task's partition `part`.  To be stored before use, so that these numbers
    stay.  A null or empty text is the one id end_id; repeated rows give their pieces again; no rows give no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size, last = 4 * capacity, np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept("byte_tokens", lambda: encoder(tokenizer, known_words), (tokenizer, known_words))
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)

        def made(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            row, total, start, ids, at = zip(*rows)
            columns = [keys.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (total, start, [len(x) // 4 for x in ids])), pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(at, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["k", "doc_tokens", "start", "length", "ids", "part", "at"])

        for batch in batches:
            rows = []
            for n, text in enumerate(batch.column("t")):
                ids = encode(text.as_py() or "") + last
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    rows.append((n, len(ids) // 4, at // 4, piece, seen[len(piece) // 4]))
                    seen[len(piece) // 4] += 1
                    if len(rows) >= AT_ONCE:
                        yield made(batch.column("k"), rows)
                        rows = []
            if rows:
                yield made(batch.column("k"), rows)

    return (
        docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
        .mapInArrow(cut, f"k {kind}, doc_tokens long, start long, length long, ids binary, part int, at long")
        .withColumnRenamed("k", id_col)
    )


# ---- the plan


def combinations(capacity: int, depth: int = 3) -> np.ndarray:
    """All ways to fill a window with up to three lengths, the largest first, 0 where there are fewer."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1 to 3")
    ways = [np.array([[capacity, 0, 0]])]
    if depth > 1:
        a = np.arange((capacity + 1) // 2, capacity)
        ways.append(np.stack([a, capacity - a, 0 * a], 1))
    if depth > 2:
        a, b = (x.ravel() for x in np.meshgrid(np.arange(1, capacity), np.arange(1, capacity), indexing="ij"))
        c = capacity - a - b
        some = (a >= b) & (b >= c) & (c > 0)
        ways.append(np.stack([a, b, c], 1)[some])
    return np.concatenate(ways)


def solve(ways: np.ndarray, histogram: np.ndarray, *, rounds: int = 200, small: float = 1e-3) -> np.ndarray:
    """x >= 0 that makes || A x - histogram || least; column j of A counts the lengths of ways[j], whatever stands at 0.

    Block coordinate descent: each round takes ways that share no length, best gain first, and sets all of them to their best
    value at once, which is exact since their columns are orthogonal.  It ends after `rounds`, or once ten rounds together gain
    less than the part `small` of the squares that are left.
    """
    x, left = np.zeros(len(ways)), histogram.astype(float).copy()
    left[0] = 0.0
    equal = (ways[:, :1] == ways[:, 1:2]).astype(int) + (ways[:, 1:2] == ways[:, 2:]) * (ways[:, 1:2] > 0) + (ways[:, :1] == ways[:, 2:]) * (ways[:, :1] > 0)
    squares = ((ways > 0).sum(1) + 2 * equal[:, 0]).astype(float)
    best = float(left @ left)
    for k in range(rounds):
        slope = left[ways].sum(1)
        step = np.maximum(slope / squares, -x)
        gain = step * (2 * slope - step * squares)
        top = np.argpartition(-gain, min(4000, len(gain) - 1))[:4000]
        used = np.zeros(len(histogram), dtype=bool)
        for j in top[np.argsort(-gain[top], kind="stable")].tolist():
            if gain[j] <= 0:
                break
            w = ways[j]
            w = w[w > 0]
            if not used[w].any():
                used[w] = True
                x[j] += step[j]
                np.subtract.at(left, w, step[j])
        if k % 10 == 9:
            now = float(left @ left)
            if best - now <= small * best:
                break
            best = now
    return x


@dataclass(frozen=True)
class Plan:
    """Where pieces go: row i is about the pieces of length[i] with ranks from first[i] on, up to the next row's.

    The piece of rank first[i] + d has its first size[i] ids at offset[i] of sequence[i] + d; what is left of it, if anything,
    is the piece of length next_length[i] and rank next_first[i] + d.
    """

    length: np.ndarray
    first: np.ndarray
    size: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    next_length: np.ndarray
    next_first: np.ndarray
    sequences: int


class _Planner:
    def __init__(self, histogram: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, histogram.astype(np.int64).copy()
        self.left[0] = 0
        self.total, self.taken = self.left.copy(), np.zeros_like(self.left)
        self.rows: list[tuple[int, int, int, int, int, int, int]] = []
        self.sequences = 0

    def take(self, length: int, times: int, offset: int, size: int) -> None:
        """Put `size` ids of `times` pieces into the next `times` sequences; what is left of them become pieces."""
        rest = length - size
        self.rows.append((length, int(self.taken[length]), size, self.sequences, offset, rest, int(self.total[rest]) if rest else 0))
        self.taken[length] += times
        self.left[length] -= times
        if rest:
            self.total[rest] += times
            self.left[rest] += times

    def repeat(self, lengths: list[int], times: int) -> None:
        at = 0
        for n in lengths:
            self.take(n, times, at, min(n, self.capacity - at))
            at += n
        self.sequences += times

    def greedy(self) -> None:
        """Fill windows from the longest piece left down, cutting one piece to close a gap, as often as the pieces last."""
        while True:
            lengths, gap, use = [], self.capacity, {}
            while gap:
                free = np.flatnonzero(self.left)
                free = free[self.left[free] > np.array([use.get(n, 0) for n in free.tolist()], dtype=np.int64)] if use else free
                if not len(free):
                    break
                i = int(np.searchsorted(free, gap, "right")) - 1
                n = int(free[i]) if i >= 0 else int(free[-1])  # the largest that fits, or the largest to be cut
                lengths.append(n)
                use[n] = use.get(n, 0) + 1
                gap -= min(n, gap)
            if gap:
                return self.close(lengths)
            self.repeat(lengths, min(int(self.left[n]) // k for n, k in use.items()))

    def close(self, lengths: list[int]) -> None:
        """What does not fill a window is parted into sequences whose lengths are powers of two: they need no padding."""
        total, lengths = sum(lengths), list(lengths)
        while total:
            room = size = 1 << total.bit_length() - 1
            while room:
                n = lengths.pop(0)
                put = min(n, room)
                self.take(n, 1, size - room, put)
                room -= put
                if n > put:
                    lengths.insert(0, n - put)
            self.sequences += 1
            total -= size


def plan(histogram: np.ndarray, capacity: int = 1024, *, depth: int = 3) -> Plan:
    """The plan for histogram[n] pieces of each length n: rounded repeats of combinations, then greedy windows.

    Repeats are rounded to whole numbers and held to the pieces left, the most frequent combination first.  All sequences but
    at most log2(capacity) + 1 last ones are full, and those have powers of two as lengths, so nothing is padded at all.
    The rows of a plan are bounded by the combinations, not by the pieces.  capacity must be a power of two.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    made = _Planner(histogram, capacity)
    if made.left.any():
        ways = combinations(capacity, depth)
        ways = ways[((ways == 0) | (histogram[ways] > 0)).all(1)]
        if len(ways):
            x = np.rint(solve(ways, histogram)).astype(np.int64)
            for j in np.argsort(-x, kind="stable")[: int((x > 0).sum())].tolist():
                w = [n for n in ways[j].tolist() if n]
                times = min(int(x[j]), *(int(made.left[n]) // w.count(n) for n in w))
                if times > 0:
                    made.repeat(w, times)
        made.greedy()
    rows = np.array(sorted(made.rows), dtype=np.int64).reshape(-1, 7).T
    return Plan(*rows, made.sequences)


def places(made: Plan, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds of (row, start within the piece, size, sequence, offset): a piece comes once for each part of it."""
    keys, row, start = made.length * RANKS + made.first, np.arange(len(length)), np.zeros(len(length), dtype=np.int64)
    while len(row):
        i = np.searchsorted(keys, length * RANKS + rank, "right") - 1
        d = rank - made.first[i]
        yield row, start, made.size[i], made.sequence[i] + d, made.offset[i]
        more = made.next_length[i] > 0
        i, d = i[more], d[more]
        row, start, length, rank = row[more], start[more] + made.size[i], made.next_length[i], made.next_first[i] + d


# ---- the operator


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, depth: int = 3, end_id: int = 0, known_words: int = WORDS) -> DataFrame:
    """All ids of all documents in sequences of `capacity` ids: (id_col, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its tokens and end_id; ids are little-endian unsigned 32-bit.  Every id lies in one piece, a sequence has no
    gaps, and all but a few last sequences, of lengths that are powers of two, are full.  A null or empty text is the id end_id;
    rows that share an id are documents each, null ids included; no rows give no rows.

    Texts are tokenised once, into a table with each piece's number among the pieces of its length in its partition.  The
    sizes of (partition, length) are summed up along the partitions, which gives a number among all pieces of the length
    without an order over them.  The histogram, at most `capacity` rows, is all that the driver sees.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    parts = tables.put(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, known_words=known_words))
    sizes = tables.put(parts.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length: at most `capacity`
        histogram[r["length"]] = r["n"]
    made = plan(histogram, capacity, depth=depth)
    rows = parts.join(base, ["part", "length"]).select(F.col(id_col).alias("k"), "doc_tokens", "start", "length", "ids", (F.col("base") + F.col("at")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank", "start"))
            ids = batch.column("ids")
            for row, at, size, sequence, offset in places(made, length, rank):
                own = pa.array([ids[r].as_py()[4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), at.tolist(), size.tolist())], pa.binary())
                index = pa.array(row)
                columns = [batch.column("k").take(index), pa.array(start[row] + at), pa.array(size), own, batch.column("doc_tokens").take(index), pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(put, f"k {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").withColumnRenamed("k", id_col)

"""Best-fit decreasing packing of token sequences."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, documents_of, per_worker, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class CapacityTree:
    """A segment tree over remaining capacities 0..limit that finds the smallest non-empty one >= x in O(log limit)."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.best = [-1] * (2 * self.size)  # the largest marked capacity below a node

    def mark(self, cap: int, on: bool) -> None:
        i = cap + self.size
        self.best[i] = cap if on else -1
        while i > 1:
            i >>= 1
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def at_least(self, x: int) -> int:
        """The smallest marked capacity >= x, or -1."""
        i = x + self.size
        if self.best[i] >= 0:
            return x
        while i > 1:
            if not i & 1 and self.best[i + 1] >= 0:
                i += 1
                while i < self.size:
                    i = 2 * i if self.best[2 * i] >= 0 else 2 * i + 1
                return self.best[i]
            i >>= 1
        return -1


def plan_bins(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Bins with equal remaining capacity are interchangeable, so runs of bins are placed at once:
    a run in the tightest fitting capacity takes ``capacity // length`` items a bin, exactly
    what item-by-item best fit does. The plan's size depends on the number of different
    lengths (<= limit), not on the number of documents.

    Rows: (length, first rank, end rank, first bin, items a bin, offset in the bin).
    """
    tree, runs, out, new = CapacityTree(limit), defaultdict(list), [], 0

    def put(cap: int, first: int, n: int) -> None:
        if cap and n:
            runs[cap].append((first, n))
            tree.mark(cap, True)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            cap = tree.at_least(length)
            if cap < 0:
                cap, first, n = limit, new, -(-left // (limit // length))
                new += n
            else:
                first, n = runs[cap].pop()
                if not runs[cap]:
                    tree.mark(cap, False)
            each = cap // length
            used = min(n, -(-left // each))
            put(cap, first + used, n - used)
            items = min(left, used * each)
            out.append((length, rank, rank + items, first, each, limit - cap))
            full, rest = divmod(items, each)
            put(cap - each * length, first, full)
            if rest:
                put(cap - rest * length, first + full, 1)
            rank, left = rank + items, left - items
    return out


_MARK = bytes(1 if 33 <= b < 127 and not chr(b).isalnum() else 0 for b in range(256))
_PAIR = re.compile(r"(?:[^\w\s]|_){2}")


class WordIds(dict):
    """Token ids, as bytes, of chunks without spaces, remembered.

    In this vocabulary a run of letters, of digits or of marks is a word of its own, and case
    doesn't count. So where no two marks stand together, full stops and commas are set apart
    and the text is lowered first, which leaves far fewer different chunks. Two generations of
    ``most`` chunks bound the memory: when the younger is full, it becomes the older one.
    """

    def __init__(self, tokenizer: str, most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.encode, self.most, self.old = Tokenizer.from_file(tokenizer).encode, most, {}

    def ids(self, text: str) -> bytes:
        if text.isascii():
            lone = b"\1\1" not in text.encode().translate(_MARK)
        else:
            lone = not _PAIR.search(text) and "\u03a3" not in text and "\u0130" not in text  # these two don't lower one by one
        if lone:
            text = text.lower().replace(".", " . ").replace(",", " , ")
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.get(chunk)
        if value is None:
            value = array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` and cut those over ``limit`` tokens: rows of PIECES.

    ``part`` and ``rank`` number the pieces of one length within a task. White space separates
    tokens in this vocabulary, so chunks between spaces are encoded once and memoised.
    """

    def make():
        ids, end = per_worker(f"ids {tokenizer}", lambda: WordIds(tokenizer)), array("I", [end_id]).tobytes()
        seen, part = defaultdict(int), TaskContext.get().partitionId()
        step = 4 * limit

        def each(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = ids.ids(text) + end
                for k, at in enumerate(range(0, len(own), step)):
                    cut = own[at:at + step]
                    n = len(cut) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"), zip(*rows))) if rows else None

        return each

    return arrow_map(documents_of(docs), PIECES, make)


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Pack whole documents into sequences of at most ``limit`` tokens by best-fit decreasing.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only texts over
    ``limit`` tokens are cut. A null or empty text is one piece of one token; repeated rows are
    packed as often as they occur; ties go by the order of the tasks; an empty table gives no rows.

    The driver sees only a histogram of at most ``limit`` lengths and the plan made from it.
    Ranks come from counts by (task, length), so a length shared by any share of the rows is
    never gathered. Tokens are made once, into a staged table.
    """
    pieces = staged(token_pieces(docs, tokenizer, limit), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.max("rank").alias("n")).select("part", "length", (F.col("n") + 1).alias("n"))
    counts = staged(counts, "counts")
    plan = plan_bins({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)
    by_length: dict[int, list] = defaultdict(list)
    for length, *row in plan:
        by_length[length].append(row)
    table = {k: np.array(v, np.int64) for k, v in by_length.items()}

    from pyspark.sql import Window as W

    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at, t = np.flatnonzero(length == n), table[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                i = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 2] + i // row[:, 3], row[:, 4] + i % row[:, 3] * n
            return {f: batch.column(i) for i, f in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))} | {"sequence_id": seq, "offset": off}

        return each

    return arrow_map(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make)

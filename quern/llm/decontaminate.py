"""Benchmark decontamination by latent semantic retrieval with an exact check of what it finds."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, documents_of, give_back, slices

_SPACES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of letters and digits (ASCII case and punctuation; other letters as they are)."""
    return text.encode("utf-8", "surrogatepass").translate(_SPACES).split()


@dataclass
class Settings:
    """window: words of a passage, made of two half windows; rank: latent dimensions; spare: random directions beyond them that
    the decomposition is made from; features: bound on the vocabulary; cosine: least latent similarity of a candidate;
    ratio: least share of an item's words in common order; answer: share of the item's end that is its answer, of which
    ``ratio`` / 2 must be there; block: benchmark items a pass, and characters of them."""

    window: int = 32
    rank: int = 64
    spare: int = 16
    features: int = 1 << 16
    cosine: float = 0.45
    ratio: float = 0.8
    answer: float = 0.25
    block: int = 20_000
    block_chars: int = 64 << 20
    seed: int = 7


def vocabulary(items: list[list[bytes]], bound: int) -> dict[bytes, int]:
    """Feature numbers of the items' words from 1 on; beyond the bound, words share numbers by hash. 0 is any other word."""
    out: dict[bytes, int] = {}
    for w in sorted({w for i in items for w in i}):
        out[w] = 1 + (len(out) if len(out) < bound - 1 else hash_of(w) % (bound - 1))
    return out


def hash_of(w: bytes) -> int:
    import zlib

    return zlib.crc32(w)


def ids_of(vocab: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(vocab.get, words, repeat(0)), np.int32, len(words))


def document_frequencies(docs: DataFrame, vocab: dict[bytes, int], half: int) -> tuple[int, np.ndarray]:
    """Number of half windows in all documents, and for each feature how many hold it."""
    size = max(vocab.values(), default=0) + 1

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            ids, starts = padded_ids(vocab, [words_of(t) for t in batch.column(0).to_pylist()], half)
            rows = np.sort(ids.reshape(-1, half), 1)
            again = np.zeros(rows.shape, bool)
            again[:, 1:] = rows[:, 1:] == rows[:, :-1]
            df = np.bincount(rows[~again], minlength=size)
            df[0] = starts[-1]
            f = np.flatnonzero(df)
            return {"f": f, "c": df[f]}

        return each

    got = arrow_map(documents_of(docs).select("text"), "f int, c long", make).groupBy("f").agg(F.sum("c").alias("c")).collect()
    df = np.zeros(size, np.int64)
    for r in got:
        df[r.f] = r.c
    return int(df[0]), df


def padded_ids(vocab: dict[bytes, int], texts: list[list[bytes]], half: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts one after the other, each filled up to whole half windows, and the half window where each begins."""
    gap, parts, starts, at = np.zeros(half, np.int32), [], [0], 0
    for words in texts:
        parts += [ids_of(vocab, words), gap[: -len(words) % half]]
        at += -(-len(words) // half)
        starts.append(at)
    return np.concatenate(parts) if parts else gap[:0], np.array(starts)


def half_vectors(ids: np.ndarray, half: int, rows: np.ndarray, block: int = 1 << 10) -> np.ndarray:
    """Latent vector of every half window: the sum of its words' rows, a block that fits in cache at a time."""
    y = np.empty((len(ids) // half, rows.shape[1]), np.float32)
    for at in range(0, len(y), block):
        own = ids[at * half:(at + block) * half]
        y[at:at + block] = rows[own].reshape(-1, half, rows.shape[1]).sum(1)
    return y


def add_by_feature(total: np.ndarray, ids: np.ndarray, y: np.ndarray, half: int, block: int = 1 << 17) -> None:
    """total[f] += the vectors of the half windows that hold f, once for each time."""
    for at in range(0, len(ids), block):
        own = ids[at:at + block]
        kept = np.flatnonzero(own)
        order = kept[np.argsort(own[kept], kind="stable")]
        f = own[order]
        rows = y[(at + order) // half]
        first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.empty(0, int)
        ones = np.ones(len(f), np.float32)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(f)]):
            total[f[a]] += ones[: b - a] @ rows[a:b]


def latent_space(docs: DataFrame, vocab: dict[bytes, int], weights: np.ndarray, items: list[list[bytes]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The ``s.rank`` leading right singular vectors (features x rank) and singular values of the TF-IDF passages, by a randomised SVD.

    One distributed pass computes A' (A G) for a random G of ``s.rank`` + ``s.spare`` columns:
    each task sums its passages' share, which is features x columns at most, and the shares are
    added by feature. :func:`truncated` makes the decomposition from it. The items' own rows are
    added with the weight of the passages, so that their directions are kept.
    """
    size, half = len(weights), s.window // 2
    rank = min(s.rank + s.spare, max(1, size - 1))
    omega = np.random.default_rng(s.seed).standard_normal((size, rank)).astype(np.float32)
    omega[0] = 0
    g = omega * weights[:, None]

    def share(texts: list[list[bytes]]) -> np.ndarray:
        total = np.zeros((size, rank), np.float32)
        ids, _ = padded_ids(vocab, texts, half)
        add_by_feature(total, ids, half_vectors(ids, half, g), half)
        return total

    def run(batches):
        total = np.zeros((size, rank), np.float32)
        for batch in batches:
            for part in slices(batch):
                total += share([words_of(t) for t in part.column(0).to_pylist()])
        f = np.flatnonzero(total.any(1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * rank), pa.array(total[f].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(f), lists], ["f", "y"])
        give_back()

    shares = documents_of(docs).select("text").mapInArrow(run, "f int, y array<float>")
    sums = shares.select("f", F.posexplode("y").alias("k", "v")).groupBy("f", "k").agg(F.sum(F.round(F.col("v").cast("double"), 3)).alias("v"))
    y = np.zeros((size, rank))
    for batch in sums.toArrow().to_batches():
        f, k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        y[f, k] = v
    own = share(items)
    norm = np.linalg.norm(y)
    both = weights[:, None] * (y + norm / max(np.linalg.norm(own), 1e-9) * own) if norm else weights[:, None] * own.astype(np.float64)
    vectors, values = truncated(both, omega.astype(np.float64), min(s.rank, max(1, size - 1)))
    return vectors.astype(np.float32), values


def truncated(y: np.ndarray, omega: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and singular values of A from Y = A'A Omega, without another pass over A.

    The Nystroem form: with Omega' Y = C'C the matrix Y C^-1 has A's right singular vectors as
    its left ones, and its singular values are A's. A small shift keeps C'C positive definite.
    """
    shift = 1e-7 * max(np.linalg.norm(y), 1e-30)
    y = y + shift * omega
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    value = np.maximum(value, 1e-12 * max(value.max(), 1e-30))
    u, sigma, _ = np.linalg.svd(y @ (vector / np.sqrt(value)), full_matrices=False)
    return u[:, :rank], np.sqrt(np.maximum(sigma[:rank] ** 2 - shift, 0))


def common_order(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Bits of the item's words that a longest common subsequence with ``words`` uses (bit-parallel; zeros are matches)."""
    v = full = (1 << n) - 1
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full & ~v


class Searcher:
    def __init__(self, items: list[tuple[int, list[bytes]]], vocab: dict[bytes, int], weights: np.ndarray, basis: np.ndarray, s: Settings):
        self.items, self.vocab, self.s = items, vocab, s
        self.rows = (basis * weights[:, None]).astype(np.float32)  # of a word in a passage
        self.rows[0] = 0
        self.half = s.window // 2
        self.masks, vectors = [], []
        for _, words in items:
            masks: dict[bytes, int] = {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
            ids = ids_of(vocab, words)
            x = self.rows[ids].sum(0)
            vectors.append(x / max(np.linalg.norm(x), 1e-9))
        self.vectors = np.array(vectors, np.float32).reshape(len(items), -1).T
        self.sizes = np.array([len(w) for _, w in items], np.int64)

    def find(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int, float, float]]:
        """(text, item, first word, end word, cosine, ratio): the best place of every item in every text that holds it."""
        ids, starts = padded_ids(self.vocab, texts, self.half)
        y = half_vectors(ids, self.half, self.rows)
        ends = starts[1:][np.diff(starts) > 0] - 1  # a text's last half window stands alone
        y[:-1] += np.where(np.isin(np.arange(len(y) - 1), ends)[:, None], 0, y[1:]) if len(y) > 1 else 0
        best: dict[tuple[int, int], tuple[float, int, int, float]] = {}
        step = max(16, (1 << 20) // max(1, len(self.items)))
        for at in range(0, len(y), step):
            part = y[at:at + step]
            cos = part @ self.vectors / np.maximum(np.linalg.norm(part, axis=1), 1e-9)[:, None]
            hit, item = np.nonzero(cos >= self.s.cosine)
            own = np.searchsorted(starts, at + hit, "right") - 1
            for d, r, k, c in zip(own.tolist(), ((at + hit - starts[own]) * self.half).tolist(), item.tolist(), cos[hit, item].tolist()):
                n, words = int(self.sizes[k]), texts[d]
                a, b = max(0, r - n // 2), min(len(words), r + self.s.window + n // 2)
                if sum(map(self.masks[k].__contains__, words[a:b])) < self.s.ratio * n:
                    continue
                got = common_order(self.masks[k], n, words[a:b])
                ratio, end = got.bit_count() / n, max(1, round(n * self.s.answer))
                if ratio >= self.s.ratio and (got >> (n - end)).bit_count() >= self.s.ratio / 2 * end:
                    best[d, k] = max(best.get((d, k), (0.0, 0, 0, 0.0)), (ratio, -a, b, c))
        return [(d, self.items[k][0], -a, b, c, x) for (d, k), (x, a, b, c) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, cosine, ratio): each document that holds a benchmark item, and where.

    A candidate is a passage (window of whole documents' words) whose latent cosine to the item
    is ``s.cosine`` or more; it counts when the longest common subsequence of the item with the
    words around has ``s.ratio`` of the item, its end (the answer) included. Every passage is
    searched; statistics and the singular space come from all passages.

    The benchmark is the stated query set: it is read in blocks of about ``s.block`` items or
    ``s.block_chars`` characters, so what a task holds is bounded however long it is. A null
    doc_id stays null. Null and empty texts hold nothing; null, empty
    or wordless items match nothing; equal items are all reported; repeated rows give repeated
    rows; an empty table on either side gives no rows; other columns are ignored.
    """
    schema = "doc_id long, item_id long, first_word long, end_word long, cosine double, ratio double"
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-total // s.block), -(-chars // s.block_chars))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        items = sorted((r.item_id, words_of(r.text)) for r in own.collect())
        items = [(i, w) for i, w in items if w]
        if not items:
            continue
        vocab = vocabulary([w for _, w in items], s.features)
        n, df = document_frequencies(docs, vocab, s.window // 2)
        weights = (np.log((n + 1) / (df + 1)) ** 2 + 0.01).astype(np.float32)  # squared: frequent words tell little about a passage
        basis, _ = latent_space(docs, vocab, weights, [w for _, w in items], s)

        def make(items=items, vocab=vocab, weights=weights, basis=basis):
            search = Searcher(items, vocab, weights, basis, s)

            def each(batch: pa.RecordBatch) -> dict:
                docs_ = batch.column(0).to_pylist()
                found = [(docs_[d], *x) for d, *x in search.find([words_of(t) for t in batch.column(1).to_pylist()])]
                cols = list(zip(*found)) or [()] * 6
                return dict(zip(("doc_id", "item_id", "first_word", "end_word", "cosine", "ratio"), cols))

            return each

        out = out.unionByName(arrow_map(documents_of(docs), schema, make))
    return out

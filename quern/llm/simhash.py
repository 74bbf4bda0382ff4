"""SimHash fingerprints, linked by a generalised pigeonhole search."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import arrow_map, documents_of, staged

BITS = 64
BLOCK = 64  # a probe group up to this size is verified pair by pair, a larger one by midpoints


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words; a shorter text is one shingle, one without words none.

    bytes.lower() folds A-Z only and bytes.split() cuts at 0x20 and 0x09-0x0D only.
    """
    return hashes_of_words(text.encode("utf-8", "surrogatepass").lower().split(), words, seed)


def hashes_of_words(w: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if not w:
        return np.empty(0, np.uint64)
    n = max(1, len(w) - words + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    return np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.uint64, n)


def majority(h: np.ndarray, block: int = 1 << 14) -> int:
    """The 64-bit word whose bit is 1 where over half of ``h`` have it."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), block):
        bits = np.unpackbits(h[at:at + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): the SimHash of each whole text; null and wordless texts get 0."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            fps = [majority(shingle_hashes(t, words, seed)) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "fp": np.array(fps, np.uint64).view(np.int64)}

        return each

    return arrow_map(documents_of(docs), "doc_id long, fp long", make)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            total = np.zeros((BITS, BITS))
            h = batch.column(0).to_numpy()
            for at in range(0, len(h), 1 << 16):
                bits = np.unpackbits(h[at:at + (1 << 16)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            return {"n": [len(h)], "both": [total.astype(np.int64).ravel()]}

        return each

    parts = arrow_map(fps.select("fp"), "n long, both array<long>", make)
    sums = parts.select("n", F.posexplode("both").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in sums:
        both[r.i] = r.c
    return (sums[0].n if sums else 0), both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the 64 bits into ``m`` partitions of near-equal size, bits that go together into the same one.

    What is redundant then sits in one place, and the partitions differ as independently as they can.
    """
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        own = [left.pop(0)]
        while len(own) < size:
            best = max(left, key=lambda b: (corr[b, own].mean(), -b))
            left.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def expected(n: int, p: np.ndarray, bits: list[int], t: int) -> float:
    """Estimated cost of a partition at threshold t: pairs within t bits there, plus the rows probed."""
    if t < 0:
        return 0.0
    dist = np.array([1.0])  # of the number of differing bits between two fingerprints
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        dist = np.convolve(dist, [1 - q, q])
    probes = sum(int(np.prod([(len(bits) - i) / (i + 1) for i in range(k)]) + 0.5) for k in range(t + 1))
    return n * (n - 1) / 2 * dist[: t + 1].sum() + n * probes


def allocate(n: int, p: np.ndarray, parts: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 at the least estimated cost, by dynamic programming.

    If two words differ in at most tau bits, some partition has at most t_i of them.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, tau + 1 - used):
                c = (cost + expected(n, p, bits, t), [*ts, t])
                if used + t + 1 not in nxt or c < nxt[used + t + 1]:
                    nxt[used + t + 1] = c
        best = nxt
    return best[tau + 1]


def plan_probes(fps: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, the cheapest over the possible numbers of partitions."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    plans = []
    for m in range(1, tau + 2):
        parts = correlated_parts(n, both, m)
        cost, ts = allocate(n, p, parts, tau)
        plans.append((cost, m, [(b, t) for b, t in zip(parts, ts) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def flips(bits: list[int], t: int) -> list[int]:
    """XOR masks that change at most ``t`` of ``bits``."""
    out, last = [0], [(0, -1)]
    for _ in range(t):
        last = [(m | 1 << bits[j], j) for m, i in last for j in range(i + 1, len(bits))]
        out += [m for m, _ in last]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(bits: list[int], t: int):
    """One row for each of :func:`flips`."""
    return F.explode(F.array(*[F.lit(signed(x)).cast("long") for x in flips(bits, t)]))


def links(fps: DataFrame, tau: int) -> DataFrame:
    """Edges (u, v) between different fingerprints that span the same components as all pairs within ``tau`` bits.

    ``fps`` has each fingerprint once. Every fingerprint is probed at its own value and, in a
    partition with threshold t, at all values within t // 2 bits, plus at all within
    t - t // 2 bits on the other side, so any pair within t bits meets. Groups of up to BLOCK
    are verified pair by pair, and only a spanning forest of the verified links is emitted.
    In a larger group every member meets the others at midpoints: two words within tau bits
    have a common word within tau // 2 bits of the one and tau - tau // 2 of the other, so a
    join on those is exact, however large the group; no group is gathered or cut.
    """
    probes = plan_probes(fps, tau)
    rows = None
    for i, (bits, t) in enumerate(probes):
        mask = signed(sum(1 << b for b in bits))
        part = fps.select("fp", masks(bits, (t + 1) // 2).alias("x")).select(F.xxhash64(F.lit(i), (F.col("fp").bitwiseXOR(F.col("x"))).bitwiseAND(F.lit(mask))).alias("key"), "fp")
        rows = part if rows is None else rows.unionByName(part)
    rows = staged(rows, "probes")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(sizes, "key")
    groups = met.where(F.col("n") <= BLOCK).groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            us, vs = [], []
            for own in batch.column(0).to_pylist():
                for u, v in forest(np.sort(np.array(own, np.int64)), tau):
                    us.append(u)
                    vs.append(v)
            return {"u": us, "v": vs}

        return each

    small = arrow_map(groups, "u long, v long", make)
    points = met.where(F.col("n") > BLOCK).select("fp").distinct().select("fp", masks(list(range(BITS)), (tau + 1) // 2).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("mid"), F.bit_count("x").alias("d"))
    low = points.where(F.col("d") <= tau // 2).groupBy("mid").agg(F.min("fp").alias("v"))
    large = points.join(low, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return small.unionByName(large).distinct()


def forest(x: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``tau`` bits."""
    left, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            j = todo.pop()
            hit = np.flatnonzero(left & (np.bitwise_count((x ^ x[j]).view(np.uint64)) <= tau))
            left[hit] = False
            out += [(int(x[k]), int(x[j])) for k in hit]
            todo += hit.tolist()
    return out


def simhash_components(docs: DataFrame, tau: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id reachable over links of ``tau`` bits.

    Null, empty and wordless texts have fingerprint 0 and link like others. Equal texts share a
    fingerprint, so copies are linked by equality and never paired; repeated doc_ids are kept
    as rows; an empty table gives no rows; other columns are ignored.
    """
    prints = staged(fingerprints(docs, words, seed), "fps")
    firsts = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = connected_components(links(firsts.select("fp"), tau))
    tied = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    tied = staged(tied, "tied")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(tied.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")

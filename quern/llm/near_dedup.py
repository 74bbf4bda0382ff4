"""Near-duplicate groups: a generalised pigeonhole search of SimHashes, min-wise samples for pairs beyond its bits, exact links."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import arrow_map, documents_of, dropped, likely, rows_by_bits, staged
from .simhash import hashes_of_words, links, majority

WIDE = 4  # 64-bit words of a document's wide fingerprint
BLOCK = 128  # members of a group that are compared in one place
ROOM = 16 << 20  # and bytes
MISS = 1e-6  # probability that a pair at the bound is not close on its wide fingerprints
SMALL = 32  # shingles below which a text gets as many bands again, of samples of two
COUNTED = 200  # shingles up to which the distribution of differing bits is counted out
_PLAIN = bytes(32 if 32 < c < 127 and not chr(c).isalnum() else c for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def plain_hashes(text: str, words: int) -> np.ndarray:
    """Hashes of the different shingles of a text's plain words: lower case, ASCII punctuation as space, so that edits of these alone change nothing."""
    return np.unique(hashes_of_words(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split(), words))


def mixed(h: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """``h`` under the k-th order; with a column of numbers, a row for each."""
    k = np.asarray(k, np.uint64)
    x = (h ^ (h >> np.uint64(29))) * _MIX[k % 4] + k * np.uint64(0x632BE59BD9B4E019)
    return (x ^ (x >> np.uint64(32))) * _MIX[(k + np.uint64(1)) % 4]


def sketch(text: str, words: int, bands: int, sample: int, room: int = 1 << 18) -> tuple[np.ndarray, bytes]:
    """``bands`` SimHashes, each of the ``sample`` smallest of the text's different shingles under its own order, and a wide one of all with their number.

    Of two small sets a sample is less likely to be the same, so texts of under SMALL shingles
    get ``bands`` more, of the two smallest.
    """
    h = plain_hashes(text, words)
    wide = b"".join(majority(mixed(h, k)).to_bytes(8, "little") for k in range(WIDE)) + len(h).to_bytes(8, "little")
    if not len(h):
        return np.zeros(bands, np.uint64), wide
    step, parts = max(1, room // len(h)), []
    for at in range(0, bands, step):
        parts.append(smallest(mixed(h, WIDE + np.arange(at, min(bands, at + step))[:, None]), sample))
    keys = majorities(np.concatenate(parts))
    if len(h) >= SMALL:
        return keys, wide
    return np.concatenate([keys, majorities(smallest(mixed(h, WIDE + np.arange(bands, 2 * bands)[:, None]), 2))]), wide


def smallest(x: np.ndarray, n: int) -> np.ndarray:
    return np.partition(x, n, 1)[:, :n] if x.shape[1] > n else x


def majorities(x: np.ndarray) -> np.ndarray:
    """The SimHash of each row: bits that over half of it have; of an even number of hashes their exclusive or, which ties don't weaken."""
    if x.shape[1] % 2 == 0:
        return np.bitwise_xor.reduce(x, 1)
    if x.shape[1] == 3:
        a, b, c = x.T
        return a & b | a & c | b & c
    return np.array([majority(r) for r in x], np.uint64)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 32, sample: int = 3, block: int = BLOCK, tau: int = 2) -> DataFrame:
    """(doc_id, group_id): group_id is the smallest doc_id that a document reaches over near-duplicate links.

    Two texts are near if the cosine of their sets of ``words``-word shingles, which is what
    SimHash estimates, is ``similarity`` or more. The candidates come from two searches.
    First, :func:`links` finds all pairs of 64-bit SimHashes within ``tau`` bits, by generalised
    pigeonhole with thresholds by dynamic programming; texts of one component are linked. That
    is exact: no such pair is lost. But at 0.8 texts differ in up to 22 bits, where partitions of
    a pigeonhole search are too short to select anything. So, for the pairs beyond ``tau``, each
    text also gets ``bands`` SimHashes of min-wise samples of its shingles; similar texts agree
    on whole words of these with probability 1 - (1 - j^sample)^bands at Jaccard similarity j,
    which is 0.64 at least: 0.9999 or more (small sets: 0.9997, computed). Texts that meet there
    count if they are close on a 256-bit SimHash of all shingles.
    How many bits may differ depends on the number of shingles (:func:`allowed`); a pair at the
    bound is lost there with ``MISS`` at most. Links of both searches together form wide groups:
    the candidates.

    Links are then exact: two texts of a wide group are linked if the cosine of their whole
    shingle sets is ``similarity`` or more, and :func:`group_roots` finds the components of all
    such pairs of a group, however large it is.

    Equal texts are collapsed first. Null and wordless texts have no shingles and are linked to
    each other; a text shorter than ``words`` words is one shingle; a repeated doc_id is kept;
    an empty table gives no rows.
    """
    own = documents_of(docs).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.crc32(F.col("text").cast("binary")).alias("t2"))
    ids = staged(own.select("doc_id", "t1", "t2"), "texts")
    firsts = ids.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"))

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            got = [sketch(t, words, bands, sample) for t in batch.column(1).to_pylist()]
            fps = [int.from_bytes(w[:8], "little", signed=True) for _, w in got]
            return {"doc_id": batch.column(0), "fp": fps, "keys": [k.view(np.int64) for k, _ in got], "wide": [w for _, w in got]}

        return each

    prints = staged(arrow_map(own.select("doc_id", "text"), "doc_id long, fp long, keys array<long>, wide binary", make), "sketches")
    reps = prints.join(firsts.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    fps = staged(reps.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n")), "fps")
    of = lambda end: fps.select(F.col("fp").alias(end), F.col("lead").alias(f"{end}_lead"))
    pairs = links(fps.select("fp"), tau).join(of("u"), "u").join(of("v"), "v").select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
    equal = reps.join(fps.where("n > 1"), "fp").where("doc_id <> lead").select(F.col("doc_id").alias("u"), F.col("lead").alias("v"))
    pairs = staged(pairs.unionByName(equal), "pairs")
    rows = reps.select("doc_id", "wide", F.posexplode("keys").alias("band", "k")).select(F.xxhash64("band", "k").alias("key"), "doc_id", F.col("wide").alias("body"))
    shared = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    rows = likely(rows, "key", rows_by_bits(shared.select("key"))).where("_likely").drop("_likely")
    limits = allowed(similarity)
    wide = group_roots(rows.withColumn("weight", F.lit(0).cast("long")), lambda bodies: close_sketches(bodies, limits, similarity), block, pairs=pairs)

    weights = rows.select("key", "doc_id").join(shared, "key").groupBy("doc_id").agg(F.sum("n").alias("weight"))
    texts = likely(own.select("doc_id", F.col("text").cast("binary").alias("body")), "doc_id", rows_by_bits(wide.select("node"))).where("_likely").drop("_likely")
    members = texts.join(wide.select(F.col("node").alias("doc_id"), F.col("root").alias("key")), "doc_id").join(weights, "doc_id", "left").select("key", "doc_id", "body", F.coalesce("weight", F.lit(0)).alias("weight"))
    roots = group_roots(members, lambda bodies: similar_texts(bodies, words, similarity), block)
    tied = firsts.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select("t1", "t2", F.coalesce("root", "first").alias("group_id"))
    out = staged(ids.join(tied, ["t1", "t2"]).select("doc_id", "group_id"), "near")
    dropped(ids, prints, fps, pairs, shared, wide, roots)
    return out


def group_roots(members: DataFrame, near: Callable[[list[bytes]], Callable[[int], np.ndarray]], block: int = BLOCK, room: int = ROOM, pairs: DataFrame | None = None) -> DataFrame:
    """(node, root), staged: components of the pairs of ``members`` (key, doc_id, body, weight) that share a key and are near.

    ``near(bodies)`` gives a function from a position to the flags of all that are near it. A
    group is compared in blocks of about ``block`` members and ``room`` bytes, each together with
    the group's heaviest member; where that leaves several parts, :func:`ties_between_parts`
    compares them. So the result is that of comparing all pairs of every group. ``pairs`` (u, v)
    are links that are known already.
    """
    sizes = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("bytes"), F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("head")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / room)).cast("int")
    met = staged(members.drop("weight").join(sizes.withColumn("blocks", blocks), "key"), "met")
    part = F.pmod(F.xxhash64("key", "doc_id"), F.col("blocks"))
    everywhere = F.when((F.col("doc_id") == F.col("head")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(part.cast("int")))
    groups = met.select("key", "doc_id", "body", F.explode(everywhere).alias("part")).groupBy("key", "part").agg(F.collect_list(F.struct("doc_id", "body")).alias("m")).where(F.size("m") > 1).select("m")

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            us, vs = [], []
            for m in batch.column(0).to_pylist():
                m = sorted({(x["doc_id"], x["body"]) for x in m})
                hits, left = near([b for _, b in m]), np.ones(len(m), bool)
                for i in range(len(m)):
                    if not left[i]:
                        continue
                    left[i], todo = False, [i]
                    while todo and left.any():
                        j = todo.pop()
                        hit = np.flatnonzero(left & hits(j))
                        left[hit] = False
                        us += [m[k][0] for k in hit]
                        vs += [m[j][0]] * len(hit)
                        todo += hit.tolist()
            return {"u": us, "v": vs}

        return each

    found = arrow_map(groups, "u long, v long", make)
    roots = staged(connected_components(found if pairs is None else found.unionByName(pairs)), "roots")
    large = met.where("blocks > 1").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    ties = ties_between_parts(large.withColumn("root", F.coalesce("root", "doc_id")), near, 8 * block, 4 * room)
    if ties.isEmpty():
        dropped(met, ties)
        return roots
    joined = connected_components(ties).select(F.col("node").alias("low"), F.col("root").alias("least"))
    known = roots.unionByName(ties.select(F.explode(F.array("u", "v")).alias("node")).select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("low"))
    out = staged(known.join(joined, "low", "left").select("node", F.coalesce("least", "low").alias("root")), "roots")
    dropped(met, ties, roots)
    return out


def ties_between_parts(members: DataFrame, near: Callable[[list[bytes]], Callable[[int], np.ndarray]], side: int, room: int) -> DataFrame:
    """(u, v): ties between the roots of ``members`` (key, doc_id, body, n, bytes, root) that share a key and are near.

    Only pairs of different roots can still change a component. So in every key that holds
    several roots, the members outside its most frequent root are compared with all members:
    in cells of at most about ``side`` members and ``room`` bytes of the ones and as many of
    the others, none gathered whole. Of a cell only a spanning forest of its roots is emitted.
    A key that is one part already costs nothing here.
    """
    counts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("body")).alias("b"))
    order = F.struct("c", "root")
    main = counts.groupBy("key").agg(
        F.max_by("root", order).alias("main"), F.count(F.lit(1)).alias("parts"), (F.sum("c") - F.max("c")).alias("rest"),
        (F.sum("b") - F.max_by("b", order)).alias("rest_bytes")).where("parts > 1")
    own = members.join(staged(main.drop("parts"), "parts"), "key").withColumn("out", F.col("root") != F.col("main"))
    places = lambda n, size: F.greatest(F.ceil(F.col(n) / side), F.ceil(F.col(size) / room)).cast("int")
    own = own.withColumn("rows", places("n", "bytes")).withColumn("cols", places("rest", "rest_bytes"))
    at = lambda total, salt: F.pmod(F.xxhash64("key", "doc_id", F.lit(salt)), F.col(total)).cast("int")
    own = own.select("key", "body", "root", "out", at("rows", 1).alias("row"), at("cols", 2).alias("col"), "rows", "cols")
    as_member = own.select("key", "body", "root", F.lit(False).alias("probe"), "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    as_probe = own.where("out").select("key", "body", "root", F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "col")
    cells = as_member.unionByName(as_probe).groupBy("key", "row", "col").agg(F.collect_list(F.struct("probe", "root", "body")).alias("m")).where(F.exists("m", lambda x: x["probe"])).select("m")

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            us, vs = [], []
            for m in batch.column(0).to_pylist():
                m = sorted({(x["root"], x["body"], x["probe"]) for x in m})
                hits, part = near([b for _, b, _ in m]), np.array([r for r, _, _ in m], np.int64)
                for i in (i for i, (_, _, probe) in enumerate(m) if probe):
                    away = part != part[i]
                    if not away.any():
                        break
                    for other in np.unique(part[away & hits(i)]).tolist():
                        us.append(max(other, int(part[i])))
                        vs.append(min(other, int(part[i])))
                        part[part == us[-1]] = vs[-1]
            return {"u": us, "v": vs}

        return each

    return staged(arrow_map(cells, "u long, v long", make).distinct(), "ties")


def close_prints(prints: list[bytes], limit: int | Callable[[int], np.ndarray]) -> Callable[[int], np.ndarray]:
    """Which wide fingerprints differ in ``limit`` bits at most (or ``limit(j)``, one for each) from the one at a position j."""
    x = np.frombuffer(b"".join(prints), np.uint64).reshape(-1, WIDE)
    return lambda j: np.bitwise_count(x ^ x[j]).sum(1) <= (limit(j) if callable(limit) else limit)


def close_sketches(bodies: list[bytes], limits: np.ndarray, similarity: float) -> Callable[[int], np.ndarray]:
    """Which wide fingerprints with sizes may be those of texts as similar as that to the one at a position.

    The bits allowed are those of the smaller set. Sets whose sizes alone rule the similarity out
    are never close, which loses nothing.
    """
    sizes = np.array([int.from_bytes(b[8 * WIDE:], "little") for b in bodies], np.int64)
    least = lambda j: np.minimum(sizes, sizes[j])
    close = close_prints([b[:8 * WIDE] for b in bodies], lambda j: limits[np.minimum(least(j), len(limits) - 1)])
    return lambda j: close(j) & (least(j) >= similarity**2 * np.maximum(sizes, sizes[j]) - 1e-9)


def similar_texts(texts: list[bytes], words: int, similarity: float) -> Callable[[int], np.ndarray]:
    """Which texts have a cosine of ``similarity`` or more, on whole shingle sets, to the one at a position."""
    sets = [plain_hashes(t.decode("utf-8", "surrogatepass"), words) for t in texts]
    sizes = np.array([len(s) for s in sets], np.int64)
    distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])

    def hits(j: int) -> np.ndarray:
        held = np.zeros(len(distinct), bool)
        held[places[at[j]:at[j + 1]]] = True
        sums = np.concatenate([[0], np.cumsum(held[places])])
        both = sums[at[1:]] - sums[at[:-1]]
        return (both >= similarity * np.sqrt(sizes * sizes[j]) - 1e-9) & ((sizes > 0) == (sizes[j] > 0))

    return hits


def differing(a: int, b: int, both: int) -> float:
    """Probability that a bit of the SimHashes of two sets of ``a`` and ``b`` random hashes, ``both`` of them shared, differs.

    The bit is set where more than half of a set's hashes have it, so a tie counts as 0.
    """
    def set_at(n: int) -> np.ndarray:
        own, ones = halves(n - both), np.arange(both + 1)
        more = np.concatenate([np.cumsum(own[::-1])[::-1], [0.0]])  # more[i]: i or more of the set's own hashes
        return more[np.clip(n // 2 + 1 - ones, 0, n - both + 1)]

    x, y = set_at(a), set_at(b)
    return float(np.sum(halves(both) * (x + y - 2 * x * y)))


@cache
def halves(n: int) -> np.ndarray:
    """The binomial distribution of n even throws."""
    return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])


def most_bits(p: float, n: int = 64 * WIDE) -> int:
    """The least number of bits that more of n bits, each different with probability p, exceed with ``MISS`` at most."""
    if p <= 0:
        return 0
    tail = 0.0
    for k in range(n, 0, -1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > MISS:
            return k
    return 0


@cache
def allowed(similarity: float) -> np.ndarray:
    """Differing bits of wide fingerprints at a cosine, by the number of shingles of the smaller set.

    For each size the worst of all larger sizes and overlaps that still give the similarity,
    from the exact distribution. The last entry holds for all larger sets: there the angle of
    the sets gives the probability, and the worst of the upper half of the counted sizes is kept.
    """
    worst = [0.0]
    for a in range(1, COUNTED + 1):
        pairs = [(b, math.ceil(similarity * math.sqrt(a * b) - 1e-9)) for b in range(a, int(a / similarity**2 + 1e-9) + 1)]
        worst.append(max(differing(a, b, both) for b, both in pairs if both <= a))
    rest = max(*worst[COUNTED // 2:], math.acos(similarity) / math.pi)
    return np.array([most_bits(p) for p in [*worst, rest]])

"""Removal of repeated byte strings by a sparse, range-partitioned suffix array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import keyed
from .shared import arrow_map, dropped, give_back, likely, rows_by_bits, staged

GRAM = 64  # bytes that decide where anchors are
STEP = 50  # windows that a block key stands for
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class Prefixes:
    """Polynomial sums of a text's bytes, from which the hash of any of its substrings follows."""

    def __init__(self):
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        self.up, self.down = powers(n, _BASE), powers(n, pow(_BASE, -1, 1 << 64))

    def sums(self, b: np.ndarray) -> np.ndarray:
        if len(b) + 1 > len(self.up):
            self.grow(1 << len(b).bit_length())
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], out=out[1:])
        return out

    def mixed(self, ends: np.ndarray, starts: np.ndarray, down: np.ndarray) -> np.ndarray:
        h = (ends - starts) * down
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


class Anchors(Prefixes):
    """For each window of ``width`` bytes: the leftmost position of its smallest GRAM-byte hash.

    Equal windows have their anchors at equal places, so a repeated string always shares
    anchors with its copies, while only about one suffix in (width - GRAM) / 2 is an anchor.
    """

    def __init__(self, width: int):
        super().__init__()
        self.width, self.span = width, width - GRAM + 1

    def of(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and anchor of each run of windows with one anchor; hash of the GRAM there."""
        sums = self.sums(b)
        h = self.mixed(sums[GRAM:], sums[:-GRAM], self.down[: len(b) - GRAM + 1])
        first, at = minima(h, self.span)
        n = len(h) - self.span + 1
        return first, np.diff(np.append(first, n)), at, h[at]


class Passages(Prefixes):
    """Hashes of strings of ``words`` / 2 words, so chosen that any two texts that share ``words`` words in a row share one of them."""

    def __init__(self, words: int):
        super().__init__()
        self.words, self.gram = words, -(-words // 2)

    def of(self, b: np.ndarray) -> np.ndarray:
        space = np.concatenate([[True], _SPACE[b], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edge[::2], edge[1::2]
        if len(starts) < self.words:
            return np.empty(0, np.uint64)
        sums, starts, ends = self.sums(b), starts[: len(starts) - self.gram + 1], ends[self.gram - 1:]
        h = self.mixed(sums[ends], sums[starts], self.down[starts]) ^ (ends - starts).astype(np.uint64)
        return np.unique(h[minima(h, self.words - self.gram + 1)[1]])


_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def minima(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of windows of ``span`` hashes with one smallest (leftmost) hash: the first window, and that hash's place."""
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(key, span) & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, least[first].astype(np.int64)


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours, from running minima of blocks forwards and backwards."""
    n = len(x) - span + 1
    padded = np.full(-(-len(x) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, span)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[span - 1:span - 1 + n])


def texts_of(docs: DataFrame) -> DataFrame:
    """(id, sub, text): a row key of id (a null one is the least number) and text hash; null texts are empty."""
    return keyed(docs.select("doc_id", "text")).select(F.col("_id").alias("id"), F.col("_sub").alias("sub"), F.coalesce("text", F.lit("")).alias("text"))


PLACE = ("id", "sub")
CTX = ("c1", "c2")  # 128-bit hash of a context: the bytes that a run of windows covers, and where its anchor is


def split_hash(h: int) -> tuple[int, int]:
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """One row per run of windows with one anchor: place, the GRAM bytes that the suffix there begins with, and a hash of all bytes the windows cover."""

    def make():
        from xxhash import xxh3_128_intdigest

        find = Anchors(width)

        def each(batch: pa.RecordBatch) -> dict:
            ids, subs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(7)]
            ctx: list[int] = []
            for doc, sub, text in zip(ids, subs, batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < width:
                    continue
                first, n, at, h = find.of(np.frombuffer(raw, np.uint8))
                view, off = memoryview(raw), (at - first).tolist()
                first, n = first.tolist(), n.tolist()
                for c, v in zip(cols, ([doc] * len(first), [sub] * len(first), first, n, off, [raw[k:k + GRAM] for k in at.tolist()], h.view(np.int64).tolist())):
                    c += v
                ctx += [xxh3_128_intdigest(view[p:p + k + width - 1], seed=o) for p, k, o in zip(first, n, off)]
            c1, c2 = zip(*map(split_hash, ctx)) if ctx else ((), ())
            return dict(zip(("id", "sub", "p", "n", "off", "head", "gram"), cols)) | {"c1": c1, "c2": c2}

        return each

    return arrow_map(texts_of(docs), "id long, sub long, p int, n int, off int, head binary, gram long, c1 long, c2 long", make)


def again(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` may occur more than once: counts are combined before a shuffle of keys alone, a bitmap spares the rest of it."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(key)
    return likely(rows, key, staged(rows_by_bits(repeated), "bits")).where("_likely").drop("_likely")


def multikey_quicksort(words: np.ndarray, least: int = 1 << 12) -> np.ndarray:
    """The order of the rows of ``words`` (rows x 64-bit words, the most significant first).

    Three-way partition by one word; rows equal there go on with the next word, the others with
    the same one. Parts of up to ``least`` rows are sorted by all words left.
    """
    order, todo = np.arange(len(words)), [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        own = order[lo:hi]
        if hi - lo <= least:
            order[lo:hi] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        x = words[own, depth]
        pivot = np.sort(x[:: max(1, len(x) // 31)])[min(31, len(x) - 1) // 2]
        low, high = x < pivot, x > pivot
        order[lo:hi] = np.concatenate([own[low], own[~low & ~high], own[high]])
        a, b = lo + int(low.sum()), hi - int(high.sum())
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def common_prefixes(words: np.ndarray) -> np.ndarray:
    """Length in bytes of the common prefix of each row and the one before; 0 for the first."""
    out = np.zeros(len(words), np.int64)
    open_ = np.arange(1, len(words))
    for k in range(words.shape[1]):
        differ = words[open_, k] ^ words[open_ - 1, k]
        ended = differ != 0
        rest = differ[ended]
        out[open_[ended]] = 8 * k + sum((rest < np.uint64(1 << 8 * j)).astype(np.int64) for j in range(1, 8))
        open_ = open_[~ended]
    out[open_] = 8 * words.shape[1]
    return out


def neighbours(contexts: DataFrame) -> DataFrame:
    """(c1, c2, copies, met): contexts with several copies, or (met) with a neighbour in suffix order that has the same leading GRAM bytes.

    ``contexts`` has (head, c1, c2, copies). Sampled splitters range-partition the suffixes by
    their leading bytes; ties are split by the rest of the key, so a frequent beginning spreads
    over many buckets. A bucket is sorted by multikey quicksort and neighbours are compared by
    the common prefix of their bytes; the ends of buckets, two rows each, are compared apart.
    """
    spark = contexts.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), contexts.count() >> 18)
    order = contexts.select("head", *CTX, "copies").repartitionByRange(n, "head", *CTX)
    schema = pa.schema([("head", pa.binary()), ("c1", pa.int64()), ("c2", pa.int64()), ("copies", pa.int64()), ("part", pa.int32()), ("kind", pa.int32())])
    kinds = ("alone", "met", "edge", "end")

    def run(batches):
        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        heads = table.column(0).to_pylist()
        words = np.frombuffer(b"".join(heads), ">u8").astype(np.uint64).reshape(len(heads), -1)
        order = multikey_quicksort(words)
        same = common_prefixes(words[order]) >= GRAM
        met = same | np.append(same[1:], False)
        ends = sorted({heads[order[0]], heads[order[-1]]})
        at_end = (words[order] == words[order[0]]).all(1) | (words[order] == words[order[-1]]).all(1)
        kind = np.where(met, 1, np.where(at_end, 2, 0))
        copies = table.column(3).to_numpy()[order]
        keep = (kind > 0) | (copies > 1)
        own = order[keep]
        head = [heads[i] if k == 2 else None for i, k in zip(own.tolist(), kind[keep].tolist())]
        c1, c2 = (table.column(i).to_numpy()[own] for i in (1, 2))
        blank, k = np.zeros(len(ends), np.int64), len(ends)
        cols = ([*head, *ends], np.append(c1, blank), np.append(c2, blank), np.append(copies[keep], blank), np.full(len(own) + k, part), np.append(kind[keep], np.full(k, 3)))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)
        del table, heads, words
        give_back()

    found = staged(order.mapInArrow(run, "head binary, c1 long, c2 long, copies long, part int, kind int"), "neighbours")
    ends = found.where(F.col("kind") == kinds.index("end")).groupBy("head").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    edge = found.where(F.col("kind") == kinds.index("edge")).join(ends, "head", "left").select(*CTX, "copies", F.col("parts").isNotNull().alias("met"))
    rest = found.where(F.col("kind") <= kinds.index("met")).select(*CTX, "copies", (F.col("kind") == kinds.index("met")).alias("met"))
    return rest.unionByName(edge).where("met or copies > 1")


def block_rows(bodies: DataFrame, width: int) -> DataFrame:
    """One row per context and block j of STEP windows: ``key`` hashes the bytes that all windows of the block share, (s1, s2) all that any of them covers."""

    def make():
        from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

        def each(batch: pa.RecordBatch) -> dict:
            rows = []
            for c1, c2, off, n, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                view, least = memoryview(body), off - n + 1  # windows start from least to off bytes before the anchor
                for j in range(least // STEP, off // STEP + 1):
                    at = off - STEP * j
                    lo, hi = max(STEP * j, least), min(STEP * j + STEP - 1, off)
                    key = xxh3_64_intdigest(view[at:at + width - STEP + 1], seed=j) - (1 << 63)
                    rows.append((key, *split_hash(xxh3_128_intdigest(view[off - hi:off - lo + width], seed=lo * 4096 + hi)), c1, c2, lo, hi))
            return dict(zip(("key", "s1", "s2", "c1", "c2", "lo", "hi"), zip(*rows))) if rows else None

        return each

    return arrow_map(bodies.select(*CTX, "off", "n", "body"), "key long, s1 long, s2 long, c1 long, c2 long, lo int, hi int", make)


def repeated_windows(bodies: DataFrame, width: int) -> DataFrame:
    """(c1, c2, qs): (first, last) windows in each context whose ``width`` bytes occur in another context too; they may overlap.

    Three sieves, each a count combined before its shuffle, nothing paired: blocks of windows
    whose common bytes occur once fall out; blocks covering equal bytes repeat as a whole, and
    one of them stands for all; only where different ones share a key are single windows
    hashed and counted.
    """
    blocks = staged(block_rows(bodies, width), "blocks")
    covers = staged(blocks.groupBy("key", "s1", "s2", "lo", "hi").agg(F.count(F.lit(1)).alias("c"), F.min("c1").alias("c1")), "covers")
    mixed = covers.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key")
    whole = covers.where("c > 1").select("key", "s1", "s2")
    torn = covers.join(mixed, "key").select("key", "s1", "s2", "c1")
    stands = blocks.join(torn.select("s1", "s2", "c1"), ["s1", "s2", "c1"]).groupBy("s1", "s2").agg(F.min(F.struct("c1", "c2", "lo", "hi")).alias("r")).select("s1", "s2", "r.*")
    wanted = stands.groupBy(*CTX).agg(F.collect_list(F.struct("s1", "s2", "lo", "hi")).alias("bs"))

    def make():
        from xxhash import xxh3_128_intdigest

        def each(batch: pa.RecordBatch) -> dict:
            rows = []
            for off, body, bs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                view = memoryview(body)
                for b in bs:
                    for left in range(b["lo"], b["hi"] + 1):
                        rows.append((*split_hash(xxh3_128_intdigest(view[off - left:off - left + width], seed=left)), b["s1"], b["s2"], left))
            return dict(zip(("w1", "w2", "s1", "s2", "left"), zip(*rows))) if rows else None

        return each

    windows = staged(arrow_map(bodies.join(wanted, list(CTX)).select("off", "body", "bs"), "w1 long, w2 long, s1 long, s2 long, left int", make), "windows")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w1", "w2")
    lefts = windows.join(again, ["w1", "w2"]).groupBy("s1", "s2").agg(F.collect_list("left").alias("lefts"))
    found = blocks.join(whole.select("s1", "s2", F.lit(True).alias("all")), ["s1", "s2"], "left").join(lefts, ["s1", "s2"], "left").where("all or lefts is not null")
    some = F.transform("lefts", lambda x: F.struct(x.alias("lo"), x.alias("hi")))
    spans = F.when(F.col("all"), F.array(F.struct("lo", "hi"))).otherwise(some)
    return found.select(*CTX, spans.alias("s")).groupBy(*CTX).agg(F.flatten(F.collect_list("s")).alias("lefts"))


def cut_bodies(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(c1, c2, off, n, body): the bytes of one place of each context."""
    cuts = places.groupBy(*PLACE).agg(F.collect_list(F.struct(*CTX, "p", "n", "off")).alias("cuts"))

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            rows = []
            for text, cs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(c["c1"], c["c2"], c["off"], c["n"], raw[c["p"]:c["p"] + c["n"] + width - 1]) for c in cs]
            return dict(zip(("c1", "c2", "off", "n", "body"), zip(*rows))) if rows else None

        return each

    bitmap = rows_by_bits(places.select("sub"))
    sources = likely(texts_of(docs), "sub", bitmap).where("_likely").join(cuts, list(PLACE))
    return arrow_map(sources.select("text", "cuts"), "c1 long, c2 long, off int, n int, body binary", make)


def repeated_spans(docs: DataFrame, width: int = 400) -> DataFrame:
    """(id, sub, spans): byte intervals [a, b) that strings of ``width`` bytes found elsewhere cover; they may overlap."""
    anchors = staged(anchor_rows(docs, width), "anchors")
    some = again(anchors, "gram")
    contexts = staged(some.groupBy(*CTX).agg(F.min("head").alias("head"), F.count(F.lit(1)).alias("copies")), "contexts")
    wanted = staged(neighbours(contexts), "wanted")
    members = staged(some.drop("head", "gram").join(wanted, list(CTX)), "members")
    dropped(anchors, contexts)
    places = staged(members.where("met").groupBy(*CTX).agg(F.min(F.struct(*PLACE, "p", "n", "off")).alias("r")).select(*CTX, "r.*"), "places")
    bodies = staged(cut_bodies(docs, places, width), "bodies")
    bad = repeated_windows(bodies, width)
    whole = F.array(F.struct(F.col("p").alias("a"), (F.col("p") + F.col("n") + width - 1).alias("b")))
    anchor = F.col("p") + F.col("off")
    some = F.transform("lefts", lambda x: F.struct((anchor - x["hi"]).alias("a"), (anchor - x["lo"] + width).alias("b")))
    copied = members.where("copies > 1").select(*PLACE, whole.alias("spans"))  # these need no join, however many they are
    single = members.where("copies = 1").join(bad, list(CTX)).select(*PLACE, some.alias("spans"))
    spans = copied.unionByName(single)
    out = staged(spans.groupBy(*PLACE).agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    dropped(wanted, members, places, bodies)
    return out


def shared_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """(id, sub, n_shared): how many of a text's chosen strings of ``words`` / 2 words another document has too.

    Texts that share ``words`` words in a row, white space included, share a chosen string; see
    :class:`Passages`. A row repeated whole is one document. Only documents with any are here.
    """

    def make():
        find = Passages(words)

        def each(batch: pa.RecordBatch) -> dict:
            found = [find.of(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in batch.column(2).to_pylist()]
            sizes = [len(f) for f in found]
            key = np.concatenate(found).view(np.int64) if found else []
            return {"id": np.repeat(batch.column(0).to_numpy(), sizes), "sub": np.repeat(batch.column(1).to_numpy(), sizes), "key": key}

        return each

    keys = staged(arrow_map(texts_of(docs), "id long, sub long, key long", make), "passages")
    row = F.xxhash64(*PLACE)
    shared = staged(keys.groupBy("key").agg(F.min(row).alias("a"), F.max(row).alias("b")).where("a <> b").select("key"), "shared")
    some = likely(keys, "key", staged(rows_by_bits(shared), "bits")).where("_likely").drop("_likely")
    out = staged(some.join(shared, "key", "left_semi").distinct().groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n_shared")), "n_shared")
    dropped(keys, shared)
    return out


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_suffixes(docs: DataFrame, width: int = 400, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept): each text's UTF-8 bytes without those that a
    ``width``-byte string covers which also starts anywhere else.

    Matches never cross documents and are judged on the input; overlapping places count.
    ``removed`` has the maximal removed runs, ``kept`` the other bytes. A null text is empty;
    texts under ``width`` bytes lose nothing; a row that is there twice, id included, is two
    places; rows without a doc_id are told apart by their texts; other columns are ignored; an
    empty table gives no rows.

    With ``passage``, n_shared follows: strings of the text, in passages of that many words,
    that another document has (:func:`shared_passages`); these are told, not removed.
    """

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            ids, texts, spans, shared = (batch.column(i).to_pylist() for i in range(4))
            runs = [merged(s or []) for s in spans]
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            kept = []
            for raw, own in zip(raws, runs):
                ends = [0, *(x for r in own for x in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
            return {"doc_id": ids, "n_bytes": [len(r) for r in raws], "n_removed": [len(r) - len(k) for r, k in zip(raws, kept)],
                    "removed": [[{"start": a, "end": b} for a, b in own] for own in runs], "kept": kept, "n_shared": shared}

        return each

    spans = repeated_spans(docs, width)
    if passage:
        own = spans.join(shared_passages(docs, passage), list(PLACE), "full")
    else:
        own = spans.withColumn("n_shared", F.lit(None).cast("long"))
    own = staged(own, "found")
    rows = likely(texts_of(docs).withColumn("doc_id", F.when(F.col("id") > -(2**63), F.col("id"))), "sub", rows_by_bits(own.select("sub")))
    none = {"spans": F.lit(None).cast(own.schema["spans"].dataType), "n_shared": F.lit(0).cast("long")}
    untouched = rows.where("not _likely").select("doc_id", "text", *[c.alias(k) for k, c in none.items()])
    touched = rows.where("_likely").join(own, list(PLACE), "left").select("doc_id", "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    out = arrow_map(untouched.unionByName(touched), "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary, n_shared long", make)
    return out if passage else out.drop("n_shared")

"""Toxicity by a weighted lexicon, matched after folding disguises."""

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, documents_of, give_back, worker_store

# Letters of other scripts that look like Latin ones, and digits or signs used for letters.
HOMOGLYPHS = dict(zip("абвгеёзіјкмнорстухѕԁһվɡαβεικνορτυχ", "abbreezijkmhopctyxsdhugabeiknoptux"))
SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi"))
# Harmless phrases that hold a lexicon word.
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "clown fish", "class clown", "sore loser", "idiot proof", "garbage collection")

STEMS = (5, 7)  # letters of a stem

_FOLD = str.maketrans(HOMOGLYPHS | {c: "" for c in "​‌‍⁠﻿­"})
_DIGIT = str.maketrans(SUBSTITUTES)


def fold(text: str) -> list[str]:
    """Words of a text: lower case, look-alike letters as Latin ones, digits between letters as letters, edge punctuation cut."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    return [unmask(w) for w in low.split()]


def terms(words: list[str]) -> set[str]:
    """What a lexicon may hold of a text: its words, and their beginnings (``stem*``) for languages that compound."""
    whole = {w for w in words if 2 < len(w) <= 40}
    return whole | {f"{w[:n]}*" for w in whole for n in STEMS if len(w) > n}


def unmask(word: str) -> str:
    w = word.strip(".,;:?\"'()[]{}|*#%_-")
    if w.isalpha():
        return w
    bare = w.rstrip("!")
    if any(c.isalpha() for c in bare):
        bare = bare.translate(_DIGIT)
    return bare


def is_held_out(doc_id: int | None) -> bool:
    """A row without an id has no label to learn from and is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def word_table(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(word, n1, n0): labelled training documents of each class that hold a word.

    At most ``sample`` labelled documents are read, those with the lowest hash of their id;
    held-out ids never are. A repeated label counts once, toxic if any says so.
    """
    train = (labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return documents_of(docs).join(F.broadcast(train), "doc_id").select("doc_id", "text", "toxic")


class Lexicon:
    """Weights of words, and a logistic curve over (weighted hits, weighted hits by length, distinct hits)."""

    def __init__(self, weights: dict[str, float], coef: tuple[float, ...]):
        import ahocorasick

        self.weights, self.coef = weights, coef
        self.automaton = ahocorasick.Automaton()
        for w, x in weights.items():
            self.automaton.add_word(f" {w[:-1]}" if w[-1] == "*" else f" {w} ", (w, x))
        for w in EXCEPTIONS:
            self.automaton.add_word(f" {w} ", (w, None))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, float, list[str]]:
        words = fold(text)
        line = f" {' '.join(filter(None, words))} "
        hits, free = [], []
        for end, (w, x) in self.automaton.iter(line):
            stop = end + 1 if w[-1] == "*" else end  # a stem's pattern ends with its last letter, a word's with the space after
            (free if x is None else hits).append((stop - len(w.rstrip("*")), stop, w))
        if free:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in free)]
        found = {w for _, _, w in hits}
        total = sum(self.weights[w] for _, _, w in hits)
        return total, total / math.sqrt(len(words) + 10), sum(max(self.weights[w], 0) for w in found), sorted(found)

    def score(self, text: str) -> tuple[float, list[str]]:
        *x, found = self.features(text)
        z = self.coef[0] + sum(c * math.tanh(v / s) for c, v, s in zip(self.coef[1:], x, SCALES))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), found


SCALES = (20.0, 2.0, 20.0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, words: int = 1024, least: float = 0.01, margin: float = 2.0) -> Lexicon:
    """Learn a lexicon from at most ``sample`` labelled documents outside the held-out quarter.

    A word or stem joins when a share of ``least`` of the toxic documents, and three of them,
    hold it and its smoothed log odds exceed ``margin``; the ``words`` heaviest by evidence stay. Without labels every score is
    that of an empty lexicon.
    """
    rows = word_table(docs, labels, sample)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for x in terms(fold(text)):
                    count = seen.setdefault(x, [0, 0])
                    count[0] += toxic
                    count[1] += 1
            return {"word": list(seen), "n1": [a for a, _ in seen.values()], "n": [b for _, b in seen.values()]}

        return each

    table = arrow_map(rows, "word string, n1 long, n long", make).groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    sizes = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n1, n0 = (next((r.n for r in sizes if r.toxic == k), 0) for k in (1, 0))
    odds = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n") - F.col("n1") + 0.5) / F.lit(n0 + 1.0))
    top = (table.where(F.col("n1") >= max(3, least * n1)).select("word", "n1", odds.alias("w")).where(F.col("w") > margin)
           .orderBy(F.desc(F.col("w") * F.sqrt("n1")), "word").limit(words).collect())
    raw = Lexicon({r.word: float(r.w) for r in top}, (0.0, 0.0, 0.0, 0.0))

    def make_features():
        def each(batch: pa.RecordBatch) -> dict:
            x = [raw.features(t)[:3] for t in batch.column(1).to_pylist()]
            return dict(zip("abc", zip(*x))) | {"y": batch.column(2)} if x else None

        return each

    table = arrow_map(rows, "a double, b double, c double, y int", make_features).toArrow()
    got = np.column_stack([table[c].to_numpy() for c in "abcy"]) if table.num_rows else np.zeros((0, 4))
    return Lexicon(raw.weights, tuple(fit(np.tanh(got[:, :3] / np.array(SCALES)), got[:, 3])))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; deterministic for any order of rows up to rounding."""
    x = np.column_stack([np.ones(len(x)), x])
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (y - p) - ridge * c
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c)), grad)
        c = c + step
        if abs(step).max() < 1e-9:
            break
    return np.round(c, 9)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) for every row; null and empty texts score like a text without hits.

    One scan without a shuffle; repeated rows get equal scores; a null doc_id stays null and is
    not held out; other columns are ignored; an empty table gives no rows.
    """
    weights, coef = lexicon.weights, lexicon.coef

    def make():
        own = Lexicon(weights, coef)

        def each(batch: pa.RecordBatch) -> dict:
            ids = batch.column(0).to_pylist()
            got = [own.score(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": ids, "held_out": [is_held_out(i) for i in ids], "score": [s for s, _ in got],
                    "predicted": [int(s >= cut) for s, _ in got], "hits": [",".join(h) for _, h in got]}

        return each

    return arrow_map(documents_of(docs), "doc_id long, held_out boolean, score double, predicted int, hits string", make)


def score_column(lexicon: Lexicon) -> Callable[[Column], Column]:
    """The score as a function of a text column, for filters that keep all other columns; a null text scores like an empty one."""
    weights, coef = lexicon.weights, lexicon.coef

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_store().clear()
        own = Lexicon(weights, coef)
        for texts in batches:
            yield pa.array([own.score(t or "")[0] for t in texts.to_pylist()], pa.float64())
        give_back()

    return score

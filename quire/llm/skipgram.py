"""Skip-gram vectors with negative sampling (Mikolov et al.), trained from counts of word pairs.

The pairs are counted over all texts by Spark; as the objective depends on the pairs only through their counts, training draws pairs
by count, so many for each word. Words and pairs take part by their count alone, at any amount of text: none is left out by its rank or by
its share of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, key

#: A word has a vector if it is seen so often, a pair counts if it is.
LEAST, LEAST_PAIR = 6, 2
SIZE = 32
WINDOW = 2
#: Pairs drawn for each word, and at least.
DRAWS, LEAST_DRAWS = 400, 1_500_000
BATCH = 2048
NEGATIVES = 48
RATE = 0.05
#: A word moves by at most so many draws' steps a batch, else the few words of a small vocabulary would run away.
STEPS = 16
#: Vectors in a batch that goes back.
ROWS = 10_000


def _pairs(ids: Words, words_of):  # noqa: ANN001, ANN202
    base = len(ids) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat: list[int] = []
            for lines in b.column(0).to_pylist():
                flat += [ids.get(w, 0) for w in words_of(lines)]
                flat += [0] * WINDOW
            x = np.array(flat, np.int64)
            keys = []
            for k in range(1, WINDOW + 1):
                a, c = x[:-k], x[k:]
                ok = (a > 0) & (c > 0)
                keys.append(a[ok] * base + c[ok])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return run


def _add(m: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """m[at] += x, with repeated places added up; several times as fast as ``np.add.at``."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    m[at[first]] += np.add.reduceat(x[order], first, axis=0)


def train(units: DataFrame, words: list[tuple[str, int]], words_of, seed: int = 1) -> Words | dict:  # noqa: ANN001
    """Unit vectors of words, given with their counts. units: one column of lines; words_of makes words of the lines of a row."""
    words = sorted(((w, n) for w, n in words if n >= LEAST), key=lambda w: (-w[1], w[0]))
    return vectors(units, np.array([key(w) for w, _ in words], np.uint64), np.array([n for _, n in words], np.int64), words_of, seed)


def vectors(units: DataFrame, keys: np.ndarray, counts: np.ndarray, words_of, seed: int = 1) -> Words | dict:  # noqa: ANN001
    """As train, with words given by their hashes, the most frequent first."""
    if not len(keys):
        return {}
    ids = Words(keys, np.arange(1, len(keys) + 1))
    # Pairs seen once say nothing. One task trains on the pairs, where the numeric library has one thread; only the vectors
    # come to the driver.
    rows = units.mapInArrow(_pairs(ids, words_of), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAIR)
    found = rows.repartition(1).mapInArrow(_trained(counts, seed), "id int, vector array<float>").toArrow()
    if not found.num_rows:
        return {}
    v = np.concatenate([c.flatten().to_numpy() for c in found.column("vector").chunks]).reshape(-1, SIZE)
    return Words(keys[found.column("id").to_numpy() - 1], v)


def _trained(counts: np.ndarray, seed: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in b.columns], axis=1) for b in batches if b.num_rows]
        if held:
            rows = np.concatenate(held)
            v = _fit(rows[np.argsort(rows[:, 0], kind="stable")], counts, seed)
            for at in range(1, len(v), ROWS):
                x = v[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x)), pa.int32()), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "vector"])

    return run


def _fit(rows: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    base = len(counts) + 1
    draws = max(LEAST_DRAWS, DRAWS * base)
    rng = np.random.default_rng(seed)
    pair, n = rows[:, 0], rows[:, 1].astype(float)
    share = np.array([0.0, *counts])
    common = np.sqrt(np.minimum(1, 1e-3 * share.sum() / np.maximum(share, 1)))  # frequent words are drawn less
    weight = n * common[pair // base] * common[pair % base]
    drawn = rng.choice(pair, draws, p=weight / weight.sum())
    swap = rng.random(draws) < 0.5
    word, context = np.where(swap, drawn % base, drawn // base), np.where(swap, drawn // base, drawn % base)
    noise = share**0.75 / (share**0.75).sum()
    negatives = rng.choice(base, (draws // BATCH + 1, NEGATIVES), p=noise)
    v = (rng.random((base, SIZE)) - 0.5).astype(np.float32) / SIZE
    u = np.zeros((base, SIZE), np.float32)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -8, 8)))
    for step, at in enumerate(range(0, draws, BATCH)):
        rate = np.float32(RATE * (1 - at / draws) + 1e-4)
        w, c, neg = word[at : at + BATCH], context[at : at + BATCH], negatives[step]
        vw, uc, un = v[w], u[c], u[neg]
        slow_w, slow_c = (np.minimum(1, STEPS / np.bincount(x, minlength=base)[x]).astype(np.float32)[:, None] for x in (w, c))
        g = (1 - sigmoid((vw * uc).sum(1)))[:, None]
        gn = -sigmoid(vw @ un.T) * (5 / NEGATIVES)  # shared by the batch, weighing as five a pair
        _add(u, c, rate * g * slow_c * vw)
        _add(u, neg, rate * min(1.0, STEPS * NEGATIVES / 5 / BATCH) * (gn.T @ vw))
        _add(v, w, rate * slow_w * (g * uc + gn @ un))
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)

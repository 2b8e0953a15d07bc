"""Near copies by a chosen-path similarity join (Christiani and Pagh; Christiani, Pagh and Sivertsen).

Texts of one word sequence are one class. Each class gets 64 minwise tokens of its word n-grams. A tree branches the
classes by the tokens at coordinates it selects: a node holds those that agree on all coordinates of its path. Nodes of
at most LIMIT classes are compared exhaustively, by 4 bits of each token; larger ones are branched further, by three more
coordinates. Independent trees are repeated until pairs at the threshold are found with probability RECALL. Nodes
still large at the deepest level hold texts that are mostly alike; they are compared block by block. All pairs that pass
the comparison of tokens are verified on their texts.

Large nodes are known from counts aggregated before any shuffle of their members, so no node beyond LIMIT is ever in one task.

Defined cases: null and short texts (fewer than ``least_words`` words) are in no pair; redelivered copies of an id count once; texts of
one word sequence (a class) are linked all to all if the class has at most STAR members, else to the smallest id of the class, as
are pairs between classes; ``classes`` gives every member. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TOKENS = 64
LIMIT = 300
#: Coordinates by which a large node is branched further, and how often.
BRANCH = 3
LEVELS = 3
RECALL = 0.985
#: How alike two unlike texts are on average, at most; only the first depth and the number of trees depend on it.
BACKGROUND = 0.05
STAR = 64
#: Large nodes and repeated classes are broadcast up to this count (about 50 MB), beyond it they are joined by shuffle.
BROADCAST_NODES = 500_000

_WORD = re.compile(r"[^\W_]+")
_SEED = np.random.default_rng(20240607)
_MULTIPLY = _SEED.integers(0, 2**32, TOKENS, np.uint32) | np.uint32(1)
_ADD = _SEED.integers(0, 2**32, TOKENS, np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def minwise(texts: list[list[str]], n: int) -> np.ndarray:
    """(len(texts), TOKENS) minwise tokens of the word n-grams, in 16 bits: two unlike tokens agree once in 65,536. Every text has n words or more."""
    length = np.array([len(t) for t in texts])
    w = np.fromiter((_HASHES[x] for t in texts for x in t), np.uint64, int(length.sum()))
    grams = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        grams = grams * _MIX + w[k : len(w) - n + 1 + k]
    ends = np.cumsum(length)
    inside = np.ones(len(w), bool)
    for k in range(1, n):
        inside[ends - k] = False
    x = (_mixed(grams[inside[: len(grams)]]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(length - n + 1) - (length - n + 1)
    out = np.empty((len(texts), TOKENS), np.uint16)
    for i in range(TOKENS):
        least = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], starts)
        out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)  # a minimum is small: its lower bits tell it from others
    return out


def _fixed(a: np.ndarray, width: int) -> pa.Array:
    """Rows of bytes as a binary column."""
    data = np.ascontiguousarray(a)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def _bytes(c: pa.Array, width: int) -> np.ndarray:
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    start = np.frombuffer(c.buffers()[1], np.int32)[c.offset] if len(c) else 0
    return np.frombuffer(c.buffers()[2], np.uint8)[start : start + width * len(c)].reshape(-1, width) if len(c) else np.empty((0, width), np.uint8)


def _signed(n: int, least_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                texts = [words(t) for t in b.column(1).to_pylist()]
                keep = [i for i, t in enumerate(texts) if len(t) >= max(n, least_words)]
                if not keep:
                    continue
                texts = [texts[i] for i in keep]
                cls = np.array([xxhash.xxh64_intdigest(" ".join(t)) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(cls), _fixed(minwise(texts, n), 2 * TOKENS)], names=["id", "cls", "minwise"])

    return run


def _order(tree: int) -> list[int]:
    """The coordinates that a tree selects, in order."""
    return np.random.default_rng(1000 + tree).permutation(TOKENS).tolist()


def _extended(k: np.ndarray, token: np.ndarray, c: int) -> np.ndarray:
    """The keys of nodes whose path goes on by the token at coordinate c."""
    return _mixed(k * _MIX + token + np.uint64(c << 40))


def _sketch(m: np.ndarray) -> np.ndarray:
    """4 bits of each token, 16 tokens a column."""
    low = (m ^ (m >> np.uint16(5))).astype(np.uint8) & 15
    return np.ascontiguousarray(low[:, ::2] | (low[:, 1::2] << 4)).view(np.int64)


_SKETCH = [f"s{i}" for i in range(TOKENS // 16)]


def _sketches(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in _SKETCH], axis=1).view(np.uint64)


def _minwise(c: pa.Array) -> np.ndarray:
    return _bytes(c, 2 * TOKENS).copy().view(np.uint16)


#: Tokens that a member of a large node takes along: those its tree branches by further down.
_REST = BRANCH * LEVELS
_COLUMNS = {"nodes": ["node"], "compared": ["node", "cls", *_SKETCH], "members": ["node", "tree", "cls", "rest", *_SKETCH]}
_TYPES = {"node": "long", "tree": "int", "cls": "long", "rest": "binary", **dict.fromkeys(_SKETCH, "long")}


def _schema(what: str) -> str:
    return ", ".join(f"{c} {_TYPES[c]}" for c in _COLUMNS[what])


def _rooted(trees: int, first: int, what: str):  # noqa: ANN202
    """Every class in the first node of each tree, with the columns of ``what``. Rows are (cls, minwise)."""
    orders = [_order(t) for t in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8000):
                b = whole.slice(at, 8000)
                m = _minwise(b.column(1))
                own = {"cls": b.column(0)} | ({} if what == "nodes" else dict(zip(_SKETCH, map(pa.array, _sketch(m).T.copy()))))
                for t, path in enumerate(orders):
                    k = np.full(len(m), t + 1, np.uint64)
                    for c in path[:first]:
                        k = _extended(k, m[:, c], c)
                    own["node"] = pa.array(k.view(np.int64))
                    if what == "members":
                        own |= {"tree": pa.array(np.full(len(m), t, np.int32)), "rest": _fixed(m[:, [path[(first + i) % TOKENS] for i in range(_REST)]], 2 * _REST)}
                    yield pa.RecordBatch.from_arrays([own[c] for c in _COLUMNS[what]], names=_COLUMNS[what])

    return run


def _branched(level: int, what: str):  # noqa: ANN202
    """Members of large nodes in those nodes' children, with the columns of ``what``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                b = whole.slice(at, 20_000)
                own = dict(zip(b.schema.names, b.columns))
                node, rest = own["node"].to_numpy().view(np.uint64), _bytes(own["rest"], 2 * _REST).copy().view(np.uint16)
                for child in range(BRANCH):
                    i = level * BRANCH + child
                    own["node"] = pa.array(_extended(node, rest[:, i], TOKENS + i).view(np.int64))
                    yield pa.RecordBatch.from_arrays([own[c] for c in _COLUMNS[what]], names=_COLUMNS[what])

    return run


# A pair passes if so many of the tokens agree in 4 bits: three standard deviations below what the threshold makes likely.
def _agreeing(threshold: float) -> int:
    p = threshold + (1 - threshold) / 16
    return math.floor(TOKENS * p - 3.2 * math.sqrt(TOKENS * p * (1 - p)))


def _similar(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return TOKENS - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64) >= least


def _compare_runs(key: np.ndarray, cls: np.ndarray, sketch: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within equal keys; rows are sorted by key."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    for m in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        starts = first[size == m]
        step = max(1, 400_000 // len(i))
        for at in range(0, len(starts), step):
            s = starts[at : at + step, None]
            a, b = (s + i).ravel(), (s + j).ravel()
            ok = _similar(sketch[a], sketch[b], least)
            a, b = cls[a[ok]], cls[b[ok]]
            yield np.minimum(a, b), np.maximum(a, b)


def _compared(least: int):  # noqa: ANN202
    """Pairs of the same node; rows come sorted by node, a node has a bounded number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def work(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n
            node, cls, sketch = (np.concatenate(x) for x in zip(*held))
            cutoff = len(node) if end else int(np.searchsorted(node, node[-1]))
            held[:] = [(node[cutoff:], cls[cutoff:], sketch[cutoff:])]
            n = len(node) - cutoff
            for a, b in _compare_runs(node[:cutoff], cls[:cutoff], sketch[:cutoff], least):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _sketches(b)))
                n += b.num_rows
            if n >= 100_000:
                yield from work(False)
        if held:
            yield from work(True)

    return run


def _blocks(least: int):  # noqa: ANN202
    """Pairs of one block with itself or another: side 0 against side 1, or side 0 with itself."""

    def run(f: pa.Table) -> pa.Table:
        cls, sketch, side = f.column("cls").to_numpy(), _sketches(f), f.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, i in enumerate(left):
            others = right if len(right) else left[k + 1 :]
            hit = others[_similar(sketch[i], sketch[others], least)]
            out_a.append(np.minimum(cls[i], cls[hit]))
            out_b.append(np.maximum(cls[i], cls[hit]))
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_NODES else df


def survival(threshold: float, levels: int = LEVELS) -> float:
    """The chance that a pair of that similarity in a node is together in one at least of its descendants, so many levels down."""
    q = 1.0
    for _ in range(levels):
        q = 1 - (1 - threshold * q) ** BRANCH
    return q


def candidates(unique: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b; a < b) distinct pairs of classes whose tokens agree enough. unique: (cls, minwise), n of them about.

    Every class is put into the first nodes of each tree; only members of nodes larger than LIMIT go further down, with
    their tokens, so a level costs as much as there are such members.
    """
    first = max(2, round(math.log(max(n, LIMIT) / LIMIT) / -math.log(BACKGROUND)))
    chance = threshold**first * survival(threshold)
    trees = math.ceil(math.log(1 - RECALL) / math.log(1 - chance))
    least = _agreeing(threshold)
    found, members = None, None

    def made(what: str) -> DataFrame:
        return unique.mapInArrow(_rooted(trees, first, what), _schema(what)) if members is None else members.mapInArrow(_branched(level - 1, what), _schema(what))

    for level in range(LEVELS + 1):
        larger = cut(made("nodes").groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > LIMIT).select("node"))
        n_large = larger.count()
        large = _small(larger, n_large)
        full = made("compared")
        small = full.join(large, "node", "left_anti") if n_large else full
        pairs = small.repartition("node").sortWithinPartitions("node").mapInArrow(_compared(least), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if not n_large:
            return found.distinct()
        if level < LEVELS:
            members = cut(made("members").join(large, "node", "left_semi"))
    # What is left is alike to the last coordinate: block against block, each pair of blocks a group of its own.
    rest = full.join(large, "node", "left_semi")
    blocks = rest.groupBy("node").agg(F.ceil(F.count("*") / LIMIT).cast("int").alias("g"))
    rest = rest.join(blocks, "node").withColumn("i", F.expr("cast(pmod(xxhash64(cls, 7), g) AS int)"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "node", F.least("i", "other").alias("x"), F.greatest("i", "other").alias("y"), (F.col("i") > F.col("other")).cast("int").alias("side"), "cls", *_SKETCH
    )
    return found.unionByName(rest.groupBy("node", "x", "y").applyInArrow(_blocks(least), "a long, b long")).distinct()


def _verified(n: int, threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[str, set] = {}
            keep, score = [], []
            for i, (s, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                for text in (s, t):
                    if text not in sets:
                        w = words(text)
                        sets[text] = set(zip(*(w[k:] for k in range(n))))
                common = len(sets[s] & sets[t])
                j = common / (len(sets[s]) + len(sets[t]) - common)
                if j >= threshold:
                    keep.append(i)
                    score.append(j)
            k = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return run


class Join:
    """The join over a table of (id string, text string): ``members`` (id, cls), ``classes`` and ``links``."""

    def __init__(self, texts: DataFrame, n: int = 5, threshold: float = 0.8, least_words: int = 5) -> None:
        self.texts, self.n, self.threshold = texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text"), n, threshold
        self.signed = cut(self.texts.mapInArrow(_signed(n, least_words), "id string, cls long, minwise binary"))
        repeated = cut(self.signed.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls"))
        some = repeated.count()
        side = _small(repeated, some)
        once = self.signed.select("cls", "minwise")
        self.unique = once.join(side, "cls", "left_anti").unionByName(once.join(side, "cls", "left_semi").groupBy("cls").agg(F.first("minwise").alias("minwise")))
        self.members = cut(self.signed.select("id", "cls").distinct())
        self.classes = cut(self.members.groupBy("cls").agg(F.min("id").alias("representative"), F.count("*").alias("size")))

    def links(self) -> DataFrame:
        """(a, b, similarity): verified pairs of different classes."""
        pairs = cut(candidates(self.unique, self.signed.count(), self.threshold))
        of = cut(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct().join(self.classes, "cls").select("cls", F.col("representative").alias("id")))
        # only the texts of candidates travel, each once
        text = cut(self.texts.join(_small(of, of.count()), "id").select("cls", "text").dropDuplicates(["cls"]))
        x = pairs.join(text.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        return x.select("a", "b", "text_a", "text_b").mapInArrow(_verified(self.n, self.threshold), "a long, b long, similarity double")

    def pairs(self) -> DataFrame:
        """(id_a, id_b; id_a < id_b): members of linked classes and of one class; classes beyond STAR members by their representative."""
        several = self.classes.where(f"size > 1 AND size <= {STAR}").select("cls").join(self.members, "cls")
        ends = self.classes.where(f"size = 1 OR size > {STAR}").select("cls", F.col("representative").alias("id")).unionByName(several)
        across = self.links().join(ends.select(F.col("cls").alias("a"), F.col("id").alias("id_a")), "a").join(ends.select(F.col("cls").alias("b"), F.col("id").alias("id_b")), "b").select("id_a", "id_b")
        within = several.select("cls", F.col("id").alias("id_a")).join(several.select("cls", F.col("id").alias("id_b")), "cls").where("id_a < id_b").select("id_a", "id_b")
        large = self.classes.where(F.col("size") > STAR)
        star = self.members.join(F.broadcast(large) if large.count() <= BROADCAST_NODES else large, "cls").where("id <> representative").select(F.col("representative").alias("id_a"), F.col("id").alias("id_b"))
        both = across.unionByName(within).unionByName(star)
        return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()

    def class_links(self) -> DataFrame:
        """(class_a, class_b, similarity; class_a < class_b): verified pairs of different classes by their smallest ids; none is left out, whatever the classes' sizes."""
        c = self.classes
        x = self.links().join(c.select(F.col("cls").alias("a"), F.col("representative").alias("ra")), "a").join(c.select(F.col("cls").alias("b"), F.col("representative").alias("rb")), "b")
        return x.select(F.least("ra", "rb").alias("class_a"), F.greatest("ra", "rb").alias("class_b"), "similarity").distinct()

    def report(self) -> DataFrame:
        """(id, class_id, class_size, n_links): every text with its class and the number of other classes it is linked to."""
        links = self.links()
        degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
        info = self.classes.join(degree, "cls", "left").select("cls", "representative", "size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return self.members.join(info, "cls").select("id", F.col("representative").alias("class_id"), F.col("size").alias("class_size"), "n_links")

"""Nearest vectors by cosine, exact, and a default embedding of words by their hash.

Defined cases: null vectors, and vectors of length 0 or of another size than the query's, are never near; equal distances
go by id. The query vectors are a stated set and are compared in blocks, never joined pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIMENSIONS = 64
#: Query vectors compared at once; a longer list of queries is worked off in so many passes over the vectors.
QUERY_BLOCK = 4096
#: Vectors compared at once with a block of queries.
ROWS = 2048


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], top: int, key: str = "chunk_id") -> DataFrame:
    """(key, distance) of the ``top`` nearest vectors: one pass, a top-k in each partition and one of their results."""
    q = F.array(*(F.lit(float(x)) for x in query))
    x = vectors.where((F.size("embedding") == len(query)) & (dot("embedding", "embedding") > 0))
    return x.select(key, (1 - cosine("embedding", q)).alias("distance")).orderBy("distance", key).limit(top)


def _matrix(c: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix, without a Python object for each number."""
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _blocked(ids: np.ndarray, q: np.ndarray, groups: list, top: int):  # noqa: ANN202
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    own = pa.array(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_d = np.full((len(ids), 0), np.inf)
        held_k = np.zeros((len(ids), 0), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                v, keys = _matrix(b.column(1), unit.shape[1]), b.column(0).to_numpy()
                norm = np.linalg.norm(v, axis=1)
                ok = norm > 0
                d = 1 - unit @ (v[ok] / norm[ok, None]).T
                if b.num_columns > 2:
                    # each query among the vectors of its own group only; a null group is no group
                    code = {g: i for i, g in enumerate(dict.fromkeys(own.to_pylist()))}
                    theirs = np.array([code.get(g, -1) if g is not None else -1 for g in b.column(2).to_pylist()])[ok]
                    mine = np.array([code[g] if g is not None else -2 for g in own.to_pylist()])
                    d[mine[:, None] != theirs[None, :]] = np.inf
                held_d, held_k = np.hstack([held_d, d]), np.hstack([held_k, np.broadcast_to(keys[ok], d.shape)])
                if held_d.shape[1] > top:
                    order = np.lexsort((held_k, np.round(held_d, 12)), axis=1)[:, :top]
                    held_d, held_k = np.take_along_axis(held_d, order, 1), np.take_along_axis(held_k, order, 1)
        found = np.isfinite(held_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], found.shape)[found]), pa.array(held_k[found]), pa.array(held_d[found])], names=["query_id", "id", "distance"])

    return run


def nearest_to_each(vectors: DataFrame, queries: DataFrame, top: int, within: str | None = None) -> DataFrame:
    """(query_id, id, distance, place): the ``top`` nearest of all vectors (id long, embedding) to each query (query_id long, embedding).

    within: a column of both; each query is then compared with the vectors of its own value only. The queries, a stated set, come to
    the driver in blocks of QUERY_BLOCK, by ranges of their id; each block is compared with every vector by a matrix product a batch, and
    a partition sends its own top only.
    """
    q = queries.where("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", "embedding", *([within] if within else []))
    v = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding", *([within] if within else []))
    out, last = None, None
    while True:
        block = (q if last is None else q.where(F.col("query_id") > last)).orderBy("query_id").limit(QUERY_BLOCK).collect()
        for w in sorted({len(r.embedding) for r in block} - {0}):
            part = [r for r in block if len(r.embedding) == w and any(r.embedding)]
            if part:
                near = _blocked(np.array([r.query_id for r in part]), np.array([r.embedding for r in part], float), [r[within] if within else None for r in part], top)
                x = v.where(F.size("embedding") == w).mapInArrow(near, "query_id long, id long, distance double")
                out = x if out is None else out.unionByName(x)
        if len(block) < QUERY_BLOCK:
            break
        last = block[-1].query_id
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double, place int")
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id)")
    return out.withColumn("place", place).where(F.col("place") <= top)


def embed(c: str | Column) -> Column:
    """A deterministic vector of length 1 from the words of a text: each word adds 1 or -1 at a place given by its hash; zero if it has none."""
    h = F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(w))
    raw = F.aggregate(h, F.array_repeat(F.lit(0.0), DIMENSIONS), lambda v, x: F.transform(v, lambda y, i: F.when(i == F.pmod(x, F.lit(DIMENSIONS)), y + F.when(F.pmod(F.shiftright(x, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(y)))
    norm = F.sqrt(dot(raw, raw))
    return F.when(norm > 0, F.transform(raw, lambda y: y / norm)).otherwise(raw)


def metadata(filter_: dict | None) -> Column:
    """A small filter language, {"field": value}, {"field": {"$gte": value}} and {"$and": [...]}, as a condition."""
    out = F.lit(True)
    for k, v in (filter_ or {}).items():
        if k == "$and":
            for part in v:
                out = out & metadata(part)
        elif isinstance(v, dict):
            ops = {"$gte": lambda c, x: c >= x, "$lte": lambda c, x: c <= x, "$gt": lambda c, x: c > x, "$lt": lambda c, x: c < x, "$eq": lambda c, x: c == x, "$ne": lambda c, x: c != x, "$in": lambda c, x: c.isin(x)}
            for op, x in v.items():
                out = out & ops[op](F.col(k), x)
        else:
            out = out & (F.col(k) == v)
    return out

"""Which hashes may occur more than once, by Bloom filters merged over partitions.

The filter is cut into segments of 65,536 bits, and all bits of a hash lie in one segment. Every partition makes two filters,
of hashes it saw at all and of hashes it saw twice, and sends, for each segment, their places as 16-bit numbers (at most
2 bytes for each bit of a row, far less than the rows). A segment's filters are merged in any order: a bit is repeated
if it is repeated in a part, or set in two parts. A merged segment is 8 KB of bits. Rows are tested where they are: the
segments are broadcast in rounds of at most ROUND segments, a fixed 64 MB, and each round tests the rows of its segments. A hash
is a possible repeat if all its bits are repeated: there are no false negatives, and false positives only cost their
shuffle. Only possible repeats leave their partition, at any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

HASHES = 2
SEGMENT = 1 << 16
#: Bits a row; the filter has the next power of two.
BITS_A_ROW = 8
#: Rows after which a long partition sends a filter and starts another.
FLUSH = 4_000_000
#: Segments broadcast at a time.
ROUND = 8192

_PARTS = pa.schema([("segment", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def n_segments(n: int) -> int:
    return max(1, 1 << (max(1, n) * BITS_A_ROW // SEGMENT).bit_length())


def _segment(segments: int) -> str:
    """SQL of the segment of the 64-bit column ``hash``."""
    return f"pmod(hash, {segments}L)"


def _bit(k: int) -> str:
    """SQL of the place of the k-th bit of ``hash`` in its segment."""
    return f"cast(pmod(xxhash64(hash, {k}), {SEGMENT}L) AS int)"


def _by_segment(positions: np.ndarray) -> dict[int, bytes]:
    positions = np.unique(positions)
    segment = positions // SEGMENT
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(positions) else []
    low = (positions % SEGMENT).astype("<u2")
    return {int(segment[a]): low[a:b].tobytes() for a, b in zip(first, [*first[1:], len(positions)])}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        held.clear()
        _, first, n = np.unique(rows[:, 0], return_index=True, return_counts=True)
        places = rows[:, 1:2] * SEGMENT + rows[:, 2:]
        once = _by_segment(places[first].ravel())
        twice = _by_segment(places[first[n > 1]].ravel())
        keys = list(once)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([once[k] for k in keys], pa.binary()), pa.array([twice.get(k, b"") for k in keys], pa.binary())], schema=_PARTS)

    for b in batches:
        if b.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
        if sum(map(len, held)) >= FLUSH:
            yield from flush()
    if held:
        yield from flush()


def _merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts come sorted by segment; at most one segment is open."""
    segment, once, twice = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)

    def end() -> Iterator[pa.RecordBatch]:
        if segment is not None and twice.any():
            bits = np.packbits(twice, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([bits], pa.list_(pa.int64()))], names=["segment", "bits"])

    for b in parts:
        for s, a, t in zip(*(c.to_pylist() for c in b.columns)):
            if s != segment:
                yield from end()
                segment = s
                once[:] = twice[:] = False
            a, t = np.frombuffer(a, "<u2"), np.frombuffer(t, "<u2")
            twice[a[once[a]]] = True
            twice[t] = True
            once[a] = True
    yield from end()


def repeated_bits(hashes: DataFrame, segments: int) -> DataFrame:
    """(segment, bits array<long>) of the segments with repeated bits, from a column ``hash``."""
    p = hashes.where("hash IS NOT NULL").selectExpr("hash", f"{_segment(segments)} segment", *(f"cast({_bit(k)} AS long) b{k}" for k in range(HASHES)))
    parts = p.mapInArrow(_parts, "segment long, once binary, twice binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment long, bits array<long>")


def possible_repeats(rows: DataFrame, bits: DataFrame, segments: int) -> tuple[DataFrame, DataFrame]:
    """rows with a column ``hash``, split into possible repeats and certain singletons; rows with a null hash are in neither. bits: of ``repeated_bits``, cut."""
    x = rows.where("hash IS NOT NULL").withColumn("segment", F.expr(_segment(segments)))
    if segments > ROUND:
        x = cut(x)  # each round reads the rows again
    hit = reduce(lambda a, b: a & b, (F.expr(f"getbit(bits[shiftright({_bit(k)}, 6)], {_bit(k)} & 63) = 1") for k in range(HASHES)))
    maybe, alone = [], []
    for first in range(0, segments, ROUND):
        own = F.col("segment").between(first, first + ROUND - 1)
        part, y = F.broadcast(bits.where(own)), x.where(own) if segments > ROUND else x
        maybe.append(y.join(part, "segment").where(hit).select(*rows.columns))
        alone.append(y.join(part, "segment", "left").where(F.coalesce(~hit, F.lit(True))).select(*rows.columns))
    return reduce(DataFrame.unionByName, maybe), reduce(DataFrame.unionByName, alone)

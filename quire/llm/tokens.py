"""Encoding of texts with a public byte-level BPE tokenizer, long texts in overlapping chunks.

A text of at most CHUNK characters, a few pages, is one chunk and is encoded without a shuffle. A longer one is cut into chunks that overlap;
chunks are pre-tokenised in parallel, by the task that their hash gives them to. The pre-tokeniser looks back at nothing, so once two chunks have a pre-token
boundary in common within their overlap, they agree from there on: that is where they are stitched. Each chunk then
encodes its own stretch between two stitches. Chunks without a common boundary (one pre-token longer than the overlap)
are joined and encoded as one. No stitch follows white space, whose pre-token depends on what comes after. Byte-level tokens never cross a pre-token, so the ids are those of the whole text.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text; one row per document,
in the order of ids within a text. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENIZER = "byte_bpe_50k"
#: Fixed value: the pre-token pattern of all byte-level tokenizers that come as a file of ranks; other kinds have no such file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 12
OVERLAP = 1 << 9
#: A boundary so close to a chunk's end may depend on characters beyond it.
MARGIN = 4


def vocabulary(name: str = TOKENIZER) -> str:
    """The path of a vocabulary file of the installed public tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path(f"{name}.tiktoken")
    except ImportError:
        return f"/opt/tokenizers/{name}.tiktoken"


@lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    import tiktoken

    if not Path(path).exists():
        raise FileNotFoundError(f"no file of ranks for a byte-level tokenizer: {path}")
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def _ids(path: str, text: str) -> np.ndarray:
    return encoder(path).encode_to_numpy(text, disallowed_special=()).astype(np.int32)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def _encoded(path: str, count_only: bool):  # noqa: ANN202
    """Encodes the last column, keeps the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):  # keeps a batch of ids small
                part = b.slice(at, 2000)
                ids = [_ids(path, t) if t else np.empty(0, np.int32) for t in part.column(part.num_columns - 1).to_pylist()]
                out = pa.array(np.array([len(x) for x in ids], np.int64)) if count_only else _lists(ids)
                names = part.schema.names[:-1] + ["n_tokens" if count_only else "ids"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], names=names)

    return run


def _cut_up(chunk: int, overlap: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                starts = range(0, len(t), chunk)
                for s in starts:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([s // chunk], pa.int32()), pa.array([t[s : s + chunk + overlap]])], names=["doc_id", "k", "piece"])

    return run


def _boundaries(chunk: int, overlap: int):  # noqa: ANN202
    """Pre-token boundaries, from the chunk's start, within the overlap with the chunk before and with the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail = [], []
            for t in b.column(2).to_pylist():
                at = np.fromiter((m.start() for m in _pattern().finditer(t)), np.int32)
                head.append(at[at < overlap])
                ends = [p for p in at[(at >= chunk) & (at <= len(t) - MARGIN)].tolist() if p and not t[p - 1].isspace()]
                tail.append(np.array(ends, np.int32) - chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(head), _lists(tail)], names=["doc_id", "k", "piece", "head", "tail"])

    return run


def _stitched(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, run, text): stretches of the long texts between stitches, in the order of run."""
    pieces = long.mapInArrow(_cut_up(chunk, overlap), "doc_id long, k int, piece string").repartition("doc_id", "k")
    x = pieces.mapInArrow(_boundaries(chunk, overlap), "doc_id long, k int, piece string, head array<int>, tail array<int>")
    order = Window.partitionBy("doc_id").orderBy("k")
    x = x.withColumn("stitch", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))  # after this chunk, from the next one's start
    x = x.withColumn("before", F.lag("stitch").over(order)).withColumn("first", F.col("before").isNotNull() | (F.col("k") == 0))
    x = x.withColumn("run", F.sum(F.col("first").cast("int")).over(order))
    last = F.lead("first").over(order)
    own = F.when(F.coalesce(last, F.lit(True)), F.when(F.col("stitch").isNull(), F.col("piece")).otherwise(F.expr(f"substring(piece, 1, {chunk} + stitch)"))).otherwise(F.expr(f"substring(piece, 1, {chunk})"))
    x = x.withColumn("own", F.when(F.col("first") & F.col("before").isNotNull(), F.substring(own, F.col("before") + 1, F.lit(2**31 - 1))).otherwise(own))
    runs = x.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("k", "own"))).alias("x"))  # one piece but for texts without boundaries
    return runs.select("doc_id", "run", F.array_join("x.own", "").alias("text"))


def encode(documents: DataFrame, path: str | None = None, count_only: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids), or (doc_id, n_tokens) with count_only, of a table with doc_id and text."""
    path = path or vocabulary()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = "n_tokens long" if count_only else "ids array<int>"
    # length() of a null is null: nulls are short
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(_encoded(path, count_only), f"doc_id long, {result}")
    parts = _stitched(docs.where(F.length("text") > chunk), chunk, overlap).mapInArrow(_encoded(path, count_only), f"doc_id long, run long, {result}")
    if count_only:
        long = parts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        ordered = F.array_sort(F.collect_list(F.struct("run", "ids")))
        long = parts.groupBy("doc_id").agg(F.flatten(F.transform(ordered, lambda s: s["ids"])).alias("ids"))
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the tokens' bytes are put together before they are read as UTF-8."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [encoder(path).decode_bytes(x or []).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

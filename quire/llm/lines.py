"""Lines repeated across one source's documents, by suffix arrays.

Lines become identifiers (a hash of their words), and the chunks of a document are put one after the other in their order.
A suffix is a line with the lines after it, up to WINDOW of them and into the document's next chunk. The suffixes of all
sources are sorted in range partitions by source, identifiers and document: a suffix array cut into pieces. Within a
piece, the common prefixes of neighbours give, for each length from one line to WINDOW, the runs of suffixes that begin
with the same lines, and so the number of distinct documents of each block. Runs at a piece's edge, at most two a length,
may go on in the next piece: their distinct documents are counted over all pieces. As document ids are part of the sort key,
a line, source or document of any size is spread over pieces. A suffix's longest prefix that spans enough documents is
a block; blocks that only continue the one a line before are left out. The lines of blocks are deleted. Blocks of more than WINDOW lines
appear as a chain of overlapping ones.

Defined cases: null content has no lines; an empty line or a line without a letter is never removed, and ends a block; chunks whose
document has no profile or whose source is null keep their content; redelivered chunks and profiles count once; chunks
with equal or null ldu_idx, or a table without it, go by chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import once, split_join
from ..session import cut

LEAST_DOCUMENTS = 3
LEAST_SHARE = 0.25
#: Lines of a suffix.
WINDOW = 8
#: Chunks of a document that are ordered by one task.
BUCKET = 4096
#: Sort key: source, first line (8 bytes each), and 4 bytes of each further line; 0 after the end.
_KEY = np.dtype([("source", ">u8"), ("first", ">u8"), ("rest", ">u4", (WINDOW - 1,))])
_PREFIX = [16 + 4 * k for k in range(WINDOW)]


def line_key(line: str | Column) -> Column:
    """The words of a line in order, in lower case, each run of digits as one 0."""
    words = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(words, r"\p{Nd}+", "0")


def _documents(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(document_id, source, need, n): each document with chunks and a source, how many documents a block of the source needs, and the document's rows."""
    sources = profiles.where("source IS NOT NULL AND document_id IS NOT NULL").groupBy("document_id").agg(F.first("source").alias("source"))
    d = chunks.where("chunk_id IS NOT NULL").groupBy("document_id").agg(F.count("*").alias("n")).join(sources, "document_id")
    need = d.groupBy("source").agg(F.greatest(F.lit(LEAST_DOCUMENTS), F.ceil(F.count("*") * LEAST_SHARE)).cast("int").alias("need"))
    return d.join(need, "source")


def _chunks_in_order(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(chunk_id, doc, source, need, ids, following): the line identifiers of each chunk, null for lines without a letter, and the first of the next chunk."""
    ids = F.transform(F.split("content", "\n"), lambda x: F.when(x.rlike(r"\p{L}"), F.xxhash64(line_key(x))))
    place = F.col("ldu_idx") if "ldu_idx" in chunks.columns else F.lit(None)
    x = chunks.where("content IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "document_id", place.cast("long").alias("ldu_idx"), ids.alias("ids"))
    x = x.groupBy("chunk_id").agg(F.first(F.struct("document_id", "ldu_idx", "ids")).alias("c")).select("chunk_id", "c.*")
    x = split_join(x, _documents(chunks, profiles), ["document_id"], "n", chunks.count()).withColumn("bucket", F.floor(F.coalesce("ldu_idx", F.lit(0)) / BUCKET))
    head, order = F.slice("ids", 1, WINDOW - 1), ["ldu_idx", "chunk_id"]
    bucket = Window.partitionBy("document_id", "bucket").orderBy(*order)
    # one row a bucket is ordered over the whole document
    heads = x.groupBy("document_id", "bucket").agg(F.min_by(head, F.struct(*order)).alias("head"))
    heads = heads.select("document_id", "bucket", F.lead("head").over(Window.partitionBy("document_id").orderBy("bucket")).alias("after"))
    x = x.withColumn("following", F.lead(head).over(bucket)).join(heads, ["document_id", "bucket"])
    return x.select("chunk_id", F.xxhash64("document_id").alias("doc"), F.xxhash64("source").alias("source"), "need", "ids", F.coalesce("following", "after").alias("following"))


def _flat(c: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, 0 for null, and the length of each list, 0 for a null list."""
    n = np.asarray(c.value_lengths().fill_null(0))
    return c.flatten().fill_null(0).to_numpy().view(np.uint64), n


def _fixed(a: np.ndarray, width: int) -> pa.Array:
    """Rows of bytes as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


_SUFFIX = "key binary, doc long, need int, chunk_id string, line_no int, to_end int"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, 5000):
            b = whole.slice(begin, 5000)
            own, n = _flat(b.column("ids"))
            more, m = _flat(b.column("following"))
            start = np.cumsum(n + m + WINDOW) - (n + m + WINDOW)
            row = np.repeat(np.arange(b.num_rows), n)
            line = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            flat = np.zeros(int((n + m + WINDOW).sum()), np.uint64)
            flat[start[row] + line] = own
            flat[np.repeat(start + n, m) + np.arange(len(more)) - np.repeat(np.cumsum(m) - m, m)] = more
            keep = own != 0
            row, line = row[keep], line[keep]
            w = flat[(start[row] + line)[:, None] + np.arange(WINDOW)]
            w *= np.cumprod(w != 0, axis=1, dtype=np.uint64)
            key = np.zeros(len(w), _KEY)
            key["source"] = b.column("source").to_numpy().view(np.uint64)[row]
            key["first"] = w[:, 0]
            key["rest"] = np.where(w[:, 1:] != 0, (w[:, 1:] >> np.uint64(32)) | np.uint64(1), 0)
            r = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [_fixed(key, _KEY.itemsize), b.column("doc").take(r), b.column("need").take(r), b.column("chunk_id").take(r), pa.array((line + 1).astype(np.int32)), pa.array((n[row] - line).astype(np.int32))],
                names=["key", "doc", "need", "chunk_id", "line_no", "to_end"],
            )


class _Piece:
    """One range partition of the suffix array."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        held = [b for b in batches if b.num_rows]
        self.rows = pa.Table.from_batches(held).combine_chunks() if held else None
        self.n = self.rows.num_rows if held else 0
        if not self.n:
            return
        c = self.rows.column("key").chunk(0)
        data, at = np.frombuffer(c.buffers()[2], np.uint8), np.frombuffer(c.buffers()[1], np.int32)[c.offset]
        self.bytes = data[at : at + _KEY.itemsize * self.n].reshape(self.n, _KEY.itemsize)
        key = np.ascontiguousarray(self.bytes).view(_KEY).ravel()
        self.doc, self.need = (self.rows.column(x).to_numpy() for x in ("doc", "need"))
        fields = [key["first"], *key["rest"].T]
        self.length = sum((f != 0).astype(np.int8) for f in fields)
        # common prefix with the suffix before, in lines
        same = key["source"][1:] == key["source"][:-1]
        self.common = np.zeros(self.n, np.int8)
        for f in fields:
            same &= (f[1:] == f[:-1]) & (f[1:] != 0)
            self.common[1:] += same

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the suffixes with a common prefix of k lines: their places in runs that may matter, the run of each, and by run its first place and its number of documents."""
        run = np.cumsum(self.common < k) - 1
        size = np.bincount(run)
        matters = size >= LEAST_DOCUMENTS
        matters[[0, -1]] = True  # these may go on in another piece
        at = np.flatnonzero(matters[run] & (self.length >= k))
        own, doc = run[at], self.doc[at]
        order = np.lexsort((doc, own))
        a, d = own[order], doc[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])] if len(a) else np.empty(0, bool)
        return at, own, np.flatnonzero(self.common < k), np.bincount(a[fresh], minlength=len(size))

    def prefix(self, place: int, k: int) -> bytes:
        return self.bytes[place, : _PREFIX[k - 1]].tobytes()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct documents of the runs at a piece's edges."""
    p = _Piece(batches)
    for k in range(1, WINDOW + 1) if p.n else ():
        at, own, first, _ = p.runs(k)
        for run in {0, len(first) - 1}:
            docs = np.unique(p.doc[at[own == run]])
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array([p.prefix(first[run], k)] * len(docs), pa.binary()), pa.array(docs), pa.array(np.full(len(docs), p.need[first[run]], np.int32))], names=["prefix", "doc", "need"])


def _blocks(edges: dict[bytes, int]):  # noqa: ANN202
    """The longest prefix of each suffix that spans enough documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Piece(batches)
        if not p.n:
            return
        lines, n_documents = np.zeros(p.n, np.int32), np.zeros(p.n, np.int64)
        for k in range(1, WINDOW + 1):
            at, own, first, n = p.runs(k)
            for e in {0, len(first) - 1}:
                n[e] = edges.get(p.prefix(first[e], k), 0)
            enough = (n >= p.need[first])[own]
            lines[at[enough]], n_documents[at[enough]] = k, n[own[enough]]
        keep = np.flatnonzero(lines)
        take = p.rows.select(["chunk_id", "line_no", "to_end"]).take(pa.array(keep)).combine_chunks().to_batches()
        for b in take:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines[keep]), pa.array(n_documents[keep])], names=["chunk_id", "line_no", "to_end", "n_lines", "n"])

    return run


def repeated_blocks(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(chunk_id, line_no, n_lines, to_end, n): blocks that span n documents of their source, enough of them, by the line they begin with.

    n_lines may reach into the document's next chunk; to_end is the number of lines from the first to the end of its own chunk.
    """
    suffixes = _chunks_in_order(chunks, profiles).mapInArrow(_suffixes, _SUFFIX)
    array = cut(suffixes.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc"))
    # At most two runs a length and piece, and of these only those that span enough documents: a block must span a share of
    # LEAST_SHARE of its source's documents, so a source has at most as many as some of its documents have lines.
    edges = array.mapInArrow(_edges, "prefix binary, doc long, need int").groupBy("prefix").agg(F.count_distinct("doc").alias("n"), F.first("need").alias("need")).where("n >= need")
    found = array.mapInArrow(_blocks({bytes(r.prefix): r.n for r in edges.collect()}), "chunk_id string, line_no int, to_end int, n_lines int, n long")
    before = Window.partitionBy("chunk_id").orderBy("line_no")
    goes_on = (F.lag("line_no").over(before) == F.col("line_no") - 1) & (F.lag("n_lines").over(before) > F.col("n_lines"))
    return found.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).where("NOT goes_on").select("chunk_id", "line_no", "n_lines", "to_end", "n")


def lines_to_remove(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of all lines in a repeated block."""
    b = repeated_blocks(chunks, profiles)
    return b.select("chunk_id", F.explode(F.sequence("line_no", F.col("line_no") + F.least("n_lines", "to_end") - 1)).alias("line_no")).distinct()


def without_repeated_lines(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(chunk_id, content, n_removed): every chunk with its content less the repeated blocks; null content stays null."""
    gone = lines_to_remove(chunks, profiles).groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone"))
    whole = once(chunks.where("chunk_id IS NOT NULL").select("chunk_id", "content"), "chunk_id")
    x = whole.join(gone, "chunk_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter(F.split("content", "\n"), lambda _, i: ~F.array_contains(F.col("gone"), (i + 1).cast("int")))
    return x.select("chunk_id", F.array_join(kept, "\n").alias("content"), F.size("gone").alias("n_removed"))

"""Section index of a document's chunks: ranges, signals, summaries, key names, and the choice of sections for a topic.

Input: chunks once each, with document_id, ldu_idx, chunk_type, content, section, page_refs. Defined cases: a null or empty section is ``(Untitled)``; sections
of one title are one, in order of first appearance; null content counts as empty; a section without pages begins and ends at page 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .skew import once

# Fixed values.
UNTITLED = "(Untitled)"
SENTENCES, NUMERIC_SHARE, TOP_NAMES = 3, 0.15, 10
NAME = rf"\b[A-Z][a-z]+(?:{T.B}+[A-Z][a-z]+)+\b"


def chunks_once(chunks: DataFrame) -> DataFrame:
    """Each chunk of a document once; texts of chunks that came once are not shuffled."""
    columns = [c for c in ("chunk_id", "document_id", "ldu_idx", "chunk_type", "content", "section_path", "page_refs", "page_number", "content_hash") if c in chunks.columns]
    x = once(chunks.where("document_id IS NOT NULL").select(*columns), "chunk_id")
    return x.withColumn("section", F.coalesce(F.expr("nullif(section_path, '')"), F.lit(UNTITLED))).withColumn("content", F.coalesce("content", F.lit("")))


def _numeric(c: str) -> Column:
    return F.size(F.filter(T.tokens(c), lambda t: t.rlike("[0-9]")))


def sections(chunks: DataFrame) -> DataFrame:
    """(document_id, title, node_ord, page_start, page_end, signals, summary): one row per section, one aggregation."""
    body = F.col("chunk_type") != "section"
    pages = lambda f, c: f(F.when(c, F.expr(f"array_{'min' if f is F.min else 'max'}(page_refs)")))
    every = F.lit(True)
    spoken = F.col("chunk_type").isin("paragraph", "list")
    x = chunks.groupBy("document_id", F.col("section").alias("title")).agg(
        F.min("ldu_idx").alias("node_ord"),
        F.coalesce(pages(F.min, body), pages(F.min, every), F.lit(1)).alias("page_start"),
        F.coalesce(pages(F.max, body), pages(F.max, every), F.lit(1)).alias("page_end"),
        F.max(F.col("chunk_type") == "table").alias("tables"),
        F.max(F.col("chunk_type") == "figure").alias("figures"),
        F.max(F.col("chunk_type") == "list").alias("lists"),
        F.sum(F.when(body, _numeric("content"))).alias("numeric"),
        F.sum(F.when(body, T.token_count("content"))).alias("words"),
        F.min_by(F.when(spoken, F.col("content")), F.when(spoken, F.col("ldu_idx"))).alias("told"),
        F.min_by(F.when(body & (T.strip("content") != ""), F.col("content")), F.when(body & (T.strip("content") != ""), F.col("ldu_idx"))).alias("any"),
    )
    dense = (F.col("words") > 0) & (F.col("numeric") >= NUMERIC_SHARE * F.col("words"))
    signals = F.array_join(F.array_compact(F.array(F.when(F.col("figures"), "figures"), F.when(F.col("lists"), "lists"), F.when(dense, "numeric_dense"), F.when(F.col("tables"), "tables"))), ",")
    return x.select("document_id", "title", "node_ord", "page_start", "page_end", signals.alias("signals"), T.first_sentences(F.coalesce("told", "any", F.lit("")), SENTENCES).alias("summary"))


def key_names(chunks: DataFrame, top: int = TOP_NAMES) -> DataFrame:
    """(document_id, title, name, n, place): the most frequent runs of capitalised words of each section; ties by first appearance, then name."""
    x = chunks.where("chunk_type <> 'section'").select("document_id", F.col("section").alias("title"), "ldu_idx", F.posexplode(F.regexp_extract_all(T.ascii_words("content"), F.lit(NAME), F.lit(0))).alias("pos", "name"))
    n = x.where("length(name) > 4").groupBy("document_id", "title", "name").agg(F.count("*").alias("n"), F.min(F.struct("ldu_idx", "pos")).alias("first"))
    return n.withColumn("place", F.expr("row_number() OVER (PARTITION BY document_id, title ORDER BY n DESC, first, name)")).where(F.col("place") <= top).select("document_id", "title", "name", "n", "place")


def with_key_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """nodes with ``names``, the key names of each section joined by blanks. names: from ``key_names``, a bounded number for each section."""
    n = names.groupBy("document_id", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " ").alias("names"))
    return nodes.join(n, ["document_id", "title"], "left").withColumn("names", F.coalesce("names", F.lit("")))


def choose_sections(nodes: DataFrame, questions: DataFrame, top: int = 3) -> DataFrame:
    """(question_id, document_id, title, page_start, summary, score, place): the sections of the question's document that share most words with it.

    Words of title, summary, signals and, if nodes have them, key names count. Even sections that share none are given, in order, up to ``top``.
    questions: (question_id, document_id, question).
    """
    q = T.word_set("question")
    node = T.word_set(F.concat_ws(" ", "title", "summary", "signals", *(["names"] if "names" in nodes.columns else [])))
    score = F.when(F.size(q) > 0, F.size(F.array_intersect(q, node)) / F.size(q)).otherwise(F.lit(0.0))
    x = nodes.join(questions, "document_id").withColumn("score", score)
    x = x.withColumn("place", F.expr("row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_ord, title)")).where(F.col("place") <= top)
    return x.select("question_id", "document_id", "title", "page_start", "summary", F.round("score", 6).alias("score"), "place")


def index_json(nodes: DataFrame) -> DataFrame:
    """(document_id, index_json, n_nodes): the index of each document as one JSON text, its nodes in order.

    nodes: of ``sections``, perhaps ``with_key_names``. The tree is flat; a document's sections are one row's worth, as a stored index must be.
    """
    columns = ["node_ord", "title", "page_start", "page_end", "signals", "summary", *(["names"] if "names" in nodes.columns else [])]
    x = nodes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("root_nodes"))
    return x.select("document_id", F.to_json(F.struct("document_id", "root_nodes")).alias("index_json"), F.size("root_nodes").cast("long").alias("n_nodes"))


def index_nodes(indexes: DataFrame) -> DataFrame:
    """The nodes of stored indexes, one row each, in order of node_ord."""
    node = "struct<node_ord:bigint,title:string,page_start:int,page_end:int,signals:string,summary:string,names:string>"
    x = indexes.select("document_id", F.explode(F.from_json("index_json", f"struct<root_nodes:array<{node}>>")["root_nodes"]).alias("n"))
    return x.select("document_id", "n.*")

"""Answers to questions and audits of claims over sections, chunks, facts and edges, with citations; many questions in one plan.

questions: (question_id, document_id, question). Evidence: (question_id, source_no, ord, content, page_number, content_hash, score); sources are
sections, chunks, facts and edges, 0 to 3. Chunks of the question's document are ranked by the words they share with it.
Defined cases: a question without words that count has no overlap with anything; equal scores keep their order; questions about
unknown documents are not found; of several names in a question the last counts, by first page, then name; without names there are no hints.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .entities import edge_order

# Limits, cut-offs and words of numeric questions.
CHUNKS, CHUNKS_AUDIT, FACTS, EDGES, PIECES = 5, 10, 10, 5, 3
CHUNK_LEAST, FACT_LEAST, EDGE_LEAST = 0.3, 0.2, 0.25
CITATION_WEIGHT = 0.2
NUMERIC = ["revenue", "income", "cost", "expense", "profit", "loss", "budget", "expenditure", "salary", "price", "rate", "amount", "total", "net", "gross", "tax", "fee", "dividend", "assets", "liabilities", "equity", "balance", "cash", "flow", "capital", "capacity", "subscribed", "paid-up", "how much", "how many", "what is the", "$", "%", "billion", "million", "thousand"]
NOTHING = "No relevant information found in the document."


def asks_for_number(question: str | Column) -> Column:
    """One of the words occurs anywhere in the question, also within another word."""
    low = F.lower(question)
    out = F.lit(False)
    for w in NUMERIC:
        out = out | low.contains(w)
    return out


#: Fixed value: a period in a question.
PERIOD = rf"(?i)\b(?:FY|CY|Q[1-4])?{T.B}*\d{{4}}\b|\b(?:H[12]){T.B}*\d{{4}}\b"
#: Questions are broadcast up to this count (some 30 MB), beyond it they are joined by shuffle.
BROADCAST_QUESTIONS = 100_000
SOURCES = ["pageindex_navigate", "semantic_search", "structured_query", "knowledge_graph"]


def _best(x: DataFrame, top: int | None, *order: Column | str) -> DataFrame:
    """The first ``top`` rows of each question; all, with their order, if top is None."""
    x = x.withColumn("ord_", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    return x if top is None else x.where(F.col("ord_") <= top)


def hints(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, entity_hint, period_hint): the organisation and the date of the document that the question names, else a period by its form.

    names: (document_id, entity_type, entity_name, first_page).
    """
    n = names.where("entity_type IN ('organization', 'date')").join(questions, "document_id").where(F.contains(F.lower("question"), F.lower("entity_name")))
    last = lambda kind: F.max(F.when(F.col("entity_type") == kind, F.struct("first_page", "entity_name")))["entity_name"]
    n = n.groupBy("question_id").agg(last("organization").alias("entity_hint"), last("date").alias("named_period"))
    x = questions.select("question_id", "question").join(n, "question_id", "left")
    written = F.expr("nullif(trim(period_), '')")
    return x.withColumn("period_", F.regexp_extract(T.ascii_words(F.coalesce("question", F.lit(""))), PERIOD, 0)).select("question_id", "entity_hint", F.coalesce("named_period", written).alias("period_hint"))


def evidence(questions: DataFrame, chunks: DataFrame, facts: DataFrame, edges: DataFrame | None = None, sections: DataFrame | None = None, names: DataFrame | None = None, audit: bool = False, plain: bool = False) -> DataFrame:
    """What the question's document says: its sections, chunks, facts and edges, best first.

    chunks: (document_id, chunk_id, content, page_number, content_hash, ldu_idx), sections: of ``sections.choose_sections``, names: of
    ``entities.entities``, for hints. audit: everything beyond a cut-off, without sections; plain: chunks and all facts only, as the step-wise plan gives.
    """
    q = questions.select("question_id", "document_id", "question", T.weighty_words("question").alias("words_"))
    if q.count() <= BROADCAST_QUESTIONS:
        q = F.broadcast(q)
    score = T.overlap_of("words_", "content")
    columns = ["question_id", "question", "source_no", "ord_", "content", "page_number", "content_hash"]
    none = F.lit(None).cast("string").alias("content_hash")
    out = []
    if sections is not None and not audit and not plain:
        x = sections.join(q.select("question_id", "question"), "question_id")
        out.append(x.select("question_id", "question", F.lit(0).alias("source_no"), F.col("place").alias("ord_"), F.concat(F.lit("[Section: "), "title", F.lit("] "), "summary").alias("content"), F.col("page_start").alias("page_number"), none))
    c = _best(chunks.join(q, "document_id").withColumn("score", score).where("score > 0"), CHUNKS_AUDIT if audit else CHUNKS, F.desc("score"), "ldu_idx", "content")
    if audit:
        c = c.where(F.col("score") >= CHUNK_LEAST)
    out.append(c.withColumn("source_no", F.lit(1)).select(*columns))
    f = facts.select("document_id", "fact_id", "key", "value", "entity", "metric", "period", F.col("page_ref").alias("page_number"), "content_hash").withColumn("content", F.concat("key", F.lit(": "), "value")).where("content IS NOT NULL")
    f = f.join(q if audit else q.where(asks_for_number("question")), "document_id")
    if audit:
        f = _best(f.withColumn("score", score).where(F.col("score") >= FACT_LEAST), None, "fact_id")
    elif plain:
        f = _best(f, None, "fact_id")
    else:
        if names is not None:
            holds = lambda c, h: F.col(h).isNull() | F.coalesce(F.contains(F.lower(c), F.lower(h)), F.lit(False))
            h = hints(q, names)
            h = F.broadcast(h) if questions.count() <= BROADCAST_QUESTIONS else h
            f = f.join(h, "question_id").where(holds("entity", "entity_hint") & holds("period", "period_hint"))
        f = f.withColumn("score", T.overlap_of("words_", F.concat_ws(" ", "key", "value", "entity", "metric"))).where("score > 0")
        f = _best(f, FACTS, F.desc("score"), "fact_id")
    out.append(f.withColumn("source_no", F.lit(2)).select(*columns))
    if edges is not None and not plain:
        e = edges.join(q, "document_id").withColumn("text", F.concat_ws(" ", "source", "relation", "target")).where(T.overlap_of("words_", "text") >= EDGE_LEAST)
        e = _best(e, None if audit else EDGES, edge_order(), "page_ref", "source", "relation", "target")
        written = F.col("text") if audit else F.concat(F.lit("[KG] "), F.concat_ws(" → ", "source", "relation", "target"))
        out.append(e.select("question_id", "question", F.lit(3).alias("source_no"), "ord_", written.alias("content"), F.col("page_ref").alias("page_number"), none))
    x = reduce(DataFrame.unionByName, out)
    return x.select("question_id", "source_no", F.col("ord_").alias("ord"), "content", "page_number", "content_hash", T.overlap("question", "content").alias("score"))


def answers(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, answer, n_citations, confidence, verified, tools_used): the best pieces, each text once, joined."""
    best = found.where("content <> ''").groupBy("question_id", "content").agg(F.min(F.struct("source_no", "ord")).alias("first"), F.max("score").alias("score"))
    best = _best(best, PIECES, F.desc("score"), "first")
    text = best.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord_", "content"))), lambda x: x["content"]), " ").alias("answer"))
    tools = found.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("source_no")), lambda i: F.element_at(F.array(*map(F.lit, SOURCES)), (i + 1).cast("int"))), ",").alias("tools_used"))
    n = citations(found).groupBy("question_id").agg(F.count("*").alias("n_citations"))
    x = questions.select("question_id").join(text, "question_id", "left").join(n, "question_id", "left").join(tools, "question_id", "left")
    n0 = F.coalesce("n_citations", F.lit(0))
    return x.select(
        "question_id", F.coalesce("answer", F.lit(NOTHING)).alias("answer"), n0.alias("n_citations"), F.round(F.least(F.lit(1.0), CITATION_WEIGHT * n0), 6).alias("confidence"), (n0 > 0).alias("verified"), F.coalesce("tools_used", F.lit("")).alias("tools_used")
    )


def citations(found: DataFrame) -> DataFrame:
    """(question_id, page_number, content_hash, place): the first evidence of each page of the question's document."""
    x = found.where("page_number IS NOT NULL").groupBy("question_id", "page_number").agg(F.min_by("content_hash", F.struct("source_no", "ord")).alias("content_hash"), F.min(F.struct("source_no", "ord")).alias("first"))
    return x.withColumn("place", F.expr("row_number() OVER (PARTITION BY question_id ORDER BY first, page_number)")).select("question_id", "page_number", "content_hash", "place")


def audits(claims: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, status, n_evidence): verified with evidence; unverifiable if a chunk of the document shares a word with the claim but too few; else not found."""
    n = found.groupBy("question_id").agg(F.count("*").alias("n"))
    q = claims.select("question_id", "document_id", T.weighty_words("question").alias("words_"))
    if q.count() <= BROADCAST_QUESTIONS:
        q = F.broadcast(q)
    related = chunks.join(q, "document_id").where(T.overlap_of("words_", "content") > 0).select("question_id", F.lit(True).alias("related")).distinct()
    x = claims.select("question_id").join(n, "question_id", "left").join(related, "question_id", "left")
    return x.select("question_id", F.when(F.col("n") > 0, "verified").when(F.col("related"), "unverifiable").otherwise("not_found").alias("status"), F.coalesce("n", F.lit(0)).alias("n_evidence"))

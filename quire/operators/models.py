"""Steps that a language or embedding model may take over: summaries, facts, reasons of audits, vectors.

A model is any object with the method named; it runs on the executors in Arrow batches, so it must be picklable. Without a model the
deterministic operators stand. A model that raises for a row leaves that row as it was; calls are bounded for each document.

Defined cases: null and short texts aren't sent; an empty reply changes nothing; ties go by ldu_idx, then chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What is sent, and how often.
CALLS, LEAST_CHARS, BODY, DENSE = 20, 200, 2000, 0.35


class Summariser(Protocol):
    def summarise(self, title: str, body: str, numeric: bool) -> str: ...


class FactModel(Protocol):
    def facts(self, text: str) -> list[tuple[str, str, str]]:
        """(key, value, unit) of each fact."""


class Reasoner(Protocol):
    def reason(self, claim: str, evidence: list[str]) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: pd.Series) -> pd.Series: ...


def _tried(call, *args):  # noqa: ANN001, ANN002, ANN202
    try:
        return call(*args)
    except Exception:  # noqa: BLE001  one bad reply must not end the others
        return None


def summarised(nodes: DataFrame, chunks: DataFrame, model: Summariser) -> DataFrame:
    """nodes of ``sections.sections`` with the model's summary where it gives one. The body is the section's texts, in order, up to BODY characters."""
    x = chunks.where("chunk_type <> 'section' AND content <> ''").select("document_id", F.col("section").alias("title"), "ldu_idx", F.substring("content", 1, BODY).alias("content"))
    # no more of a section's first texts than can be sent are gathered: each has a character at least
    first = F.expr("row_number() OVER (PARTITION BY document_id, title ORDER BY ldu_idx)")
    chars = F.expr("sum(length(content) + 1) OVER (PARTITION BY document_id, title ORDER BY ldu_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    x = x.withColumns({"o": first, "before": chars}).where(f"o <= {BODY} AND coalesce(before, 0) < {BODY}")
    body = x.groupBy("document_id", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ldu_idx", "content"))), lambda s: s["content"]), "\n").alias("body"))
    t = T.tokens("body")
    numeric = F.size(F.filter(t, lambda w: w.rlike("[0-9]"))) > DENSE * F.size(t)
    x = nodes.join(body, ["document_id", "title"], "left").withColumn("body", F.substring(F.coalesce("body", F.lit("")), 1, BODY)).withColumn("numeric_", F.coalesce(numeric, F.lit(False)))

    columns = nodes.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [_tried(model.summarise, a, b, bool(n)) if b else None for a, b, n in zip(f.title, f.body, f.numeric_)]
            f["summary"] = [s.strip() if s and s.strip() else old for s, old in zip(said, f.summary)]
            yield f[columns]

    return x.select(*columns, "body", "numeric_").mapInPandas(run, nodes.schema)


def facts_by_model(chunks: DataFrame, model: FactModel, calls: int = CALLS) -> DataFrame:
    """(document_id, chunk_id, page_ref, key, value, unit, method, confidence) of the first ``calls`` long chunks of each document, those of tables aside."""
    x = chunks.where((F.col("chunk_type") != "table") & (F.length("content") > LEAST_CHARS))
    x = x.withColumn("o", F.expr("row_number() OVER (PARTITION BY document_id ORDER BY ldu_idx, chunk_id)")).where(F.col("o") <= calls)
    page = F.coalesce(F.try_element_at("page_refs", F.lit(1)), F.lit(1)).cast("int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, c, p, k, v, u) for d, c, p, t in zip(f.document_id, f.chunk_id, f.page_ref, f.content) for k, v, u in _tried(model.facts, t) or [] if k and v]
            g = pd.DataFrame(rows, columns=["document_id", "chunk_id", "page_ref", "key", "value", "unit"])
            g["method"], g["confidence"] = "llm", 0.75
            yield g

    return x.select("document_id", "chunk_id", page.alias("page_ref"), "content").mapInPandas(run, "document_id string, chunk_id string, page_ref int, key string, value string, unit string, method string, confidence double")


def reasoned(audits: DataFrame, claims: DataFrame, found: DataFrame, model: Reasoner) -> DataFrame:
    """audits with ``explanation``, and the status it overrides: a text with "contradicted" makes a claim unverifiable, else one with "verified" makes it verified.

    Claims that were not found aren't sent. The evidence of a claim is its ten best pieces.
    """
    best = found.withColumn("o", F.expr("row_number() OVER (PARTITION BY question_id ORDER BY source_no, ord)")).where("o <= 10")
    best = best.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "content"))), lambda s: s["content"]).alias("evidence"))
    x = audits.join(claims.select("question_id", "question"), "question_id").join(best, "question_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["explanation"] = [(_tried(model.reason, q, list(e) if e is not None else []) or "") if s != "not_found" and q else "" for q, e, s in zip(f.question, f.evidence, f.status)]
            yield f[["question_id", "status", "n_evidence", "explanation"]]

    x = x.select("question_id", "status", "n_evidence", "question", "evidence").mapInPandas(run, "question_id long, status string, n_evidence long, explanation string")
    low = F.lower("explanation")
    status = F.when(F.contains(low, F.lit("contradicted")), "unverifiable").when(F.contains(low, F.lit("verified")), "verified").otherwise(F.col("status"))
    return x.withColumn("status", status)


def embedded(rows: DataFrame, content: str, model: Embedder | None = None, default: Column | None = None) -> DataFrame:
    """rows with ``embedding``: by the model, or by the default column where there is none."""
    if model is None:
        return rows.withColumn("embedding", default)
    f = F.pandas_udf(lambda s: model.embed(s.fillna("")), "array<float>")
    return rows.withColumn("embedding", f(content))

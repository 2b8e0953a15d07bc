"""Names in chunks and the graph of facts, names on one page, and references.

Defined cases: null content has no names; blank names are dropped; names are compared in title case with single blanks;
of equal edges the first counts, by page. With facts, their entities, metrics and periods are names as well; a fact without a page names
nothing on a page, and page 0 is none. A page's names are paired in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking

_S = T.B
# Patterns and word lists of each kind of name.
ORGANISATION = rf"\b(?:[A-Z][a-z]+(?:{_S}+[A-Z][a-z]+)+)(?:{_S}+(?:Inc|Corp|Ltd|LLC|PLC|Group|Bank|Authority|Commission|Bureau|Fund|Association|Institute|Board|Agency|Ministry|Department))?\b"
DATE = rf"(?i)\b(?:(?:FY|CY|Q[1-4])?{_S}*\d{{4}}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?){_S}+\d{{1,2}},?{_S}+\d{{4}}|(?:H[12]){_S}*\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}})\b"
AMOUNT = rf"(?i)[\$€£₤]{_S}*[\d,]+(?:\.\d+)?{_S}*(?:million|billion|thousand|[BMKTbmkt])?|\d[\d,]*(?:\.\d+)?{_S}*(?:million|billion|thousand){_S}*(?:USD|EUR|GBP|ETB|[A-Z]{{3}})"
REGULATION = rf"(?i)\b(?:IFRS|GAAP|Basel{_S}+[IV]+|IAS|ISA|SOX|Dodd-Frank|MiFID|Regulation{_S}+[A-Z]|Directive{_S}+\d+/\d+|Proclamation{_S}+No\.?{_S}*\d+|Circular{_S}+No\.?{_S}*\d+)\b"
PERSON = rf"\b(?:Mr|Mrs|Ms|Dr|Prof|CEO|CFO|CTO|Chairman|President|Director)\.?{_S}+[A-Z][a-z]+(?:{_S}+[A-Z][a-z]+){{0,3}}\b"
PATTERNS = {"organization": ORGANISATION, "date": DATE, "amount": AMOUNT, "regulation": REGULATION, "person": PERSON}
METRICS = ["revenue", "income", "profit", "loss", "ebitda", "margin", "ratio", "growth", "return", "yield", "cost", "expense", "asset", "liability", "equity", "dividend", "earnings", "cash flow", "capital", "debt", "turnover", "depreciation", "amortization", "interest", "tax", "net worth", "book value", "market cap", "share price", "eps", "roe", "roa", "roc", "npat", "pbt", "pat"]
PLACES = ["ethiopia", "addis ababa", "kenya", "nairobi", "nigeria", "lagos", "south africa", "johannesburg", "london", "new york", "washington", "beijing", "shanghai", "tokyo", "berlin", "paris", "zurich", "united states", "united kingdom", "european union", "africa"]
NEIGHBOURS = 5


def _named(c: Column) -> Column:
    return T.title(T.squeeze(c))


def _keywords(words: list[str]) -> Column:
    """The keywords that the lower-case content holds, anywhere in a word."""
    return F.array_compact(F.array(*(F.when(F.col("low_").contains(w), F.lit(w)) for w in words)))


def _typed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("name")))


KINDS = [*PATTERNS, "metric", "location"]


def _found(chunks: DataFrame, kinds: list[str]) -> tuple[DataFrame, Column]:
    """chunks with what the patterns read, made once, and the array of (entity_type, name) of each chunk."""
    x = chunks.withColumns({"page": F.coalesce(F.try_element_at("page_refs", F.lit(1)), F.lit(1)), "ascii_": T.ascii_words("content"), "low_": F.lower("content")})
    out = []
    for kind in kinds:
        if kind in PATTERNS:
            found = F.regexp_extract_all("content" if kind == "amount" else "ascii_", F.lit(PATTERNS[kind]), F.lit(0))
            if kind == "organization":
                found = F.filter(found, lambda n: (F.length(n) >= 4) & ~F.lower(n).isin(METRICS))
        else:
            found = _keywords(METRICS if kind == "metric" else PLACES)
        out.append(_typed(kind, found))
    return x, F.concat(*out)


def mentions(chunks: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(document_id, ldu_idx, page, entity_type, written, entity_name): every mention, as written and in its common form; metrics and places once a chunk. kinds: only these are looked for."""
    x, found = _found(chunks, kinds or KINDS)
    x = x.select("document_id", "ldu_idx", "page", F.explode(found).alias("e"))
    return x.select("document_id", "ldu_idx", "page", "e.entity_type", T.squeeze(F.col("e.name")).alias("written"), _named(F.col("e.name")).alias("entity_name")).where("entity_name <> ''")


def fact_names(facts: DataFrame) -> DataFrame:
    """(document_id, page, entity_type, entity_name): entity, metric and period of each fact as organisation, metric and date. facts: once each."""
    kinds = F.array(*(F.struct(F.lit(k).alias("entity_type"), F.col(c).alias("name")) for k, c in (("organization", "entity"), ("metric", "metric"), ("date", "period"))))
    x = facts.select("document_id", F.col("page_ref").alias("page"), F.explode(kinds).alias("e"))
    return x.select("document_id", "page", "e.entity_type", _named(F.col("e.name")).alias("entity_name")).where("entity_name <> ''")


def names(chunks: DataFrame, facts: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """(document_id, page, entity_type, entity_name): every mention in chunks, and in facts where they are given."""
    x = mentions(chunks, kinds).select("document_id", "page", "entity_type", "entity_name")
    if facts is None:
        return x
    f = fact_names(facts)
    return x.unionByName(f.where(F.col("entity_type").isin(kinds)) if kinds else f)


def on_pages(found: DataFrame) -> DataFrame:
    """(document_id, entity_type, entity_name, page, n): the names of ``names`` with their number on each page, for ``entities`` and ``graph`` to share."""
    return found.groupBy("document_id", "entity_type", "entity_name", "page").agg(F.count("*").alias("n"))


def entities(chunks: DataFrame | None, facts: DataFrame | None = None, kinds: list[str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """(document_id, entity_type, entity_name, n_mentions, first_page); the mentions themselves are rows of ``mentions``. found: of ``on_pages``, in place of the rest."""
    if found is not None:
        return found.groupBy("document_id", "entity_type", "entity_name").agg(F.sum("n").alias("n_mentions"), F.min("page").alias("first_page"))
    return names(chunks, facts, kinds).groupBy("document_id", "entity_type", "entity_name").agg(F.count("*").alias("n_mentions"), F.min("page").alias("first_page"))


def fact_edges(facts: DataFrame) -> DataFrame:
    """(document_id, source, relation, target, page_ref, confidence): entity to metric, and metric to period. facts: once each."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    metric = facts.where(has("entity") & has("metric")).select("document_id", F.col("entity").alias("source"), F.lit("has_metric").alias("relation"), F.col("metric").alias("target"), "page_ref", "confidence")
    period = facts.where(has("metric") & has("period")).select("document_id", F.col("metric").alias("source"), F.lit("reported_for_period").alias("relation"), F.col("period").alias("target"), "page_ref", "confidence")
    return metric.unionByName(period)


CO_OCCURS = "co_occurs_on_page"


def page_edges(chunks: DataFrame, facts: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Each name on a page, of any type, with the next NEIGHBOURS names of the page in alphabetical order. found: of ``on_pages``, so that texts aren't read again."""
    if found is None:
        x, all_ = _found(chunks, KINDS)
        # a name often stands in a chunk many times, and under several types
        x = x.select("document_id", "page", F.explode(F.array_distinct(F.transform(all_, lambda e: e["name"]))).alias("name")).select("document_id", "page", _named(F.col("name")).alias("entity_name"))
        if facts is not None:
            x = x.unionByName(fact_names(facts).select("document_id", "page", "entity_name"))
    else:
        x = found.select("document_id", "page", "entity_name")
    once_ = x.where("entity_name <> '' AND document_id IS NOT NULL AND page <> 0").distinct()
    # a page's names: a bounded group
    following = [F.expr(f"lead(entity_name, {k}) OVER (PARTITION BY document_id, page ORDER BY entity_name)") for k in range(1, NEIGHBOURS + 1)]
    x = once_.withColumn("next", F.array_compact(F.array(*following)))
    return x.select("document_id", F.col("entity_name").alias("source"), F.lit(CO_OCCURS).alias("relation"), F.explode("next").alias("target"), F.col("page").alias("page_ref"), F.lit(0.5).alias("confidence"))


def reference_edges(chunks: DataFrame) -> DataFrame:
    """Page to the table, figure or section it refers to."""
    x = chunks.select("document_id", F.coalesce(F.try_element_at("page_refs", F.lit(1)), F.lit(1)).alias("page_ref"), F.explode(chunking.references("content")).alias("x"))
    return x.select("document_id", F.concat(F.lit("page:"), "page_ref").alias("source"), F.concat(F.lit("references_"), "x.target_type").alias("relation"), F.col("x.target_label").alias("target"), "page_ref", F.lit(0.4).alias("confidence"))


def graph(facts: DataFrame, chunks: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(document_id, source, relation, target, page_ref, confidence): every edge once per document, the first of its page.

    Names from facts are in their common form, so that they meet those of pages in one node. The three kinds of edges have relations of
    their own, so each is made distinct by itself; edges of pages need no more than their least page, which is added up before they are shuffled.
    """
    key = ["document_id", "source", "relation", "target"]
    of_facts = fact_edges(facts).withColumns({c: _named(F.col(c)) for c in ("source", "target")}).where("source <> '' AND target <> ''")
    of_facts = of_facts.groupBy(*key).agg(F.min(F.struct("page_ref", (-F.col("confidence")).alias("c"))).alias("f")).select(*key, "f.page_ref", (-F.col("f.c")).alias("confidence"))
    pages = page_edges(chunks, facts, found).groupBy("document_id", "source", "target").agg(F.min("page_ref").alias("page_ref")).select("document_id", "source", F.lit(CO_OCCURS).alias("relation"), "target", "page_ref", F.lit(0.5).alias("confidence"))
    refers = reference_edges(chunks).groupBy(*key).agg(F.min("page_ref").alias("page_ref")).select(*key, "page_ref", F.lit(0.4).alias("confidence"))
    return of_facts.unionByName(pages).unionByName(refers)


def edge_order(relation: str = "relation") -> Column:
    """Edges of facts come before those of pages, and these before references."""
    return F.when(F.col(relation).isin("has_metric", "reported_for_period"), 0).when(F.col(relation) == CO_OCCURS, 1).otherwise(2)

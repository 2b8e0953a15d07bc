"""Key-value facts from chunks, by four patterns, with unit, period, section, entity and confidence; and queries over facts.

Defined cases: null content has no facts; of facts of one document with the same key and value, letter case aside, the
first counts, in the order of chunk, method and position. Key, value and content are searched whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The patterns of keys and values.
_S = T.B
VALUE = rf"[\$€£₤]?{_S}*[\d,._]+(?:\.\d+)?(?:{_S}*(?:million|billion|thousand|[BMKTbmkt]))?(?:{_S}*%|(?:{_S}+[A-Z]{{2,5}}))?"
PATTERNS = {
    "kv": (rf"([A-Z][A-Za-z /&-]+?){_S}*[:=]{_S}*({VALUE})", "regex"),
    "text": (rf"^([A-Z][A-Za-z /.&-]{{2,40}}?){_S}*:{_S}*([A-Z0-9][^\n]{{3,120}})$", "regex"),
    "gap": (rf"([A-Z][A-Za-z /&-]{{3,40}}?){_S}{{2,}}({VALUE})", "regex"),
    "table": (rf"^([A-Za-z][A-Za-z /&()-]+?){_S}*\|{_S}*([\d,._]+(?:\.\d+)?)(?:{_S}*\|.*)?$", "table_parse"),
}
METHODS = {"table": 0, "kv": 1, "text": 2, "gap": 3}
PERIOD = rf"(?i)(?:FY|CY|Q[1-4])?{_S}*\d{{4}}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*{_S}+\d{{4}}|(?:H[12]){_S}*\d{{4}}|(?:first|second|third|fourth){_S}+(?:quarter|half)"
HEADING = rf"^(?:\d+\.?\d*\.?\d*){_S}+[A-Z].*$"
NO_ENTITY = ["Total", "Net", "Gross", "Operating", "Annual", "Monthly", "Quarterly", "Average", "Median", "Adjusted", "Non"]
CONFIDENCE = {"regex": 0.70, "table_parse": 0.85}


def _pairs(pattern: str) -> Column:
    """array of (method_no, pos, key, value) that one pattern finds in ``content``."""
    p = T.LINES_JAVA + PATTERNS[pattern][0]
    keys, values = (F.regexp_extract_all("content", F.lit(p), F.lit(g)) for g in (1, 2))

    def one(x: Column, i: Column) -> Column:
        key = F.regexp_replace(T.strip(x["k"]), "[:]+$", "") if pattern == "table" else T.strip(x["k"])
        return F.struct(F.lit(METHODS[pattern]).alias("method_no"), i.alias("pos"), key.alias("key"), T.strip(x["v"]).alias("value"))

    return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), one)


def _page() -> Column:
    return F.coalesce(F.try_element_at("page_refs", F.lit(1)), F.lit(1)).alias("page_ref")


def extract(chunks: DataFrame, pattern: str) -> DataFrame:
    """(document_id, ldu_idx, chunk_id, page_ref, method_no, pos, key, value) of one pattern; tables are read by ``table`` only."""
    x = chunks.where((F.col("chunk_type") == "table") == F.lit(pattern == "table"))
    return x.select("document_id", "ldu_idx", "chunk_id", _page(), F.explode(_pairs(pattern)).alias("p")).select("document_id", "ldu_idx", "chunk_id", "page_ref", "p.*")


def unit_of(v: str) -> Column:
    s = T.strip(v)
    out = F.when(F.contains(F.col(v), F.lit("%")), "%")
    for mark, name in (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("₤", "GBP")):
        out = out.when(s.startswith(mark), name)
    return out.otherwise(F.regexp_extract(s, r"\b([A-Z]{2,5})$", 1))


def entity_of(key: str) -> Column:
    t = T.tokens(key)
    first, last = F.element_at(t, 1), F.element_at(t, -1)
    return F.when((F.size(t) >= 2) & first.rlike("^[A-Z]") & last.rlike("^[A-Z]") & ~first.isin(NO_ENTITY), first).otherwise(F.lit(""))


def confidence(method: str | Column, value: str | Column) -> Column:
    """A base for the method, more if the value is a number once marks are taken away, less if not."""
    base = F.lit(0.5)
    for name, c in CONFIDENCE.items():
        base = F.when(T.col(method) == name, F.lit(c)).otherwise(base)
    plain = F.regexp_replace(value, rf"[\$€£₤,%_{T.BLANKS}]", "")
    number = plain.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$")
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.when(number, 0.05).otherwise(-0.10))), 4)


def facts(chunks: DataFrame) -> DataFrame:
    """All patterns' facts, once per document, key and value: one pass over the chunks; their texts stay where they are."""
    table = F.col("chunk_type") == "table"
    x = chunks.select("document_id", "ldu_idx", "chunk_id", "page_refs", "content", F.when(table, _pairs("table")).when(~table, F.concat(*(_pairs(p) for p in ("kv", "text", "gap")))).alias("pairs")).where("size(pairs) > 0")
    x = x.select("document_id", "ldu_idx", "chunk_id", _page(), T.strip(F.regexp_extract("content", PERIOD, 0)).alias("period"), F.substring(T.strip(F.regexp_extract("content", T.LINES_JAVA + HEADING, 0)), 1, 120).alias("section"), "pairs")
    x = x.select("document_id", "ldu_idx", "chunk_id", "page_ref", "period", "section", F.explode("pairs").alias("p")).select("document_id", "ldu_idx", "chunk_id", "page_ref", "period", "section", "p.*").where("key <> '' AND value <> ''")
    first = F.expr("row_number() OVER (PARTITION BY document_id, lower(key), lower(value) ORDER BY ldu_idx, method_no, pos, chunk_id)")
    x = x.withColumn("r", first).where("r = 1")
    # a text without figures is less sure, and so is one without a colon
    method = F.when(F.col("method_no") == METHODS["table"], PATTERNS["table"][1]).otherwise(PATTERNS["kv"][1])
    less = F.when(F.col("method_no") == METHODS["gap"], 0.05).otherwise(0.0)
    text = F.col("method_no") == METHODS["text"]
    x = x.withColumn("method", method).withColumn("sure", F.when(text, F.lit(0.55)).otherwise(F.round(confidence("method", "value") - less, 4)))
    return x.select(
        "document_id", "chunk_id", "key", "value", F.when(text, F.lit("")).otherwise(unit_of("value")).alias("unit"), "page_ref", entity_of("key").alias("entity"), F.when(text, F.lit("")).otherwise(F.col("key")).alias("metric"),
        "period", "section", "method", F.col("sure").alias("confidence"),
    )


def like(c: str, pattern: str) -> Column:
    """SQL LIKE without an escape character, letter case aside."""
    return F.col(c).ilike(pattern.replace("\\", "\\\\"))


def query(facts: DataFrame, document_id: str | None = None, key: str | None = None, entity: str | None = None, period: str | None = None, least_confidence: float = 0.0) -> DataFrame:
    """Facts that meet all conditions given; equality and confidence reach the scan."""
    terms = []
    if document_id is not None:
        terms.append(F.col("document_id") == document_id)
    if key is not None:
        terms.append(like("key", key))
    if entity is not None:
        terms.append(like("entity", f"%{entity}%"))
    if period is not None:
        terms.append(like("period", f"%{period}%"))
    if least_confidence > 0:
        terms.append(F.col("confidence") >= least_confidence)
    return facts.where(reduce(lambda a, b: a & b, terms)) if terms else facts

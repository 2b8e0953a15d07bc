"""From blocks to chunks: detection of lists, headings and references, windows, packing, tables and figures.

Defined cases: null and blank text makes no chunk; null headers, rows and captions are empty; ties are broken by idx, then block_id; blocks
delivered twice count once; a single item or word run longer than MAX_TOKENS stays whole in its pack. Texts of any length are cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .skew import carried, once, running_sums

# Sizes in tokens, and patterns.
MAX_TOKENS, OVERLAP = 512, 64
LIST_ITEMS = [rf"^(\d+)\.{T.B}", rf"^[-•●◦▪]{T.B}", rf"^[a-z]\){T.B}", rf"^[ivxlcdm]+\){T.B}"]
HEADING = rf"^(?:(?:[A-Z][A-Z{T.BLANKS}\d.&:–—-]{{2,80}})|(?:\d+(?:\.\d+)*{T.B}+[A-Z].{{0,80}})|(?:[A-Z][a-zA-Z{T.BLANKS}&:–—-]{{2,60}}))$"
REFERENCE = rf"(?i)(?:see|refer{T.B}+to|as{T.B}+shown{T.B}+in|in|per){T.B}+((?:Table|Figure|Fig\.|Section|Appendix|Chart|Note)){T.B}*(\d+(?:\.\d+)*)"
SUBHEAD = rf"^[A-Z][A-Za-z{T.BLANKS}]{{2,40}}$"
REFERENCE_TYPES = ["table", "fig", "section", "appendix", "note", "chart"]
PAGES_A_BUCKET = 16


def is_list(c: str | Column) -> Column:
    """One kind of item mark begins two lines or more."""
    out = F.lit(False)
    for p in LIST_ITEMS:
        out = out | (F.regexp_count(c, F.lit(T.LINES_JAVA + p)) >= 2)
    return out


def is_heading(c: str | Column) -> Column:
    """At most ten words, no full stop at the end, and the form of a heading."""
    s = T.strip(c)
    return (s != "") & (F.size(T.tokens(s)) <= 10) & ~s.endswith(".") & s.rlike("(?d)" + HEADING)


def references(c: str | Column) -> Column:
    """array of (target_type, target_label) of every reference to a table, figure, section ..."""
    words = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))
    numbers = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(2))

    def kind(word: Column) -> Column:
        w = F.lower(word)
        out = F.lit("figure")
        for t in reversed(REFERENCE_TYPES):
            out = F.when(w.contains(t), F.lit("figure" if t == "fig" else t)).otherwise(out)
        return out

    return F.transform(F.arrays_zip(words.alias("w"), numbers.alias("n")), lambda x: F.struct(kind(x["w"]).alias("target_type"), F.concat_ws(" ", x["w"], x["n"]).alias("target_label")))


def window_texts(content: str | Column, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """array<string>: a text of at most ``size`` tokens as it is, a longer one in overlapping windows of tokens; none for a text without tokens."""
    t, step = T.tokens(content), size - overlap
    n = F.coalesce(F.size(t), F.lit(0))
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    cut_ = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(t, i * step + 1, F.lit(size)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(content)).otherwise(cut_)


def windows(texts: DataFrame, key: str, content: str, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(key, window_no, content, token_count) of the windows of each text."""
    w = texts.select(key, F.posexplode(window_texts(content, size, overlap)).alias("window_no", "content"))
    return w.withColumn("token_count", T.token_count("content"))


def list_texts(content: str | Column, size: int = MAX_TOKENS) -> Column:
    """array<string>: a list of at most ``size`` tokens as it is, a longer one in packs of its items, in order, a new pack before the item that would exceed ``size``."""
    starts = rf"{T.LINES_JAVA}(?=^(?:\d+\.{T.B}|[-•●◦▪]{T.B}|[a-z]\){T.B}))"
    items = F.filter(F.transform(F.split(content, starts), lambda i: T.strip(i)), lambda i: i != "")
    # A fold over one text's items: what is being packed, and the packs done.
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, i: Column) -> Column:
        k = F.size(T.tokens(i))
        flush = (a["n"] + k > size) & (a["n"] > 0)
        done = F.when(flush, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        open_ = F.when(flush | (a["n"] == 0), i).otherwise(F.concat(a["open"], F.lit("\n"), i))
        return F.struct(done.alias("done"), open_.alias("open"), F.when(flush, k).otherwise(a["n"] + k).alias("n"))

    packed = F.aggregate(items, zero, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return F.when(F.size(T.tokens(content)) <= size, F.array(content)).otherwise(packed)


def pack_list(texts: DataFrame, key: str, content: str, size: int = MAX_TOKENS) -> DataFrame:
    """(key, pack_no, content, token_count) of the packs of each list."""
    x = texts.where(T.strip(content) != "").select(key, F.posexplode(list_texts(content, size)).alias("pack_no", "content"))
    return x.withColumn("token_count", T.token_count("content"))


def table_groups(rows_: str | Column) -> Column:
    """array of (label, rows): a table of four rows or more cut at its subheader rows, if that gives two groups or more; else one group without label.

    A subheader has a capitalised text in its first cell and nothing in the others; of several in a row the last one counts.
    """
    rows = F.coalesce(rows_, F.array().cast("array<array<string>>"))

    def sub(r: Column) -> Column:
        first = T.strip(F.coalesce(F.try_element_at(r, F.lit(1)), F.lit("")))
        rest = F.forall(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda c: T.strip(F.coalesce(c, F.lit(""))).isin("", "-", "—"))
        return first.rlike("(?d)" + SUBHEAD) & rest

    # A fold over one table's rows, a bounded group: (label, rows) of each island.
    zero = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.array().cast("array<array<string>>").alias("rows")))

    def step(a: Column, r: Column) -> Column:
        last = F.element_at(a, -1)
        fresh = F.concat(a, F.array(F.struct(T.strip(F.element_at(r, 1)).alias("label"), F.array().cast("array<array<string>>").alias("rows"))))
        more = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["label"].alias("label"), F.concat(last["rows"], F.array(r)).alias("rows"))))
        return F.when(sub(r), fresh).otherwise(more)

    groups = F.filter(F.aggregate(rows, zero, step), lambda g: F.size(g["rows"]) > 0)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), rows.alias("rows")))
    return F.when((F.size(rows) >= 4) & (F.size(groups) >= 2), groups).otherwise(whole)


def subgroups(tables: DataFrame) -> DataFrame:
    """(block_id, group_no, label, rows) of the groups of each table."""
    x = once(tables.where("kind = 'table'").select("block_id", "rows"), "block_id")
    return x.select("block_id", F.posexplode(table_groups("rows")).alias("group_no", "g")).select("block_id", "group_no", "g.label", "g.rows")


def table_text(headers: str | Column, rows: str | Column, caption: str | Column) -> Column:
    """An optional caption, the header, a rule and the rows, cells joined by `` | ``."""
    line = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    h = T.col(headers)
    head = F.when(F.size(h) > 0, F.array(line(h), F.array_join(F.transform(h, lambda _: F.lit("---")), " | "))).otherwise(F.array().cast("array<string>"))
    body = F.coalesce(F.transform(rows, line), F.array().cast("array<string>"))
    top = F.when(F.coalesce(T.col(caption), F.lit("")) != "", F.array(F.concat(F.lit("Caption: "), caption))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(top, head, body), "\n")


def figure_text(figure_type: str | Column, caption: str | Column) -> Column:
    c = T.col(caption)
    return F.concat(F.lit("["), F.upper(figure_type), F.lit("] "), F.when(F.coalesce(c, F.lit("")) == "", F.lit("(no caption)")).otherwise(c))


def chunk_blocks(blocks: DataFrame) -> DataFrame:
    """(document_id, ldu_idx, block_id, part_no, page_number, chunk_type, content, parent_section, token_count, content_hash, table_id, figure_id, subgroup_label, parent_table_id, cross_references) in reading order.

    Order is page, then texts before tables before figures, then idx. A heading is its own section and that of all after
    it, across pages; tables and figures of a page come after its last heading. A paragraph of more than MAX_TOKENS tokens is cut
    into overlapping windows, a longer list into packs of items, a table into its groups of rows, each with the header. A table or figure without an id
    is numbered within its document. Groups of a table, headings and figures have no references.
    """
    kind = F.expr("CASE kind WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END")
    text = F.col("kind") == "text"
    needed = ["block_id", "document_id", "page_number", "kind", "idx", "content", "headers", "rows", "caption", "figure_type"]
    ids = [F.col(c) if c in blocks.columns else F.lit(None).cast("string").alias(c) for c in ("table_id", "figure_id")]
    x = once(blocks.select(*needed, *ids), "block_id").withColumn("kind_no", kind).withColumn("text", T.strip("content")).where(~text | (F.col("text") != ""))
    heading, listed = text & is_heading("text"), text & is_list("text")
    chunk_type = F.when(heading, "section").when(listed, "list").when(text, "paragraph").otherwise(F.col("kind"))
    x = x.withColumn("chunk_type", chunk_type).withColumn("heading", F.when(heading, F.col("text")))
    plain = lambda c: F.struct(c.alias("content"), F.lit(None).cast("string").alias("label"))
    groups = table_groups("rows")
    of_table = F.transform(groups, lambda g: F.struct(F.concat(F.when(F.coalesce(g["label"], F.lit("")) != "", F.concat(F.lit("[Subgroup: "), g["label"], F.lit("]\n"))).otherwise(F.lit("")), table_text("headers", g["rows"], "caption")).alias("content"), g["label"].alias("label")))
    parts = F.when(F.col("chunk_type") == "section", F.array(plain(F.col("text"))))
    parts = parts.when(F.col("chunk_type") == "list", F.transform(list_texts("text"), plain)).when(F.col("chunk_type") == "paragraph", F.transform(window_texts("text"), plain))
    parts = parts.when(F.col("kind") == "table", of_table).otherwise(F.array(plain(figure_text(F.coalesce("figure_type", F.lit("image")), "caption"))))
    x = x.withColumn("parts", parts).withColumn("bucket", F.floor(F.col("page_number") / PAGES_A_BUCKET))
    x = x.select("document_id", "bucket", "page_number", "kind", "kind_no", "idx", "block_id", "chunk_type", "heading", "parts", "table_id", "figure_id")
    order = ["page_number", "kind_no", "idx", "block_id"]
    x = carried(x, "document_id", "bucket", order, "heading", "parent_section")
    one = lambda k: F.when(F.col("kind") == k, 1).otherwise(0)
    x = running_sums(x, "document_id", "bucket", order, {"end": F.size("parts"), "tables": one("table"), "figures": one("figure")})
    named = lambda k, c: F.when(F.col("kind") == k, F.coalesce(F.expr(f"nullif({k}_id, '')"), F.concat(F.lit(f"{k.title()}_"), F.col(c)))).alias(f"{k}_id")
    several = F.size("parts") > 1
    x = x.select("document_id", "block_id", "page_number", "chunk_type", "parent_section", named("table", "tables"), named("figure", "figures"), (F.col("end") - F.size("parts")).alias("start"), ((F.col("kind") == "table") & several).alias("grouped"), F.posexplode("parts").alias("part_no", "p"))
    refers = F.col("chunk_type").isin("paragraph", "list") | ((F.col("chunk_type") == "table") & ~F.col("grouped"))
    return x.select(
        "document_id", (F.col("start") + F.col("part_no")).alias("ldu_idx"), "block_id", "part_no", "page_number", "chunk_type", F.col("p.content").alias("content"), "parent_section", T.token_count("p.content").alias("token_count"), T.content_hash("p.content").alias("content_hash"),
        "table_id", "figure_id", F.col("p.label").alias("subgroup_label"), F.when(F.col("grouped"), F.col("table_id")).alias("parent_table_id"), F.when(refers, references("p.content")).alias("cross_references"),
    )


def violations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, violation) of chunks that are empty, too long, have a stale hash or no page."""
    blank = T.strip(F.coalesce("content", F.lit(""))) == ""
    checks = [
        F.when(blank, "empty"),
        F.when((T.token_count("content") > MAX_TOKENS) & (F.coalesce("chunk_type", F.lit("")) != "table"), "too long"),
        F.when(~blank & ~F.col("content_hash").eqNullSafe(T.content_hash("content")), "hash"),
        F.when(F.coalesce(F.size("page_refs"), F.lit(0)) < 1, "no page"),
    ]
    x = chunks.where("chunk_id IS NOT NULL").select("chunk_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))
    return x.distinct()

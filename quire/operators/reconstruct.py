"""Rows of text from recognised boxes, and confidences of pages.

boxes: (box_id, document_id, page_number, idx, text, x1, y1, x2, y2, confidence, page_height), once each. Defined cases:
blank and null texts are dropped; null confidences don't count in sums; ties are broken by idx, then box_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Fixed values.
ROW_TOLERANCE, ROW_SHARE, LEAST_GAP = 8.0, 0.012, 20.0


def boxes_once(boxes: DataFrame) -> DataFrame:
    return boxes.where("box_id IS NOT NULL").dropDuplicates(["box_id"])


def distinct_boxes(boxes: DataFrame) -> DataFrame:
    """The first box of a page with a text, blanks and letter case aside."""
    x = boxes.withColumn("norm", F.lower(T.squeeze("text"))).where("norm <> ''")
    first = F.min(F.struct("idx", "box_id")).alias("first")
    keep = x.groupBy("document_id", "page_number", "norm").agg(first).select(F.col("first.box_id").alias("box_id"))
    return boxes.join(keep, "box_id", "left_semi")


def rows(boxes: DataFrame) -> DataFrame:
    """(document_id, page_number, row_no, text, n_boxes, x1, y1, x2, y2): boxes joined into rows.

    Boxes go by the middle of their height; one belongs to the row while it is within a tolerance of the row's first box.
    Two boxes with hardly a gap between them stay apart. A fold over one page's boxes, a bounded group.
    """
    x = boxes.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("yc", (F.col("y1") + F.col("y2")) / 2).withColumn("tol", F.greatest(F.lit(ROW_TOLERANCE), ROW_SHARE * F.col("page_height")))
    page = x.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("yc", "idx", "box_id", "tol", "text", "x1", "y1", "x2", "y2"))).alias("b"))
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))

    def step(a: Column, b: Column) -> Column:
        new = a["anchor"].isNull() | (F.abs(b["yc"] - a["anchor"]) > b["tol"])
        row = F.when(new, a["row"] + 1).otherwise(a["row"])
        return F.struct(F.when(new, b["yc"]).otherwise(a["anchor"]).alias("anchor"), row.alias("row"), F.concat(a["rows"], F.array(row)).alias("rows"))

    page = page.withColumn("r", F.aggregate("b", zero, step, lambda a: a["rows"]))
    flat = page.select("document_id", "page_number", F.explode(F.arrays_zip("b", "r")).alias("z")).select("document_id", "page_number", F.col("z.r").alias("row"), "z.b.*")
    group = flat.groupBy("document_id", "page_number", "row").agg(F.array_sort(F.collect_list(F.struct(((F.col("x1") + F.col("x2")) / 2).alias("xc"), "idx", "box_id", "text", "x1", "y1", "x2", "y2"))).alias("b"))
    two = F.size("b") == 2
    gap = F.element_at("b", 2)["x1"] - F.element_at("b", 1)["x2"]
    apart = two & (gap < LEAST_GAP)
    parts = F.when(apart, F.transform("b", lambda q: F.array(q))).otherwise(F.array("b"))
    out = group.select("document_id", "page_number", "row", F.posexplode(parts).alias("part", "p"))
    lo = lambda c: F.array_min(F.transform("p", lambda q: q[c]))
    hi = lambda c: F.array_max(F.transform("p", lambda q: q[c]))
    number = F.expr("row_number() OVER (PARTITION BY document_id, page_number ORDER BY row, part)")
    return out.select("document_id", "page_number", number.alias("row_no"), F.array_join(F.transform("p", lambda q: T.strip(q["text"])), " | ").alias("text"), F.size("p").alias("n_boxes"), lo("x1").alias("x1"), lo("y1").alias("y1"), hi("x2").alias("x2"), hi("y2").alias("y2"))


def running_confidence(boxes: DataFrame) -> DataFrame:
    """(document_id, page_number, confidence): the mean confidence of all boxes so far; one row a page is ordered, not the boxes."""
    p = boxes.groupBy("document_id", "page_number").agg(F.sum("confidence").alias("s"), F.count("*").alias("n"))
    so_far = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("document_id", "page_number", (F.coalesce(F.sum("s").over(so_far), F.lit(0.0)) / F.sum("n").over(so_far)).alias("confidence"))


def fast_text_confidence(density: str | Column, image_share: str | Column) -> Column:
    return 0.6 * F.least(T.col(density) / 0.02, F.lit(1.0)) + 0.4 * F.greatest(F.lit(0.0), 1 - T.col(image_share) / 0.5)


def layout_confidence(coverage: str | Column, completeness: str | Column) -> Column:
    """Of a layout model: from the share of pages with text, and of tables with rows (1 without tables)."""
    return F.bround(F.least(0.5 * T.col(coverage) + 0.3 * T.col(completeness) + 0.2, F.lit(1.0)), 4)


def layout_fallback_score(mean_chars: str | Column, n_tables: str | Column, coverage: str | Column, empty_share: str | Column) -> Column:
    c = F.least(T.col(mean_chars) / 500, F.lit(1.0)) * 0.5 + F.least(0.05 * T.col(n_tables), F.lit(0.2)) + 0.2 * T.col(coverage) + 0.1 * (1 - T.col(empty_share))
    return F.least(c, F.lit(1.0))


def layout_fallback_confidence(mean_chars: str | Column, n_tables: str | Column, coverage: str | Column, empty_share: str | Column) -> Column:
    return F.bround(layout_fallback_score(mean_chars, n_tables, coverage, empty_share), 4)


def ocr_confidence(total: str | Column, n_boxes: str | Column) -> Column:
    """The mean confidence of the boxes; 0.1 without any."""
    n = T.col(n_boxes)
    return F.when(n > 0, F.bround(F.least(F.coalesce(T.col(total), F.lit(0.0)) / n, F.lit(1.0)), 4)).otherwise(F.lit(0.1))


def ocr_fallback_confidence(mean_chars: str | Column) -> Column:
    """Of embedded text taken in place of recognition."""
    return F.bround(F.least(T.col(mean_chars) / 500, F.lit(1.0)) * 0.5, 4)


# Confidence by mean characters a page, above 200, above 50, and else.
VISION_STEPS = {"model": (0.75, 0.50, 0.20), "text": (0.60, 0.40, 0.15), "plain": (0.55, 0.35, 0.15)}


def vision_confidence(mean_chars: str | Column, source: str = "model") -> Column:
    """Of a vision model, or of text taken in its place by a better or a plainer reader."""
    high, middle, low = VISION_STEPS[source]
    return F.when(T.col(mean_chars) > 200, high).when(T.col(mean_chars) > 50, middle).otherwise(low)


FIGURE_AREA = 0.05


def words_to_blocks(words: DataFrame) -> DataFrame:
    """(document_id, page_number, content): the words of a page, in order, as one block. words: (document_id, page_number, idx, text); blank ones are left out. One page's words."""
    x = words.where(T.strip(F.coalesce("text", F.lit(""))) != "").groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("w"))
    return x.select("document_id", "page_number", F.array_join(F.transform("w", lambda q: q["text"]), " ").alias("content"))


def large_images(images: DataFrame) -> DataFrame:
    """images (width, height, page_width, page_height, ...) that take more than FIGURE_AREA of their page: figures."""
    return images.where(F.col("width") * F.col("height") > FIGURE_AREA * F.col("page_width") * F.col("page_height"))


def collected_items(items: DataFrame) -> DataFrame:
    """Blocks from a layout model's items: (document_id, page_number, idx, kind, content, headers, rows, caption, bbox).

    items: (document_id, page_number, ord, item_class, text, headers, rows, caption, bbox). Items without a page are dropped; a
    missing box is the whole page; tables and pictures are told by their class, all others are texts and dropped if blank.
    """
    kind = F.when(F.col("item_class") == "TableItem", "table").when(F.col("item_class") == "PictureItem", "figure").otherwise("text")
    whole = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(612.0).alias("x2"), F.lit(792.0).alias("y2"))
    x = items.where("page_number IS NOT NULL").withColumn("kind", kind).where((F.col("kind") != "text") | (T.strip(F.coalesce("text", F.lit(""))) != ""))
    x = x.withColumn("idx", F.expr("row_number() OVER (PARTITION BY document_id, page_number, kind ORDER BY ord)") - 1)
    return x.select("document_id", "page_number", "idx", "kind", F.when(F.col("kind") == "text", T.strip("text")).alias("content"), F.when(F.col("kind") == "table", F.col("headers")).alias("headers"), F.when(F.col("kind") == "table", F.col("rows")).alias("rows"), F.when(F.col("kind") == "figure", F.coalesce("caption", F.lit(""))).alias("caption"), F.coalesce("bbox", whole).alias("bbox"))

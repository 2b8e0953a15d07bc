import pytest
from pyspark.sql import functions as F

from quire.llm import ocr

RARE, COMMON, SEEN = "The farm paid the tax.", "The form of the tax.", "The audit of the tax."


def scans(spark, words):
    """A table with farm 5 times, form 60 times, audit 8 times, and filler up to so many words."""
    lines = [("a_1", "\n".join([RARE] * 5)), ("a_2", "\n".join([COMMON] * 60)), ("a_3", "\n".join([SEEN] * 8))]
    filler = spark.range(24, numPartitions=4).select(F.format_string("f_%d", "id").alias("chunk_id"), F.expr(f"repeat(concat(repeat('the tax of ', 1000), '\n'), {words // 72_000})").alias("content"))
    chunks = spark.createDataFrame(lines, "chunk_id string, content string").unionByName(filler).withColumn("document_id", F.lit("d"))
    profiles = spark.createDataFrame([("d", "scanned_image")], "document_id string, origin_type string")
    boxes = spark.createDataFrame([], "box_id string, document_id string, page_number int, idx int, text string, y1 double, page_height double")
    return chunks, profiles, boxes


@pytest.mark.parametrize("words", [72_000, 12_096_000])
def test_a_right_word_stays_at_any_size_of_the_table(spark, rows, words):
    """At 12 million words, one seen 5 times was taken for one never seen, and so for a misreading of form."""
    assert [r for r in rows(ocr.noise(*scans(spark, words))) if r[1][0] == "a"] == []


def test_every_word_keeps_its_count_and_its_vector(spark):
    counts, vectors, _, _ = ocr.fit(ocr.units(*scans(spark, 12_096_000)))
    assert [counts.get(w, 0) for w in ("farm", "form", "audit", "firm")] == [5, 60, 8, 0]
    assert vectors.get("audit") is not None and vectors.get("form") is not None and vectors.get("farm") is None

import pytest
from pyspark.sql import functions as F

from quire.operators import reconstruct, triage

PAGE = "document_id string, page_number int, width double, height double, n_chars int, image_area double, table_area double, text string, n string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGE)


def test_origin(spark):
    p = pages(
        spark,
        ("a", 1, 612.0, 792.0, 10000, 0.0, 0.0, ""), ("b", 1, 612.0, 792.0, 0, 612.0 * 792, 0.0, ""), ("c", 1, 612.0, 792.0, 10000, 612.0 * 554, 0.0, ""), ("d", 1, 612.0, 792.0, 20, 612.0 * 238, 0.0, ""), ("e", 1, 0.0, 0.0, 5, 0.0, 0.0, ""),
        *(("f", i, 612.0, 792.0, 5000 if i < 6 else 0, 0.0, 0.0, "") for i in range(1, 12)), ("g", 1, None, None, None, None, None, None),
    )
    got = {r.document_id: (r.origin_type, r.confidence) for r in triage.origin(p).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "native_digital", "b": "scanned_image", "c": "native_digital", "d": "mixed", "e": "scanned_image", "f": "native_digital", "g": "scanned_image"}
    assert got["e"][1] == 0.5 and all(0.5 <= v[1] <= 1 for v in got.values())


def test_layout(spark):
    p = pages(
        spark,
        ("a", 1, 612.0, 792.0, 10, 0.0, 612.0 * 634, ""), ("b", 1, 612.0, 792.0, 5000, 612.0 * 317, 0.0, ""), ("c", 1, 612.0, 792.0, 10, 0.0, 0.0, ""), ("d", 1, 0.0, 0.0, 10, 0.0, 0.0, ""), ("e", 1, 612.0, 792.0, 5000, 612.0 * 300, 612.0 * 500, ""), ("f", 1, 612.0, 792.0, 10, 0.0, 0.0, ""),
    )
    w = spark.createDataFrame([("c", 1, x, x + 150.0) for x in [50.0] * 10 + [400.0] * 10] + [("f", 1, 50.0, 200.0)] * 9, "document_id string, page_number int, x0 double, x1 double")
    got = {r.document_id: r.layout_complexity for r in triage.layout(p, w).collect()}
    assert got == {"a": "table_heavy", "b": "figure_heavy", "c": "multi_column", "d": "single_column", "e": "table_heavy", "f": "single_column"}


def test_domain_ties_go_to_the_first(spark):
    p = pages(spark, ("a", 1, 1.0, 1.0, 1, 0.0, 0.0, "revenue court"), ("b", 1, 1.0, 1.0, 1, 0.0, 0.0, "patient Diagnosis revenue"), ("c", 1, 1.0, 1.0, 1, 0.0, 0.0, "nothing"), ("d", 3, 1.0, 1.0, 1, 0.0, 0.0, "court"), ("e", 1, 1.0, 1.0, 1, 0.0, 0.0, None))
    assert {r.document_id: r.domain_hint for r in triage.domain(p).collect()} == {"a": "financial", "b": "medical", "c": "general", "e": "general"}


def test_routing_and_classes(spark):
    x = spark.createDataFrame(
        [("1", "scanned_image", "single_column", None, None), ("2", "native_digital", "single_column", "financial", "x.pdf"), ("3", "native_digital", "table_heavy", None, "y.pdf"), ("4", "mixed", "single_column", None, "Survey_1.pdf"), ("5", "form_fillable", "single_column", None, "z")],
        "document_id string, origin_type string, layout_complexity string, domain_hint string, source_filename string",
    )
    cost = triage.cost("origin_type", "layout_complexity")
    got = {r.document_id: (r.c, r.k, len(r.t)) for r in x.select("document_id", cost.alias("c"), triage.document_class().alias("k"), triage.chain("origin_type", "layout_complexity", cost).alias("t")).collect()}
    assert got == {"1": ("needs_vision_model", "B", 2), "2": ("fast_text_sufficient", "A", 4), "3": ("needs_layout_model", "D", 3), "4": ("needs_layout_model", "C", 3), "5": ("needs_layout_model", "C", 3)}
    assert {r["class"]: (r.n, r.enough) for r in triage.class_coverage(x.limit(0)).collect()} == dict.fromkeys("ABCD", (0, False))
    assert [r.document_id for r in triage.coverage_gap(x, x.select("document_id").union(spark.sql("SELECT '9'"))).collect()] == ["9"]


TRY = "document_id string, strategy string, page_number int, n_chars int, page_confidence double, doc_confidence double, error string"


def _escalated(spark, chains, tries, **changes):
    from dataclasses import replace

    p = spark.createDataFrame(sorted({(t[0], t[2]) for t in tries}), "document_id string, page_number int")
    ledger, pages = triage.escalate(p, spark.createDataFrame(chains, "document_id string, chain array<string>"), spark.createDataFrame(tries, TRY), replace(triage.RULES, **changes))
    return ledger.orderBy("document_id", "depth").collect(), pages


A, B, C, D = triage.TIERS


def test_escalation(spark, rows):
    tries = [("a", A, 1, 900, 0.3, 0.3, None), ("a", A, 2, 900, 0.9, 0.3, None), ("a", B, 1, 950, 0.85, 0.85, None), ("b", A, 1, 900, 0.95, 0.95, None), ("c", C, 1, 900, 0.1, 0.1, None)]
    ledger, pages = _escalated(spark, [("a", [A, B]), ("b", [A, B]), ("c", [C, D]), ("z", [A])], tries)
    got = [(r.document_id, r.strategy_used, r.n_pages, r.escalation_triggered, r.flagged_for_review, r.page_scope) for r in ledger if r.document_id != "z"]
    assert got == [("a", A, 2, True, True, [1]), ("a", B, 1, False, False, [1]), ("b", A, 1, False, False, None), ("c", C, 1, True, True, [1])]
    assert ledger[0].escalation_reason == "page-level escalation: 1 pages below 0.6 confidence" and ledger[0].cost_estimate == "low"
    assert rows(pages) == [("a", 1, B, 950), ("a", 2, A, 900), ("b", 1, A, 900), ("c", 1, C, 900)]


def test_escalation_budget_vision_and_failures(spark, rows):
    # without weak pages all are tried again
    tries = [("a", A, p, 900, 0.0, 0.2, None) for p in (1, 2)] + [("a", B, p, 800, 0.9, 0.1, None) for p in (1, 2)] + [("a", C, p, 10, 0.9, 0.9, None) for p in (1, 2)]
    tries += [("e", A, 1, None, None, None, "boom"), ("e", B, 1, 70, 0.9, 0.9, None)]
    chains = [("a", [A, B, C, D]), ("e", [A, B, C, D])]
    ledger, pages = _escalated(spark, chains, tries, budget=0.02)
    got = [(r.document_id, r.strategy_used, r.confidence_score, r.failure_reason, r.fallback_trigger, r.escalation_reason) for r in ledger]
    assert got == [
        ("a", A, 0.2, None, None, "confidence 0.2000 < 0.6"), ("a", B, 0.1, None, None, "confidence 0.1000 < 0.5"), ("a", C, 0.0, "budget_exhausted (0.02)", None, None),
        ("e", A, 0.0, "boom", "exception", None), ("e", B, 0.9, None, None, None),
    ]
    assert rows(pages) == [("a", 1, A, 900), ("a", 2, A, 900), ("e", 1, B, 70)]
    ledger, _ = _escalated(spark, chains, tries, budget=9.0)
    assert [r.strategy_used for r in ledger if r.document_id == "a"] == [A, B, C]
    ledger, _ = _escalated(spark, chains, tries, budget=0.02, vision=True)
    assert [(r.strategy_used, r.failure_reason) for r in ledger if r.document_id == "a"][2:] == [(C, "budget_exhausted (0.02)"), (D, "budget_exhausted (0.02)")]
    ledger, _ = _escalated(spark, chains, tries, max_depth=1)
    assert len(ledger) == 2


def test_rules_of_a_file(tmp_path):
    from quire.operators import rules

    (tmp_path / "r.yaml").write_text('{"origin_detection": {"min_char_density": 0.5}, "escalation": {"strategy_a_min_confidence": 1, "max_escalation_depth": 2}, "domain_keywords": {"x": ["Y"]}, "else": 1}')
    r = rules.load(str(tmp_path / "r.yaml"))
    assert (r.native_density, r.fast_text_least, r.max_depth, r.domains, r.scanned_share) == (0.5, 1.0, 2, {"x": ["y"]}, 0.7)
    (tmp_path / "s.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        rules.load(str(tmp_path / "s.yaml"))


def test_profiles_and_gaps(spark):
    p = pages(spark, ("a", 1, 612.0, 792.0, 10000, 0.0, 0.0, "revenue"), ("a", 2, 612.0, 792.0, 5, 0.0, 0.0, ""))
    w = spark.createDataFrame([], "document_id string, page_number int, x0 double, x1 double")
    files = spark.createDataFrame([("a", "a.pdf"), ("b", "Survey.pdf"), ("c", "Annual_Report_June.pdf")], "document_id string, source_filename string")
    got = {r.document_id: r for r in triage.profiles(files, p, w).collect()}
    assert (got["a"].origin_type, got["a"].estimated_extraction_cost, got["a"].domain_hint, got["a"].page_count, got["a"].total_chars) == ("native_digital", "fast_text_sufficient", "financial", 2, 10005)
    assert (got["b"].origin_type, got["b"].layout_complexity, got["b"].page_count, got["b"].confidence) == ("scanned_image", "single_column", 0, 0.5)
    x = triage.profiles(files.limit(0), p, w)
    gaps = {(r["class"], r.needed, r.document_id) for r in triage.gap_candidates(x, files).collect()}
    assert gaps == {("A", 3, "c"), ("B", 3, None), ("C", 3, "b"), ("D", 3, None)}


def test_confidences(spark):
    x = spark.sql("SELECT 0.5D h, 300D m, 3 n, 0D z, cast(null AS double) e")
    r = x.select(
        reconstruct.layout_confidence("h", "h").alias("a"), reconstruct.layout_fallback_confidence("m", "n", "h", "z").alias("b"), reconstruct.ocr_confidence("e", "n").alias("c"), reconstruct.ocr_confidence("h", F.lit(0)).alias("d"),
        reconstruct.ocr_fallback_confidence("m").alias("f"), *(reconstruct.vision_confidence(F.lit(float(k)), s).alias(f"{s}{k}") for s in reconstruct.VISION_STEPS for k in (201, 200, 50)),
    ).first()
    assert tuple(r) == (0.6, 0.65, 0.0, 0.1, 0.3, 0.75, 0.5, 0.2, 0.6, 0.4, 0.15, 0.55, 0.35, 0.15)


def test_items_and_words_become_blocks(spark, rows):
    items = spark.createDataFrame([("d", 1, 0, "TextItem", " a ", None), ("d", 1, 1, "TableItem", None, [["1"]]), ("d", 1, 2, "PictureItem", None, None), ("d", None, 3, "TextItem", "x", None), ("d", 1, 4, "TextItem", " ", None), ("d", 1, 5, "Other", "b", None)], "document_id string, page_number int, ord int, item_class string, text string, rows array<array<string>>")
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    got = reconstruct.collected_items(items.withColumns({"headers": F.array(F.lit("h")), "caption": F.lit(None).cast("string"), "bbox": F.lit(None).cast(box)})).collect()
    assert sorted((r.kind, r.idx, r.content, r.caption) for r in got if r.kind != "table") == [("figure", 0, None, ""), ("text", 0, "a", None), ("text", 1, "b", None)] and all(r.bbox.x2 == 612.0 for r in got)
    w = spark.createDataFrame([("d", 1, 2, "b"), ("d", 1, 1, "a"), ("d", 1, 3, " "), ("d", 2, 1, None)], "document_id string, page_number int, idx int, text string")
    assert rows(reconstruct.words_to_blocks(w)) == [("d", 1, "a b")]
    im = spark.createDataFrame([(100.0, 100.0, 600.0, 600.0), (200.0, 100.0, 600.0, 600.0)], "width double, height double, page_width double, page_height double")
    assert [r.width for r in reconstruct.large_images(im).collect()] == [200.0]


def test_merge_keeps_the_first_of_equal_pages(spark, rows):
    t = spark.createDataFrame([("a", 1, "fast_text", 5), ("a", 1, "ocr_heavy", 5), ("a", 2, "fast_text", 5), ("a", 2, "ocr_heavy", 6)], "document_id string, page_number int, strategy string, n_chars long")
    assert rows(triage.merge_pages(t)) == [("a", 1, "fast_text", 5), ("a", 2, "ocr_heavy", 6)]
    assert triage.low_confidence_pages(t.withColumn("page_confidence", F.lit(0.0)), 0.5).count() == 4


BOX = "box_id string, document_id string, page_number int, idx int, text string, x1 double, y1 double, x2 double, y2 double, confidence double, page_height double, row string"


def box(i, y, text="t", x=0.0, conf=0.9, page=1):
    return (str(i), "d", page, i, text, x, y - 1, x + 10, y + 1, conf, 600.0, "clash")


def test_rows_anchor_on_the_first_box(spark):
    ys = [100.0, 105.0, 109.0, 200.0, 207.0, 209.0]
    b = spark.createDataFrame([box(i, y, f"t{i}", 100.0 * i) for i, y in enumerate(ys)] + [box(9, 300.0, " "), box(10, 300.0, None)], BOX)
    got = [(r.text, r.n_boxes, r.x1, r.x2) for r in reconstruct.rows(b).orderBy("row_no").collect()]
    assert got == [("t0 | t1", 2, 0.0, 110.0), ("t2", 1, 200.0, 210.0), ("t3 | t4", 2, 300.0, 410.0), ("t5", 1, 500.0, 510.0)]
    near = spark.createDataFrame([box(1, 100.0, "a", 0.0), box(2, 100.0, "b", 15.0)], BOX)
    assert [r.text for r in reconstruct.rows(near).orderBy("row_no").collect()] == ["a", "b"]
    assert reconstruct.rows(b.limit(0)).count() == 0


def test_distinct_boxes_and_running_confidence(spark):
    b = spark.createDataFrame([box(1, 1.0, "Total  Assets"), box(2, 2.0, "total assets"), box(3, 3.0, None), box(4, 9.0, "x", conf=0.5, page=2), box(5, 9.0, "y", conf=None, page=2)], BOX)
    b = b.unionByName(b)
    once = reconstruct.boxes_once(b)
    assert sorted(r.box_id for r in reconstruct.distinct_boxes(once).collect()) == ["1", "4", "5"]
    got = {r.page_number: round(r.confidence, 6) for r in reconstruct.running_confidence(once).collect()}
    assert got == {1: 0.9, 2: round((2.7 + 0.5) / 5, 6)}

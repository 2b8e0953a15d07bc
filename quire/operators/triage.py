"""Profiles of documents from page primitives: origin, layout, domain, cost, class, and their coverage.

pages: (document_id, page_number, width, height, n_chars, image_area, table_area, text); words: (document_id, page_number, x0, x1).
Defined cases: pages without area make a scanned image of confidence 0.5 and a single column; nulls count as nothing; only the first pages
count, as many as the constants say, by page_number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .rules import Rules

RULES = Rules()
DOMAINS = RULES.domains

# Word lists of file names, and classes.
TECHNICAL_NAMES = ["fta", "assessment", "survey", "pharmaceutical", "company_profile", "company profile", "at_a_glance", "vulnerability", "security_vulnerability", "procedure", "whistle", "manufacturing"]
FISCAL_NAMES = ["tax_expenditure", "tax expenditure", "consumer price index", "consumer_price_index", "price index", "price_index", "assigned-regular-budget"]
ANNUAL_NAMES = ["annual_report_june", "annual report june"]
CLASSES = ["A", "B", "C", "D"]
CLASS_LEAST = 3


def origin(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(document_id, origin_type, confidence)."""
    p = pages.where(F.col("page_number") <= rules.sample_pages).groupBy("document_id")
    x = p.agg(F.sum("n_chars").alias("chars"), F.sum(F.col("width") * F.col("height")).alias("area"), F.sum("image_area").alias("images"))
    density, share = F.col("chars") / F.col("area"), F.col("images") / F.col("area")
    empty = F.coalesce("area", F.lit(0.0)) == 0
    native, scanned = density >= rules.native_density, share > rules.scanned_share
    kind = F.when(empty, "scanned_image").when(native, "native_digital").when(scanned, "scanned_image").otherwise("mixed")
    far = lambda v, t: F.least(F.abs(v - t) / t, F.lit(1.0))
    sure = F.when(empty, 0.5).otherwise(F.round(0.5 + 0.5 * (far(density, rules.native_density) + far(share, rules.scanned_share)) / 2, 4))
    return x.select("document_id", kind.alias("origin_type"), sure.alias("confidence"))


def layout(pages: DataFrame, words: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(document_id, layout_complexity): tables, then figures, then the spread of the words' middles."""
    p = pages.where(F.col("page_number") <= rules.sample_pages)
    a = p.groupBy("document_id").agg(F.sum("n_chars").alias("chars"), F.sum(F.col("width") * F.col("height")).alias("area"), F.sum("image_area").alias("images"), F.sum("table_area").alias("tables"))
    mid = ((F.col("x0") + F.col("x1")) / 2 / F.col("width")).alias("mid")
    w = words.join(p.select("document_id", "page_number", "width"), ["document_id", "page_number"]).where("width > 0").select("document_id", mid)
    w = w.groupBy("document_id").agg(F.count("*").alias("n"), F.avg("mid").alias("mean"), F.stddev_samp("mid").alias("dev"))
    x = a.join(w, "document_id", "left")
    some = F.coalesce("area", F.lit(0.0)) > 0
    columns = (F.col("n") >= rules.column_words) & (F.col("mean") > 0) & (F.col("dev") / F.col("mean") > rules.column_variation)
    kind = F.when(some & (F.col("tables") / F.col("area") > rules.table_share), "table_heavy").when(some & (F.col("images") / F.col("area") > rules.figure_share) & (F.col("chars") / F.col("area") > rules.figure_density), "figure_heavy").when(some & columns, "multi_column").otherwise("single_column")
    return x.select("document_id", kind.alias("layout_complexity"))


def domain(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(document_id, domain_hint): the domain with most of its keywords in the first pages, the first listed of equals; general if none."""
    low = F.lower("text")
    p = pages.where(F.col("page_number") <= rules.domain_pages)
    n = [F.max(F.when(low.contains(w), 1).otherwise(0)) for words in rules.domains.values() for w in words]
    sums, at = [], 0
    for name, words in rules.domains.items():
        total = n[at]
        for k in range(at + 1, at + len(words)):
            total = total + n[k]
        sums.append(total.alias(name))
        at += len(words)
    x = p.groupBy("document_id").agg(*sums)
    best = F.greatest(*rules.domains) if len(rules.domains) > 1 else F.col(*rules.domains)
    out = F.lit("general")
    for name in reversed(rules.domains):
        out = F.when((best > 0) & (F.col(name) == best), name).otherwise(out)
    return x.select("document_id", out.alias("domain_hint"))


def cost(origin_type: str | Column, layout_complexity: str | Column) -> Column:
    o, c = (F.col(x) if isinstance(x, str) else x for x in (origin_type, layout_complexity))
    return F.when(o == "scanned_image", "needs_vision_model").when((o == "native_digital") & (c == "single_column"), "fast_text_sufficient").otherwise("needs_layout_model")


def profiles(files: DataFrame, pages: DataFrame, words: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(document_id, source_filename, origin_type, layout_complexity, language, language_confidence, domain_hint, estimated_extraction_cost, page_count, total_chars, confidence).

    files: (document_id, source_filename). A document without pages is a scanned image of a single column, of no pages. The language is not
    looked for here; each document has the same placeholder of confidence 0.5.
    """
    n = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count"), F.sum(F.coalesce("n_chars", F.lit(0))).cast("long").alias("total_chars"))
    x = files.select("document_id", "source_filename")
    for part in (n, origin(pages, rules), layout(pages, words, rules), domain(pages, rules)):
        x = x.join(part, "document_id", "left")
    x = x.withColumns({"origin_type": F.coalesce("origin_type", F.lit("scanned_image")), "layout_complexity": F.coalesce("layout_complexity", F.lit("single_column")), "domain_hint": F.coalesce("domain_hint", F.lit("general"))})
    return x.select(
        "document_id", "source_filename", "origin_type", "layout_complexity", F.lit("en").alias("language"), F.lit(0.5).alias("language_confidence"), "domain_hint", cost("origin_type", "layout_complexity").alias("estimated_extraction_cost"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("total_chars", F.lit(0)).cast("long").alias("total_chars"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def document_class(origin_type: str = "origin_type", layout_complexity: str = "layout_complexity", domain_hint: str = "domain_hint", filename: str = "source_filename") -> Column:
    """A to D, the first rule that holds."""
    o, c, d, f = F.col(origin_type), F.col(layout_complexity), F.coalesce(domain_hint, F.lit("")), F.lower(F.coalesce(filename, F.lit("")))
    return (
        F.when(o == "scanned_image", "B").when(_any(f, TECHNICAL_NAMES), "C").when(_any(f, FISCAL_NAMES), "D").when((c == "table_heavy") & o.isin("native_digital", "mixed"), "D").when(_any(f, ANNUAL_NAMES), "A").when(o == "native_digital", "A").otherwise("C")
    )


def class_coverage(profiles: DataFrame) -> DataFrame:
    """(class, n, enough): every class, also those without documents."""
    n = profiles.groupBy(document_class().alias("class")).agg(F.count("*").alias("n"))
    every = profiles.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    x = every.join(n, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.withColumn("enough", F.col("n") >= CLASS_LEAST)


def coverage_gap(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """Files without a profile: (document_id, ...) of files, less those profiled."""
    return files.join(profiles.select("document_id").distinct(), "document_id", "left_anti")


def gap_candidates(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """(class, needed, document_id, source_filename): for each class with fewer than CLASS_LEAST documents, the files without a profile whose name has a word of the class; one row without a file if there is none.

    Only names tell what a file may be before it is read: words of technical papers for C, of tax and price reports for D, of annual
    reports for A. No word tells scans.
    """
    short = class_coverage(profiles).where("NOT enough").select("class", (F.lit(CLASS_LEAST) - F.col("n")).alias("needed"))
    name = F.lower(F.coalesce("source_filename", F.lit("")))
    kind = F.when(_any(name, TECHNICAL_NAMES), "C").when(_any(name, FISCAL_NAMES), "D").when(_any(name, ANNUAL_NAMES), "A")
    open_ = coverage_gap(profiles, files).select(kind.alias("class"), "document_id", "source_filename").where("class IS NOT NULL")
    return F.broadcast(short).join(open_, "class", "left")  # at most four classes


# Routing: which ways of extraction are tried, in order, and when the next one is.
CHAINS = {"vision": ["ocr_heavy", "vision_augmented"], "layout": ["layout_aware", "ocr_heavy", "vision_augmented"], "fast": ["fast_text", "layout_aware", "ocr_heavy", "vision_augmented"]}
TIERS = ["fast_text", "layout_aware", "ocr_heavy", "vision_augmented"]
COSTS = {"fast_text": ("low", 0.0), "layout_aware": ("medium", 0.01), "ocr_heavy": ("high", 0.05), "vision_augmented": ("extreme", 0.10)}
COSTLY = ["ocr_heavy", "vision_augmented"]
SPARSE_PAGE = 50


def _by_tier(of: str | Column, values: dict[str, object], otherwise: object) -> Column:
    out = F.lit(otherwise)
    for tier, v in values.items():
        out = F.when((F.col(of) if isinstance(of, str) else of) == tier, F.lit(v)).otherwise(out)
    return out


def chain(origin_type: str, layout_complexity: str, cost_hint: Column) -> Column:
    """The ways of extraction to try, from the cheapest that can do."""
    o, c = F.col(origin_type), F.col(layout_complexity)
    a = {k: F.array(*(F.lit(x) for x in v)) for k, v in CHAINS.items()}
    return F.when(o == "scanned_image", a["vision"]).when(o == "mixed", a["layout"]).when((cost_hint == "needs_layout_model") | c.isin("table_heavy", "figure_heavy", "multi_column"), a["layout"]).when(cost_hint == "needs_vision_model", a["vision"]).otherwise(a["fast"])


def low_confidence_pages(pages: DataFrame, least: float) -> DataFrame:
    """Pages with hardly any text, or with a confidence above 0 and below ``least``."""
    return pages.where((F.coalesce("n_chars", F.lit(0)) < SPARSE_PAGE) | ((F.col("page_confidence") > 0) & (F.col("page_confidence") < least)))


def merge_pages(tries: DataFrame) -> DataFrame:
    """(document_id, page_number, strategy, n_chars): of the tries at a page, the first with most characters."""
    tier = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("strategy"))
    best = F.max_by(F.struct("strategy", "n_chars"), F.struct("n_chars", -tier))
    return tries.groupBy("document_id", "page_number").agg(best.alias("b")).select("document_id", "page_number", "b.strategy", "b.n_chars")


def strategies_used(tries: DataFrame) -> DataFrame:
    """(document_id, strategies): the ways that gave pages of a document, in order, joined by commas."""
    tiers = F.filter(F.array(*(F.lit(t) for t in TIERS)), lambda t: F.array_contains(F.col("used"), t))
    return tries.groupBy("document_id").agg(F.collect_set("strategy").alias("used")).select("document_id", F.array_join(tiers, ",").alias("strategies"))


LEDGER = ["document_id", "depth", "strategy_used", "n_pages", "confidence_score", "cost_estimate", "page_scope", "failure_reason", "fallback_trigger", "escalation_triggered", "escalation_reason", "flagged_for_review"]


def escalate(pages: DataFrame, chains: DataFrame, tries: DataFrame, rules: Rules = RULES) -> tuple[DataFrame, DataFrame]:
    """The ledger of what was tried for each document, and (document_id, page_number, strategy, n_chars) of the pages it got.

    tries: (document_id, strategy, page_number, n_chars, page_confidence, doc_confidence, error), what each way would give. A document goes on to the
    next way while its confidence is below the way's least; then only with its weak pages, if it has any: pages of hardly any text, or of a confidence
    above 0 and below that least. A way that fails is followed by the next with the same pages. Costly ways are left out, with an entry, once a document has
    spent the budget, and vision, without one, unless it is allowed. page_scope is the pages after narrowing, null for all.
    The loop has at most four steps, one for each way; each step is one plan over all documents.
    """
    tries, chains = cut(tries), cut(chains.where("document_id IS NOT NULL"))
    state = chains.select("document_id", F.lit(0.0).alias("cost"), F.lit(True).alias("going"), F.lit(False).alias("narrowed"))
    got = pages.select("document_id", "page_number", F.lit(True).alias("todo"), F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("page_confidence")).distinct()
    got, ledger = cut(got), []
    for depth in range(min(len(TIERS), rules.max_depth)):
        at = chains.where(F.size("chain") > depth).select("document_id", F.element_at("chain", depth + 1).alias("tier")).join(state.where("going"), "document_id")
        if not rules.vision:
            at = at.where("tier <> 'vision_augmented'")
        blocked = F.col("tier").isin(COSTLY) & (F.col("cost") >= rules.budget)
        least = _by_tier("tier", {t: rules.least(t) for t in TIERS}, 0.5)
        new = tries.select("document_id", F.col("strategy").alias("tier"), "page_number", F.col("n_chars").cast("long").alias("new_chars"), F.col("page_confidence").alias("new_confidence"), "doc_confidence")
        errors = tries.where("error IS NOT NULL").groupBy("document_id", F.col("strategy").alias("tier")).agg(F.max("error").alias("error"))
        at = at.join(errors, ["document_id", "tier"], "left")  # one failure is that of the whole attempt
        x = got.join(at.withColumn("blocked", blocked), "document_id", "left").withColumn("here", F.col("tier").isNotNull() & ~F.coalesce("blocked", F.lit(False)) & F.col("todo"))
        x = x.join(new, ["document_id", "tier", "page_number"], "left")
        gave = F.col("here") & F.col("error").isNull() & F.col("doc_confidence").isNotNull()
        better = gave & (F.col("n_chars").isNull() | (F.coalesce("new_chars", F.lit(0)) > F.col("n_chars")))
        x = x.withColumns({
            "strategy": F.when(better, F.col("tier")).otherwise(F.col("strategy")),
            "page_confidence": F.when(better, F.col("new_confidence")).otherwise(F.col("page_confidence")),
            "n_chars": F.when(better, F.coalesce("new_chars", F.lit(0))).otherwise(F.col("n_chars")),
        })
        weak = F.col("n_chars").isNotNull() & ((F.col("n_chars") < SPARSE_PAGE) | ((F.col("page_confidence") > 0) & (F.col("page_confidence") < least)))
        x = cut(x.select("document_id", "page_number", "todo", "strategy", "n_chars", "page_confidence", "here", weak.alias("weak"), gave.alias("gave"), "doc_confidence"))
        d = x.groupBy("document_id").agg(F.sum(F.col("gave").cast("int")).alias("n_pages"), F.max(F.when(F.col("gave"), F.col("doc_confidence"))).alias("confidence"), F.sum(F.col("weak").cast("int")).alias("n_weak"))
        d = at.withColumn("blocked", blocked).withColumn("least", least).join(d, "document_id", "left")
        failed = F.col("error").isNotNull()
        sure = F.when(F.col("blocked") | failed, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
        d = d.withColumns({"failed": failed, "sure": sure, "n_weak": F.coalesce("n_weak", F.lit(0)), "n_pages": F.coalesce("n_pages", F.lit(0))})
        worked = ~F.col("blocked") & ~F.col("failed")
        d = d.withColumns({"worked": worked, "more": worked & (F.col("sure") < F.col("least"))})
        d = cut(d.withColumn("narrow", F.col("more") & (F.col("n_weak") > 0)))
        # a document's pages: a bounded group, as its ledger entry must be one row
        scope = x.join(d.where("narrow OR narrowed").select("document_id", "narrow"), "document_id").where("CASE WHEN narrow THEN weak ELSE todo END").groupBy("document_id").agg(F.array_sort(F.collect_set("page_number")).alias("page_scope"))
        reason = F.when(F.col("narrow"), F.format_string("page-level escalation: %d pages below %s confidence", "n_weak", F.col("least").cast("string"))).when(F.col("more"), F.format_string("confidence %.4f < %s", "sure", F.col("least").cast("string")))
        entry = d.join(scope, "document_id", "left").select(
            "document_id", F.lit(depth).alias("depth"), F.col("tier").alias("strategy_used"), "n_pages", F.col("sure").alias("confidence_score"), _by_tier("tier", {t: c for t, (c, _) in COSTS.items()}, "unknown").alias("cost_estimate"), "page_scope",
            F.when(F.col("blocked"), F.format_string("budget_exhausted (%.2f)", "cost")).when(F.col("failed"), F.col("error")).alias("failure_reason"), F.when(F.col("failed"), "exception").alias("fallback_trigger"),
            F.col("more").alias("escalation_triggered"), reason.alias("escalation_reason"), (F.col("sure") < rules.review_below).alias("flagged_for_review"),
        )
        ledger.append(entry)
        spent = F.when(F.col("worked"), _by_tier("tier", {t: c for t, (_, c) in COSTS.items()}, 0.0) * F.greatest(F.col("n_pages"), F.lit(1))).otherwise(0.0)
        after = d.select("document_id", F.round(F.col("cost") + spent, 6).alias("cost_"), (F.col("more") | ~F.col("worked")).alias("going_"), (F.col("narrowed") | F.col("narrow")).alias("narrowed_"), "narrow")
        # a document whose chain is left out here goes on; one that is done, or has no more ways, is no longer in ``at``
        state = cut(state.join(after.drop("narrow"), "document_id", "left").select("document_id", F.coalesce("cost_", "cost").alias("cost"), F.coalesce("going_", "going").alias("going"), F.coalesce("narrowed_", "narrowed").alias("narrowed")))
        x = x.join(after.select("document_id", "narrow"), "document_id", "left")
        got = x.select("document_id", "page_number", F.when(F.coalesce("narrow", F.lit(False)), F.col("weak")).otherwise(F.col("todo")).alias("todo"), "strategy", "n_chars", "page_confidence")
    return reduce(DataFrame.unionByName, ledger).select(*LEDGER), got.where("n_chars IS NOT NULL").select("document_id", "page_number", "strategy", "n_chars")

"""Queries of the training-text problems over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import exact, language, lines, mojibake, neardup, ocr, packing, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated across a source's documents."""
    return lines.lines_to_remove(table(spark, d, "chunks"), table(spark, d, "profiles"))


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk without the lines its source repeats."""
    return lines.without_repeated_lines(table(spark, d, "chunks"), table(spark, d, "profiles"))


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "chunks"), table(spark, d, "profiles"), table(spark, d, "ocr_boxes")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Noise of the scan in chunks and boxes."""
    return ocr.noise(*_scans(spark, d))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of scanned chunks and of pages of boxes."""
    return ocr.repaired(*_scans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of facts that differ in formatting only."""
    return exact.copy_pairs(table(spark, d, "facts"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One fact per statement and the number of its copies."""
    return exact.collapse(table(spark, d, "facts"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), "content")
    return chunks.unionByName(table(spark, d, "blocks").select(F.lit("blocks").alias("table_name"), F.col("block_id").alias("record_id"), "content"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records decoded with a wrong encoding."""
    return mojibake.garbled(_contents(spark, d)).select("table_name", "record_id")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled records read again, and how they were garbled."""
    return mojibake.garbled(_contents(spark, d))


def _near(spark: SparkSession, d: str) -> neardup.Join:
    texts = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    return neardup.Join(texts, n=3, threshold=0.6, least_words=25)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks that share most of their word trigrams."""
    return _near(spark, d).pairs().toDF("chunk_id_a", "chunk_id_b")


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its class of equal texts and the number of classes near to it."""
    return _near(spark, d).report().toDF("chunk_id", "class_id", "class_size", "n_links")


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal texts that are near to each other, by their representatives; with p7_groups they give every link."""
    return _near(spark, d).class_links()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, d, "documents"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    """A container for every text, for each specification."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p9_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many containers were filled, and how full they are."""
    return packing.summary(p9_pack(spark, d), table(spark, d, "container_specs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label is missing or wrong, or that hold several languages."""
    return language.wrong_labels(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of sentences in one language, with a confidence."""
    return language.segments(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_cleaned, p2_found, p2_repaired, p5_found, p5_collapsed, p6_found, p6_restored, p7_found, p7_groups, p7_links, p8_ids, p9_pack, p9_summary, p10_found, p10_segments)}

_LINES = r"""
WITH once AS (SELECT DISTINCT chunk_id, document_id, content FROM chunks WHERE chunk_id IS NOT NULL),
source_of AS (SELECT DISTINCT document_id, source FROM profiles WHERE source IS NOT NULL),
texts AS (SELECT chunk_id, document_id, source, unnest(string_split(content, chr(10))) text, generate_subscripts(string_split(content, chr(10)), 1) line_no
  FROM once JOIN source_of USING (document_id) WHERE content IS NOT NULL),
keyed AS (SELECT *, regexp_replace(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') k FROM texts WHERE regexp_matches(text, '\p{L}')),
sizes AS (SELECT source, count(DISTINCT document_id) n FROM once JOIN source_of USING (document_id) GROUP BY 1),
frequent AS (SELECT source, k FROM keyed JOIN sizes USING (source) GROUP BY source, k, n HAVING count(DISTINCT document_id) >= 3 AND count(DISTINCT document_id) >= 0.25 * n),
found AS (SELECT DISTINCT chunk_id, line_no::int line_no FROM keyed JOIN frequent USING (source, k))
"""

_CANONICAL = lambda c, kept: (
    rf"array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower({c}), '[;|]'), lambda p: "
    rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '(\p{{Nd}})\.(\p{{Nd}})', '\1⌘\2', 'g'), '(\p{{Nd}})\.(\p{{Nd}})', '\1⌘\2', 'g'), '(^|[^\p{{L}}\p{{N}}])-(\p{{Nd}})', '\1⌦\2', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}{kept}]', '', 'g')), lambda p: p <> '')), '|')"
)
_FACTS = f"""
WITH canonical AS (SELECT DISTINCT fact_id, entity, period, coalesce(unit, '') unit, {_CANONICAL("key", "%⌘⌦")} k, {_CANONICAL("value", "%⌘⌦")} v FROM facts),
cases AS (SELECT *, min(fact_id) OVER (PARTITION BY entity, period, unit, k, v) a, count(*) OVER (PARTITION BY entity, period, unit, k, v) n
  FROM canonical WHERE entity IS NOT NULL AND k <> '' AND v <> '')
"""

SQL = {
    "p1_found": _LINES + "SELECT * FROM found",
    "p1_cleaned": _LINES
    + """, gone AS (SELECT chunk_id, list(line_no) gone FROM found GROUP BY 1)
    SELECT chunk_id, array_to_string([x[1] FOR x IN list_zip(string_split(content, chr(10)), generate_series(1, len(string_split(content, chr(10))))) IF gone IS NULL OR NOT list_contains(gone, x[2]::int)], chr(10)) AS content,
      coalesce(len(gone), 0)::int n_removed FROM once LEFT JOIN gone USING (chunk_id)""",
    "p7_found": r"""WITH w AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') w FROM chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL),
      g AS (SELECT chunk_id, unnest(list_distinct([(w[i], w[i + 1], w[i + 2]) FOR i IN generate_series(1, len(w) - 2)])) g FROM w WHERE len(w) >= 25),
      n AS (SELECT chunk_id, count(*) n FROM g GROUP BY 1),
      c AS (SELECT a.chunk_id a, b.chunk_id b, count(*) k FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
      SELECT c.a chunk_id_a, c.b chunk_id_b FROM c JOIN n x ON x.chunk_id = c.a JOIN n y ON y.chunk_id = c.b WHERE k >= 0.6 * (x.n + y.n - k)""",
    "p5_found": _FACTS + "SELECT a fact_id_a, fact_id fact_id_b FROM cases WHERE fact_id <> a",
    "p5_collapsed": _FACTS + "SELECT a fact_id, n n_copies FROM cases WHERE fact_id = a UNION ALL SELECT fact_id, 1 FROM canonical WHERE entity IS NULL OR k IS NULL OR v IS NULL OR k = '' OR v = ''",
}

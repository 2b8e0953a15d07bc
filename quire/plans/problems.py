"""Queries of the general training-data problems, 3 and 4, over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans, units
from ..session import cut, table


def _common(spark: SparkSession, d: str) -> DataFrame:
    return units.to_common_units(table(spark, d, "facts"), table(spark, d, "metric_units"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of facts that state one amount in different units or scales."""
    return units.same_amount_pairs(_common(spark, d))


def p3_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every fact of a metric with a common unit, its amount in that unit and where the unit was found."""
    return _common(spark, d).select("fact_id", "number", "unit_found", "found_in", F.round("amount", 6).alias("amount"), "common_unit")


def p3_defaulted(spark: SparkSession, d: str) -> DataFrame:
    """As p3_amounts, with the usual unit of the document's source where a fact names none at all."""
    sources = table(spark, d, "profiles").where("source IS NOT NULL AND document_id IS NOT NULL").groupBy("document_id").agg(F.first("source").alias("source"))
    # one row a document; adaptive execution splits the facts of a document that has very many
    facts, kinds = table(spark, d, "facts").join(sources, "document_id", "left"), table(spark, d, "metric_units")
    found = units.to_common_units(facts, kinds).select("fact_id", "metric", "unit_found").join(facts.select("fact_id", "source").dropDuplicates(["fact_id"]), "fact_id")
    x = units.to_common_units(facts, kinds, cut(units.usual_units(found)))
    return x.select("fact_id", "number", "unit_found", "found_in", F.round("amount", 6).alias("amount"), "common_unit")


def _references(spark: SparkSession, d: str) -> list[tuple[orphans.Reference, int]]:
    ledger, chunks, profiles = (table(spark, d, t) for t in ("provenance_ledger", "chunks", "profiles"))
    return [
        (
            orphans.Reference(
                "provenance_ledger",
                ledger.select(F.col("ledger_id").cast("string").alias("record_id"), orphans.chunk_key("chunk_id").alias("key"), F.col("event_time").alias("at")),
                chunks.select(orphans.chunk_key("chunk_id").alias("key"), F.col("created_at").alias("since"), F.col("deleted_at").alias("until")),
            ),
            ledger.count(),
        ),
        (
            orphans.Reference(
                "chunks",
                chunks.select(F.col("chunk_id").alias("record_id"), F.col("document_id").alias("key"), F.col("created_at").alias("at")),
                profiles.select(F.col("document_id").alias("key"), F.col("processing_timestamp").alias("since"), F.col("deleted_at").alias("until")),
            ),
            chunks.count(),
        ),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of the ledger (to chunks) and of the chunks (to profiles)."""
    a, b = (orphans.orphans(r, n) for r, n in _references(spark, d))
    return a.unionByName(b)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and kind beside the number of references."""
    a, b = (orphans.orphan_counts(r, n) for r, n in _references(spark, d))
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (p3_found, p3_amounts, p3_defaulted, p4_found, p4_counts)}


def _alias_rows() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(a)}, {q(b)}, {c!r}::double, {o!r}::double, {s})" for a, b, c, o, s in units.aliases())


def _units_sql() -> str:
    blank, number = units.BLANK, units.NUMBER
    tidy = lambda c: f"trim(lower(regexp_replace({c}, '{blank}', ' ', 'g')))"
    scale = "CASE suffix " + " ".join("WHEN '" + w.replace("'", "''") + f"' THEN {s!r}::double" for w, s in units.SCALES.items()) + " END"
    head = f"^(?:((?i:etb|birr|br))\\.? ?)?({number})"
    return rf"""
    WITH alias(quantity, name, factor, "offset", scaled) AS (VALUES {_alias_rows()}),
    once AS (SELECT DISTINCT fact_id, entity, metric, period, key, value, unit, section FROM facts WHERE fact_id IS NOT NULL),
    cleaned AS (SELECT o.*, m.quantity, m.common_unit,
        regexp_replace(regexp_replace(regexp_replace(o.value, '{blank}', ' ', 'g'), '^[ *"“,;:(]+', ''), '[ *"”.,;:…)]+$', '') v
      FROM once o JOIN metric_units m USING (metric)),
    split AS (SELECT *, regexp_extract(v, '{head}', 1) prefix, regexp_extract(v, '{head}', 2) number_text, regexp_extract(v, '{head}', 0) head FROM cleaned),
    parts AS (SELECT *, TRY_CAST(replace(regexp_replace(number_text, '[,_ ]', '', 'g'), '−', '-') AS double) number,
        {tidy("unit")} unit_name,
        regexp_replace(regexp_replace(trim(lower(substring(v, length(head) + 1))), '^[ .,;:*]+', ''), '[ .,;:*]+$', '') suffix,
        {tidy(r"regexp_extract(key, '\(([^()]*)\)[^()]*$', 1)")} key_unit,
        {tidy(r"regexp_extract(section, '(?i)figures in ([^()]*)\)', 1)")} section_unit
      FROM split),
    scaled AS (SELECT *, {scale} scale,
        CASE WHEN prefix <> '' THEN trim(lower(prefix) || ' ' || suffix) WHEN {scale} IS NULL THEN suffix END text_unit FROM parts),
    found AS (SELECT s.*, coalesce(a.name, b.name, c.name, e.name) unit_found,
        CASE WHEN a.name IS NOT NULL THEN 'unit' WHEN b.name IS NOT NULL THEN 'text' WHEN c.name IS NOT NULL THEN 'key' WHEN e.name IS NOT NULL THEN 'section' END found_in,
        coalesce(a.factor, b.factor, c.factor, e.factor) * CASE WHEN coalesce(a.scaled, b.scaled, c.scaled, e.scaled) OR scale IS NULL THEN 1.0 ELSE scale END factor,
        coalesce(a."offset", b."offset", c."offset", e."offset") "offset"
      FROM scaled s LEFT JOIN alias a ON a.quantity = s.quantity AND a.name = s.unit_name
        LEFT JOIN alias b ON b.quantity = s.quantity AND b.name = s.text_unit
        LEFT JOIN alias c ON c.quantity = s.quantity AND c.name = s.key_unit
        LEFT JOIN alias e ON e.quantity = s.quantity AND e.name = s.section_unit),
    amounts AS (SELECT *, number * factor + "offset" amount FROM found)
    """


_CHUNK_KEY = r"regexp_replace(regexp_replace(lower(regexp_replace(chunk_id, '^\s+|\s+$', '', 'g')), '_0+([0-9])', '_\1'), '^$', '')"

ORPHANS_SQL = f"""
WITH refs AS (
  SELECT DISTINCT 'provenance_ledger' table_name, ledger_id::varchar record_id, {_CHUNK_KEY} k, event_time seen FROM provenance_ledger WHERE chunk_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'chunks', chunk_id, document_id, created_at FROM chunks WHERE document_id IS NOT NULL),
targets AS (
  SELECT 'provenance_ledger' table_name, {_CHUNK_KEY} k, min(created_at) since, max(deleted_at) until FROM chunks GROUP BY 1, 2
  UNION ALL SELECT 'chunks', document_id, min(processing_timestamp), max(deleted_at) FROM profiles GROUP BY 1, 2),
judged AS (
  SELECT r.table_name, record_id, strftime(seen, '%Y-%m') period,
    CASE WHEN t.k IS NULL THEN 'missing' WHEN seen < since THEN 'late' WHEN seen >= until THEN 'deleted' END orphan_kind
  FROM refs r LEFT JOIN targets t ON r.table_name = t.table_name AND r.k = t.k)
"""

SQL = {
    "p3_found": _units_sql()
    + f"""SELECT DISTINCT least(a.fact_id, b.fact_id) fact_id_a, greatest(a.fact_id, b.fact_id) fact_id_b
    FROM amounts a JOIN amounts b ON a.entity = b.entity AND a.metric = b.metric AND a.period = b.period AND a.fact_id < b.fact_id
    WHERE abs(a.amount - b.amount) <= {units.TOLERANCE} * greatest(abs(a.amount), abs(b.amount))
      AND (abs(a.factor - b.factor) > 1e-9 * greatest(a.factor, b.factor) OR abs(a."offset" - b."offset") > 1e-9)""",
    "p3_amounts": _units_sql() + "SELECT fact_id, number, unit_found, found_in, round(amount, 6) amount, common_unit FROM amounts",
    "p3_defaulted": _units_sql()
    + """, sources AS (SELECT DISTINCT document_id, source FROM profiles WHERE source IS NOT NULL), own AS (SELECT DISTINCT fact_id, source FROM facts JOIN sources USING (document_id)),
    usual AS (SELECT source, metric, unit_found usual FROM (SELECT source, metric, unit_found, row_number() OVER (PARTITION BY source, metric ORDER BY count(*) DESC, unit_found) r FROM amounts JOIN own USING (fact_id) WHERE unit_found IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1),
    named AS (SELECT a.*, usual FROM amounts a LEFT JOIN own USING (fact_id) LEFT JOIN usual ON usual.source = own.source AND usual.metric = a.metric)
    SELECT fact_id, number, coalesce(unit_found, l.name) unit_found, coalesce(found_in, CASE WHEN l.name IS NOT NULL THEN 'source' END) found_in,
      round(coalesce(amount, CASE WHEN unit_found IS NULL THEN number * (l.factor * CASE WHEN l.scaled OR scale IS NULL THEN 1.0 ELSE scale END) + l."offset" END), 6) amount, common_unit
    FROM named n LEFT JOIN alias l ON n.unit_found IS NULL AND l.quantity = n.quantity AND l.name = n.usual""",
    "p4_found": ORPHANS_SQL + "SELECT table_name, record_id, orphan_kind, period FROM judged WHERE orphan_kind IS NOT NULL",
    "p4_counts": ORPHANS_SQL
    + """SELECT o.*, n.n_references FROM
      (SELECT table_name, period, orphan_kind, count(*) n_orphans FROM judged WHERE orphan_kind IS NOT NULL GROUP BY ALL) o
      JOIN (SELECT table_name, period, count(*) n_references FROM judged GROUP BY ALL) n
        ON o.table_name = n.table_name AND o.period IS NOT DISTINCT FROM n.period""",
}

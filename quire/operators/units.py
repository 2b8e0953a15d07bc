"""Quantities recorded in different units: one number in the common unit of each metric.

The unit of a statement is looked up in this order: the unit field, the text after (or the currency before) the number,
a unit in brackets at the end of the key, a unit announced in the section heading, and last the usual unit of the
document's source for the metric where a table of such defaults is given. A bare scale word in the text ("5.2 million")
multiplies a unit that carries no scale of its own.

Defined cases: a null, empty or numberless value, a metric without a common unit and a unit that belongs to another
quantity give null ``amount``; the row is kept. Redelivered copies of a fact_id count once. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Name of a unit, factor and offset to the common unit of its quantity.
UNITS: dict[str, dict[str, tuple[float, float]]] = {
    "money": {"etb": (1, 0), "birr": (1, 0), "br": (1, 0), "ethiopian birr": (1, 0), "santim": (0.01, 0), "santims": (0.01, 0)},
    "mass": {"t": (1, 0), "tonne": (1, 0), "tonnes": (1, 0), "metric ton": (1, 0), "metric tons": (1, 0), "kg": (0.001, 0), "kilogram": (0.001, 0), "kilograms": (0.001, 0), "g": (1e-6, 0), "quintal": (0.1, 0), "quintals": (0.1, 0), "qt": (0.1, 0), "lb": (0.00045359237, 0), "lbs": (0.00045359237, 0), "pounds": (0.00045359237, 0), "kt": (1000, 0), "kilotonnes": (1000, 0), "mt": (1e6, 0)},
    "energy": {"mwh": (1, 0), "megawatt hours": (1, 0), "kwh": (0.001, 0), "kilowatt hours": (0.001, 0), "gwh": (1000, 0), "twh": (1e6, 0), "gj": (1 / 3.6, 0), "tj": (1000 / 3.6, 0), "mj": (0.001 / 3.6, 0)},
    "area": {"ha": (1, 0), "hectare": (1, 0), "hectares": (1, 0), "km²": (100, 0), "km2": (100, 0), "sq km": (100, 0), "square kilometres": (100, 0), "m²": (0.0001, 0), "m2": (0.0001, 0), "sq m": (0.0001, 0), "square metres": (0.0001, 0), "acre": (0.40468564224, 0), "acres": (0.40468564224, 0)},
    "length": {"km": (1, 0), "kilometre": (1, 0), "kilometres": (1, 0), "kilometers": (1, 0), "m": (0.001, 0), "metres": (0.001, 0), "meters": (0.001, 0), "mi": (1.609344, 0), "mile": (1.609344, 0), "miles": (1.609344, 0)},
    "share": {"%": (1, 0), "percent": (1, 0), "per cent": (1, 0), "pct": (1, 0), "bps": (0.01, 0), "basis points": (0.01, 0), "basis point": (0.01, 0), "ratio": (100, 0), "fraction": (100, 0)},
    "duration": {"d": (1, 0), "day": (1, 0), "days": (1, 0), "h": (1 / 24, 0), "hr": (1 / 24, 0), "hrs": (1 / 24, 0), "hour": (1 / 24, 0), "hours": (1 / 24, 0), "week": (7, 0), "weeks": (7, 0)},
    "temperature": {"°c": (1, 0), "deg c": (1, 0), "degrees celsius": (1, 0), "c": (1, 0), "°f": (5 / 9, -160 / 9), "deg f": (5 / 9, -160 / 9), "degrees fahrenheit": (5 / 9, -160 / 9), "f": (5 / 9, -160 / 9), "k": (1, -273.15), "kelvin": (1, -273.15)},
    "volume": {"m³": (1, 0), "m3": (1, 0), "cubic metre": (1, 0), "cubic metres": (1, 0), "l": (0.001, 0), "litre": (0.001, 0), "litres": (0.001, 0), "liters": (0.001, 0), "hl": (0.1, 0), "hectolitres": (0.1, 0), "ml": (1000, 0), "megalitre": (1000, 0), "megalitres": (1000, 0)},
    "power": {"mw": (1, 0), "megawatt": (1, 0), "megawatts": (1, 0), "kw": (0.001, 0), "kilowatts": (0.001, 0), "gw": (1000, 0), "gigawatts": (1000, 0)},
}
# Words of scale before or after a unit.
SCALES: dict[str, float] = {"thousand": 1e3, "'000": 1e3, "’000": 1e3, "million": 1e6, "mn": 1e6, "mio": 1e6, "billion": 1e9, "bn": 1e9}


def aliases() -> list[tuple[str, str, float, float, bool]]:
    """(quantity, name, factor, offset, has its own scale) for every unit, and every unit with a scale word before or after it."""
    rows = []
    for quantity, names in UNITS.items():
        for name, (factor, offset) in names.items():
            rows.append((quantity, name, float(factor), float(offset), False))
            if offset == 0:
                for word, scale in SCALES.items():
                    rows += [(quantity, f"{word} {name}", factor * scale, 0.0, True), (quantity, f"{name} {word}", factor * scale, 0.0, True)]
    return rows


# White space to the two engines' regular expressions alike, no-break and narrow no-break space included.
BLANK = "[\\s\u00a0\u2007\u202f]+"
NUMBER = r"[-+−]?[0-9][0-9,_ ]*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def _tidy(c: str) -> str:
    return f"trim(lower(regexp_replace({c}, r'{BLANK}', ' ')))"


SCALE_OF = "CASE suffix " + " ".join(f"WHEN \"{w}\" THEN {s!r}D" for w, s in SCALES.items()) + " END"


def to_common_units(facts: DataFrame, metric_units: DataFrame, source_defaults: DataFrame | None = None) -> DataFrame:
    """One row per fact_id with number, unit found, where it was found, and ``amount`` in ``common_unit``.

    source_defaults: (source, metric, unit); with it, facts needs a column ``source``.
    """
    spark = facts.sparkSession
    # A fixed table of some hundred rows made above, and one row per metric: both broadcast by their proven size.
    alias = F.broadcast(spark.createDataFrame(aliases(), "quantity string, name string, factor double, offset double, scaled boolean"))
    if source_defaults is None:
        facts = facts.withColumn("default_unit", F.lit(None).cast("string"))
    else:
        facts = facts.join(source_defaults.select("source", "metric", F.col("unit").alias("default_unit")), ["source", "metric"], "left")
    x = spark.sql(
        rf"""
        WITH once AS (
          SELECT fact_id, first(entity) entity, first(metric) metric, first(period) period, first(key) key, first(value) value,
                 first(unit) unit, first(section) section, first(default_unit) default_unit
          FROM {{facts}} WHERE fact_id IS NOT NULL GROUP BY fact_id),
        cleaned AS (
          SELECT o.*, m.quantity, m.common_unit,
                 regexp_replace(regexp_replace(o.value, r'{BLANK}', ' '), r'^[ *"“,;:(]+|[ *"”.,;:…)]+$', '') v
          FROM once o JOIN {{units}} m ON o.metric = m.metric),
        split AS (
          SELECT *, regexp_extract(v, r'^(?:(?i)(etb|birr|br)\.? ?)?({NUMBER})', 1) prefix,
                 regexp_extract(v, r'^(?:(?i)(etb|birr|br)\.? ?)?({NUMBER})', 2) number_text
          FROM cleaned)
        SELECT fact_id, entity, metric, period, key, value, unit, quantity, common_unit,
               try_cast(replace(regexp_replace(number_text, '[,_ ]', ''), '−', '-') AS double) number,
               {_tidy("unit")} unit_name,
               trim(lower(substring(v, length(regexp_extract(v, r'^(?:(?i)(etb|birr|br)\.? ?)?({NUMBER})', 0)) + 1))) suffix,
               lower(prefix) prefix,
               {_tidy(r"regexp_extract(key, r'\(([^()]*)\)[^()]*$', 1)")} key_unit,
               {_tidy(r"regexp_extract(section, r'(?i)figures in ([^()]*)\)', 1)")} section_unit,
               {_tidy("default_unit")} default_name
        FROM split""",
        facts=facts,
        units=F.broadcast(metric_units.select("metric", "quantity", "common_unit").dropDuplicates(["metric"])),
    )
    x = x.withColumn("suffix", F.regexp_replace("suffix", r"^[ .,;:*]+|[ .,;:*]+$", "")).withColumn("scale", F.expr(SCALE_OF))
    x = x.withColumn("text_unit", F.when(F.col("prefix") != "", F.concat_ws(" ", "prefix", F.expr("nullif(suffix, '')"))).when(F.col("scale").isNull(), F.col("suffix")))
    places = [("unit", "unit_name"), ("text", "text_unit"), ("key", "key_unit"), ("section", "section_unit"), ("source", "default_name")]
    for p, c in places:
        a = alias.select("quantity", F.col("name").alias(c), F.struct("factor", "offset", "scaled", F.col("name").alias("name"), F.lit(p).alias("place")).alias(f"u_{p}"))
        x = x.join(a, ["quantity", c], "left")
    found = reduce(lambda a, b: F.coalesce(a, b), [F.col(f"u_{p}") for p, _ in places])
    x = x.withColumn("found", found)
    factor = F.col("found.factor") * F.when(F.col("found.scaled") | F.col("scale").isNull(), 1.0).otherwise(F.col("scale"))
    x = x.withColumn("factor", factor).withColumn("offset", F.col("found.offset"))
    return x.select(
        "fact_id", "entity", "metric", "period", "value", "unit", "number", F.col("found.name").alias("unit_found"), F.col("found.place").alias("found_in"),
        "factor", "offset", (F.col("number") * F.col("factor") + F.col("offset")).alias("amount"), "common_unit",
    )


def usual_units(found: DataFrame) -> DataFrame:
    """(source, metric, unit): the unit that a source's statements of a metric most often have, the first by name of equals. found: (source, metric, unit_found).

    Counted before it is shuffled; a source has a row for each metric, of which there are as many as common units are known.
    """
    n = found.where("source IS NOT NULL AND metric IS NOT NULL AND unit_found IS NOT NULL").groupBy("source", "metric", "unit_found").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "unit_found"))
    return n.groupBy("source", "metric").agg(best.alias("b")).select("source", "metric", F.col("b.unit_found").alias("unit"))


#: Amounts within this share of the larger magnitude are the same.
TOLERANCE = 0.001


def same_amount_pairs(common: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(fact_id_a, fact_id_b; a < b) of one entity, metric and period with the same amount, recorded in different units or scales.

    Statements are first collapsed to distinct (entity, metric, period, unit, amount). These are matched by logarithmic
    bucket of the amount, each looked for in its own and both neighbouring buckets, so no pair outside the tolerance band
    is built beyond bucket neighbours, and then expanded to the facts. Null entity, metric, period or amount: no case.
    """
    key = ["entity", "metric", "period"]
    log = F.log(F.abs("amount"))
    c = common.select("fact_id", *key, "factor", "offset", "amount").where(" AND ".join(f"{k} IS NOT NULL" for k in [*key, "amount", "factor"])).withColumn(
        "bucket", F.when(F.col("amount") == 0, F.lit(None).cast("long")).otherwise(F.floor(log / F.lit(tolerance * 1.1))).cast("long")
    )
    c = c.withColumn("bucket", F.coalesce("bucket", F.lit(-(2**60)))).withColumn("positive", F.col("amount") >= 0)
    c = cut(c)  # used four times below
    combo = [*key, "factor", "offset", "amount", "bucket", "positive"]
    distinct = c.select(*combo).distinct()
    a = distinct.select(*key, "positive", *(F.col(k).alias(f"{k}_a") for k in ("factor", "offset", "amount", "bucket")), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = distinct.select(*key, "positive", "bucket", *(F.col(k).alias(f"{k}_b") for k in ("factor", "offset", "amount")))
    differ = (F.abs(F.col("factor_a") - F.col("factor_b")) > 1e-9 * F.greatest("factor_a", "factor_b")) | (F.abs(F.col("offset_a") - F.col("offset_b")) > 1e-9)
    near = F.abs(F.col("amount_a") - F.col("amount_b")) <= tolerance * F.greatest(F.abs("amount_a"), F.abs("amount_b"))
    # Each pair of distinct statements once, the smaller factor (then offset) first.
    once = (F.col("factor_a") < F.col("factor_b")) | ((F.col("factor_a") == F.col("factor_b")) & (F.col("offset_a") < F.col("offset_b")))
    pairs = a.join(b, [*key, "positive", "bucket"]).where(differ & near & once).drop("bucket", "positive", "bucket_a")
    for side in "ab":
        ids = c.select(*key, *(F.col(k).alias(f"{k}_{side}") for k in ("factor", "offset", "amount")), F.col("fact_id").alias(f"id_{side}"))
        pairs = pairs.join(ids, [*key, f"factor_{side}", f"offset_{side}", f"amount_{side}"])
    return pairs.select(F.least("id_a", "id_b").alias("fact_id_a"), F.greatest("id_a", "id_b").alias("fact_id_b")).distinct()

"""Copies that differ in formatting only: white space, letter case, punctuation, symbols and the order of parts.

Defined cases: facts with a null entity, key or value, or with nothing left of key or value, are statements of their own.
Null and empty unit are the same; period may be null and then equals only null. Redelivered copies of a fact_id count
once. Very long values are compared whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_join
from ..session import cut
from . import bloom

# A decimal point between digits, a minus sign before a digit and not after a letter or digit, and % say something, in a key as in a value: "Ratio (%)" isn't "Ratio".
_FORMATTING = r"(?!(?<=\p{Nd})\.(?=\p{Nd}))(?!(?<![\p{L}\p{N}])-(?=\p{Nd}))[^\p{L}\p{N}\p{M}%]"


def canonical(text: str | Column) -> Column:
    """Parts between ; and |, each without formatting, sorted; an empty string if nothing is left."""
    parts = F.transform(F.split(F.lower(text), "[;|]"), lambda p: F.regexp_replace(p, _FORMATTING, ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "|")


FIELDS = ["entity", "period", "unit", "key", "value"]


def canonical_facts(facts: DataFrame) -> DataFrame:
    """fact_id, the canonical fields and ``hash``, null where the fact is no case."""
    x = facts.select("fact_id", "entity", "period", F.coalesce("unit", F.lit("")).alias("unit"), canonical("key").alias("key"), canonical("value").alias("value"))
    case = F.col("entity").isNotNull() & (F.col("key") != "") & (F.col("value") != "")
    return x.withColumn("period", F.concat(F.lit("="), "period")).withColumn("period", F.coalesce("period", F.lit(""))).withColumn("hash", F.when(case, F.xxhash64(*FIELDS)))


def _repeats(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Facts that may have a copy (cut, as they are used more than once), those that certainly have none, all, and the number of all."""
    rows = canonical_facts(facts)
    total = facts.count()
    segments = bloom.n_segments(total)
    maybe, alone = bloom.possible_repeats(rows, cut(bloom.repeated_bits(rows, segments)), segments)
    return cut(maybe), alone, rows, total


def copy_pairs(facts: DataFrame) -> DataFrame:
    """(fact_id_a, fact_id_b): the smallest fact_id of a group of copies with each other one."""
    maybe, _, _, total = _repeats(facts)
    groups = maybe.groupBy(*FIELDS).agg(F.min("fact_id").alias("fact_id_a"), F.count("*").alias("n")).where("n > 1")
    x = split_join(maybe.select(*FIELDS, F.col("fact_id").alias("fact_id_b")), groups, FIELDS, "n", total)
    return x.where("fact_id_a <> fact_id_b").select("fact_id_a", "fact_id_b").distinct()  # redelivered copies


def collapse(facts: DataFrame) -> DataFrame:
    """(fact_id, n_copies): one row per statement, its smallest fact_id and the number of its copies, itself included."""
    maybe, alone, rows, _ = _repeats(facts)
    groups = maybe.dropDuplicates(["fact_id"]).groupBy(*FIELDS).agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("n_copies"))
    # a redelivered fact was seen twice and so is a possible repeat; one that is no case has no hash and is compared by its id
    single = alone.select("fact_id", F.lit(1).cast("long").alias("n_copies"))
    no_case = rows.where("hash IS NULL").select("fact_id").distinct().select("fact_id", F.lit(1).cast("long").alias("n_copies"))
    return groups.select("fact_id", "n_copies").unionByName(single).unionByName(no_case)

"""References to records that do not exist, no longer exist or do not exist yet.

References are first counted per key and month with their first and last time. Against the targets that decides whole
groups (all missing, all late, all deleted, all in order) or leaves a look at each record. Groups of very many references
are set apart whether or not they hold an orphan: there are at most ``HEAVY_KEYS`` of them, their records are taken out of
the shuffle by a broadcast anti-join and those with orphans are judged against broadcast targets; all others go through
an ordinary shuffle join on key and month, where a group has a bounded number of rows. Both parts are united. Counts are
made of the groups' counts; only groups that are neither wholly orphan nor in order are looked at record by record.

Defined cases: null references are no case and are dropped; a null time can only be ``missing``, with a null period;
redelivered copies of a record count once; a target delivered twice has its first creation and its last deletion.
Empty tables give no rows, or, as targets, make every reference missing. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A group (a key and month) is heavy if it holds at least one in so many of all references ...
HEAVY_KEYS = 10_000
#: ... and at least so many.
HEAVY_LEAST = 10_000


def chunk_key(c: str | Column) -> Column:
    """Chunk ids are the same if they agree after trimming and lower-casing, with the part after ``_`` read as an integer."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(t, r"_0+(?=[0-9])", "_")


@dataclass
class Reference:
    """refs: (record_id string, key, at timestamp). targets: (key, since timestamp, until timestamp)."""

    table_name: str
    refs: DataFrame
    targets: DataFrame


PERIOD = "coalesce(date_format(at, 'yyyy-MM'), '')"


def _references(r: Reference) -> DataFrame:
    """(record_id, key, at, month); month is empty where the time is null."""
    return r.refs.where("key IS NOT NULL").select("record_id", "key", "at", F.expr(PERIOD).alias("month"))


def _targets(t: DataFrame) -> DataFrame:
    return t.where("key IS NOT NULL").groupBy("key").agg(F.min("since").alias("since"), F.max("until").alias("until"), F.lit(True).alias("there"))


def _kind() -> Column:
    return F.when(F.col("there").isNull(), "missing").when(F.col("at") < F.col("since"), "late").when(F.col("at") >= F.col("until"), "deleted")


def heavy_limit(total: int) -> int:
    return max(HEAVY_LEAST, total // HEAVY_KEYS)


def _groups(refs: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """(key, month, n, since, until, there, heavy, whole, mixed): whole is the kind of all references of the group, if they have one; mixed: some are orphans, or may be."""
    g = refs.groupBy("key", "month").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).join(targets, "key", "left")
    gone = F.col("first_at") >= F.col("until")
    whole = F.when(F.col("there").isNull(), "missing").when(F.col("last_at") < F.col("since"), "late").when(gone & ~(F.col("first_at") < F.coalesce("since", "first_at")), "deleted")
    some = (F.col("first_at") < F.col("since")) | (F.col("last_at") >= F.col("until"))
    g = g.withColumn("whole", whole).withColumn("heavy", F.col("n") >= heavy_limit(total))
    return g.select("key", "month", "n", "since", "until", "there", "heavy", "whole", (F.col("whole").isNull() & F.coalesce(some, F.lit(False))).alias("mixed"))


def _judged(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """The orphans among references, distinct. groups: all heavy ones, and the light ones that hold orphans; cut."""
    on, info = ["key", "month"], ["key", "month", "since", "until", "there"]
    heavy = groups.where("heavy")  # at most HEAVY_KEYS rows, by the limit
    light = groups.where("NOT heavy AND bad").select(*info)
    light_refs = refs.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    heavy_refs = refs.join(F.broadcast(heavy.where("bad").select(*info)), on)
    x = heavy_refs.unionByName(light_refs).withColumn("orphan_kind", _kind()).where("orphan_kind IS NOT NULL")
    return x.select("record_id", "orphan_kind", F.expr("nullif(month, '')").alias("period")).distinct()  # redelivered copies; only orphans are left to compare


def orphans(r: Reference, total: int) -> DataFrame:
    """(table_name, record_id, orphan_kind, period) of each orphan record. total: the number of references, for the heavy limit."""
    refs = _references(r)
    groups = _groups(refs, _targets(r.targets), total).withColumn("bad", F.col("whole").isNotNull() | F.col("mixed")).where("heavy OR bad")
    return _judged(refs, cut(groups)).select(F.lit(r.table_name).alias("table_name"), "record_id", "orphan_kind", "period")


def orphan_counts(r: Reference, total: int) -> DataFrame:
    """(table_name, period, orphan_kind, n_orphans, n_references): per table and month, the orphans of each kind beside all references.

    Copies of a record are found by its id, a shuffle of ids without hot keys; all else starts from the groups' counts.
    """
    refs = _references(r)
    once = refs.groupBy("record_id").agg(F.first(F.struct("key", "at", "month")).alias("r")).select("record_id", "r.*")
    groups = _groups(once, _targets(r.targets), total)
    period = F.expr("nullif(month, '')").alias("period")
    n = groups.groupBy(period).agg(F.sum("n").alias("n_references"))
    wholly = groups.where("whole IS NOT NULL").groupBy(period, F.col("whole").alias("orphan_kind")).agg(F.sum("n").alias("n"))
    looked = cut(groups.where("heavy OR mixed").withColumn("bad", F.col("mixed")))
    partly = _judged(refs, looked).groupBy("period", "orphan_kind").agg(F.count("*").alias("n"))
    o = wholly.unionByName(partly).groupBy("period", "orphan_kind").agg(F.sum("n").alias("n_orphans"))
    n = n.withColumnRenamed("period", "p")
    return o.join(n, o.period.eqNullSafe(n.p)).select(F.lit(r.table_name).alias("table_name"), "period", "orphan_kind", "n_orphans", "n_references")

"""Filling containers of fixed capacity with texts sized in tokens: hierarchical residual packing.

Every partition packs its own texts, the largest first, each into the container it fits best. Nearly full containers are
done. The others, as items of their fill, climb a tree: FAN_IN groups at a time are packed again by best fit. A group sends
up at most ``PER_RESIDUAL`` containers of each free size, one row each, so a task of the tree holds at most
FAN_IN * PER_RESIDUAL * capacity rows. Containers left behind, and those at the top, are mixed by hash into groups of about
REST and packed again, in ROUNDS rounds, so that fills that fit each other meet wherever they come from. Only fills travel;
each round says which container is poured into which, and the texts' rows join their final container once.

Defined cases: a text larger than the capacity is split into full containers and a rest, which is packed like any other text; null and empty
texts have no tokens and take a place, but no room, in some container; an empty table has no containers; documents
that share their text are packed one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import tokens

FAN_IN = 8
NEARLY_FULL = 0.98
PER_RESIDUAL = 16
REST, ROUNDS = 100_000, 2


class BestFit:
    """Containers by free size; a bit mask of the free sizes in use finds the tightest one that holds an item."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask, self.free, self.n = capacity, 0, defaultdict(list), 0

    def place(self, size: int) -> int:
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bins = self.free[room]
            number = bins.pop()
            if not bins:
                self.mask &= ~(1 << room)
        else:
            number, room = self.n, self.capacity
            self.n += 1
        left = room - size
        self.free[left].append(number)
        self.mask |= 1 << left
        return number


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for each item, the largest items placed first."""
    packer, out = BestFit(capacity), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = packer.place(int(sizes[i]))
    return out


_LOCAL = "spec_id int, bin long, fill long, doc_id long, part_no int, first_token long, n_tokens long"


def _local(specs: list[tuple[int, int]]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) for b in batches if b.num_rows]
        if not held:
            return
        rows = np.concatenate(held)
        base = TaskContext.get().partitionId() << 32
        for spec, capacity in specs:
            n = rows[:, 1]
            parts = np.maximum(1, -(-n // capacity))
            doc = np.repeat(rows[:, 0], parts)
            part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(capacity, np.repeat(n, parts) - part * capacity)
            bins = best_fit(size, capacity)
            fill = np.bincount(bins, weights=size).astype(np.int64)[bins]
            cols = [np.full(len(doc), spec, np.int32), bins + base, fill, doc, part.astype(np.int32), (part * capacity).astype(np.int64), size]
            for at in range(0, len(doc), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in cols], names=["spec_id", "bin", "fill", "doc_id", "part_no", "first_token", "n_tokens"])

    return run


_POURED = "spec_id int, head long, lead long, fill long, goes_on boolean"


def _merge(capacities: dict[int, int], per_residual: int | None):  # noqa: ANN202
    """One group's containers (spec_id, head, fill), packed again: each with the container it is poured into."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        capacity = capacities[int(f.spec_id.iloc[0])]
        heads = f[["spec_id", "head", "fill"]].sort_values(["fill", "head"], ascending=[False, True])
        number = best_fit(heads.fill.to_numpy(), capacity)
        heads["lead"] = heads.groupby(number)["head"].transform("min")
        heads["fill"] = np.bincount(number, weights=heads.fill).astype(np.int64)[number]
        first = heads[heads["head"] == heads["lead"]]
        goes_on = first.fill < NEARLY_FULL * capacity
        if per_residual is not None:
            goes_on &= first.groupby("fill").cumcount() < per_residual
        heads["goes_on"] = heads.lead.isin(set(first.lead[goes_on]))
        return heads[["spec_id", "head", "lead", "fill", "goes_on"]]

    return run


def pack(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container_id, doc_id, part_no, first_token, n_tokens): the place of every text, or part of a large one, for each specification.

    specs: (spec_id, tokenizer, capacity), a parameter table of a few rows. container_id is unique within a spec_id.
    """
    # A parameter table, not data: one row per kind of container that is asked for.
    by_tokenizer: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in specs.select("spec_id", "tokenizer", "capacity").distinct().collect():
        by_tokenizer[r.tokenizer].append((r.spec_id, r.capacity))
    capacities = {s: c for v in by_tokenizer.values() for s, c in v}
    out = None
    for tokenizer, own in sorted(by_tokenizer.items()):
        # Long texts are counted apart from short ones; their sizes, two numbers a text, are mixed, so that small fill up what large leave.
        sizes = tokens.encode(documents, tokens.vocabulary(tokenizer), count_only=True).repartition("doc_id")
        # The local packing is kept: container numbers are its own, and it holds the costly token counts.
        local = cut(sizes.mapInArrow(_local(sorted(own)), _LOCAL))
        out = local if out is None else out.unionByName(local)
    if out is None:
        return documents.sparkSession.createDataFrame([], "spec_id int, container_id string, doc_id long, part_no int, first_token long, n_tokens long")
    groups = out.select(F.max(F.shiftright("bin", 32))).first()[0] or 0
    capacity = F.element_at(F.create_map(*(F.lit(x) for kv in capacities.items() for x in kv)), F.col("spec_id"))
    not_full = F.col("fill") < NEARLY_FULL * capacity
    bins = out.select("spec_id", F.col("bin").alias("head"), "fill").distinct().where(not_full)
    rank = F.expr(f"row_number() OVER (PARTITION BY spec_id, shiftright(head, 32), fill ORDER BY head) <= {PER_RESIDUAL}")
    bins = bins.withColumn("goes_on", rank)
    rest, open_, poured, width = bins.where("NOT goes_on").drop("goes_on"), bins.where("goes_on"), [], 1

    def packed(x: DataFrame, per_residual: int | None) -> DataFrame:
        merged = cut(x.groupBy("spec_id", "group").applyInPandas(_merge(capacities, per_residual), _POURED))
        poured.append(merged.where("head <> lead").select("spec_id", "head", "lead"))
        return merged.where("head = lead").select("spec_id", "head", "fill", "goes_on")

    while width <= groups:
        width *= FAN_IN
        leads = packed(open_.withColumn("group", F.floor(F.shiftright("head", 32) / width)), PER_RESIDUAL)
        rest = rest.unionByName(leads.where("NOT goes_on").where(not_full).drop("goes_on"))
        open_ = leads.where("goes_on")
    rest = rest.unionByName(open_.drop("goes_on"))
    for salt in range(ROUNDS):
        n = rest.count()
        mixed = rest.withColumn("group", F.pmod(F.xxhash64("head", F.lit(salt)), F.lit(max(1, -(-n // REST)))))
        rest = packed(mixed, None).where("goes_on").drop("goes_on")
        if n <= REST:
            break  # one group had them all
    final = out.select("spec_id", "bin").distinct().withColumn("head", F.col("bin"))
    for p in poured:
        final = final.join(p, ["spec_id", "head"], "left").select("spec_id", "bin", F.coalesce("lead", "head").alias("head"))
    placed = out.join(final.where("head <> bin"), ["spec_id", "bin"], "left")
    return placed.select("spec_id", F.hex(F.coalesce("head", "bin")).alias("container_id"), "doc_id", "part_no", "first_token", "n_tokens")


def summary(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, n_containers, n_tokens, least_containers, fill): beside the least number that the tokens could take."""
    x = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n_tokens")).groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    x = x.join(F.broadcast(specs.select("spec_id", "capacity").distinct()), "spec_id")
    return x.select("spec_id", "capacity", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("n_tokens") / F.col("n_containers") / F.col("capacity"), 6).alias("fill"))

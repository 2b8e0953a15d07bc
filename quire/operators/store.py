"""Sinks on plain files: keep-latest upsert, replacement by document, appends, deletion, and lookups.

A table is cut into buckets by a hash of document_id. A write reads and rewrites only the buckets of the documents it touches, into a
folder of its own, and then commits a manifest that says which folders make up each bucket: readers see the old or the new state,
and a write that fails leaves the old one. A manifest that is there already is another writer's, and the write fails. Appends add a folder
to a bucket. Rows of one key belong to one document. Schemas grow by missing columns with defaults. Files are reached through Hadoop's
file systems, so a session needs its own driver JVM.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# Columns a stored table must have, and what rows written before they existed get.
SCHEMAS = {
    "documents": {"document_id": "string", "source_filename": "string", "origin_type": "string", "processing_timestamp": "timestamp"},
    "chunks": {"chunk_id": "string", "document_id": "string", "ldu_idx": "long", "page_number": "int", "chunk_type": "string", "content": "string", "content_hash": "string", "section_path": "string", "token_count": "int"},
    "structured_tables": {"table_id": "string", "document_id": "string", "page_number": "int", "caption": "string", "headers": "array<string>", "rows": "array<array<string>>"},
    "provenance_ledger": {"document_id": "string", "chunk_id": "string", "action": "string", "event_time": "timestamp", "metadata_json": "string"},
    "page_indexes": {"document_id": "string", "index_json": "string", "n_nodes": "long"},
    "fact_tables": {"fact_id": "long", "document_id": "string", "key": "string", "value": "string", "unit": "string", "page_ref": "int", "content_hash": "string", "entity": "string", "metric": "string", "period": "string", "section": "string", "extraction_method": "string", "confidence": "double"},
    "entity_mentions": {"document_id": "string", "entity_type": "string", "entity_name": "string", "n_mentions": "long", "first_page": "int"},
    "knowledge_graph_edges": {"document_id": "string", "source": "string", "relation": "string", "target": "string", "page_ref": "int", "confidence": "double"},
    "embeddings": {"chunk_id": "string", "document_id": "string", "page_number": "int", "chunk_type": "string", "embedding": "array<float>"},
    "profiles": {"document_id": "string", "source_filename": "string", "origin_type": "string", "layout_complexity": "string", "language": "string", "language_confidence": "double", "domain_hint": "string", "estimated_extraction_cost": "string", "page_count": "int", "total_chars": "long", "confidence": "double"},
    "extraction_ledger": {"document_id": "string", "depth": "int", "strategy_used": "string", "n_pages": "long", "confidence_score": "double", "cost_estimate": "string", "page_scope": "array<int>", "failure_reason": "string", "fallback_trigger": "string", "escalation_triggered": "boolean", "escalation_reason": "string", "flagged_for_review": "boolean"},
    "query_logs": {"question_id": "long", "document_id": "string", "question": "string", "answer": "string", "confidence": "double", "tools_used": "string", "asked_at": "timestamp"},
}
KEYS = {"documents": ["document_id"], "chunks": ["chunk_id"], "structured_tables": ["table_id"], "page_indexes": ["document_id"], "profiles": ["document_id"], "embeddings": ["chunk_id"]}


def latest(rows: DataFrame, keys: list[str], by: list[str | Column]) -> DataFrame:
    """One row per key, the last by ``by``; an aggregation with partial results, not a sort of each key's rows."""
    order = F.struct(*by)
    value = F.struct(*(c for c in rows.columns))
    return rows.groupBy(*(F.col(k).alias(f"k_{k}") for k in keys)).agg(F.max_by(value, order).alias("v_")).select("v_.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with those of equal keys replaced, and new rows."""
    both = old.withColumn("gen_", F.lit(0)).unionByName(new.withColumn("gen_", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["gen_"]).drop("gen_")


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the new rows' documents are replaced; rows of a longer earlier run don't stay."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(old: DataFrame, document_ids: DataFrame) -> DataFrame:
    return old.join(document_ids.select("document_id").distinct(), "document_id", "left_anti")


BUCKETS = 64
#: Folders of a bucket after which an append puts them together.
PARTS = 16


class Store:
    """Tables of SCHEMAS under one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path  # type: ignore[union-attr]
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # type: ignore[union-attr]

    # A manifest: number of buckets, and the folders of each bucket that isn't empty.

    def _last(self, name: str) -> int:
        p = self._path(f"{self.folder}/{name}/manifests")
        if not self._fs.exists(p):
            return -1
        names = [f.getPath().getName() for f in self._fs.listStatus(p)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def _manifest(self, name: str, version: int | None = None) -> dict:
        v = self._last(name) if version is None else version
        if v < 0:
            raise FileNotFoundError(f"no table {name} in {self.folder}")
        f = self._fs.open(self._path(f"{self.folder}/{name}/manifests/{v}.json"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")  # type: ignore[union-attr]
        f.close()
        return json.loads(text)

    def _commit(self, name: str, version: int, manifest: dict) -> None:
        at = f"{self.folder}/{name}/manifests"
        staged, final = self._path(f"{at}/_{uuid.uuid4().hex}"), self._path(f"{at}/{version}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, True)
            raise RuntimeError(f"another writer has changed {name}")
        # folders that neither this state nor the one before holds
        kept = {w for m in (manifest, self._manifest(name, version - 1) if version else manifest) for parts in m["parts"].values() for w in parts}
        if version >= 2:
            for w in {w for parts in self._manifest(name, version - 2)["parts"].values() for w in parts} - kept:
                self._fs.delete(self._path(f"{self.folder}/{name}/data/{w}"), True)
            self._fs.delete(self._path(f"{at}/{version - 2}.json"), True)

    def create(self) -> None:
        """Makes every table that isn't there; safe to repeat."""
        for name in SCHEMAS:
            if self._last(name) < 0:
                self._commit(name, 0, {"buckets": self.buckets, "parts": {}})

    def _bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        key = F.coalesce("document_id", F.lit("")) if "document_id" in df.columns else F.lit("")
        return df.withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))

    def _read(self, name: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        at = f"{self.folder}/{name}/data"
        paths = [f"{at}/{w}/bucket_={b}" for b, parts in manifest["parts"].items() if buckets is None or int(b) in buckets for w in parts]
        schema = SCHEMAS[name]
        if not paths:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in schema.items()))
        df = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        for c, t in schema.items():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(t))
        return df

    def read(self, name: str) -> DataFrame:
        return self._read(name, self._manifest(name))

    def _write(self, name: str, df: DataFrame, buckets: int) -> tuple[str, list[int]]:
        """A new folder with the rows, and the buckets it has; rows of a bucket, if they are many, are spread over files."""
        w = uuid.uuid4().hex
        at = f"{self.folder}/{name}/data/{w}"
        self._bucketed(df, buckets).write.partitionBy("bucket_").mode("errorifexists").parquet(at)
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(at))]
        return w, [int(n.split("=")[1]) for n in found if n.startswith("bucket_=")]

    def append(self, name: str, new: DataFrame) -> None:
        """Rows are added; nothing is rewritten but a bucket of too many folders."""
        v, m = self._last(name), self._manifest(name)
        w, touched = self._write(name, new, m["buckets"])
        for b in map(str, touched):
            m["parts"][b] = [*m["parts"].get(b, []), w]
        crowded = [int(b) for b in m["parts"] if len(m["parts"][b]) > PARTS]
        if crowded:
            w, touched = self._write(name, self._read(name, m, crowded), m["buckets"])
            m["parts"] |= {str(b): [w] for b in touched}
        self._commit(name, v + 1, m)

    def _replace(self, name: str, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """The buckets that ``new`` touches are rewritten as change(old, new)."""
        v, m = self._last(name), self._manifest(name)
        new = cut(new)
        touched = [r.bucket_ for r in self._bucketed(new, m["buckets"]).select("bucket_").distinct().collect()]  # at most as many as there are buckets
        w, filled = self._write(name, change(self._read(name, m, touched), new), m["buckets"])
        for b in touched:
            m["parts"].pop(str(b), None)
        m["parts"] |= {str(b): [w] for b in filled}
        self._commit(name, v + 1, m)

    def upsert(self, name: str, new: DataFrame) -> None:
        self._replace(name, new, lambda old, x: upsert(old, x, KEYS[name]))

    def replace_documents(self, name: str, new: DataFrame) -> None:
        self._replace(name, new, replace_documents)

    def delete_documents(self, name: str, document_ids: DataFrame) -> None:
        self._replace(name, document_ids, delete_documents)


def recent(rows: DataFrame, by: str, key: str, top: int) -> DataFrame:
    """The last ``top`` rows: a top-k, no full sort."""
    return rows.orderBy(F.desc(by), key).limit(top)

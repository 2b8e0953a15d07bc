import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import sampling, store, vectors
from quire.sources import documents
from quire.streaming import ingest


def test_sampling():
    s = sampling.sample_pages
    assert s(7, 3) == [1, 3, 5] and s(3, 3) == [1, 2, 3] and s(1, 3) == [1] and s(10, 3, "head") == [1, 2, 3] and s(2, 5) == [1, 2]
    p = s(60, 10)
    assert len(p) == 10 and p == sorted(p) and len(s(9, 2)) == 2 and s(0, 3) == [] and s(2, 1) == [1]
    assert len(s(50, 5, "random")) == 5 and s(9, 3, "uniform") == [1, 5, 9]
    assert sampling.parse_range("3-5") == [3, 4, 5] and sampling.parse_range("4,1,4") == [1, 4]
    for bad in ("", "x", "5-3", "0"):
        with pytest.raises(ValueError):
            sampling.parse_range(bad)


VEC = "chunk_id string, id long, embedding array<float>, distance string"


def test_nearest(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 0.0], "c"), ("b", 2, [1.0, 1.0], "c"), ("c", 3, [2.0, 0.0], "c"), ("d", 4, None, "c"), ("e", 5, [0.0, 0.0], "c"), ("f", 6, [1.0], "c"), ("g", 7, [-1.0, 0.0], "c")], VEC)
    assert [r.chunk_id for r in vectors.nearest(v, [1.0, 0.0], 3).collect()] == ["a", "c", "b"]
    q = v.select(F.col("id").alias("query_id"), "embedding").where("id in (1, 4, 7)")
    got = [(r.query_id, r.id) for r in vectors.nearest_to_each(v, q, 2).orderBy("query_id", "place").collect()]
    assert got == [(1, 1), (1, 3), (7, 7), (7, 2)]
    assert vectors.nearest_to_each(v, q.limit(0), 2).count() == 0 and vectors.nearest(v.limit(0), [1.0, 0.0], 2).count() == 0
    assert v.where(vectors.metadata({"$and": [{"chunk_id": "a"}, {"id": {"$gte": 1}}]})).count() == 1


def test_embedding_is_a_unit_vector(spark):
    r = spark.sql("SELECT 'Net income rose' t UNION ALL SELECT '' UNION ALL SELECT cast(null as string)").select("t", vectors.embed("t").alias("e")).collect()
    assert abs(np.linalg.norm(r[0].e) - 1) < 1e-9 and not any(r[1].e)


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.create()
    s.create()
    d = lambda *r: spark.createDataFrame(r, "document_id string, source_filename string")
    for name in ("x", "y", "z"):
        s.upsert("documents", d(("a", name)))
    got = s.read("documents").collect()
    assert len(got) == 1 and got[0].source_filename == "z" and got[0].origin_type is None
    f = lambda *r: spark.createDataFrame(r, "document_id string, key string")
    s.replace_documents("fact_tables", f(("a", "Revenue"), ("b", "Cost")))
    s.replace_documents("fact_tables", f(("a", "Revenue"), ("a", "Profit")))
    assert sorted((r.document_id, r.key) for r in s.read("fact_tables").collect()) == [("a", "Profit"), ("a", "Revenue"), ("b", "Cost")]
    s.delete_documents("fact_tables", f(("a", "")))
    assert s.read("fact_tables").count() == 1
    s.append("query_logs", spark.createDataFrame([(1, "q")], "question_id long, question string"))
    s.append("query_logs", spark.createDataFrame([(1, "q")], "question_id long, question string"))
    assert s.read("query_logs").count() == 2
    with pytest.raises(FileNotFoundError):
        store.Store(spark, str(tmp_path / "none")).read("documents")


def test_a_write_touches_its_buckets_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"), buckets=8)
    s.create()
    x = lambda ids, name: spark.createDataFrame([(f"d{i}", name) for i in ids], "document_id string, source_filename string")
    s.upsert("documents", x(range(40), "first"))
    before = s._manifest("documents")["parts"]
    assert len(before) > 4
    s.upsert("documents", x([3], "second"))
    after = s._manifest("documents")["parts"]
    assert sum(before[b] != after[b] for b in after) == 1
    got = {r.document_id: r.source_filename for r in s.read("documents").collect()}
    assert len(got) == 40 and got["d3"] == "second" and list(got.values()).count("first") == 39
    # a write that fails changes nothing
    bad = x([1], "third").withColumn("source_filename", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        s.append("documents", bad)
    assert s.read("documents").count() == 40
    for _ in range(store.PARTS + 2):
        s.append("query_logs", x([3], "q").select("document_id"))
    assert s.read("query_logs").count() == store.PARTS + 2 and max(map(len, s._manifest("query_logs")["parts"].values())) <= store.PARTS
    with pytest.raises(RuntimeError, match="another writer"):
        s._commit("documents", s._last("documents"), {"buckets": 8, "parts": {}})


def test_vectors_are_upserted_and_deleted(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.create()
    v = lambda *r: spark.createDataFrame(r, "chunk_id string, document_id string, embedding array<float>")
    s.upsert("embeddings", v(("a_1", "a", [1.0, 0.0]), ("b_1", "b", [0.0, 1.0])))
    s.upsert("embeddings", v(("a_1", "a", [0.0, 1.0])))
    assert [(r.chunk_id, round(r.distance, 6)) for r in vectors.nearest(s.read("embeddings").where(vectors.metadata({"document_id": "a"})), [0.0, 1.0], 3).collect()] == [("a_1", 0.0)]
    s.delete_documents("embeddings", v(("", "a", None)))
    assert [r.chunk_id for r in s.read("embeddings").collect()] == ["b_1"]


def test_nearest_within_a_group_and_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.1], "y"), (3, [0.0, 1.0], "x"), (4, [0.5, 1.0], None), (5, [0.0, 0.0], "x"), (6, [1.0], "x")], "id long, embedding array<double>, g string").repartition(2)
    q = v.withColumnRenamed("id", "query_id")
    whole = {(r.query_id, r.id) for r in vectors.nearest_to_each(v, q, 2).collect()}
    own = {(r.query_id, r.id) for r in vectors.nearest_to_each(v, q, 2, within="g").collect()}
    assert own == {(1, 1), (1, 3), (2, 2), (3, 3), (3, 1), (6, 6)} and len(whole) == 9
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vectors, "ROWS", 1)
    assert {(r.query_id, r.id) for r in vectors.nearest_to_each(v, q, 2).collect()} == whole


def test_sampled_pages_as_a_column(spark):
    from quire.operators import sampling

    x = spark.createDataFrame([(i,) for i in range(0, 40)] + [(None,)], "t int")
    for n in (1, 2, 3, 5, 10):
        for way in ("thirds", "uniform", "head"):
            for r in x.select("t", sampling.sampled("t", n, way).alias("p")).collect():
                assert r.p == sampling.sample_pages(r.t or 0, n, way), (r.t, n, way)


def test_latest_and_recent(spark, rows):
    x = spark.createDataFrame([("a", 1, "p"), ("a", 2, None), (None, 1, "q"), ("a", 2, None)], "k string, t int, v string")
    assert rows(store.latest(x, ["k"], ["t"])) == sorted([("a", 2, None), (None, 1, "q")], key=repr)
    assert [r.t for r in store.recent(x, "t", "k", 2).collect()] == [2, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftwo\f".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    files = documents.scan(spark, str(tmp_path), "*.txt")
    got = documents.decode(files).orderBy("source_filename", "page_number").collect()
    assert [(r.source_filename, r.page_number, r.text) for r in got if r.error is None] == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, "")]
    assert [r.source_filename for r in got if r.error] == ["b.txt"]
    assert {r.i for r in spark.sql("SELECT 'a' s").select(documents.document_id("s").alias("i")).collect()} == {got[0].document_id}
    assert documents.decode(files, pages=[2]).where("error IS NULL").count() == 1 and documents.decode(files, pages=[]).where("error IS NULL").count() == 3
    assert "plugin not installed" in documents.decode(documents.scan(spark, str(tmp_path), "*.pdf"), "fast_text").first().error


def test_ledger(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"document_id": "a", "action": "x"}\n{"document_id": "b"}\nnot json\n')
    assert documents.ledger(spark, str(tmp_path / "l.jsonl"), "a").count() == 1


def test_stream_upserts_and_windows(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.create()
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "document_id string, source_filename string")
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        q = ingest.upsert_stream(spark.readStream.schema(rows.schema).parquet(source), s, "documents", str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert s.read("documents").count() == 2
    e = spark.createDataFrame([(dt.datetime(2020, 1, 1, 1, m), "k") for m in (0, 30, 59)] + [(dt.datetime(2020, 1, 1, 2), "k")], "ts timestamp, kind string")
    assert sorted(r.n for r in ingest.counts(e, "ts", "kind").collect()) == [1, 3]

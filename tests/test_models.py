import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_index_facts_graph import chunks

from quire.operators import models, sections

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors have no tests

class Model:
    def summarise(self, title, body, numeric):
        if title == "Bad":
            raise RuntimeError("no reply")
        return f"{len(body)} {numeric}"

    def facts(self, text):
        return [("Key", str(len(text)), "u"), ("", "x", "")]

    def reason(self, claim, evidence):
        return {"a": "It is contradicted, not verified", "b": "cannot be verified"}.get(claim, "")

    def embed(self, texts):
        return pd.Series([[float(len(t))] for t in texts])


def test_summaries(spark):
    c = chunks(spark, [("paragraph", "one 1 2", "A", [1]), ("paragraph", "x" * 3000, "Bad", [1]), ("section", "C", "C", [1]), ("paragraph", "y" * 3000, "D", [1]), ("paragraph", "z", "D", [1])])
    got = {r.title: r.summary for r in models.summarised(sections.sections(c), c, Model()).collect()}
    assert got["A"] == "7 True" and got["Bad"].startswith("xxx") and got["C"] == "" and got["D"] == f"{models.BODY} False"


def test_facts_have_a_budget(spark):
    c = chunks(spark, [("paragraph", f"{i} " + "w" * 300, "A", [i]) for i in range(5)] + [("paragraph", "short", "A", [1]), ("table", "t" * 300, "A", [1]), ("paragraph", None, "A", [1])])
    got = models.facts_by_model(c, Model(), calls=3).collect()
    assert sorted((r.page_ref, r.key, r.value, r.method, r.confidence) for r in got) == [(i, "Key", "302", "llm", 0.75) for i in range(3)]


def test_reasons_override(spark):
    a = spark.createDataFrame([(1, "verified", 1), (2, "unverifiable", 0), (3, "not_found", 0), (4, "unverifiable", 0)], "question_id long, status string, n_evidence long")
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "question_id long, question string")
    found = spark.createDataFrame([(1, 1, 1, "text")], "question_id long, source_no int, ord int, content string")
    got = {r.question_id: (r.status, bool(r.explanation)) for r in models.reasoned(a, q, found, Model()).collect()}
    assert got == {1: ("unverifiable", True), 2: ("verified", True), 3: ("not_found", False), 4: ("unverifiable", False)}


def test_embeddings(spark):
    x = spark.createDataFrame([("ab",), (None,)], "content string")
    assert [r.embedding for r in models.embedded(x, "content", Model()).collect()] == [[2.0], [0.0]]
    assert models.embedded(x, "content", default=F.array(F.lit(1.0))).first().embedding == [1.0]

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_core_does_not_import_llm():
    for p in (ROOT / "quire").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_sql_only_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry_and_one_query_against_duckdb(spark):
    import duckdb

    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("p4_found", "p4_counts", "p3_amounts", "facts_query", "class_coverage", "chunked_blocks", "escalation", "rows_of_boxes", "page_index", "sampled_pages"):
        got = e.queries()[name](spark, str(DATA))
        columns = sorted(got.columns)
        want = con.sql(e.oracle_sql()[name])
        assert columns == sorted(want.columns), name
        order = [want.columns.index(c) for c in columns]
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        ours = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
        assert ours == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr), name

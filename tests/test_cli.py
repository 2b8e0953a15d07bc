import pytest

from quire import cli


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "report.txt").write_text("Financial Overview\fTotal Revenue: $4.2B for FY2024.\nMore text.")
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    db = ["--db", str(tmp_path / "db")]
    cli.main([*db, "init-db"])
    for _ in range(2):  # a second run replaces, it doesn't add
        cli.main([*db, "batch", str(tmp_path / "in"), "--pattern", "*.txt", "--decoder", "plain_text"])
    assert "bad.txt" in capsys.readouterr().out
    from quire.operators.store import Store

    s = Store(spark, str(tmp_path / "db"))
    assert s.read("documents").count() == 1 and s.read("chunks").count() == 2
    assert s.read("fact_tables").where("key = 'Total Revenue'").count() == 1
    doc = s.read("documents").first().document_id
    cli.main([*db, "query", "What is the total revenue?", "--doc-id", doc])
    cli.main([*db, "audit", "Total Revenue of $4.2B for FY2024.", "--doc-id", doc])
    cli.main([*db, "show", "pageindex", doc])
    cli.main([*db, "query", "revenue"])
    cli.main([*db, "list-docs"])
    out = capsys.readouterr().out
    assert "4.2B" in out and "verified" in out and "Financial Overview" in out and "report.txt" in out
    with pytest.raises(SystemExit):
        cli.main([*db, "audit"])
    assert {(r.question, r.document_id) for r in s.read("query_logs").collect()} == {("What is the total revenue?", doc), ("Total Revenue of $4.2B for FY2024.", doc)}
    assert s.read("page_indexes").first().n_nodes == 1 and s.read("profiles").first().page_count == 2
    assert s.read("embeddings").count() == 2 and s.read("knowledge_graph_edges").count() > 0 and s.read("extraction_ledger").count() == 2
    for what in ("ledger", "facts", "profile", "graph", "names"):
        cli.main([*db, "--json", "show", what, doc])
    cli.main([*db, "--json", "history"])
    out = capsys.readouterr().out
    assert out.count(f'"document_id":"{doc}"') > 8 and '"strategy_used":"plain_text"' in out
    cli.main([*db, "export", str(tmp_path / "run"), "--doc-id", doc])
    assert spark.read.json(str(tmp_path / "run" / "chunks")).count() == 2 and spark.read.json(str(tmp_path / "run" / "page_indexes")).first().n_nodes == 1
    cli.main([*db, "delete", doc])
    assert s.read("chunks").count() == s.read("embeddings").count() == s.read("documents").count() == 0 and s.read("query_logs").count() == 2

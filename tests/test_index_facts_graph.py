from pyspark.sql import functions as F

from quire.operators import answers, entities, facts, sections

CHUNK = "chunk_id string, document_id string, ldu_idx long, chunk_type string, content string, section_path string, page_refs array<int>, page_number int, n string"


def chunks(spark, rows):
    c = spark.createDataFrame([(f"d_{i:04d}", "d", i, t, x, s, p, (p or [1])[0], "clash") for i, (t, x, s, p) in enumerate(rows)], CHUNK)
    return sections.chunks_once(c.unionByName(c))


def test_sections(spark):
    c = chunks(
        spark,
        [("section", "Zebra", "Zebra", [1]), ("table", "a | 1", "Zebra", [2]), ("paragraph", "Revenue grew. By 12 in 2020. Third. Fourth.", "Zebra", [3]), ("paragraph", "x", "Alpha", [5]), ("list", "words only here", "", []), ("figure", None, None, None), ("paragraph", "Back in Zebra", "Zebra", [9])],
    )
    got = {r.title: (r.node_ord, r.page_start, r.page_end, r.signals, r.summary) for r in sections.sections(c).collect()}
    assert got["Zebra"] == (0, 2, 9, "numeric_dense,tables", "Revenue grew. By 12 in 2020. Third.")
    assert got["Alpha"] == (3, 5, 5, "", "x.") and got["(Untitled)"] == (4, 1, 1, "figures,lists", "words only here.")
    q = spark.createDataFrame([(1, "d", "revenue growth"), (2, "d", "?"), (3, "none", "revenue")], "question_id long, document_id string, question string")
    top = [(r.question_id, r.title, r.score) for r in sections.choose_sections(sections.sections(c), q, 2).orderBy("question_id", "place").collect()]
    assert top == [(1, "Zebra", 0.5), (1, "Alpha", 0.0), (2, "Zebra", 0.0), (2, "Alpha", 0.0)]


def test_key_names_count_and_tie(spark):
    c = chunks(spark, [("paragraph", "Acme Bank met Blue River. Acme Bank paid.", "S", [1]), ("section", "Acme Bank", "S", [1]), ("paragraph", "éAcme Bank", "S", [1])])
    assert [(r.name, r.n) for r in sections.key_names(c).orderBy("place").collect()] == [("Acme Bank", 2), ("Blue River", 1)]


def test_facts_patterns_and_dedup(spark):
    c = chunks(
        spark,
        [("paragraph", "Total Revenue: $4.2B for FY2024. Net Income: $1.1B.", "S", [4]), ("paragraph", "Loans: 500 branches", "S", [5]), ("paragraph", "Total Assets    500,000", "S", []), ("paragraph", "The company was founded in Addis Ababa.", "S", [1]), ("table", "Revenue | 4,200 | 3,800\nExpenses | 2,100 | 1,900", "S", [6]), ("paragraph", "total REVENUE. Total Revenue: $4.2B", "S", [9]), ("paragraph", None, "S", [9])],
    )
    got = {(r.key, r.value): (r.unit, r.page_ref, r.confidence, r.period) for r in facts.facts(c).collect()}
    assert got[("Total Revenue", "$4.2B")][:3] == ("USD", 4, 0.6) and got[("Total Revenue", "$4.2B")][3] == "FY2024"
    assert got[("Loans", "500 b")][0] == ""
    assert got[("Total Assets", "500,000")][1:3] == (1, 0.7)
    assert got[("Revenue", "4,200")][2] == 0.9 and got[("Expenses", "2,100")][2] == 0.9
    assert sum(k == "Total Revenue" for k, _ in got) <= 2
    assert facts.facts(c.limit(0)).count() == 0


def test_query_is_case_insensitive_and_literal_about_backslashes(spark, rows):
    f = spark.createDataFrame([("d", "Revenue", "Acme", "2020", 0.9), ("d", "Cost", None, None, 0.5), ("e", "a\\b", "x", "1", 0.2)], "document_id string, key string, entity string, period string, confidence double")
    assert [r.key for r in facts.query(f, key="%revenue%").collect()] == ["Revenue"]
    assert [r.key for r in facts.query(f, key="a\\b").collect()] == ["a\\b"]
    assert facts.query(f).count() == 3 and facts.query(f, document_id="d", least_confidence=0.6).count() == 1 and facts.query(f, entity="cme", period="20").count() == 1


FACT = "fact_id long, document_id string, key string, value string, unit string, entity string, metric string, period string, page_ref int, content_hash string, confidence double"


def test_graph(spark, rows):
    f = spark.createDataFrame([(1, "d", "Revenue", "5", "", "Acme", "Revenue", "2024", 3, None, 0.9), (2, "d", "Revenue", "5", "", "Acme", "Revenue", "2024", 2, None, 0.9), (3, "d", "x", "y", None, None, None, None, None, None, None)], FACT)
    c = chunks(spark, [("paragraph", "Acme Bank and Blue River, see Table 3. Blue River owes Acme Bank.", "S", [1]), ("paragraph", None, None, None)])
    g = {tuple(r) for r in entities.graph(f, c).collect()}
    assert g == {
        ("d", "Acme", "has_metric", "Revenue", 2, 0.9),
        ("d", "Revenue", "reported_for_period", "2024", 2, 0.9),
        ("d", "Acme Bank", "co_occurs_on_page", "Blue River", 1, 0.5),
        *(("d", a, "co_occurs_on_page", b, p, 0.5) for p in (2, 3) for a, b in (("2024", "Acme"), ("2024", "Revenue"), ("Acme", "Revenue")) if p == 2),
        ("d", "page:1", "references_table", "Table 3", 1, 0.4),
    }
    kinds = {(r.entity_type, r.entity_name) for r in entities.entities(c).collect()}
    assert ("organization", "Acme Bank") in kinds


def test_answers_and_audits(spark):
    c = chunks(spark, [("paragraph", "Total Revenue was $4.2B for FY2024.", "S", [5]), ("paragraph", "The board declared a dividend.", "S", [8])]).withColumn("content_hash", F.md5("content"))
    f = spark.createDataFrame([(1, "d", "Total Revenue", "$4.2B", "USD", None, "Total Revenue", "FY2024", 5, "h", 0.6)], FACT)
    q = spark.createDataFrame([(1, "d", "What is the total revenue?"), (2, "d", "A branch opened on Mars?"), (3, "none", "What is the total revenue?"), (4, "d", None), (5, "d", "Had the board a branch?")], "question_id long, document_id string, question string")
    e = entities.fact_edges(f)
    found = answers.evidence(q, c, f, e)
    a = {r.question_id: r for r in answers.answers(q, found).collect()}
    assert "4.2B" in a[1].answer and a[1].n_citations == 1 and a[1].confidence == 0.2 and a[1].verified
    assert a[1].tools_used == "semantic_search,structured_query,knowledge_graph" and a[2].tools_used == ""
    assert a[2].answer == answers.NOTHING and not a[3].verified and not a[4].verified
    s = {r.question_id: r.status for r in answers.audits(q, answers.evidence(q, c, f, e, audit=True), c).collect()}
    assert s == {1: "verified", 2: "not_found", 3: "not_found", 4: "not_found", 5: "verified"}
    plain = answers.evidence(q, c, f, plain=True).collect()
    assert {(r.question_id, r.source_no, r.content) for r in plain if r.question_id == 1} == {(1, 1, "Total Revenue was $4.2B for FY2024."), (1, 2, "Total Revenue: $4.2B")}


def test_sections_hints_and_graph_are_evidence(spark):
    c = chunks(spark, [("paragraph", "Acme Bank earned much in FY2024.", "Income of Acme Bank", [2]), ("paragraph", "Costs fell.", "Costs", [4])]).withColumn("content_hash", F.md5("content"))
    rows = [(1, "d", "Income", "5", "", "Acme Bank", "Income", "FY2024", 2, "h", 0.9), (2, "d", "Income", "7", "", "Other Group", "Income", "FY2024", 3, "h", 0.9), (3, "d", "Income", "9", "", "Acme Bank", "Income", "FY2023", 3, "h", 0.9)]
    f = spark.createDataFrame(rows, FACT)
    q = spark.createDataFrame([(1, "d", "What is the income of Acme Bank in FY2024?"), (2, "d", "What is the income?")], "question_id long, document_id string, question string")
    nodes = sections.with_key_names(sections.sections(c), sections.key_names(c))
    chosen = sections.choose_sections(nodes, q)
    names = entities.entities(c, f)
    h = {r.question_id: (r.entity_hint, r.period_hint) for r in answers.hints(q, names).collect()}
    assert h == {1: ("Acme Bank", "Fy2024"), 2: (None, None)}
    found = answers.evidence(q, c, f, entities.graph(f, c), chosen, names).collect()
    own = lambda i, s: [r.content for r in sorted(found, key=lambda r: r.ord) if (r.question_id, r.source_no) == (i, s)]
    assert own(1, 0) == ["[Section: Income of Acme Bank] Acme Bank earned much in FY2024.", "[Section: Costs] Costs fell."]
    assert own(1, 2) == ["Income: 5"] and own(2, 2) == ["Income: 5", "Income: 7", "Income: 9"]
    assert own(1, 3)[0] == "[KG] Acme Bank → has_metric → Income" and len(own(1, 3)) == 5
    a = {r.question_id: r for r in answers.answers(q, spark.createDataFrame(found)).collect()}
    assert a[1].tools_used == ",".join(answers.SOURCES) and a[1].n_citations == 2  # pages 2 and 4


def test_page_index_is_written_and_read_again(spark, rows):
    c = chunks(spark, [("paragraph", "Acme Bank met Blue River. It paid.", "S", [1]), ("table", "a | 1", "T", [3])])
    nodes = sections.with_key_names(sections.sections(c), sections.key_names(c))
    stored = sections.index_json(nodes)
    assert [(r.document_id, r.n_nodes) for r in stored.collect()] == [("d", 2)]
    back = sections.index_nodes(stored)
    assert rows(back.select(sorted(back.columns))) == rows(nodes.select(sorted(nodes.columns)))

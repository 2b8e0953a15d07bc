from quire.operators import entities
from test_index_facts_graph import FACT, chunks


def test_pages_pair_names_of_every_type_and_of_facts(spark):
    f = spark.createDataFrame([(1, "d", "k", "v", None, "Blue  River", "gross loans", "FY2019", 2, None, 0.9), (2, "d", "k", "v", None, " ", None, None, 2, None, 0.9), (3, "d", "k", "v", None, "Lone Hill", None, None, None, None, None)], FACT)
    c = chunks(spark, [("paragraph", "Acme Bank paid $5 million in Nairobi in 2024, said Dr. Abel.", "S", [1])])
    e = {(r.source, r.target, r.page_ref) for r in entities.graph(f, c).where("relation = 'co_occurs_on_page'").collect()}
    assert e == {(a, b, p) for p, names in ((1, ["$5 Million", "2024", "Acme Bank", "Dr. Abel", "Nairobi"]), (2, ["Blue River", "Fy2019", "Gross Loans"])) for i, a in enumerate(names) for b in names[i + 1 : i + 6]}
    of_facts = {(r.source, r.relation, r.target) for r in entities.graph(f, c).where("relation in ('has_metric', 'reported_for_period')").collect()}
    assert of_facts == {("Blue River", "has_metric", "Gross Loans"), ("Gross Loans", "reported_for_period", "Fy2019")}
    names = {(r.entity_type, r.entity_name, r.n_mentions, r.first_page) for r in entities.entities(c, f).collect()}
    assert {("organization", "Blue River", 1, 2), ("metric", "Gross Loans", 1, 2), ("date", "Fy2019", 1, 2), ("organization", "Lone Hill", 1, None), ("organization", "Acme Bank", 1, 1)} <= names

"""Commands over a store: init-db, batch, query, audit, show, list-docs, history, delete, export. Each prints the rows of one DataFrame, as a table or as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .operators import answers, chunking, entities, facts, models, reconstruct, rules, sections, store, triage, vectors
from .operators.sampling import parse_range
from .sources import documents


def ingest(spark: SparkSession, s: store.Store, folder: str, pattern: str, decoder: str, pages: list[int] | None, rule_file: str | None = None) -> DataFrame:
    """Files to profiles, chunks, index, facts, names, graph and vectors, all documents in one plan; stored rows of these documents are replaced. Gives what failed."""
    p = session.cut(documents.decode(documents.scan(spark, folder, pattern), decoder, pages))
    good, given = p.where("error IS NULL"), rules.load(rule_file) if rule_file else rules.Rules()
    none = lambda t: F.lit(None).cast(t)
    blocks = good.select(
        "document_id", "page_number", F.format_string("%s_p%03d", "document_id", "page_number").alias("block_id"), F.lit("text").alias("kind"), F.lit(0).alias("idx"), F.col("text").alias("content"), none("array<string>").alias("headers"),
        none("array<array<string>>").alias("rows"), none("string").alias("caption"), none("string").alias("figure_type"),
    )
    files = good.groupBy("document_id").agg(F.first("source_filename").alias("source_filename"))
    of_pages = good.select("document_id", "page_number", "width", "height", F.length("text").alias("n_chars"), F.lit(0.0).alias("image_area"), F.lit(0.0).alias("table_area"), "text")
    words = good.select("document_id", "page_number", F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1")).limit(0)
    profile = session.cut(triage.profiles(files, of_pages, words, given))
    s.upsert("profiles", profile)
    s.upsert("documents", profile.select("document_id", "source_filename", "origin_type", F.current_timestamp().alias("processing_timestamp")))
    c = session.cut(chunking.chunk_blocks(blocks)).withColumn("chunk_id", F.format_string("%s_%04d", "document_id", "ldu_idx"))
    c = c.withColumns({"page_refs": F.array("page_number"), "section": F.coalesce("parent_section", F.lit(sections.UNTITLED))})
    s.replace_documents("chunks", c.select("chunk_id", "document_id", "ldu_idx", "page_number", "chunk_type", "content", "content_hash", F.col("parent_section").alias("section_path"), "token_count"))
    s.replace_documents("embeddings", models.embedded(c.select("chunk_id", "document_id", "page_number", "chunk_type", "content"), "content", default=vectors.embed("content").cast("array<float>")).drop("content"))
    s.upsert("page_indexes", sections.index_json(sections.with_key_names(sections.sections(c), sections.key_names(c))))
    f = session.cut(facts.facts(c).select(F.xxhash64("document_id", "key", "value").alias("fact_id"), "document_id", "key", "value", "unit", "page_ref", "entity", "metric", "period", "section", F.col("method").alias("extraction_method"), "confidence"))
    s.replace_documents("fact_tables", f)
    found = session.cut(entities.on_pages(entities.names(c, f)))
    s.replace_documents("entity_mentions", entities.entities(None, found=found))
    s.replace_documents("knowledge_graph_edges", entities.graph(f, c, found))
    n = of_pages.groupBy("document_id").agg(F.count("*").alias("n_pages"), F.sum("n_chars").alias("n"), F.sum(F.col("width") * F.col("height")).alias("area"))
    sure = F.bround(reconstruct.fast_text_confidence(F.when(F.col("area") > 0, F.col("n") / F.col("area")).otherwise(0.0), F.lit(0.0)), 4)
    low = sure < given.review_below
    entry = n.select("document_id", F.lit(0).alias("depth"), F.lit(decoder).alias("strategy_used"), "n_pages", sure.alias("confidence_score"), F.lit(triage.COSTS.get(decoder, ("unknown", 0.0))[0]).alias("cost_estimate"), F.lit(False).alias("escalation_triggered"), low.alias("flagged_for_review"))
    s.append("extraction_ledger", entry)
    s.append("provenance_ledger", good.select("document_id").distinct().select("document_id", F.lit(f"extraction:{decoder}").alias("action"), F.current_timestamp().alias("event_time")))
    return p.where("error IS NOT NULL").select("source_filename", "error")


def ask(spark: SparkSession, s: store.Store, text: str, document_id: str, audit: bool) -> DataFrame:
    """An answer or an audit of one document, from all that is stored of it; the question is logged with what was found."""
    d = F.col("document_id") == document_id
    q = spark.createDataFrame([(1, document_id, text)], "question_id long, document_id string, question string")
    c, f, e = (s.read(t).where(d) for t in ("chunks", "fact_tables", "knowledge_graph_edges"))
    chosen = sections.choose_sections(sections.index_nodes(s.read("page_indexes").where(d)), q)
    found = session.cut(answers.evidence(q, c, f, e, chosen, s.read("entity_mentions").where(d), audit))
    out = session.cut(answers.audits(q, found, c) if audit else answers.answers(q, found))
    said = out.select("question_id", (F.col("status") if audit else F.col("answer")).alias("answer"), *([] if audit else ["confidence", "tools_used"]))
    s.append("query_logs", q.join(said, "question_id").withColumn("asked_at", F.current_timestamp()))
    return out


#: Characters of a chunk in an export.
PREVIEW = 120


def export(s: store.Store, folder: str, document_id: str | None = None) -> None:
    """Profiles, ledger, previews of chunks, indexes, facts and graph as JSON lines, a folder for each, of one document or all."""
    d = F.lit(True) if document_id is None else F.col("document_id") == document_id
    for name in ("profiles", "extraction_ledger", "chunks", "page_indexes", "fact_tables", "knowledge_graph_edges"):
        x = s.read(name).where(d)
        if name == "chunks":
            x = x.withColumn("content", F.substring("content", 1, PREVIEW))
        x.write.mode("overwrite").json(f"{folder}/{name}")


def _print(df: DataFrame, as_json: bool) -> None:
    if as_json:
        for row in df.toJSON().toLocalIterator():
            print(row)
    else:
        df.show(truncate=60)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("--db", default="quire_db")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init-db")
    b = sub.add_parser("batch")
    b.add_argument("folder")
    b.add_argument("--pattern", default="*.pdf")
    b.add_argument("--decoder", default="fast_text", choices=sorted(documents.DECODERS))
    b.add_argument("--pages", type=parse_range)
    b.add_argument("--rules")
    for name in ("query", "audit"):
        a = sub.add_parser(name)
        a.add_argument("text", nargs="?")
        a.add_argument("--doc-id")
        a.add_argument("--top", type=int, default=5)
    show = sub.add_parser("show")
    show.add_argument("what", choices=["pageindex", "ledger", "facts", "profile", "graph", "names"])
    show.add_argument("document_id")
    sub.add_parser("list-docs")
    sub.add_parser("history").add_argument("--top", type=int, default=20)
    sub.add_parser("delete").add_argument("document_id")
    x = sub.add_parser("export")
    x.add_argument("folder")
    x.add_argument("--doc-id")
    args = p.parse_args(argv)

    spark = session.build()
    session.ship(spark)
    s = store.Store(spark, args.db)
    s.create()
    out = None
    if args.command == "batch":
        out = ingest(spark, s, args.folder, args.pattern, args.decoder, args.pages, args.rules)
    elif args.command in ("query", "audit") and args.text and args.doc_id:
        out = ask(spark, s, args.text, args.doc_id, args.command == "audit")
    elif args.command == "query" and args.text:
        e = spark.range(1).select(vectors.embed(F.lit(args.text)).alias("e")).first().e
        out = vectors.nearest(s.read("embeddings"), e, args.top)
    elif args.command == "audit" and args.doc_id:
        _print(s.read("chunks").where(F.col("document_id") == args.doc_id).orderBy("ldu_idx").limit(10), args.json)
        out = s.read("fact_tables").where(F.col("document_id") == args.doc_id).orderBy("key", "fact_id").limit(15)
    elif args.command == "show":
        d = F.col("document_id") == args.document_id
        if args.what == "pageindex":
            out = sections.index_nodes(s.read("page_indexes").where(d)).orderBy("node_ord")
        else:
            out = s.read({"ledger": "extraction_ledger", "facts": "fact_tables", "profile": "profiles", "graph": "knowledge_graph_edges", "names": "entity_mentions"}[args.what]).where(d)
    elif args.command == "list-docs":
        out = s.read("documents").orderBy(F.desc("processing_timestamp"), "document_id")
    elif args.command == "history":
        out = store.recent(s.read("query_logs"), "asked_at", "question_id", args.top)
    elif args.command == "delete":
        gone = spark.createDataFrame([(args.document_id,)], "document_id string")
        for name in store.SCHEMAS:
            if name not in ("query_logs", "provenance_ledger"):  # what happened stays on record
                s.delete_documents(name, gone)
    elif args.command == "export":
        export(s, args.folder, args.doc_id)
    elif args.command != "init-db":
        p.error("a text, a document id or both are needed")
    if out is not None:
        _print(out, args.json)


if __name__ == "__main__":
    main()

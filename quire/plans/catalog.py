"""Queries of the document-analytics operators over the test tables, each with its SQL.

The SQL is DuckDB's. Where the fold over a group's history can't be said in it, a query has none and is tested against
a plain Python model instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, chunking, entities, facts, reconstruct, sampling, sections, store, triage, vectors
from ..operators.skew import once
from ..session import cut, table
from ..streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
B, M = T.B, T.LINES_RE2


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return sections.chunks_once(table(spark, d, "chunks"))


ONCE = """WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, ldu_idx, chunk_type, coalesce(content, '') content, coalesce(nullif(section_path, ''), '(Untitled)') section, page_refs, page_number, content_hash
  FROM chunks WHERE chunk_id IS NOT NULL AND document_id IS NOT NULL)"""
PAGE = "coalesce(page_refs[1], 1)"


# Text.


@query(f"SELECT DISTINCT chunk_id, {T.sql_hash('content')} computed, content_hash IS NOT DISTINCT FROM {T.sql_hash('content')} fresh FROM chunks WHERE content IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    h = T.content_hash("content")
    return table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", h.alias("computed"), F.col("content_hash").eqNullSafe(h).alias("fresh")).distinct()


@query(
    f"""WITH t AS (SELECT doc_id, text, {T.sql_tokens('text')} t FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, text, t, unnest(generate_series(0, greatest(0, ceil((len(t) - 512) / 448.0))::int)) window_no FROM t WHERE len(t) > 0)
    SELECT doc_id, window_no::int window_no, md5(CASE WHEN len(t) <= 512 THEN text ELSE array_to_string(t[window_no * 448 + 1 : window_no * 448 + 512], ' ') END) content_md5, len(t[window_no * 448 + 1 : window_no * 448 + 512])::int token_count FROM w"""
)
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.windows(table(spark, d, "documents"), "doc_id", "text")
    return w.select("doc_id", "window_no", F.md5("content").alias("content_md5"), "token_count")


@query(
    ONCE
    + ", x AS (SELECT chunk_id, content, "
    + " OR ".join(f"len(regexp_extract_all(content, '{M}{p}')) >= 2" for p in chunking.LIST_ITEMS)
    + f""" is_list, string_split(content, chr(10))[1] line FROM c)
    SELECT chunk_id, is_list, {T.sql_strip('line')} <> '' AND len({T.sql_tokens('line')}) <= 10 AND NOT ends_with({T.sql_strip('line')}, '.') AND regexp_matches({T.sql_strip('line')}, '{chunking.HEADING}') is_heading FROM x"""
)
def list_and_heading(spark: SparkSession, d: str) -> DataFrame:
    line = F.element_at(F.split("content", "\n"), 1)
    return _chunks(spark, d).withColumn("line", line).select("chunk_id", chunking.is_list("content").alias("is_list"), chunking.is_heading("line").alias("is_heading"))


_CELLS = lambda r: f"array_to_string([coalesce(q, '') FOR q IN {r}], ' | ')"
_TABLE = f"""array_to_string(list_concat(CASE WHEN coalesce(caption, '') <> '' THEN ['Caption: ' || caption] ELSE [] END,
  CASE WHEN len(headers) > 0 THEN [{_CELLS('headers')}, array_to_string(['---' FOR q IN headers], ' | ')] ELSE [] END, coalesce([{_CELLS('r')} FOR r IN rows], [])), chr(10))"""
_FIGURE = "'[' || upper(coalesce(figure_type, 'image')) || '] ' || CASE WHEN coalesce(caption, '') = '' THEN '(no caption)' ELSE caption END"
_SUB = rf"regexp_matches({T.sql_strip('r[1]')}, '{chunking.SUBHEAD}') AND len(list_filter(r[2:], lambda q: {T.sql_strip('coalesce(q, chr(32))')} NOT IN ('', '-', '—'))) = 0"
# Groups of rows of each table of b, one without a label where it isn't cut.
_GROUPS = f"""tb AS (SELECT block_id, coalesce(rows, []) rows FROM b WHERE kind = 'table'),
  tr AS (SELECT block_id, rows, unnest(rows) r, generate_subscripts(rows, 1) i FROM tb), ts AS (SELECT *, {_SUB} sub FROM tr),
  tg AS (SELECT *, sum(sub::int) OVER (PARTITION BY block_id ORDER BY i) island, last_value(CASE WHEN sub THEN {T.sql_strip('r[1]')} END IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY i ROWS UNBOUNDED PRECEDING) label FROM ts),
  tn AS (SELECT block_id, island, label, list(r ORDER BY i) rows, row_number() OVER (PARTITION BY block_id ORDER BY island) - 1 group_no, count(*) OVER (PARTITION BY block_id) n_groups FROM tg WHERE NOT sub GROUP BY 1, 2, 3),
  tc AS (SELECT tn.* FROM tn JOIN tb USING (block_id) WHERE n_groups >= 2 AND len(tb.rows) >= 4),
  grouped AS (SELECT block_id, group_no::int group_no, label, rows FROM tc UNION ALL SELECT block_id, 0, NULL, rows FROM tb WHERE block_id NOT IN (SELECT block_id FROM tc))"""
_N = f"len({T.sql_tokens('txt')})"
_WINDOWS = f"CASE WHEN {_N} <= 512 THEN [txt] ELSE [array_to_string({T.sql_tokens('txt')}[i * 448 + 1 : i * 448 + 512], ' ') FOR i IN range(0, ceil(({_N} - 512) / 448.0)::bigint + 1)] END"
_ITEMS = rf"list_filter([{T.sql_strip('q')} FOR q IN string_split(regexp_replace(txt, '(?m)^(\d+\.{B}|[-•●◦▪]{B}|[a-z]\){B})', chr(1) || '\1', 'g'), chr(1))], lambda q: q <> '')"
_FOLD = "CASE WHEN a.n + x.n > 512 THEN {'d': list_append(a.d, a.o), 'o': x.o, 'n': x.n} ELSE {'d': a.d, 'o': a.o || chr(10) || x.o, 'n': a.n + x.n} END"
_PACKED = f"list_reduce([{{'d': []::varchar[], 'o': q, 'n': len({T.sql_tokens('q')})}} FOR q IN {_ITEMS}], lambda a, x: {_FOLD})"
_PACKS = f"CASE WHEN {_N} <= 512 THEN [txt] ELSE list_append(({_PACKED}).d, ({_PACKED}).o) END"


def _ldus(blocks: str) -> str:
    """The chunks of blocks. ``blocks``: SQL of the blocks."""
    order = "PARTITION BY document_id ORDER BY page_number, kind_no, idx, block_id"
    return f"""WITH b AS ({blocks}), {_GROUPS},
  t AS (SELECT *, CASE kind WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END kind_no, {T.sql_strip('content')} txt FROM b),
  h AS (SELECT *, kind = 'text' AND len({T.sql_tokens('txt')}) <= 10 AND NOT ends_with(txt, '.') AND regexp_matches(txt, '{chunking.HEADING}') heading,
    {' OR '.join(f"len(regexp_extract_all(txt, '{M}{p}')) >= 2" for p in chunking.LIST_ITEMS)} listed FROM t WHERE kind <> 'text' OR txt <> ''),
  k AS (SELECT *, CASE WHEN heading THEN 'section' WHEN kind = 'text' AND listed THEN 'list' WHEN kind = 'text' THEN 'paragraph' ELSE kind END chunk_type FROM h),
  gp AS (SELECT g.block_id, list({{'c': CASE WHEN coalesce(label, '') <> '' THEN '[Subgroup: ' || label || ']' || chr(10) ELSE '' END || {_TABLE.replace('IN rows]', 'IN g.rows]')}, 'l': label}} ORDER BY group_no) parts FROM grouped g JOIN b USING (block_id) GROUP BY 1),
  pp AS (SELECT k.*, CASE chunk_type WHEN 'section' THEN [{{'c': txt, 'l': NULL::varchar}}] WHEN 'list' THEN [{{'c': q, 'l': NULL::varchar}} FOR q IN {_PACKS}] WHEN 'paragraph' THEN [{{'c': q, 'l': NULL::varchar}} FOR q IN {_WINDOWS}]
    WHEN 'table' THEN parts ELSE [{{'c': {_FIGURE}, 'l': NULL::varchar}}] END ps FROM k LEFT JOIN gp USING (block_id)),
  o AS (SELECT *, last_value(CASE WHEN heading THEN txt END IGNORE NULLS) OVER w parent_section, sum(len(ps)) OVER w - len(ps) start,
    CASE WHEN kind = 'table' THEN coalesce(nullif(table_id, ''), 'Table_' || count(*) FILTER (kind = 'table') OVER w) END tid, CASE WHEN kind = 'figure' THEN coalesce(nullif(figure_id, ''), 'Figure_' || count(*) FILTER (kind = 'figure') OVER w) END fid
    FROM pp WINDOW w AS ({order} ROWS UNBOUNDED PRECEDING)),
  ldus AS (SELECT document_id, start, block_id, page_number, chunk_type, parent_section, tid, fid, len(ps) n_parts, unnest(ps) p, generate_subscripts(ps, 1) - 1 part_no FROM o)
  SELECT document_id, (start + part_no)::bigint ldu_idx, block_id, part_no::int part_no, page_number, chunk_type, parent_section, len({T.sql_tokens('p.c')})::int token_count, {T.sql_hash('p.c')} content_hash,
    tid table_id, fid figure_id, p.l subgroup_label, CASE WHEN chunk_type = 'table' AND n_parts > 1 THEN tid END parent_table_id FROM ldus"""


@query(_ldus("SELECT DISTINCT ON (block_id) * FROM blocks WHERE block_id IS NOT NULL"))
def chunked_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_blocks(table(spark, d, "blocks")).drop("content", "cross_references")


_LONG = """SELECT document_id, document_id || k.id block_id, k.p::int page_number, k.kind kind, k.i::int idx, k.c content, ['Item', 'Amount'] headers, k.r "rows", 'Of ' || source caption, NULL::varchar figure_type, NULL::varchar table_id, NULL::varchar figure_id
  FROM (SELECT doc_id::varchar document_id, coalesce(source, '') source, unnest([
    {'id': 'a', 'p': 1, 'kind': 'text', 'i': 0, 'c': 'Report', 'r': NULL::varchar[][]}, {'id': 'b', 'p': 1, 'kind': 'text', 'i': 1, 'c': text, 'r': NULL::varchar[][]},
    {'id': 'c', 'p': 2, 'kind': 'text', 'i': 0, 'c': '- ' || replace(text, '. ', '.' || chr(10) || '- '), 'r': NULL::varchar[][]},
    {'id': 't', 'p': 2, 'kind': 'table', 'i': 1, 'c': NULL, 'r': [['All', '1'], ['Assets', '-'], ['loans', n_chars::varchar], ['cash', '2'], ['Liabilities', ''], ['deposits', doc_id::varchar]]}]) k FROM documents WHERE text IS NOT NULL)"""


def _long_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as long paragraphs, long lists and tables with subheaders: ``blocks`` has few of these."""
    t, s = "array<array<string>>", F.lit
    none = s(None).cast(t)
    cells = F.array(*(F.array(s(a), b) for a, b in (("All", s("1")), ("Assets", s("-")), ("loans", F.col("n_chars").cast("string")), ("cash", s("2")), ("Liabilities", s("")), ("deposits", F.col("doc_id").cast("string")))))
    k = [("a", 1, "text", 0, s("Report"), none), ("b", 1, "text", 1, F.col("text"), none), ("c", 2, "text", 0, F.concat(s("- "), F.expr("replace(text, '. ', '.\n- ')")), none), ("t", 2, "table", 1, s(None).cast("string"), cells)]
    kinds = F.array(*(F.struct(s(i).alias("id"), s(p).alias("p"), s(kind).alias("kind"), s(n).alias("i"), c.alias("c"), r.cast(t).alias("r")) for i, p, kind, n, c, r in k))
    x = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("source", s("")).alias("source"), F.explode(kinds).alias("k"))
    return x.select("document_id", F.concat("document_id", "k.id").alias("block_id"), F.col("k.p").alias("page_number"), "k.kind", F.col("k.i").alias("idx"), F.col("k.c").alias("content"), F.array(s("Item"), s("Amount")).alias("headers"), F.col("k.r").alias("rows"), F.concat(s("Of "), "source").alias("caption"), s(None).cast("string").alias("figure_type"))


@query(_ldus(_LONG))
def chunked_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_blocks(_long_blocks(spark, d)).drop("content", "cross_references")


@query(
    f"""{ONCE}, l AS (SELECT document_id, page_number, string_agg(content, chr(10) ORDER BY ldu_idx, content) txt FROM c WHERE chunk_type = 'list' GROUP BY 1, 2),
    k AS (SELECT document_id, page_number, {_PACKS} ps FROM l WHERE {T.sql_strip('txt')} <> ''), u AS (SELECT document_id, page_number, unnest(ps) c, generate_subscripts(ps, 1) - 1 pack_no FROM k)
    SELECT document_id, page_number, pack_no::int pack_no, len({T.sql_tokens('c')})::int token_count, md5(c) content_md5 FROM u"""
)
def list_packs(spark: SparkSession, d: str) -> DataFrame:
    # one page's lists
    x = _chunks(spark, d).where("chunk_type = 'list'").groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ldu_idx", "content"))), lambda s: s["content"]), "\n").alias("content"))
    x = chunking.pack_list(x.withColumn("page", F.struct("document_id", "page_number")), "page", "content")
    return x.select("page.document_id", "page.page_number", "pack_no", "token_count", F.md5("content").alias("content_md5"))


@query(f"WITH b AS (SELECT DISTINCT ON (block_id) * FROM blocks WHERE block_id IS NOT NULL), {_GROUPS} SELECT block_id, group_no, label, len(rows)::int n_rows FROM grouped")
def table_subgroups(spark: SparkSession, d: str) -> DataFrame:
    return chunking.subgroups(table(spark, d, "blocks")).select("block_id", "group_no", "label", F.size("rows").alias("n_rows"))


@query(f"SELECT DISTINCT block_id, CASE kind WHEN 'table' THEN {_TABLE} ELSE {_FIGURE} END text FROM blocks WHERE kind IN ('table', 'figure') AND block_id IS NOT NULL")
def tables_and_figures(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("kind IN ('table', 'figure') AND block_id IS NOT NULL")
    text = F.when(F.col("kind") == "table", chunking.table_text("headers", "rows", "caption")).otherwise(chunking.figure_text(F.coalesce("figure_type", F.lit("image")), "caption"))
    return b.select("block_id", text.alias("text")).distinct()


@query(
    f"""WITH c AS (SELECT DISTINCT chunk_id, coalesce(content, '') content, chunk_type, content_hash, page_refs FROM chunks WHERE chunk_id IS NOT NULL), b AS (SELECT *, {T.sql_strip('content')} = '' blank FROM c)
    SELECT DISTINCT chunk_id, v violation FROM (SELECT chunk_id, unnest([CASE WHEN blank THEN 'empty' END, CASE WHEN len({T.sql_tokens('content')}) > 512 AND coalesce(chunk_type, '') <> 'table' THEN 'too long' END,
      CASE WHEN NOT blank AND content_hash IS DISTINCT FROM {T.sql_hash('content')} THEN 'hash' END, CASE WHEN coalesce(len(page_refs), 0) < 1 THEN 'no page' END]) v FROM b) WHERE v IS NOT NULL"""
)
def chunk_violations(spark: SparkSession, d: str) -> DataFrame:
    return chunking.violations(table(spark, d, "chunks"))


# Sections.

_NUMERIC = f"len(list_filter({T.sql_tokens('content')}, lambda t: regexp_matches(t, '[0-9]')))"
_NODES = f"""{ONCE}, n AS (SELECT document_id, section title, min(ldu_idx) node_ord,
    coalesce(min(list_min(page_refs)) FILTER (chunk_type <> 'section'), min(list_min(page_refs)), 1) page_start, coalesce(max(list_max(page_refs)) FILTER (chunk_type <> 'section'), max(list_max(page_refs)), 1) page_end,
    bool_or(chunk_type = 'table') tables, bool_or(chunk_type = 'figure') figures, bool_or(chunk_type = 'list') lists,
    sum({_NUMERIC}) FILTER (chunk_type <> 'section') num, sum(len({T.sql_tokens('content')})) FILTER (chunk_type <> 'section') words,
    arg_min(content, ldu_idx) FILTER (chunk_type IN ('paragraph', 'list')) told, arg_min(content, ldu_idx) FILTER (chunk_type <> 'section' AND {T.sql_strip('content')} <> '') anything FROM c GROUP BY 1, 2),
  s AS (SELECT *, array_to_string(list_filter([CASE WHEN figures THEN 'figures' END, CASE WHEN lists THEN 'lists' END, CASE WHEN words > 0 AND num >= 0.15 * words THEN 'numeric_dense' END, CASE WHEN tables THEN 'tables' END], lambda q: q IS NOT NULL), ',') signals,
    array_to_string(list_filter(string_split(regexp_replace({T.sql_strip("coalesce(told, anything, '')")}, '([.!?]){B}+', '\\1' || chr(1), 'g'), chr(1)), lambda q: q <> '')[1:3], ' ') told3 FROM n),
  nodes AS (SELECT document_id, title, node_ord, page_start, page_end, signals, CASE WHEN told3 = '' OR regexp_matches(told3, '[.!?]$') THEN told3 ELSE told3 || '.' END summary FROM s)"""


@query(_NODES + " SELECT document_id, title, node_ord, page_start, page_end, signals, summary FROM nodes")
def section_index(spark: SparkSession, d: str) -> DataFrame:
    return sections.sections(_chunks(spark, d))


_KEY_NAMES = f"""km AS (SELECT document_id, section title, ldu_idx, unnest(x) name, generate_subscripts(x, 1) pos FROM (SELECT *, regexp_extract_all({T.sql_ascii_words('content')}, '{sections.NAME}') x FROM c WHERE chunk_type <> 'section')),
    kn AS (SELECT document_id, title, name, count(*) n, min((ldu_idx, pos)) f FROM km WHERE length(name) > 4 GROUP BY 1, 2, 3),
    key_names AS (SELECT document_id, title, name, n, place::int place FROM (SELECT *, row_number() OVER (PARTITION BY document_id, title ORDER BY n DESC, f, name) place FROM kn) WHERE place <= 10)"""


@query(f"{ONCE}, {_KEY_NAMES} SELECT * FROM key_names")
def key_names(spark: SparkSession, d: str) -> DataFrame:
    return sections.key_names(_chunks(spark, d))


def _nodes(c: DataFrame) -> DataFrame:
    return sections.with_key_names(sections.sections(c), sections.key_names(c))


# Nodes with the words of their key names.
_NAMED_NODES = f"""{_NODES}, {_KEY_NAMES}, named_nodes AS (SELECT nodes.*, coalesce(k, '') key_words FROM nodes LEFT JOIN (SELECT document_id, title, string_agg(name, ' ' ORDER BY place) k FROM key_names GROUP BY 1, 2) USING (document_id, title))"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """One question for every document with a fact that names an entity and a metric: about its first such fact."""
    f = table(spark, d, "facts").where("entity IS NOT NULL AND coalesce(metric, '') <> '' AND document_id IS NOT NULL")
    q = f.groupBy("document_id").agg(F.min(F.struct("fact_id", "metric", "entity")).alias("f"))
    return q.select(F.col("f.fact_id").alias("question_id"), "document_id", F.concat(F.lit("What is the "), "f.metric", F.lit(" of "), "f.entity", F.lit("?")).alias("question"))


_QUESTIONS = """questions AS (SELECT f.fact_id question_id, document_id, 'What is the ' || f.metric || ' of ' || f.entity || '?' question FROM
  (SELECT document_id, min({'fact_id': fact_id, 'metric': metric, 'entity': entity}) f FROM facts WHERE entity IS NOT NULL AND coalesce(metric, '') <> '' AND document_id IS NOT NULL GROUP BY 1))"""


_CHOSEN = f"""sc AS (SELECT q.question_id, document_id, title, page_start, summary, node_ord, len(list_intersect({T.sql_words('question')}, {T.sql_words("concat_ws(' ', title, summary, signals, key_words)")})) / len({T.sql_words('question')}) score FROM named_nodes JOIN questions q USING (document_id)),
    chosen AS (SELECT question_id, document_id, title, page_start, summary, round(score, 6) score, place::int place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_ord, title) place FROM sc) WHERE place <= 3)"""


@query(f"{_NAMED_NODES}, {_QUESTIONS}, {_CHOSEN} SELECT question_id, document_id, title, score, place FROM chosen")
def section_choice(spark: SparkSession, d: str) -> DataFrame:
    return sections.choose_sections(_nodes(_chunks(spark, d)), _questions(spark, d)).drop("page_start", "summary")


@query(f"{_NAMED_NODES} SELECT document_id, node_ord, title, page_start, page_end, signals, summary, key_words \"names\", count(*) OVER (PARTITION BY document_id) n_nodes FROM named_nodes")
def page_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of each document as one JSON text, and its nodes read again from it."""
    stored = sections.index_json(_nodes(_chunks(spark, d)))
    return sections.index_nodes(stored).join(stored.select("document_id", "n_nodes"), "document_id")


# Facts. Beside the chunks, reports of suppliers are written here, as chunks have few facts of some forms.


def _report(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    dollars = F.col("s_acctbal").cast("decimal(18,0)").cast("string")
    text = F.concat(F.lit("2.1 Supplier Accounts FY2024\nAcme Balance: $"), F.abs(dollars.cast("long")).cast("string"), F.lit(" million\nNation Code    "), F.col("s_nationkey").cast("string"), F.lit("\nSupplier Kind: Wholesale partner of record\nTotal Orders = "), (F.col("s_suppkey") % 97).cast("string"), F.lit("% as shown in Table 3"))
    rows = F.concat(F.lit("Orders Open | "), (F.col("s_suppkey") % 13).cast("string"), F.lit(" | 7\nOrders Closed | "), (F.col("s_suppkey") % 11).cast("string"))
    doc = F.substring(F.sha2(F.col("s_suppkey").cast("string"), 256), 1, 12)
    kinds = F.array(F.struct(F.lit("paragraph").alias("chunk_type"), F.lit(0).cast("long").alias("ldu_idx"), text.alias("content")), F.struct(F.lit("table").alias("chunk_type"), F.lit(1).cast("long").alias("ldu_idx"), rows.alias("content")))
    x = s.select(doc.alias("document_id"), F.explode(kinds).alias("x")).select("document_id", "x.*")
    return x.select("document_id", "ldu_idx", F.format_string("%s_%04d", "document_id", "ldu_idx").alias("chunk_id"), "chunk_type", "content", F.array(F.lit(1)).alias("page_refs"), F.lit("(Untitled)").alias("section"))


def _fact_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).select("document_id", "ldu_idx", "chunk_id", "chunk_type", "content", "page_refs", "section")
    return c.unionByName(_report(spark, d))


_REPORT = f"""{ONCE}, sup AS (SELECT substring(sha256(s_suppkey::varchar), 1, 12) document_id, s_suppkey k, s_nationkey nk, abs(s_acctbal::decimal(18,0)::bigint)::varchar bal FROM supplier),
  rep AS (SELECT document_id, 0 ldu_idx, 'paragraph' chunk_type, '2.1 Supplier Accounts FY2024' || chr(10) || 'Acme Balance: $' || bal || ' million' || chr(10) || 'Nation Code    ' || nk || chr(10) || 'Supplier Kind: Wholesale partner of record' || chr(10) || 'Total Orders = ' || (k % 97) || '% as shown in Table 3' content FROM sup
    UNION ALL SELECT document_id, 1, 'table', 'Orders Open | ' || (k % 13) || ' | 7' || chr(10) || 'Orders Closed | ' || (k % 11) FROM sup),
  a AS (SELECT document_id, ldu_idx, chunk_id, chunk_type, content, page_refs FROM c UNION ALL SELECT document_id, ldu_idx, document_id || '_' || lpad(ldu_idx::varchar, 4, '0'), chunk_type, content, [1] FROM rep)"""


_XREF_CTES = f"""x AS (SELECT chunk_id, document_id, {PAGE} page, regexp_extract_all(content, '{chunking.REFERENCE}', 1) w, regexp_extract_all(content, '{chunking.REFERENCE}', 2) n FROM a),
  refs AS (SELECT chunk_id, document_id, page, unnest(w) w, unnest(n) n, generate_subscripts(w, 1) - 1 pos FROM x),
  typed AS (SELECT *, CASE {' '.join(f"WHEN contains(lower(w), '{t}') THEN '{'figure' if t == 'fig' else t}'" for t in chunking.REFERENCE_TYPES)} ELSE 'figure' END target_type, w || ' ' || n target_label FROM refs)"""


_XREF = f"{_REPORT}, {_XREF_CTES}"


@query(_XREF + " SELECT chunk_id, pos::int pos, target_type, target_label FROM typed")
def cross_references(spark: SparkSession, d: str) -> DataFrame:
    x = _fact_chunks(spark, d).select("chunk_id", F.posexplode(chunking.references("content")).alias("pos", "x"))
    return x.select("chunk_id", "pos", "x.target_type", "x.target_label")


def _pairs(name: str) -> str:
    p = M + facts.PATTERNS[name][0]
    p = p.replace("'", "''")
    key = T.sql_strip("k") if name != "table" else f"regexp_replace({T.sql_strip('k')}, '[:]+$', '')"
    test = "chunk_type = 'table'" if name == "table" else "chunk_type <> 'table'"
    return f"""{name}_x AS (SELECT *, regexp_extract_all(content, '{p}', 1) ks, regexp_extract_all(content, '{p}', 2) vs FROM a WHERE {test}),
  {name}_p AS (SELECT document_id, ldu_idx, chunk_id, {PAGE} page_ref, content, {facts.METHODS[name]} method_no, generate_subscripts(ks, 1) - 1 pos, unnest(ks) k, unnest(vs) v FROM {name}_x),
  {name}_f AS (SELECT document_id, ldu_idx, chunk_id, page_ref, content, method_no, pos, {key} "key", {T.sql_strip('v')} "value", '{facts.PATTERNS[name][1]}' "method" FROM {name}_p)"""


def _extraction(name: str):  # noqa: ANN202
    def f(spark: SparkSession, d: str) -> DataFrame:
        return facts.extract(_fact_chunks(spark, d), name).select("chunk_id", "pos", "key", "value")

    f.__name__ = f"facts_{name}"
    return query(f'{_REPORT}, {_pairs(name)} SELECT chunk_id, pos::int pos, "key", "value" FROM {name}_f')(f)


for _n in facts.PATTERNS:
    _extraction(_n)

_UNIT = rf"""CASE WHEN contains("value", '%') THEN '%' WHEN starts_with("value", '$') THEN 'USD' WHEN starts_with("value", '€') THEN 'EUR' WHEN starts_with("value", '£') OR starts_with("value", '₤') THEN 'GBP' ELSE regexp_extract("value", '\b([A-Z]{{2,5}})$', 1) END"""
_KEY_TOKENS = T.sql_tokens('"key"')
_ENTITY = f"""CASE WHEN len({_KEY_TOKENS}) >= 2 AND regexp_matches({_KEY_TOKENS}[1], '^[A-Z]') AND regexp_matches({_KEY_TOKENS}[-1], '^[A-Z]') AND {_KEY_TOKENS}[1] NOT IN ({', '.join(f"'{w}'" for w in facts.NO_ENTITY)}) THEN {_KEY_TOKENS}[1] ELSE '' END"""
_SURE = rf"""round(least(1.0, greatest(0.0, CASE "method" WHEN 'regex' THEN 0.7 ELSE 0.85 END + CASE WHEN regexp_matches(regexp_replace("value", '[\$€£₤,%_{T.BLANKS}]', '', 'g'), '^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$') THEN 0.05 ELSE -0.10 END)), 4)"""
_ALL_FACTS = f"""{_REPORT}, {", ".join(_pairs(n) for n in facts.PATTERNS)},
  u AS ({" UNION ALL ".join(f"SELECT * FROM {n}_f" for n in facts.PATTERNS)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower("key"), lower("value") ORDER BY ldu_idx, method_no, pos, chunk_id) r FROM u),
  ff AS (SELECT document_id, chunk_id, "key", "value", CASE WHEN method_no = 2 THEN '' ELSE {_UNIT} END unit, page_ref, {_ENTITY} entity, CASE WHEN method_no = 2 THEN '' ELSE "key" END metric,
    {T.sql_strip(f"regexp_extract(content, '{facts.PERIOD}', 0)")} period, substring({T.sql_strip(f"regexp_extract(content, '{M}{facts.HEADING}', 0)")}, 1, 120) section, "method",
    CASE WHEN method_no = 2 THEN 0.55 ELSE round({_SURE} - CASE WHEN method_no = 3 THEN 0.05 ELSE 0.0 END, 4) END::double confidence FROM r WHERE r = 1 AND "key" <> '' AND "value" <> '')"""


@query(_ALL_FACTS + " SELECT * FROM ff")
def facts_all(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts(_fact_chunks(spark, d))


@query(_ALL_FACTS + """ SELECT document_id, chunk_id, "key", "value", unit, page_ref, confidence FROM ff WHERE "key" ILIKE '%balance%' AND period ILIKE '%2024%' AND confidence >= 0.5""")
def facts_query(spark: SparkSession, d: str) -> DataFrame:
    f = facts.query(facts.facts(_fact_chunks(spark, d)), key="%balance%", period="2024", least_confidence=0.5)
    return f.select("document_id", "chunk_id", "key", "value", "unit", "page_ref", "confidence")


@query("""SELECT DISTINCT fact_id, document_id, key, "value", confidence FROM facts WHERE key ILIKE '%revenue%' AND period ILIKE '%20%' AND confidence >= 0.7""")
def stored_facts(spark: SparkSession, d: str) -> DataFrame:
    f = facts.query(table(spark, d, "facts"), key="%revenue%", period="20", least_confidence=0.7)
    return f.select("fact_id", "document_id", "key", "value", "confidence").distinct()


# Names and graph.


_ASCII = T.sql_ascii_words("content")
_FOUND = {k: f"regexp_extract_all({'content' if k == 'amount' else _ASCII}, '{p}')" for k, p in entities.PATTERNS.items()}
_FOUND["organization"] = f"list_filter({_FOUND['organization']}, lambda q: length(q) >= 4 AND lower(q) NOT IN ({', '.join(repr(w) for w in entities.METRICS)}))"
for _k, _w in (("metric", entities.METRICS), ("location", entities.PLACES)):
    _FOUND[_k] = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(content), '{w}') THEN '{w}' END" for w in _w) + "], lambda q: q IS NOT NULL)"


@query(
    f"""{_REPORT}, m AS ({" UNION ALL ".join(f"SELECT document_id, {PAGE} page, '{k}' entity_type, unnest({x}) w FROM a" for k, x in _FOUND.items())}),
    s AS (SELECT *, regexp_replace({T.sql_strip('w')}, '{B}+', ' ', 'g') written FROM m)
    SELECT document_id, entity_type, written, count(*) n_mentions, min(page) first_page FROM s WHERE written <> '' GROUP BY 1, 2, 3"""
)
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = entities.mentions(_fact_chunks(spark, d))
    return m.groupBy("document_id", "entity_type", "written").agg(F.count("*").alias("n_mentions"), F.min("page").alias("first_page"))


_TITLE = lambda c: rf"array_to_string(list_transform(regexp_extract_all(lower({c}), '\p{{L}}+|\P{{L}}+'), lambda x: upper(x[1]) || x[2:]), '')"
_MENTIONS = f"""{_REPORT}, m AS ({" UNION ALL ".join(f"SELECT document_id, {PAGE} page, '{k}' entity_type, unnest({x}) w FROM a" for k, x in _FOUND.items())}),
  named AS (SELECT document_id, page, entity_type, {_TITLE(f"regexp_replace({T.sql_strip('w')}, '{B}+', ' ', 'g')")} entity_name FROM m)"""


_FACT_EDGES = """f AS (SELECT DISTINCT fact_id, document_id, entity, metric, period, page_ref, confidence FROM facts),
  fe AS (SELECT document_id, entity source, 'has_metric' relation, metric target, page_ref, confidence FROM f WHERE coalesce(entity, '') <> '' AND coalesce(metric, '') <> ''
    UNION ALL SELECT document_id, metric, 'reported_for_period', period, page_ref, confidence FROM f WHERE coalesce(metric, '') <> '' AND coalesce(period, '') <> '')"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "facts"), "fact_id")


@query(f"WITH {_FACT_EDGES} SELECT document_id, source, relation, target, min(page_ref) page_ref, count(*) n FROM fe GROUP BY 1, 2, 3, 4")
def fact_edges(spark: SparkSession, d: str) -> DataFrame:
    return entities.fact_edges(_facts(spark, d)).groupBy("document_id", "source", "relation", "target").agg(F.min("page_ref").alias("page_ref"), F.count("*").alias("n"))


@query(f"{_XREF} SELECT document_id, 'page:' || page source, 'references_' || target_type relation, target_label target, count(*) n FROM typed GROUP BY 1, 2, 3, 4")
def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return entities.reference_edges(_fact_chunks(spark, d)).groupBy("document_id", "source", "relation", "target").agg(F.count("*").alias("n"))


# Names of every type, those of facts among them.
_COMMON = lambda c: _TITLE(f"regexp_replace({T.sql_strip(c)}, '{B}+', ' ', 'g')")
_EVERY_CTES = f"""{_FACT_EDGES}, fw AS (SELECT document_id, page_ref page, unnest(['organization', 'metric', 'date']) entity_type, unnest([entity, metric, period]) w FROM f WHERE fact_id IS NOT NULL),
    every AS (SELECT * FROM named WHERE entity_name <> '' UNION ALL SELECT * FROM (SELECT document_id, page, entity_type, {_COMMON('w')} entity_name FROM fw WHERE w IS NOT NULL) WHERE entity_name <> '')"""


@query(f"{_MENTIONS}, {_EVERY_CTES} SELECT document_id, entity_type, entity_name, count(*) n_mentions, min(page) first_page FROM every GROUP BY 1, 2, 3")
def entity_names(spark: SparkSession, d: str) -> DataFrame:
    return entities.entities(_fact_chunks(spark, d), _facts(spark, d))


_GRAPH_CTES = f"""page_names AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY entity_name) r FROM (SELECT DISTINCT document_id, page, entity_name FROM every WHERE page <> 0)),
    pe AS (SELECT x.document_id, x.entity_name source, 'co_occurs_on_page' relation, y.entity_name target, x.page page_ref, 0.5 confidence FROM page_names x JOIN page_names y ON x.document_id = y.document_id AND x.page = y.page AND y.r - x.r BETWEEN 1 AND 5),
    ce AS (SELECT * FROM (SELECT document_id, {_COMMON('source')} source, relation, {_COMMON('target')} target, page_ref, confidence FROM fe) WHERE source <> '' AND target <> ''),
    {_XREF_CTES}, re AS (SELECT document_id, 'page:' || page, 'references_' || target_type, target_label, page, 0.4 FROM typed),
    e AS (SELECT 0 kind, * FROM ce UNION ALL SELECT 1, * FROM pe UNION ALL SELECT 2, * FROM re),
    edges AS (SELECT DISTINCT ON (document_id, source, relation, target) kind, document_id, source, relation, target, page_ref, confidence::double confidence FROM e ORDER BY document_id, source, relation, target, kind, page_ref, confidence DESC)"""


@query(f"{_MENTIONS}, {_EVERY_CTES}, {_GRAPH_CTES} SELECT document_id, source, relation, target, page_ref, confidence FROM edges")
def knowledge_graph(spark: SparkSession, d: str) -> DataFrame:
    return entities.graph(_facts(spark, d), _fact_chunks(spark, d))


# Triage. Pages are made of blocks: text, and the boxes of figures and tables, on pages of 612 by 792; words are the scanned lines.


def _pages(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("block_id IS NOT NULL").dropDuplicates(["block_id"])
    area = F.abs(F.col("bbox.x2") - F.col("bbox.x1")) * F.abs(F.col("bbox.y2") - F.col("bbox.y1"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, area.cast("decimal(20,6)"))), F.lit(0)).cast("double")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("idx", "block_id", F.coalesce("content", F.lit("")).alias("t"))))), lambda s: s["t"]), "\n")  # one page's blocks
    p = b.groupBy("document_id", "page_number").agg(text.alias("text"), of("figure").alias("image_area"), of("table").alias("table_area"))
    return p.select("document_id", "page_number", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.length("text").alias("n_chars"), "image_area", "table_area", "text")


_PAGES = """b AS (SELECT DISTINCT ON (block_id) * FROM blocks WHERE block_id IS NOT NULL),
  p AS (SELECT document_id, page_number, 612.0::double width, 792.0::double height, coalesce(string_agg(coalesce(content, ''), chr(10) ORDER BY idx, block_id) FILTER (kind = 'text'), '') text,
    coalesce(sum(ar) FILTER (kind = 'figure'), 0)::double image_area, coalesce(sum(ar) FILTER (kind = 'table'), 0)::double table_area FROM (SELECT *, (abs(bbox.x2 - bbox.x1) * abs(bbox.y2 - bbox.y1))::decimal(20,6) ar FROM b) GROUP BY 1, 2),
  first5 AS (SELECT document_id, sum(length(text)) chars, sum(width * height) area, sum(image_area::decimal(20,6))::double images, sum(table_area::decimal(20,6))::double tables FROM p WHERE page_number <= 5 GROUP BY 1)"""
_FAR = lambda v, t: f"least(abs({v} - {t}) / {t}, 1.0)"


@query(
    f"""WITH {_PAGES} SELECT document_id, CASE WHEN chars / area >= 0.001 THEN 'native_digital' WHEN images / area > 0.7 THEN 'scanned_image' ELSE 'mixed' END origin_type,
    round(0.5 + 0.5 * ({_FAR('chars / area', '0.001')} + {_FAR('images / area', '0.7')}) / 2, 4)::double confidence FROM first5"""
)
def origin_type(spark: SparkSession, d: str) -> DataFrame:
    return triage.origin(_pages(spark, d))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return reconstruct.boxes_once(table(spark, d, "ocr_boxes")).select("document_id", "page_number", F.col("x1").alias("x0"), F.col("x2").alias("x1"))


_LAYOUT_CTES = f"""o AS (SELECT DISTINCT ON (box_id) document_id, page_number, (x1 + x2) / 2 / 612.0 mid FROM ocr_boxes WHERE box_id IS NOT NULL),
  w AS (SELECT o.document_id, count(*) n, avg(mid) mean, stddev_samp(mid) dev FROM o JOIN p USING (document_id, page_number) WHERE page_number <= 5 GROUP BY 1),
  lay AS (SELECT document_id, CASE WHEN tables / area > 0.3 THEN 'table_heavy' WHEN images / area > 0.25 AND chars / area > 0.005 THEN 'figure_heavy' WHEN n >= 10 AND mean > 0 AND dev / mean > 0.25 THEN 'multi_column' ELSE 'single_column' END layout_complexity FROM first5 LEFT JOIN w USING (document_id))"""


@query(f"WITH {_PAGES}, {_LAYOUT_CTES} SELECT * FROM lay")
def layout_class(spark: SparkSession, d: str) -> DataFrame:
    return triage.layout(_pages(spark, d), _words(spark, d))


def _domain_cte() -> str:
    n = ", ".join("(" + " + ".join(f"max(contains(lower(text), '{w}')::int)" for w in words) + f") {name}" for name, words in triage.DOMAINS.items())
    cases = " ".join(f"WHEN {name} > 0 AND {name} = greatest({', '.join(triage.DOMAINS)}) THEN '{name}'" for name in triage.DOMAINS)
    return f"dk AS (SELECT document_id, {n} FROM p WHERE page_number <= 2 GROUP BY 1), dom AS (SELECT document_id, CASE {cases} ELSE 'general' END domain_hint FROM dk)"


@query(f"WITH {_PAGES}, {_domain_cte()} SELECT * FROM dom")
def domain_hint(spark: SparkSession, d: str) -> DataFrame:
    return triage.domain(_pages(spark, d))


_HAS = lambda words: "(" + " OR ".join(f"contains(lower(coalesce(source_filename, '')), '{w}')" for w in words) + ")"
_PROFILES = f"""p AS (SELECT DISTINCT ON (document_id) * FROM profiles WHERE document_id IS NOT NULL),
  k AS (SELECT *, CASE WHEN origin_type = 'scanned_image' THEN 'needs_vision_model' WHEN origin_type = 'native_digital' AND layout_complexity = 'single_column' THEN 'fast_text_sufficient' ELSE 'needs_layout_model' END cost,
    CASE WHEN origin_type = 'scanned_image' THEN 'B' WHEN {_HAS(triage.TECHNICAL_NAMES)} THEN 'C' WHEN {_HAS(triage.FISCAL_NAMES)} THEN 'D' WHEN layout_complexity = 'table_heavy' AND origin_type IN ('native_digital', 'mixed') THEN 'D'
      WHEN {_HAS(triage.ANNUAL_NAMES)} THEN 'A' WHEN origin_type = 'native_digital' THEN 'A' ELSE 'C' END class FROM p)"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profiles").where("document_id IS NOT NULL").dropDuplicates(["document_id"])


@query(
    f"""WITH {_PROFILES} SELECT document_id, cost, class, CASE WHEN origin_type = 'scanned_image' THEN 'ocr_heavy,vision_augmented' WHEN origin_type = 'mixed' OR cost = 'needs_layout_model' OR layout_complexity IN ('table_heavy', 'figure_heavy', 'multi_column') THEN 'layout_aware,ocr_heavy,vision_augmented'
      ELSE 'fast_text,layout_aware,ocr_heavy,vision_augmented' END chain FROM k"""
)
def routing(spark: SparkSession, d: str) -> DataFrame:
    cost = triage.cost("origin_type", "layout_complexity")
    return _profiles(spark, d).select("document_id", cost.alias("cost"), triage.document_class().alias("class"), F.array_join(triage.chain("origin_type", "layout_complexity", cost), ",").alias("chain"))


@query(f"WITH {_PROFILES} SELECT c.class, count(k.class) n, count(k.class) >= 3 enough FROM (VALUES ('A'), ('B'), ('C'), ('D')) c(class) LEFT JOIN k ON k.class = c.class GROUP BY 1")
def class_coverage(spark: SparkSession, d: str) -> DataFrame:
    return triage.class_coverage(_profiles(spark, d))


@query("SELECT DISTINCT document_id FROM chunks WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM profiles WHERE document_id IS NOT NULL)")
def unprofiled(spark: SparkSession, d: str) -> DataFrame:
    return triage.coverage_gap(_profiles(spark, d), table(spark, d, "chunks").where("document_id IS NOT NULL").select("document_id").distinct())


_PAGE_SURE = "0.6 * least(length(text) / (width * height) / 0.02, 1.0) + 0.4 * greatest(0.0, 1 - image_area / (width * height) / 0.5)"


def _sure_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the confidence of their text."""
    area = F.col("width") * F.col("height")
    return _pages(spark, d).withColumn("page_confidence", reconstruct.fast_text_confidence(F.col("n_chars") / area, F.col("image_area") / area))


@query(f"WITH {_PAGES} SELECT document_id, page_number FROM p WHERE length(text) < 50 OR ({_PAGE_SURE} > 0 AND {_PAGE_SURE} < 0.5)")
def sparse_pages(spark: SparkSession, d: str) -> DataFrame:
    return triage.low_confidence_pages(_sure_pages(spark, d), 0.5).select("document_id", "page_number")


_AREA = "sum(width * height)"
_SIGNALS = f"""signals AS (SELECT document_id, count(*) n_pages, sum(length(text)) chars, {_AREA} area, sum(image_area::decimal(20,6))::double images, count(*) FILTER (length(text) > 0) with_text FROM p GROUP BY 1),
  parts AS (SELECT document_id, count(*) FILTER (kind = 'table') n_tables, count(*) FILTER (kind = 'table' AND len("rows") > 0) full_tables, count(*) FILTER (kind = 'text') n_texts, count(*) FILTER (kind = 'text' AND {T.sql_strip("coalesce(content, '')")} = '') n_blank FROM b GROUP BY 1),
  ocr AS (SELECT document_id, sum(confidence::decimal(20,6)) s, count(*) n FROM (SELECT DISTINCT ON (box_id) * FROM ocr_boxes WHERE box_id IS NOT NULL) GROUP BY 1)"""


@query(
    f"""WITH {_PAGES}, {_SIGNALS}, v AS (SELECT *, chars / n_pages mean, with_text / n_pages coverage, CASE WHEN n_tables > 0 THEN full_tables / n_tables ELSE 1.0 END complete, CASE WHEN n_texts > 0 THEN n_blank / n_texts ELSE 0.0 END blank FROM signals JOIN parts USING (document_id) LEFT JOIN ocr USING (document_id))
    SELECT document_id, round_even(0.6 * least(chars / area / 0.02, 1.0) + 0.4 * greatest(0.0, 1 - images / area / 0.5), 4)::double fast_text, round_even(least(0.5 * coverage + 0.3 * complete + 0.2, 1.0), 4)::double layout_model,
      round(least(least(mean / 500, 1e0) * 0.5e0 + least(0.05e0 * n_tables, 0.2e0) + 0.2e0 * coverage + 0.1e0 * (1 - blank), 1e0), 6)::double layout_text, CASE WHEN n > 0 THEN round_even(least((coalesce(s, 0) / n)::double, 1.0), 4) ELSE 0.1 END::double ocr,
      round_even(least(mean / 500, 1.0) * 0.5, 4)::double ocr_text, CASE WHEN mean > 200 THEN 0.75 WHEN mean > 50 THEN 0.5 ELSE 0.2 END::double vision, CASE WHEN mean > 200 THEN 0.6 WHEN mean > 50 THEN 0.4 ELSE 0.15 END::double vision_text, CASE WHEN mean > 200 THEN 0.55 WHEN mean > 50 THEN 0.35 ELSE 0.15 END::double vision_plain FROM v"""
)
def strategy_confidences(spark: SparkSession, d: str) -> DataFrame:
    """What each way of extraction, and what takes its place, would say of its result."""
    blank = T.strip(F.coalesce("content", F.lit(""))) == ""
    n = lambda c: F.count(F.when(c, 1))
    kind = F.col("kind")
    b = once(table(spark, d, "blocks"), "block_id").groupBy("document_id").agg(n(kind == "table").alias("n_tables"), n((kind == "table") & (F.size("rows") > 0)).alias("full_tables"), n(kind == "text").alias("n_texts"), n((kind == "text") & blank).alias("n_blank"))
    p = _pages(spark, d).groupBy("document_id").agg(F.count("*").alias("n_pages"), F.sum("n_chars").alias("chars"), F.sum(F.col("width") * F.col("height")).alias("area"), F.sum(F.col("image_area").cast("decimal(20,6)")).cast("double").alias("images"), n(F.col("n_chars") > 0).alias("with_text"))
    o = reconstruct.boxes_once(table(spark, d, "ocr_boxes")).groupBy("document_id").agg(F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double").alias("s"), F.count("*").alias("n"))
    x = p.join(b, "document_id").join(o, "document_id", "left")
    x = x.withColumns({"mean": F.col("chars") / F.col("n_pages"), "coverage": F.col("with_text") / F.col("n_pages"), "complete": F.when(F.col("n_tables") > 0, F.col("full_tables") / F.col("n_tables")).otherwise(1.0), "blank": F.when(F.col("n_texts") > 0, F.col("n_blank") / F.col("n_texts")).otherwise(0.0)})
    return x.select(
        "document_id", F.bround(reconstruct.fast_text_confidence(F.col("chars") / F.col("area"), F.col("images") / F.col("area")), 4).alias("fast_text"), reconstruct.layout_confidence("coverage", "complete").alias("layout_model"),
        F.round(reconstruct.layout_fallback_score("mean", "n_tables", "coverage", "blank"), 6).alias("layout_text"), reconstruct.ocr_confidence("s", F.coalesce("n", F.lit(0))).alias("ocr"), reconstruct.ocr_fallback_confidence("mean").alias("ocr_text"),
        *(reconstruct.vision_confidence("mean", k).alias(c) for k, c in (("model", "vision"), ("text", "vision_text"), ("plain", "vision_plain"))),
    )


@query(f"WITH o AS (SELECT DISTINCT ON (box_id) * FROM ocr_boxes WHERE box_id IS NOT NULL) SELECT document_id, page_number, md5(string_agg(text, ' ' ORDER BY idx, text)) content_md5 FROM o WHERE {T.sql_strip('text')} <> '' GROUP BY 1, 2")
def words_as_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = reconstruct.words_to_blocks(reconstruct.boxes_once(table(spark, d, "ocr_boxes")))
    return x.select("document_id", "page_number", F.md5("content").alias("content_md5"))


@query(f"""WITH {_PAGES}, {_LAYOUT_CTES}, {_domain_cte()},
    f AS (SELECT DISTINCT ON (document_id) document_id, source_filename FROM profiles WHERE document_id IS NOT NULL), n AS (SELECT document_id, count(*) page_count, sum(length(text)) total_chars FROM p GROUP BY 1),
    og AS (SELECT document_id, CASE WHEN chars / area >= 0.001 THEN 'native_digital' WHEN images / area > 0.7 THEN 'scanned_image' ELSE 'mixed' END origin_type, round(0.5 + 0.5 * ({_FAR('chars / area', '0.001')} + {_FAR('images / area', '0.7')}) / 2, 4)::double confidence FROM first5),
    j AS (SELECT f.*, coalesce(origin_type, 'scanned_image') origin_type, coalesce(layout_complexity, 'single_column') layout_complexity, coalesce(domain_hint, 'general') domain_hint, coalesce(page_count, 0) page_count, coalesce(total_chars, 0) total_chars, coalesce(confidence, 0.5) confidence
      FROM f LEFT JOIN n USING (document_id) LEFT JOIN og USING (document_id) LEFT JOIN lay USING (document_id) LEFT JOIN dom USING (document_id))
    SELECT document_id, source_filename, origin_type, layout_complexity, 'en' "language", 0.5::double language_confidence, domain_hint,
      CASE WHEN origin_type = 'scanned_image' THEN 'needs_vision_model' WHEN origin_type = 'native_digital' AND layout_complexity = 'single_column' THEN 'fast_text_sufficient' ELSE 'needs_layout_model' END estimated_extraction_cost, page_count::int page_count, total_chars::bigint total_chars, confidence::double confidence FROM j""")
def document_profiles(spark: SparkSession, d: str) -> DataFrame:
    return triage.profiles(_profiles(spark, d), _pages(spark, d), _words(spark, d))


@query(
    f"""WITH {_PROFILES}, n AS (SELECT c.class, 3 - count(k.class) needed FROM (VALUES ('A'), ('B'), ('C'), ('D')) c(class) LEFT JOIN (SELECT * FROM k WHERE origin_type = 'scanned_image') k ON k.class = c.class GROUP BY 1),
    g AS (SELECT CASE WHEN {_HAS(triage.TECHNICAL_NAMES)} THEN 'C' WHEN {_HAS(triage.FISCAL_NAMES)} THEN 'D' WHEN {_HAS(triage.ANNUAL_NAMES)} THEN 'A' END class, document_id, source_filename FROM p WHERE coalesce(origin_type, '') <> 'scanned_image')
    SELECT n.class, needed::bigint needed, document_id, source_filename FROM n LEFT JOIN g ON g.class = n.class WHERE needed > 0"""
)
def coverage_candidates(spark: SparkSession, d: str) -> DataFrame:
    """As if only the scanned documents were profiled yet: which others may fill the classes that lack documents."""
    p = _profiles(spark, d)
    return triage.gap_candidates(p.where("origin_type = 'scanned_image'"), p)


_TRIES = f"""{_PAGES}, o AS (SELECT DISTINCT ON (box_id) document_id, page_number, text, confidence FROM ocr_boxes WHERE box_id IS NOT NULL),
  tries AS (SELECT document_id, page_number, 'fast_text' strategy, length(text) n_chars FROM p UNION ALL SELECT document_id, page_number, 'ocr_heavy', sum(coalesce(length(text), 0)) FROM o GROUP BY 1, 2)"""


def _tries(spark: SparkSession, d: str) -> DataFrame:
    a = _pages(spark, d).select("document_id", "page_number", F.lit("fast_text").alias("strategy"), F.col("n_chars").cast("long").alias("n_chars"))
    o = reconstruct.boxes_once(table(spark, d, "ocr_boxes")).groupBy("document_id", "page_number").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    return a.unionByName(o.select("document_id", "page_number", F.lit("ocr_heavy").alias("strategy"), "n_chars"))


@query(f"WITH {_TRIES} SELECT DISTINCT ON (document_id, page_number) document_id, page_number, strategy, n_chars::bigint n_chars FROM tries ORDER BY document_id, page_number, n_chars DESC, strategy = 'ocr_heavy'")
def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    return triage.merge_pages(_tries(spark, d))


def _escalation_sql(budget: float = 0.5) -> str:
    """Four steps, one for each way; vision isn't allowed."""
    least, cost = "CASE tier WHEN 'fast_text' THEN 0.6 WHEN 'layout_aware' THEN 0.5 WHEN 'ocr_heavy' THEN 0.4 ELSE 0.0 END", "CASE tier WHEN 'layout_aware' THEN 0.01 WHEN 'ocr_heavy' THEN 0.05 WHEN 'vision_augmented' THEN 0.1 ELSE 0.0 END"
    steps = []
    for k in range(4):
        steps.append(f"""at{k} AS (SELECT *, {least} least, tier IN ('ocr_heavy', 'vision_augmented') AND cost >= {budget} blocked FROM (SELECT document_id, chain[{k + 1}] tier, cost, narrowed FROM ch JOIN s{k} USING (document_id) WHERE len(chain) > {k} AND going) WHERE tier <> 'vision_augmented'),
  y{k} AS (SELECT g.*, a.tier, a.least, t.n_chars nc, t.page_confidence npc, t.doc_confidence dc, a.tier IS NOT NULL AND NOT coalesce(blocked, false) AND todo AND t.doc_confidence IS NOT NULL gave FROM g{k} g LEFT JOIN at{k} a USING (document_id) LEFT JOIN tr t ON t.document_id = g.document_id AND t.strategy = a.tier AND t.page_number = g.page_number),
  x{k} AS (SELECT *, n_chars IS NOT NULL AND (n_chars < 50 OR (page_confidence > 0 AND page_confidence < least)) weak FROM (SELECT document_id, page_number, todo, tier, least, dc, gave, CASE WHEN better THEN coalesce(nc, 0) ELSE n_chars END n_chars, CASE WHEN better THEN npc ELSE page_confidence END page_confidence
    FROM (SELECT *, gave AND (n_chars IS NULL OR coalesce(nc, 0) > n_chars) better FROM y{k}))),
  d{k} AS (SELECT *, more AND n_weak > 0 narrow FROM (SELECT *, NOT blocked AND sure < least more FROM (SELECT a.*, coalesce(n_pages, 0) n_pages, coalesce(n_weak, 0) n_weak, CASE WHEN blocked THEN 0.0 ELSE coalesce(conf, 0.0) END sure FROM at{k} a
    LEFT JOIN (SELECT document_id, sum(gave::int) n_pages, sum(weak::int) n_weak, max(dc) FILTER (gave) conf FROM x{k} GROUP BY 1) USING (document_id)))),
  e{k} AS (SELECT {k} depth, d.*, sc.page_scope FROM d{k} d LEFT JOIN (SELECT document_id, list(DISTINCT page_number ORDER BY page_number) page_scope FROM x{k} JOIN (SELECT document_id, narrow FROM d{k} WHERE narrow OR narrowed) USING (document_id) WHERE CASE WHEN narrow THEN weak ELSE todo END GROUP BY 1) sc USING (document_id)),
  s{k + 1} AS (SELECT s.document_id, round(s.cost + coalesce(CASE WHEN d.blocked THEN 0.0 ELSE {cost} * greatest(n_pages, 1) END, 0), 6) cost, coalesce(d.more OR d.blocked, s.going) going, coalesce(d.narrowed OR d.narrow, s.narrowed) narrowed FROM s{k} s LEFT JOIN d{k} d USING (document_id)),
  g{k + 1} AS (SELECT x.document_id, page_number, CASE WHEN coalesce(narrow, false) THEN weak ELSE todo END todo, n_chars, page_confidence FROM x{k} x LEFT JOIN d{k} USING (document_id))""")
    lists = "['layout_aware', 'ocr_heavy', 'vision_augmented']"
    return f"""WITH {_PAGES}, {_PROFILES.replace("p AS (", "pr AS (", 1).replace("FROM p)", "FROM pr)")}, {_SIGNALS},
  ch AS (SELECT document_id, CASE WHEN origin_type = 'scanned_image' THEN ['ocr_heavy', 'vision_augmented'] WHEN origin_type = 'mixed' OR cost = 'needs_layout_model' OR layout_complexity IN ('table_heavy', 'figure_heavy', 'multi_column') THEN {lists} ELSE list_prepend('fast_text', {lists}) END chain FROM k),
  oc AS (SELECT document_id, page_number, sum(length(text)) n_chars, (sum(confidence::decimal(20,6)) / count(*))::double page_confidence FROM (SELECT DISTINCT ON (box_id) * FROM ocr_boxes WHERE box_id IS NOT NULL) GROUP BY 1, 2),
  tr AS (SELECT document_id, 'fast_text' strategy, page_number, length(text) n_chars, {_PAGE_SURE} page_confidence, round_even(0.6 * least(chars / area / 0.02, 1.0) + 0.4 * greatest(0.0, 1 - images / area / 0.5), 4)::double doc_confidence FROM p JOIN signals USING (document_id)
    UNION ALL SELECT document_id, 'ocr_heavy', page_number, n_chars, page_confidence, round_even(least((coalesce(s, 0) / n)::double, 1.0), 4)::double FROM oc JOIN ocr USING (document_id)),
  g0 AS (SELECT document_id, page_number, true todo, NULL::bigint n_chars, NULL::double page_confidence FROM p), s0 AS (SELECT document_id, 0.0::double cost, true going, false narrowed FROM ch),
  {", ".join(steps)}, e AS ({" UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(4))})
  SELECT document_id, depth, tier strategy_used, n_pages::bigint n_pages, sure::double confidence_score, CASE tier WHEN 'fast_text' THEN 'low' WHEN 'layout_aware' THEN 'medium' WHEN 'ocr_heavy' THEN 'high' ELSE 'extreme' END cost_estimate, array_to_string(page_scope, ',') page_scope,
    CASE WHEN blocked THEN 'budget_exhausted (' || printf('%.2f', cost) || ')' END failure_reason, more escalation_triggered, CASE WHEN narrow THEN 'page-level escalation: ' || n_weak || ' pages below ' || least::double || ' confidence' WHEN more THEN 'confidence ' || printf('%.4f', sure) || ' < ' || least::double END escalation_reason, sure < 0.4 flagged_for_review FROM e"""


@query(_escalation_sql())
def escalation(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of all documents, of text and of recognised lines as the ways there are; a layout model isn't here, and gives nothing."""
    area = F.col("width") * F.col("height")
    pages = cut(_sure_pages(spark, d))
    total = pages.groupBy("document_id").agg(F.sum("n_chars").alias("c"), F.sum(area).alias("a"), F.sum(F.col("image_area").cast("decimal(20,6)")).cast("double").alias("i"))
    total = total.select("document_id", F.bround(reconstruct.fast_text_confidence(F.col("c") / F.col("a"), F.col("i") / F.col("a")), 4).alias("doc_confidence"))
    boxes = cut(reconstruct.boxes_once(table(spark, d, "ocr_boxes")).groupBy("document_id", "page_number").agg(F.sum(F.length("text")).alias("n_chars"), F.sum(F.col("confidence").cast("decimal(20,6)")).alias("s"), F.count("*").alias("n")))
    sure = boxes.groupBy("document_id").agg(reconstruct.ocr_confidence(F.sum("s").cast("double"), F.sum("n")).alias("doc_confidence"))
    tries = pages.join(total, "document_id").select("document_id", F.lit("fast_text").alias("strategy"), "page_number", F.col("n_chars").cast("long").alias("n_chars"), "page_confidence", "doc_confidence")
    tries = tries.unionByName(boxes.join(sure, "document_id").select("document_id", F.lit("ocr_heavy").alias("strategy"), "page_number", "n_chars", (F.col("s") / F.col("n")).cast("double").alias("page_confidence"), "doc_confidence"))
    chains = _profiles(spark, d).select("document_id", triage.chain("origin_type", "layout_complexity", triage.cost("origin_type", "layout_complexity")).alias("chain"))
    ledger, _ = triage.escalate(pages, chains, tries.withColumn("error", F.lit(None).cast("string")))
    return ledger.drop("fallback_trigger").withColumn("page_scope", F.array_join("page_scope", ","))


# Recognised boxes.

_BOXES = "o AS (SELECT DISTINCT ON (box_id) * FROM ocr_boxes WHERE box_id IS NOT NULL)"
_NORM = f"lower(regexp_replace({T.sql_strip('text')}, '{B}+', ' ', 'g'))"


@query(f"WITH {_BOXES} SELECT DISTINCT ON (document_id, page_number, norm) box_id, text FROM (SELECT *, {_NORM} norm FROM o) WHERE norm <> '' ORDER BY document_id, page_number, norm, idx, box_id")
def distinct_boxes(spark: SparkSession, d: str) -> DataFrame:
    return reconstruct.distinct_boxes(reconstruct.boxes_once(table(spark, d, "ocr_boxes"))).select("box_id", "text")


_ROW = "CASE WHEN abs(x.y - a.y) > x.t THEN {'y': x.y, 't': x.t, 'r': a.r + 1, 's': list_append(a.s, a.r + 1)} ELSE {'y': a.y, 't': a.t, 'r': a.r, 's': list_append(a.s, a.r)} END"


@query(
    f"""WITH {_BOXES}, w AS (SELECT *, (y1 + y2) / 2 yc, greatest(8.0, 0.012 * page_height) tol FROM o WHERE {T.sql_strip("coalesce(text, '')")} <> ''),
    l AS (SELECT document_id, page_number, list({{'b': box_id, 'y': yc, 't': tol}} ORDER BY yc, idx, box_id) bs FROM w GROUP BY 1, 2),
    f AS (SELECT document_id, page_number, bs, (list_reduce([{{'y': q.y, 't': q.t, 'r': 1, 's': [1]}} FOR q IN bs], lambda a, x: {_ROW})).s rs FROM l),
    u AS (SELECT unnest(bs).b box_id, unnest(rs) r FROM f), j AS (SELECT w.*, r FROM w JOIN u USING (box_id)),
    g AS (SELECT document_id, page_number, r, list({{'text': {T.sql_strip('text')}, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY (x1 + x2) / 2, idx, box_id) bs FROM j GROUP BY 1, 2, 3),
    s AS (SELECT document_id, page_number, r, CASE WHEN len(bs) = 2 AND bs[2].x1 - bs[1].x2 < 20 THEN [[bs[1]], [bs[2]]] ELSE [bs] END ps FROM g), t AS (SELECT document_id, page_number, r, unnest(ps) p, generate_subscripts(ps, 1) part FROM s)
    SELECT document_id, page_number, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY r, part))::int row_no, array_to_string([q.text FOR q IN p], ' | ') text, len(p)::int n_boxes,
      list_min([q.x1 FOR q IN p]) x1, list_min([q.y1 FOR q IN p]) y1, list_max([q.x2 FOR q IN p]) x2, list_max([q.y2 FOR q IN p]) y2 FROM t"""
)
def rows_of_boxes(spark: SparkSession, d: str) -> DataFrame:
    return reconstruct.rows(reconstruct.boxes_once(table(spark, d, "ocr_boxes")))


@query(
    f"""WITH {_BOXES}, p AS (SELECT document_id, page_number, sum(confidence::decimal(20,6)) s, count(*) n FROM o GROUP BY 1, 2)
    SELECT document_id, page_number, round((coalesce(sum(s) OVER w, 0) / sum(n) OVER w)::double, 6) confidence FROM p WINDOW w AS (PARTITION BY document_id ORDER BY page_number)"""
)
def running_confidence(spark: SparkSession, d: str) -> DataFrame:
    b = reconstruct.boxes_once(table(spark, d, "ocr_boxes")).withColumn("confidence", F.col("confidence").cast("decimal(20,6)"))
    return reconstruct.running_confidence(b).select("document_id", "page_number", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


_THIRD = "(page_count // 3)"
_SAMPLED = f"""CASE WHEN page_count <= 0 THEN [] WHEN page_count <= 5 THEN range(1, page_count + 1) ELSE list_concat(list_concat([1], [{_THIRD} + 1 + i * greatest(1, {_THIRD} // 3) FOR i IN range(0, least(3, {_THIRD}))]), [2 * {_THIRD} + 1])[1:5] END"""
_UNIFORM = "CASE WHEN page_count <= 0 THEN [] WHEN page_count <= 4 THEN range(1, page_count + 1) ELSE list_sort(list_distinct([(round_even(i * (page_count - 1) / 3, 0) + 1)::bigint FOR i IN range(0, 4)])) END"


@query(
    f"""WITH p AS (SELECT DISTINCT document_id, coalesce(page_count, 0)::bigint page_count FROM profiles WHERE document_id IS NOT NULL), s AS (SELECT document_id, unnest(['thirds', 'uniform', 'head']) strategy, unnest([{_SAMPLED}, {_UNIFORM}, range(1, least(page_count, 3) + 1)]) pages FROM p)
    SELECT document_id, strategy, unnest(pages)::int page_number FROM s"""
)
def sampled_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _profiles(spark, d)
    ways = F.array(*(F.struct(F.lit(w).alias("strategy"), sampling.clamp(sampling.sampled("page_count", n, w), "page_count").alias("pages")) for w, n in (("thirds", 5), ("uniform", 4), ("head", 3))))
    return p.select("document_id", F.explode(ways).alias("w")).select("document_id", "w.strategy", F.explode("w.pages").alias("page_number"))


# Vectors. A query vector is the first stored one.

_Q = "q AS (SELECT embedding e FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"WITH {_Q} SELECT vec_id, round(1 - list_cosine_similarity(embedding::double[], e::double[]), 6) distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::double[], e::double[]), vec_id LIMIT 10")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").select("embedding").first()
    return vectors.nearest(v, list(q.embedding) if q else [0.0], 10, "vec_id").withColumn("distance", F.round("distance", 6))


@query(f"WITH {_Q} SELECT vec_id, round(1 - list_cosine_similarity(embedding::double[], e::double[]), 6) distance FROM embeddings, q WHERE label = 1 ORDER BY 1 - list_cosine_similarity(embedding::double[], e::double[]), vec_id LIMIT 10")
def nearest_in_label(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").select("embedding").first()
    return vectors.nearest(v.where(vectors.metadata({"$and": [{"label": 1}]})), list(q.embedding) if q else [0.0], 10, "vec_id").withColumn("distance", F.round("distance", 6))


@query(
    """WITH s AS (SELECT q.vec_id query_id, v.vec_id id, 1 - list_cosine_similarity(v.embedding::double[], q.embedding::double[]) distance FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) place FROM s) SELECT query_id, id, round(distance, 6) distance, place::int place FROM r WHERE place <= 5"""
)
def nearest_to_each(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("id", F.col("vec_id"))
    q = v.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id"))
    return vectors.nearest_to_each(v, q, 5).withColumn("distance", F.round("distance", 6))


_EACH = "WITH s AS (SELECT q.vec_id query_id, v.vec_id id, q.label ql, v.label vl, 1 - list_cosine_similarity(v.embedding::double[], q.embedding::double[]) distance FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 {0}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) place FROM s)"


@query(_EACH.format("AND q.label = v.label") + " SELECT query_id, id, round(distance, 6) distance, place::int place FROM r WHERE place <= 5")
def nearest_in_own_label(spark: SparkSession, d: str) -> DataFrame:
    """The search with a filter of metadata, for every query: among the vectors of its own label."""
    v = table(spark, d, "embeddings").withColumn("id", F.col("vec_id"))
    return vectors.nearest_to_each(v, v.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id")), 5, within="label").withColumn("distance", F.round("distance", 6))


@query(_EACH.format("") + " SELECT query_id, id, round(distance, 6) distance, place::int place FROM r WHERE place <= 5 AND ql = vl")
def nearest_then_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The search over all vectors, and only then the filter: fewer rows than were asked for, or none."""
    v = table(spark, d, "embeddings").withColumn("id", F.col("vec_id"))
    near = vectors.nearest_to_each(v, v.where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id")), 5)
    label = v.select("id", "label")
    x = near.join(label, "id").join(label.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id").where("label = own")
    return x.select("query_id", "id", F.round("distance", 6).alias("distance"), "place")


@query(f"WITH c AS (SELECT DISTINCT chunk_id, document_id, content FROM chunks WHERE content IS NOT NULL), {_QUESTIONS} SELECT question_id, chunk_id, round({T.sql_overlap('question', 'content')}, 6)::double score FROM c JOIN questions USING (document_id)")
def overlap_score(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("content IS NOT NULL").select("chunk_id", "document_id", "content").distinct()
    return c.join(_questions(spark, d), "document_id").select("question_id", "chunk_id", F.round(T.overlap("question", "content"), 6).alias("score"))


# Answers and audits.


def _evidence(spark: SparkSession, d: str, audit: bool = False, plain: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, chunks and evidence from the sections, chunks, facts and the whole graph."""
    q, c, f = cut(_questions(spark, d)), _chunks(spark, d), _facts(spark, d)
    found = None if plain else cut(entities.on_pages(entities.names(c, f)))  # for the graph and the hints
    e = None if plain else entities.graph(f, c, found)
    s = None if audit or plain else sections.choose_sections(_nodes(c), q)
    n = None if audit or plain else entities.entities(None, found=found.where("entity_type IN ('organization', 'date')"))
    return q, c, answers.evidence(q, c, f, e, s, n, audit, plain)


def _evidence_sql(audit: bool, plain: bool = False) -> str:
    numeric = "true" if audit else "(" + " OR ".join("contains(lower(question), '" + w + "')" for w in answers.NUMERIC) + ")"
    found = " UNION ALL ".join(f"SELECT document_id, {PAGE} page, '{k}' entity_type, unnest({x}) w FROM a" for k, x in _FOUND.items())
    over = lambda c: T.sql_overlap("question", c)
    hit = lambda c, h: f"({h} IS NULL OR contains(lower(coalesce({c}, '')), lower({h})))"
    fact = "SELECT question_id, question, 2 source_no, row_number() OVER (PARTITION BY question_id ORDER BY {o}) ord, content, page_ref page_number, content_hash FROM fq WHERE {w}"
    if audit:
        facts_ = fact.format(o="fact_id", w=f"{over('content')} >= 0.2")
    elif plain:
        facts_ = fact.format(o="fact_id", w="true")
    else:
        text = over("concat_ws(' ', key, \"value\", entity, metric)")
        facts_ = "SELECT * FROM (" + fact.format(o=f"{text} DESC, fact_id", w=f"{text} > 0 AND {hit('entity', 'entity_hint')} AND {hit('period', 'period_hint')}") + ") WHERE ord <= 10"
    parts = [f"""SELECT question_id, question, source_no, ord, content, page_number, content_hash FROM (SELECT question_id, question, 1 source_no, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ldu_idx, content) ord, content, page_number, content_hash, score
      FROM (SELECT question_id, question, ldu_idx, content, page_number, content_hash, {over('content')} score FROM c JOIN questions USING (document_id)) WHERE score > 0) WHERE ord <= {10 if audit else 5}{' AND score >= 0.3' if audit else ''}""", facts_]
    if not plain:
        written = "txt" if audit else "'[KG] ' || source || ' → ' || relation || ' → ' || target"
        parts.append(f"""SELECT * FROM (SELECT question_id, question, 3 source_no, row_number() OVER (PARTITION BY question_id ORDER BY kind, page_ref, source, relation, target) ord, {written} content, page_ref page_number, NULL content_hash
      FROM (SELECT *, concat_ws(' ', source, relation, target) txt FROM edges JOIN questions USING (document_id)) WHERE {over('txt')} >= 0.25){'' if audit else ' WHERE ord <= 5'}""")
    if not audit and not plain:
        parts.append("SELECT question_id, question, 0, place, '[Section: ' || title || '] ' || summary, page_start, NULL FROM chosen JOIN questions USING (question_id)")
    return f"""{_NAMED_NODES}, {_QUESTIONS}, {_CHOSEN}, a AS (SELECT document_id, ldu_idx, chunk_id, chunk_type, content, page_refs FROM c),
  m AS ({found}), named AS (SELECT document_id, page, entity_type, {_COMMON('w')} entity_name FROM m), {_EVERY_CTES}, {_GRAPH_CTES},
  en AS (SELECT document_id, entity_type, entity_name, min(page) first_page FROM every WHERE entity_type IN ('organization', 'date') GROUP BY 1, 2, 3),
  hn AS (SELECT question_id, arg_max(entity_name, (coalesce(first_page, -1), entity_name)) FILTER (entity_type = 'organization') eh, arg_max(entity_name, (coalesce(first_page, -1), entity_name)) FILTER (entity_type = 'date') dh
    FROM en JOIN questions USING (document_id) WHERE contains(lower(question), lower(entity_name)) GROUP BY 1),
  hints AS (SELECT question_id, eh entity_hint, coalesce(dh, nullif(trim(regexp_extract({T.sql_ascii_words('question')}, '{answers.PERIOD}')), '')) period_hint FROM questions LEFT JOIN hn USING (question_id)),
  fq AS (SELECT *, key || ': ' || "value" content FROM (SELECT DISTINCT ON (fact_id) * FROM facts WHERE fact_id IS NOT NULL) JOIN questions USING (document_id) JOIN hints USING (question_id) WHERE {numeric} AND key || "value" IS NOT NULL),
  evidence AS (SELECT question_id, source_no, ord, content, page_number, content_hash, {over('content')} score FROM ({" UNION ALL ".join(f"({p})" for p in parts)})),
  cites AS (SELECT question_id, page_number, arg_min(content_hash, source_no * 1000000 + ord) content_hash, min(source_no * 1000000 + ord) f FROM evidence WHERE page_number IS NOT NULL GROUP BY 1, 2)"""


@query(_evidence_sql(False) + " SELECT question_id, source_no, ord::int ord, content, page_number, round(score, 6)::double score FROM evidence")
def answer_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d)[2].select("question_id", "source_no", "ord", "content", "page_number", F.round("score", 6).alias("score"))


_ANSWERS = """, b AS (SELECT question_id, content, max(score) score, min(source_no * 1000000 + ord) f FROM evidence WHERE content <> '' GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, f) place FROM b),
    t AS (SELECT question_id, string_agg(content, ' ' ORDER BY place) answer FROM p WHERE place <= 3 GROUP BY 1), nc AS (SELECT question_id, count(*) n FROM cites GROUP BY 1),
    tools AS (SELECT question_id, string_agg(['pageindex_navigate', 'semantic_search', 'structured_query', 'knowledge_graph'][source_no + 1], ',' ORDER BY source_no) tools_used FROM (SELECT DISTINCT question_id, source_no FROM evidence) GROUP BY 1)
    SELECT question_id, coalesce(answer, 'No relevant information found in the document.') answer, coalesce(n, 0) n_citations, round(least(1.0, 0.2 * coalesce(n, 0)), 6)::double confidence, coalesce(n, 0) > 0 verified, coalesce(tools_used, '') tools_used
    FROM questions LEFT JOIN t USING (question_id) LEFT JOIN nc USING (question_id) LEFT JOIN tools USING (question_id)"""


@query(_evidence_sql(False) + _ANSWERS)
def answers_to_questions(spark: SparkSession, d: str) -> DataFrame:
    q, _, found = _evidence(spark, d)
    return answers.answers(q, cut(found))


@query(_evidence_sql(False, plain=True) + _ANSWERS)
def answers_step_by_step(spark: SparkSession, d: str) -> DataFrame:
    """The plan that retrieves, looks up and composes, without hints, ranking of facts, sections or graph."""
    q, _, found = _evidence(spark, d, plain=True)
    return answers.answers(q, cut(found))


@query(_evidence_sql(False) + " SELECT question_id, page_number, row_number() OVER (PARTITION BY question_id ORDER BY f, page_number)::int place FROM cites")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return answers.citations(_evidence(spark, d)[2]).select("question_id", "page_number", "place")


@query(
    _evidence_sql(True)
    + f""" SELECT question_id, CASE WHEN coalesce(n, 0) > 0 THEN 'verified' WHEN question_id IN (SELECT question_id FROM c JOIN questions USING (document_id) WHERE {T.sql_overlap('question', 'content')} > 0) THEN 'unverifiable' ELSE 'not_found' END status, coalesce(n, 0) n_evidence
    FROM questions LEFT JOIN (SELECT question_id, count(*) n FROM evidence GROUP BY 1) USING (question_id)"""
)
def audit_status(spark: SparkSession, d: str) -> DataFrame:
    q, c, found = _evidence(spark, d, audit=True)
    return answers.audits(q, found, c)


# Stored tables and logs.


@query("SELECT DISTINCT ON (document_id, action) document_id, action, ledger_id, event_time FROM provenance_ledger WHERE document_id IS NOT NULL ORDER BY document_id, action, event_time DESC, ledger_id DESC")
def latest_actions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "provenance_ledger").where("document_id IS NOT NULL").select("document_id", "action", "ledger_id", "event_time")
    return store.latest(x, ["document_id", "action"], ["event_time", "ledger_id"])


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return store.recent(table(spark, d, "events").select("event_id", "ts", "event_type"), "ts", "event_id", 20)


@query("SELECT DISTINCT document_id, source_filename, processing_timestamp FROM profiles WHERE document_id IS NOT NULL")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profiles").where("document_id IS NOT NULL").select("document_id", "source_filename", "processing_timestamp").distinct().orderBy(F.desc("processing_timestamp"), "document_id")


@query("SELECT date_trunc('hour', ts) window_start, event_type, count(*) n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.counts(table(spark, d, "events"), "ts", "event_type")

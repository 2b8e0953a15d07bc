import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking

TEXTS = st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_text_primitives_agree_with_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", T.strip("t").alias("s"), T.tokens("t").alias("k"), T.content_hash("t").alias("h")).collect():
        t = texts[r.i]
        assert r.s == t.strip() and r.k == t.split()
        assert r.h == hashlib.sha256(t.strip().encode()).hexdigest()


def test_title_overlap_sentences(spark):
    r = spark.sql("SELECT 'cash-flow o’neil été 3rd' a, 'What is the net income?' q, 'Net INCOME rose' b, cast(null as string) z").select(
        T.title("a").alias("t"), T.overlap("q", "b").alias("o"), T.overlap("z", "b").alias("n"), T.overlap("b", "z").alias("m"), T.first_sentences(F.lit("One. Two! Three? Four."), 3).alias("s"), T.first_sentences(F.lit("no end"), 3).alias("e")
    ).first()
    assert r.t == "Cash-Flow O’Neil Été 3Rd" and abs(r.o - 2 / 3) < 1e-9
    assert r.s == "One. Two! Three?" and r.e == "no end."
    assert r.n == 0.0


def test_windows(spark):
    counts = [0, 1, 512, 513, 960, 961, 1000, 1856]
    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in counts] + [(-1, None)], "n int, t string")
    got = {}
    for r in chunking.windows(df, "n", "t").orderBy("n", "window_no").collect():
        got.setdefault(r.n, []).append(r.token_count)
    assert got == {1: [1], 512: [512], 513: [512, 65], 960: [512, 512], 961: [512, 512, 65], 1000: [512, 512, 104], 1856: [512, 512, 512, 512]}


def pack(items, size):
    done, open_, n = [], "", 0
    for i in items:
        k = len(i.split())
        if n and n + k > size:
            done.append(open_)
            open_, n = "", 0
        open_ = f"{open_}\n{i}" if n else i
        n += k
    return done + [open_]


def test_list_packing_is_greedy(spark):
    items = [f"{i}. " + "w " * k for i, k in enumerate((2, 1, 0, 6, 1, 1, 9), 1)]
    text = "\n".join(items)
    df = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "- one")], "k int, t string")
    rows = chunking.pack_list(df, "k", "t", 5).orderBy("k", "pack_no").collect()
    assert [r.content for r in rows if r.k == 1] == pack([i.strip() for i in items], 5)
    assert [r.content for r in rows if r.k == 4] == ["- one"] and not [r for r in rows if r.k in (2, 3)]


def test_detection(spark):
    cases = {"1. a\n2. b": (True, False), "- a\nb": (False, False), "Financial Overview": (False, True), "2.1 Debt Service": (False, True), "Revenue grew strongly.": (False, False), "NOTES": (False, True), "": (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: (r.l, r.h) for r in df.select("t", chunking.is_list("t").alias("l"), chunking.is_heading("t").alias("h")).collect()} == cases
    x = spark.sql("SELECT 'as shown in Table 3. See also Figure 2, see fig. 4.1; per NOTE 7' t").select(chunking.references("t").alias("r")).first().r
    assert [tuple(i) for i in x] == [("table", "Table 3"), ("figure", "fig. 4.1"), ("note", "NOTE 7")]


BLOCK = "block_id string, document_id string, page_number int, kind string, idx int, content string, headers array<string>, rows array<array<string>>, caption string, figure_type string, bucket string"


def test_subgroups(spark):
    t = lambda i, rows: (i, "d", 1, "table", 0, None, None, rows, None, None, "clash")
    df = spark.createDataFrame(
        [t("a", [["Assets", "-", "-"], ["x", "1", "2"], ["y", "1", "2"], ["Liabilities", "", None], ["z", "3", "4"], ["q", "3", "4"]]), t("b", [["Assets", "-"], ["x", "1"], ["y", "2"]]), t("c", None), t("d", [["x", "1"], ["Assets", ""], ["Other Assets", ""], ["y", "2"], ["Last Part", "-"]])], BLOCK
    )
    got = {}
    for r in chunking.subgroups(df.unionByName(df)).orderBy("block_id", "group_no").collect():
        got.setdefault(r.block_id, []).append((r.label, len(r.rows)))
    assert got == {"a": [("Assets", 2), ("Liabilities", 2)], "b": [(None, 3)], "c": [(None, 0)], "d": [(None, 1), ("Other Assets", 1)]}


def test_chunks_of_blocks_carry_headings_across_pages(spark):
    x = lambda i, p, k, n, c=None, h=None, r=None, cap=None: (i, "d", p, k, n, c, h, r, cap, "chart" if k == "figure" else None, "clash")
    df = spark.createDataFrame(
        [x("1", 1, "text", 0, "Financial Overview"), x("2", 1, "text", 1, "Profit rose by ten."), x("3", 1, "table", 2, None, ["Year", "Profit"], [["2020", None]], "T"), x("4", 20, "text", 0, "1. a b c d e f g h i j k\n2. b."), x("5", 20, "text", 1, "  "), x("6", 40, "text", 0, "Risk"), x("7", 40, "figure", 3), x("8", 41, "text", 0, None)], BLOCK
    )
    got = [(r.ldu_idx, r.block_id, r.chunk_type, r.parent_section, r.content) for r in chunking.chunk_blocks(df.unionByName(df)).orderBy("ldu_idx").collect()]
    assert got == [
        (0, "1", "section", "Financial Overview", "Financial Overview"),
        (1, "2", "paragraph", "Financial Overview", "Profit rose by ten."),
        (2, "3", "table", "Financial Overview", "Caption: T\nYear | Profit\n--- | ---\n2020 | "),
        (3, "4", "list", "Financial Overview", "1. a b c d e f g h i j k\n2. b."),
        (4, "6", "section", "Risk", "Risk"),
        (5, "7", "figure", "Risk", "[CHART] (no caption)"),
    ]
    assert chunking.chunk_blocks(df.limit(0)).count() == 0


def test_long_texts_lists_and_tables_are_cut(spark, monkeypatch):
    """Windows of a long paragraph, packs of a long list, groups of a table; references of each part."""
    words = [f"w{i}" for i in range(1000)]
    words[600:603] = ["see", "Table", "7"]
    items = [f"{i}. " + " ".join([f"item{i}"] * 60) for i in range(1, 30)]
    x = lambda i, p, k, n, c=None, h=None, r=None, cap=None: (i, "d", p, k, n, c, h, r, cap, None, None)
    table = [["All", "1"], ["Assets", "-"], ["loans", "2"], ["cash", "3"], ["Liabilities", None], ["deposits", "4"]]
    df = spark.createDataFrame([x("1", 1, "text", 0, " ".join(words)), x("2", 1, "text", 1, "\n".join(items)), x("3", 1, "table", 2, None, ["Item", "Amount"], table, "C"), x("4", 2, "table", 0, None, ["A"], [["see Note 3"]])], BLOCK)
    got = chunking.chunk_blocks(df).orderBy("ldu_idx").collect()
    assert [r.ldu_idx for r in got] == list(range(len(got)))
    para = [r for r in got if r.block_id == "1"]
    assert [r.content for r in para] == [" ".join(words[a : a + 512]) for a in (0, 448, 896)] and [r.token_count for r in para] == [512, 512, 104]
    assert [[tuple(c) for c in r.cross_references] for r in para] == [[], [("table", "Table 7")], []]
    packs = [r for r in got if r.block_id == "2"]
    assert [r.content for r in packs] == pack(items, 512) and len(packs) > 2 and all(r.chunk_type == "list" and r.token_count <= 512 for r in packs)
    head = "Caption: C\nItem | Amount\n--- | ---\n"
    groups = [(r.content, r.subgroup_label, r.table_id, r.parent_table_id, r.cross_references) for r in got if r.block_id == "3"]
    assert groups == [
        (head + "All | 1", None, "Table_1", "Table_1", None),
        ("[Subgroup: Assets]\n" + head + "loans | 2\ncash | 3", "Assets", "Table_1", "Table_1", None),
        ("[Subgroup: Liabilities]\n" + head + "deposits | 4", "Liabilities", "Table_1", "Table_1", None),
    ]
    last = got[-1]
    assert last.table_id == "Table_2" and last.parent_table_id is None and [tuple(c) for c in last.cross_references] == [("note", "Note 3")]
    assert {r.chunk_type for r in got if r.token_count > chunking.MAX_TOKENS} == set()


def test_violations(spark, rows):
    h = hashlib.sha256(b"ok").hexdigest()
    long = "w " * 600
    df = spark.createDataFrame(
        [("a", "ok", "paragraph", h, [1]), ("b", "ok", "paragraph", h.upper(), [1]), ("c", " ", "paragraph", None, [1]), ("d", long, "table", hashlib.sha256(long.strip().encode()).hexdigest(), [1]), ("e", long, "list", hashlib.sha256(long.strip().encode()).hexdigest(), []), ("f", None, None, None, None), ("a", "ok", "paragraph", h, [1])],
        "chunk_id string, content string, chunk_type string, content_hash string, page_refs array<int>",
    )
    assert rows(chunking.violations(df)) == [("b", "hash"), ("c", "empty"), ("e", "no page"), ("e", "too long"), ("f", "empty"), ("f", "no page")]

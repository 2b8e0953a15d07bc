import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quire.llm import bloom, exact, lines, neardup

CHUNK = "chunk_id string, document_id string, content string, line string, n long, source string"
PROFILE = "document_id string, source string, rank int"


def key(line):
    return tuple(re.sub(r"\d+", "0", w) for w in re.findall(r"[^\W_]+", line.lower()))


def brute_lines(chunks, profiles):
    source = {d: s for d, s, _ in profiles if s is not None}
    docs, spans = defaultdict(set), defaultdict(set)
    each = []
    for c, d, text, *_ in set(chunks):
        if d not in source or c is None:
            continue
        docs[source[d]].add(d)
        for i, line in enumerate((text if text is not None else "").split("\n"), 1):
            if re.search(r"[^\W\d_]", line):
                spans[source[d], key(line)].add(d)
                each.append((c, i, source[d], key(line)))
    return sorted({(c, i) for c, i, s, k in each if len(spans[s, k]) >= 3 and len(spans[s, k]) >= 0.25 * len(docs[s])})


def test_lines_against_brute_force(spark, rows):
    r = random.Random(3)
    notices = ["© 2020 Press. All rights", "Page 7 helpful?", "See   NOTES", "—", "12", ""]
    chunks, profiles = [], []
    for d in range(60):
        s = r.choice(["a", "a", "a", "b", "c", None])
        if d % 9:
            profiles.append((f"d{d}", s, 1))
        for i in range(r.randint(0, 3)):
            body = [r.choice(notices).replace("7", str(r.randint(1, 99))) if r.random() < 0.5 else f"text {r.random()}x" for _ in range(r.randint(0, 6))]
            chunks.append((f"d{d}_{i}", f"d{d}", "\n".join(body), "clash", 1, "clash"))
    chunks += [("z", "d1", None, None, None, None), ("y", "gone", "See notes", None, None, None)]
    want = brute_lines(chunks, profiles)
    c = spark.createDataFrame(chunks + chunks[:9], CHUNK)
    p = spark.createDataFrame(profiles + profiles[:3], PROFILE)
    assert rows(lines.lines_to_remove(c, p)) == sorted(want, key=repr) and want
    kept = {x.chunk_id: x for x in lines.without_repeated_lines(c, p).collect()}
    gone = defaultdict(set)
    for k, i in want:
        gone[k].add(i)
    for k, _, text, *_ in chunks:
        expect = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in gone[k])
        assert kept[k].content == expect


def test_blocks_of_several_lines(spark):
    c = spark.createDataFrame([(f"d{i}_0", f"d{i}", f"own {i} words\nNotice one\nNotice two\nNotice three\nother {i}x", None, 1, None) for i in range(4)], CHUNK)
    c = c.selectExpr("chunk_id", "document_id", "regexp_replace(content, '[0-9]', '') || chunk_id AS content")
    p = spark.createDataFrame([(f"d{i}", "s", 1) for i in range(4)], PROFILE)
    # maximal blocks: the first line is the same in all without its number, and so is the last
    assert {(r.line_no, r.n_lines, r.n) for r in lines.repeated_blocks(c, p).collect()} == {(1, 5, 4)}
    assert lines.lines_to_remove(c.limit(0), p).count() == 0 and lines.lines_to_remove(c, p.limit(0)).count() == 0


def _blocks(df):
    return {(r.chunk_id, r.line_no, r.n_lines, r.n) for r in df.collect()}


def test_blocks_are_maximal_and_run_over_chunks(spark, monkeypatch):
    rows = []
    for i in "abcd":
        rows += [(f"{i}0", i, 0, f"own {i * 3}\nNotice one\nNotice two\nNotice three\nend {i * 2}"), (f"{i}1", i, 1, f"start {i * 4}\nShared one"), (f"{i}2", i, 2, f"Shared two\nrest {i * 5}")]
    rows += [("e0", "e", 0, "Notice two\n\nNotice three")]  # an empty line ends a block
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, ldu_idx long, content string").repartition(5)
    p = spark.createDataFrame([(i, "s", 1) for i in "abcde"], PROFILE)
    got = _blocks(lines.repeated_blocks(c, p))
    want = {(f"{i}{k}", line, n, 4) for i in "abcd" for k, line, n in ((0, 2, 3), (1, 2, 2), (2, 1, 1))} | {("e0", 1, 1, 5), ("e0", 3, 1, 5)}
    assert got == want
    removed = {tuple(r) for r in lines.lines_to_remove(c, p).collect()}
    assert removed == {(f"{i}{k}", line) for i in "abcd" for k, line in ((0, 2), (0, 3), (0, 4), (1, 2), (2, 1))} | {("e0", 1), ("e0", 3)}
    monkeypatch.setattr(lines, "BUCKET", 1)  # every chunk of a document is ordered by another task
    assert _blocks(lines.repeated_blocks(c, p)) == want


def test_the_rows_come_from_the_common_prefixes(spark, monkeypatch):
    rows = [(i, i, 0, f"Notice of {'xyz'[k % 3]}\nown {i * 9}") for k, i in enumerate("abcdefghi")]
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, ldu_idx long, content string").repartition(9)
    p = spark.createDataFrame([(i, "s", 1) for i in "abcdefghi"], PROFILE)
    assert lines.lines_to_remove(c, p).count() == 9
    plain = lines._Piece.__init__

    def without(self, batches):
        plain(self, batches)
        if self.n:
            self.common[:] = 0

    monkeypatch.setattr(lines._Piece, "__init__", without)
    pieces = [r for r in lines._chunks_in_order(c, p).collect()]
    assert len(pieces) == 9
    import pyarrow as pa

    table = lines._chunks_in_order(c, p).mapInArrow(lines._suffixes, lines._SUFFIX).toPandas().sort_values(["key", "doc"])
    batch = pa.RecordBatch.from_pandas(table, schema=pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("need", pa.int32()), ("chunk_id", pa.string()), ("line_no", pa.int32()), ("to_end", pa.int32())]), preserve_index=False)
    assert sum(b.num_rows for b in lines._blocks({})(iter([batch]))) == 0
    monkeypatch.undo()
    assert sum(b.num_rows for b in lines._blocks({})(iter([batch]))) > 0


FACT = "fact_id long, entity string, period string, unit string, key string, value string, hash string"


def plain(text, value):
    if text is None:
        return None
    out = []
    for p in re.split("[;|]", text.lower()):
        if value:
            p = re.sub(r"(?<=\d)\.(?=\d)", "⌘", p)
            p = re.sub(r"(?<![^\W_])-(?=\d)", "⌦", p)
        out.append("".join(c for c in p if c.isalnum() or (value and c in "⌘⌦%")))
    return tuple(sorted(x for x in out if x))


def test_copies_against_brute_force(spark, rows):
    r = random.Random(5)
    base = [("Audit Opinion", "unqualified; signed 9 June"), ("Fleet | Owned", "trucks 9 | pickups 4"), ("Net", "-1,234.5"), ("Net", "1234.5"), ("Net", "12345"), ("Rate (%)", "5%"), ("Rate", "5"), ("Lot", "LOT-9/9"), ("  ", "5"), ("x", "—"), (None, "5"), ("x", None)]
    facts = []
    for i in range(400):
        k, v = r.choice(base)
        for f in (str.upper, lambda s: f" {s}. ", lambda s: s.replace(" ", " "), lambda s: "; ".join(reversed(re.split(r"\s*[;|]\s*", s)))):
            if r.random() < 0.3:
                k, v = k and f(k), v and f(v)
        facts.append((i, r.choice(["A", "A", "B", None]), r.choice(["2020", None]), r.choice([None, "", "t"]), k, v, "clash"))
    groups = defaultdict(list)
    for i, e, p, u, k, v, _ in facts:
        kk, vv = plain(k, True), plain(v, True)
        if e is not None and kk and vv:
            groups[e, p, u or "", kk, vv].append(i)
    want = sorted(((min(g), x) for g in groups.values() for x in g if x != min(g)), key=repr)
    df = spark.createDataFrame(facts + facts[:20], FACT).repartition(5)
    assert rows(exact.copy_pairs(df)) == want and want
    single = [i for i, e, p, u, k, v, _ in facts if e is None or not plain(k, True) or not plain(v, True)]
    assert rows(exact.collapse(df)) == sorted([(min(g), len(g)) for g in groups.values()] + [(i, 1) for i in single], key=repr)
    assert exact.copy_pairs(df.limit(0)).count() == 0 and exact.collapse(df.limit(0)).count() == 0


def test_bloom_has_no_false_negatives(spark, monkeypatch):
    values = [i % 700 for i in range(1000)] + [None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i int").selectExpr("xxhash64(v) hash", "i", "v").withColumn("hash", F.expr("CASE WHEN v IS NOT NULL THEN hash END")).repartition(7)
    for segments, a_round in ((1, 8192), (4, 1), (8, 3)):
        monkeypatch.setattr(bloom, "ROUND", a_round)
        p = bloom.repeated_bits(df, segments)
        maybe, alone = bloom.possible_repeats(df, p, segments)
        a, b = {r.i for r in maybe.collect()}, {r.i for r in alone.collect()}
        assert a | b == set(range(1000)) and not a & b
        assert all(i in a for i in range(1000) if values.count(values[i]) > 1)
        assert len(b) > 300


def test_only_possible_repeats_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(bloom, "ROUND", 1)
    monkeypatch.setattr(bloom, "n_segments", lambda n: 4)
    data = [(i, "A", "2020", None, "k", str(i // 2 if i < 20 else i), "clash") for i in range(400)]
    df = spark.createDataFrame(data, FACT)
    assert {tuple(r) for r in exact.copy_pairs(df).collect()} == {(i, i + 1) for i in range(0, 20, 2)}
    maybe, alone, _, _ = exact._repeats(df)
    assert maybe.count() < 30 and maybe.count() + alone.count() == 400


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.randint(20, 60))]
        out.append((f"t{i:04d}", " ".join(w)))
    return out


def brute_pairs(rows, n, threshold, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= least:
            sets[i] = set(zip(*(w[k:] for k in range(n))))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("limit", [300, 6])
def test_near_copies_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "LIMIT", limit)
    data = texts(260, 7)
    data += [("copy1", data[0][1].upper() + "!"), ("copy2", data[0][1]), ("null", None), ("empty", ""), ("short", "one two"), (data[3][0], data[3][1])]
    want = brute_pairs(dict(data).items(), 3, 0.6, 25)
    df = spark.createDataFrame([(i, t, "clash") for i, t in data], "id string, text string, cls string").repartition(3)
    j = neardup.Join(df, n=3, threshold=0.6, least_words=25)
    got = {tuple(r) for r in j.pairs().collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 40
    report = {r.id: r for r in j.report().collect()}
    across = {tuple(r)[:2] for r in j.class_links().collect()}
    assert across == {(min(a, b), max(a, b)) for x, y in got for a, b in [(report[x].class_id, report[y].class_id)] if a != b}
    assert report["copy1"].class_id == report["copy2"].class_id == "copy1" and report["copy1"].class_size == 3 and "short" not in report


def test_a_large_class_is_a_star(spark, monkeypatch):
    monkeypatch.setattr(neardup, "STAR", 3)
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(f"a{i}", t) for i in range(6)] + [("b", t.replace("w39", "v"))], "id string, text string")
    got = {tuple(r) for r in neardup.Join(df, n=3, threshold=0.6, least_words=25).pairs().collect()}
    assert got == {("a0", f"a{i}") for i in range(1, 6)} | {("a0", "b")}
    assert neardup.Join(df.limit(0)).pairs().count() == 0


def test_dense_cluster_is_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIMIT", 4)
    monkeypatch.setattr(neardup, "LEVELS", 1)
    base = [f"w{i}" for i in range(60)]
    data = [(f"t{i:02d}", " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(30)]
    df = spark.createDataFrame(data, "id string, text string")
    got = {tuple(r) for r in neardup.Join(df, n=3, threshold=0.6, least_words=25).pairs().collect()}
    assert got == brute_pairs(data, 3, 0.6, 25)

import re
from collections import defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.vocabulary()).exists(), reason="needs the public vocabulary files")
DOC = "doc_id long, text string, ids string, k int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], DOC)


HARD = ["a" * 400 + " b", "x y\n\nz\n\n  The end" * 9, " " * 300, None, "", "ab're it's" * 60, "<|endoftext|> ok", "été 中文 ሰላም 😀 " * 20, "\n\n\n", "1 22 333" * 30]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 24), (40, 10), (7, 5)])
def test_chunks_stitch_to_the_whole(spark, chunk, overlap):
    enc = tokens.encoder(tokens.vocabulary())
    got = {r.doc_id: r.ids for r in tokens.encode(docs(spark, HARD), chunk=chunk, overlap=overlap).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(HARD)}
    n = {r.doc_id: r.n_tokens for r in tokens.encode(docs(spark, HARD), count_only=True, chunk=chunk, overlap=overlap).collect()}
    assert n == {i: len(x) for i, x in got.items()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'res \n\t1é.中"), max_size=90), min_size=1, max_size=8))
def test_round_trip(spark, texts):
    df = docs(spark, texts)
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, chunk=16, overlap=6)).collect()}
    assert back == dict(enumerate(texts))


def test_empty(spark):
    assert tokens.encode(docs(spark, ["x"]).limit(0)).count() == 0


def test_packing(spark):
    texts = [("word " * n) or None for n in [3, 70, 5, 12, 0, 30, 9, 9, 64, 200, 1] * 12]
    specs = spark.createDataFrame([(1, tokens.TOKENIZER, 64), (2, tokens.TOKENIZER, 16), (1, tokens.TOKENIZER, 64)], "spec_id int, tokenizer string, capacity int")
    df = docs(spark, texts).repartition(9)
    sizes = {r.doc_id: r.n_tokens for r in tokens.encode(df, count_only=True).collect()}
    placed = packing.pack(df, specs).collect()
    for spec, capacity in ((1, 64), (2, 16)):
        own = [r for r in placed if r.spec_id == spec]
        fill, parts = defaultdict(int), defaultdict(list)
        for r in own:
            fill[r.container_id] += r.n_tokens
            parts[r.doc_id].append((r.part_no, r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity and set(parts) == set(sizes)
        for d, p in parts.items():
            p.sort()
            assert sum(n for *_, n in p) == sizes[d] and len(p) == max(1, -(-sizes[d] // capacity))
            assert [f for _, f, _ in p] == [capacity * i for i in range(len(p))]
        least = -(-sum(sizes.values()) // capacity)
        assert len(fill) <= 1.08 * least + 2
    s = {r.spec_id: r for r in packing.summary(packing.pack(df, specs), specs).collect()}
    assert s[1].n_tokens == sum(sizes.values()) and 0.9 < s[1].fill <= 1


def test_containers_left_behind_are_packed_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_RESIDUAL", 1)
    specs = spark.createDataFrame([(1, tokens.TOKENIZER, 20)], "spec_id int, tokenizer string, capacity int")
    df = docs(spark, [" ".join(["one"] * (11 if i % 2 else 9)) for i in range(120)]).repartitionByRange(24, "doc_id")
    n = {}
    for rounds in (0, 2):
        monkeypatch.setattr(packing, "ROUNDS", rounds)
        s = packing.summary(packing.pack(df, specs), specs).collect()[0]
        n[rounds] = s.n_containers
    assert n[2] <= n[0] and n[2] <= 1.05 * s.least_containers + 1


def test_packing_of_nothing(spark):
    specs = spark.createDataFrame([(1, tokens.TOKENIZER, 64)], "spec_id int, tokenizer string, capacity int")
    assert packing.pack(docs(spark, ["x"]).limit(0), specs).count() == 0
    assert packing.pack(docs(spark, ["x"]), specs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest():
    p = packing.BestFit(10)
    a, b = p.place(7), p.place(6)
    assert a != b and p.place(3) == a and p.place(4) == b and p.place(0) in (a, b)

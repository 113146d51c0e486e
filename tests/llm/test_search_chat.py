import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import chat, topk


def test_bitmap_scores_are_inner_products():
    rng = np.random.default_rng(5)
    for low, high, n, d in ((-90, 90, 130, 64), (0, 1, 1, 3), (-5, -4, 70, 1), (-(2**30), 2**30, 65, 5)):
        v, q = rng.integers(low, high, (n, d)), rng.integers(low, high, d)
        block = topk.BitSlicedBlock(v)
        for k in (1, 5, n + 3):
            want = sorted(((int(s), i) for i, s in enumerate(v @ q) if i != 0), key=lambda x: (-x[0], x[1]))[:k]
            assert block.top(q, k, 0) == want


VECTORS = [(i, [float(np.sin(i * j + 1)) for j in range(8)]) for i in range(120)]
VECTORS += [(200, None), (250, [None, 1.0]), (251, [float("nan")]), (252, [float("inf")]), (253, []), (254, [0.5] * 3), (None, [0.9] * 8), (50, [1.0] * 8), (300, [1.0] * 8), (301, [1.0] * 8), (302, [1.0] * 8)]


def test_top_k_equals_brute_force(spark):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in VECTORS], "vec_id long, embedding array<float>, row string, q string").repartition(3)
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark, df, F.col("vec_id") % 50 == 0).collect())
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in VECTORS if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (qid, q) in enumerate(fine):
        if qid is None or qid % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), i is None, i or 0, i) for m, (i, v) in enumerate(fine) if m != n))
        want += [(qid, rank + 1, s[3], -s[0]) for rank, s in enumerate(scored[:5])]
    assert got == Counter(want)


def test_top_k_in_several_passes_and_of_nothing(spark, monkeypatch):
    df = spark.createDataFrame(VECTORS[:60], "vec_id long, embedding array<double>")
    one = topk.top_k(spark, df, F.col("vec_id") % 5 == 0).collect()
    monkeypatch.setattr(topk, "QUERIES", 5)
    assert Counter(map(tuple, topk.top_k(spark, df, F.col("vec_id") % 5 == 0).collect())) == Counter(map(tuple, one))
    assert topk.top_k(spark, df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>[]/\\sINST ab")), max_size=40))
def test_escape_round_trip(t):
    e = chat.escape(t)
    assert chat.unescape(e) == t
    assert not any(c in e for c in chat.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "</s>"]), st.text(max_size=30)), max_size=6))
def test_formatting_reads_back(turns):
    batch = chat.pa.RecordBatch.from_arrays([chat.pa.array([1] * len(turns), chat.pa.int64()), chat.pa.array([r for r, _ in turns], chat.pa.string()), chat.pa.array([t for _, t in turns], chat.pa.string())], names=["c", "r", "t"])
    out = [r for b in chat.read_back(chat.format_partition([batch], chat.TEMPLATE, size=7)) for r in b.to_pylist()]
    if not turns:
        assert out == []
        return
    said = "".join(t for r, t in turns if r == "assistant")
    assert out[0]["n_turns"] == len(turns) and out[0]["loss_chars"] == len(said)
    assert out[0]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert out[0]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def render(source, **env):
    return "".join(t for t, _ in chat.generate(chat.parse(source))(env))


def test_template_language():
    assert render("{% for x in xs %}{{ loop.index }}{{ x.a }}{% if loop.last %}.{% else %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": None}]) == "1p,2."
    assert render("{% set y = a + 'b' | upper %}{{ y ~ 1 + 2 }}{# no #}", a="a") == "aB12"
    assert render("{% if a == 1 %}x{% elif a in xs and not b %}y{% else %}z{% endif %}", a=2, xs=[2], b=False) == "y"
    assert render("{{ m['k'] }}{{ m.gone }}{{ (1 + 1) }}", m={"k": "v"}) == "v2"


def test_constants_are_folded():
    assert chat.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}e{% endif %}{{ x }}") == [("text", "abcd"), ("out", ("name", "x"))]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ f() }}", "{{ x | eval }}", "{% while x %}", "{% for x in y %}", "{{ 'a }}", "{{ x.y( }}", "{% import os %}"])
def test_sandbox_refuses(bad):
    with pytest.raises(chat.TemplateError):
        chat.parse(bad)


def test_attributes_reach_keys_only():
    assert render("{{ x.upper }}{{ x.a.real }}", x={"a": 1}) == ""


def test_conversations_with_gaps(spark):
    rows = [(1, 1, "assistant", "b", "z"), (1, 0, "user", "a", "z"), (2, 0, None, None, "z"), (None, 5, "assistant", "n", "z"), (3, None, "assistant", "first", "z"), (3, 0, "assistant", "dup", "z"), (3, 0, "assistant", "dup", "z"), (4, 0, "user", "", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.format_conversations(spark, df).mapInArrow(chat.read_back, chat.DIGEST).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n") and got[1].loss_chars == 1
    assert got[2].turns_sha256 == sha("\n\n") and got[None].loss_sha256 == sha("n") and got[3].loss_sha256 == sha("firstdupdup") and got[4].loss_chars == 0
    assert chat.format_conversations(spark, df.limit(0)).count() == 0

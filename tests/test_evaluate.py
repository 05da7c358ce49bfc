"""Evaluation, fusion, chunking, sampling and running values on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.operators import chunking, evaluate, rerank, running


def test_outcomes_by_hand(spark):
    cases = spark.createDataFrame([(1, ["A01B0001020000", "C07"]), (2, ["B01"]), (3, [])], "case_id long, ipc array<string>")
    preds = spark.createDataFrame([(1, 1, "B01C0001000000"), (1, 2, "B02"), (1, 3, "A01B0001040000"), (1, 4, "A01B0001020000"), (2, 1, "C01")], "case_id long, rank int, symbol string")
    o = {(r.case_id, r.level): (r.first_hit, r.main_hit) for r in evaluate.outcomes(cases, preds).collect()}
    assert o[1, "section"] == (2, 2) and o[1, "class"] == (3, 3) and o[1, "group"] == (3, 3) and o[1, "subgroup"] == (4, 4)
    assert o[2, "section"] == (None, None) and o[3, "section"] == (None, None) and len(o) == 15
    r = {x.level: x for x in evaluate.rows(evaluate.outcomes(cases, preds)).collect()}
    assert r["section"].n == 3 and r["section"].mrr == pytest.approx(0.5 / 3) and r["section"].hit_1 == 0 and r["section"].hit_3 == pytest.approx(1 / 3)
    assert evaluate.table(evaluate.rows(evaluate.outcomes(cases, preds))).split("\n")[1].split()[:3] == ["section", "0.0%", "33.3%"]
    m = {x.case_id: x for x in evaluate.misses(cases, preds, evaluate.outcomes(cases, preds), "subgroup").collect()}
    assert set(m) == {2, 3} and m[2].predicted == "C01" and m[3].gold == ""


def test_fuse(spark):
    d = spark.createDataFrame([(0.9, -20.0), (0.8, 20.0)], "s double, l double")
    assert [round(r.x, 6) for r in d.select(rerank.fuse(F.col("s"), F.col("l")).alias("x")).collect()] == [0.45, 0.8]
    with pytest.raises(ValueError, match="fusion"):
        rerank.fuse(F.lit(1), F.lit(1), "sum")
    assert (rerank.candidates(10), rerank.candidates(3), rerank.candidates(3, 7), rerank.candidates(3, 0), rerank.candidates(3, None, False)) == (50, 25, 7, 25, 3)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.;\n ", max_size=60), st.integers(1, 6), st.integers(0, 3))
def test_chunks_by_rules(text, limit, overlap):
    """Whatever the counter: within the limit, all words in order, and each chunk as long as it can be."""
    got = chunking.chunks(text, limit, overlap=overlap)
    same = chunking.chunks(text, limit, lambda t: len(t.split()), overlap)
    assert got == same and all(0 < len(c.split()) <= limit for c in got)
    plain = chunking.chunks(text, limit, overlap=0)
    assert " ".join(plain).split() == text.split()
    long = chunking.chunks(text, limit, lambda t: 2 * len(t.split()) + 1, 0)
    assert all(2 * len(c.split()) + 1 <= limit or len(c.split()) == 1 for c in long) and " ".join(long).split() == text.split()


def test_chunks():
    t = "One two three. Four five; six seven eight nine.\n\nAn end"
    assert chunking.chunks(t, 7, overlap=0) == ["One two three. Four five;", "six seven eight nine.", "An end"]
    assert chunking.chunks(t, 6) == ["One two three. Four five;", "Four five; six seven eight nine.", "An end"]
    assert chunking.chunks(t, None) == ["One two three. Four five; six seven eight nine.", "An end"]
    assert chunking.chunks("a b c d e", 2) == ["a b", "c d", "e"] and chunking.chunks("a b c d e", 3, overlap=2) == ["a b c", "d e"]
    assert chunking.chunks(None, 5) == chunking.chunks(" \n\n ", 5) == []


def test_sample(spark):
    rows = spark.createDataFrame([(i, i < 30) for i in range(35)] + [(99, None)], "id long, a boolean")
    got = evaluate.stratified_sample(rows, "id", "a", 20).collect()
    assert len(got) == 20 and sum(bool(r.a) for r in got) == 14
    assert evaluate.stratified_sample(rows, "id", "a", 50).count() == 36 and evaluate.stratified_sample(rows.limit(0), "id", "a", 5).count() == 0


def test_running(spark):
    rnd = random.Random(1)
    rows = [(None if k == 2 else k, i, rnd.randint(0, 9), rnd.choice([None, f"v{i}"])) for k in range(3) for i in range(40 if k else 200)]
    d = spark.createDataFrame(rows, "k int, i int, x int, v string").repartition(7)
    got = running.scan(d, ["k"], ["i"], sums={"s": F.col("x")}, lasts={"last": F.col("v")}).collect()
    want, s, last = {}, {}, {}
    for k, i, x, v in rows:
        s[k], last[k] = s.get(k, 0) + x, v or last.get(k)
        want[k, i] = s[k], last[k]
    assert {(r.k, r.i): (r.s, r["last"]) for r in got} == want

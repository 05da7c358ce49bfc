"""Ids against the whole-text encoder, exact round trips, places, and packing against its rules."""

import os
from collections import defaultdict

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from treeline.llm import packing as P
from treeline.llm import tokens as T

PATH = f"{T.FOLDER}/{T.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_and_round_trip(text):
    e = T.encoder(PATH)
    ids = e.encode(text)
    assert ids == e.tokenizer.encode(text, add_special_tokens=False).ids and e.decode(ids) == text
    starts, ends = e.places(text, ids)
    assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends)) and (not ids or (starts[0] == 0 and ends[-1] == len(text)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60) | st.none(), max_size=4))
def test_every_vocabulary_of_the_library(texts):
    """Whatever a vocabulary does to a text before it splits it, the ids are the library's for the whole text."""
    for name in sorted(f for f in os.listdir(T.FOLDER) if f.endswith(".json")):
        e = T.encoder(f"{T.FOLDER}/{name}")
        assert e.encode_all(texts) == [e.tokenizer.encode(t, add_special_tokens=False).ids if t else [] for t in texts], name


def test_other_vocabularies():
    e = T.encoder(f"{T.FOLDER}/word_bpe_49k.json")
    text = "  Two   Wörds, path=word_bpe_49k "
    ids = e.encode(text)
    assert not e.by_word and e.decode(ids).split() == ["two", "wörds", ",", "path", "=", "word", "_", "bpe", "_", "4", "9", "k"]
    starts, ends = e.places(text, ids)
    assert [text[a:b] for a, b in zip(starts, ends)][:1] == ["Two"] and len(starts) == len(ids)
    for name in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"):
        with pytest.raises(ValueError, match="not a vocabulary"):
            T.encoder(f"{T.FOLDER}/{name}")


def test_split_characters():
    e = T.encoder(PATH)
    ids = e.encode("a\U0001f9ec𝗈z")
    parts = [[i] for i in ids]
    assert "".join(e.decode_parts(parts)) == "a\U0001f9ec𝗈z" and e.decode(ids[:2]) != "a\U0001f9ec"
    assert e.encode("<|endoftext|>") != [50256] and len(T.byte_table()) == 256


def test_tables(spark):
    d = spark.createDataFrame([(1, "two words", 0), (2, "", 0), (3, None, 0), (1, "two words", 1), (4, "é" * 5000, 2)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, len(r.ids)) for r in T.encode(d).collect())
    assert got[:4] == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert {(r.doc_id, r.text) for r in T.decode(T.encode(d)).collect()} == {(1, "two words"), (2, ""), (3, ""), (4, "é" * 5000)}
    assert sorted((r.doc_id, r.n) for r in T.sizes(d).collect()) == got and T.encode(d.limit(0)).count() == 0
    assert {r.doc_id: r.ends for r in T.places(d).collect()}[1] == [3, 9]


def rules(rows, sizes, capacity):
    parts, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        if r.length:
            bins[r.container_id].append((r.container_start, r.container_start + r.length))
    assert set(parts) == set(sizes)
    for d, ps in parts.items():
        ps.sort(key=lambda r: r.part)
        assert sum(p.length for p in ps) == sizes[d] and [p.doc_start for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        assert len(ps) == 1 if sizes[d] <= capacity else all(p.length == capacity for p in ps[:-1])
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][1] <= capacity
    return sum(sizes.values()) / (len(bins) * capacity)


def test_packing(spark):
    sizes = {i: (i * 7919) % 97 + (500 if i % 50 == 0 else 0) for i in range(2000)}
    d = spark.createDataFrame(list(sizes.items()), "doc_id long, n long")
    for per in (4096, 50):  # small packers leave a larger share open
        packed = P.pack(d, 128, 16, per).cache()
        assert rules(packed.collect(), sizes, 128) > (0.95 if per == 4096 else 0.9)  # small packers leave a larger share open
        assert P.fill(packed, 128).first().tokens == sum(sizes.values())
    odd = spark.createDataFrame([(1, None), (2, 0), (3, 128), (4, 129)], "doc_id long, n long")
    rules(P.pack(odd, 128).collect(), {1: 0, 2: 0, 3: 128, 4: 129}, 128)
    assert P.pack(d.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        P.pack(d, 0)


@example([3, 18, 15, 3, 0], 2)
@example([4, 20, 16], 1)
@given(st.lists(st.integers(0, 40), max_size=80), st.integers(1, 5))
def test_best_fit_by_brute_force(sizes, most_open):
    """The same with a plain list of open containers: best fit, the fullest closes first, the oldest among equals in both."""
    p = P.Packer(20, most_open)
    free: dict[int, int] = {}
    n = 0
    for s in (min(s, 20) for s in sizes):
        fits = [(f, c) for c, f in free.items() if f >= s]
        if s == 20:
            want, at = n, 0
            n += 1
        elif fits:
            f, want = min(fits)
            at, free[want] = 20 - f, f - s
        else:
            if len(free) == most_open:
                free.pop(min((f, c) for c, f in free.items())[1])
            want, at, free[n] = n, 0, 20 - s
            n += 1
        assert p.put(s) == (want, at)
        free = {c: f for c, f in free.items() if f}
        assert p.open == len(free) <= most_open


def test_repeats_are_dealt(spark):
    """Neither empty items nor the repeats of one id meet in one packer, and the deal is the same however rows are laid out."""
    d = spark.createDataFrame([(1, 0)] * 3000 + [(i, 0) for i in range(3000)] + [(7, 5)] * 3000, "doc_id long, n long")
    packed = P.pack(d, 128, 16, most_items=500)
    assert packed.count() == 9000 and packed.selectExpr("container_id >> 40 as p").groupBy("p").count().where("count > 900").count() == 0
    assert P.faults(d, packed, 128).first().asDict() == {"items": 3000, "missing": 0, "wrong_total": 0, "overfull": 0, "gaps": 0, "split_small": 0}
    again = P.pack(d.repartition(7, "n"), 128, 16, most_items=500)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, again.collect()))
    assert P.faults(d, packed.where("doc_id <> 5"), 128).first().missing == 1

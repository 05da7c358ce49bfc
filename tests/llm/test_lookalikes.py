"""What looks the same is one class, what does not is not."""

import pytest

from treeline.llm import lookalikes as L

SAME = [("The filters", "Ｔｈｅ　ﬁlters"), ("motores", "motоres"), ("Тhe", "The"), ("ções", "ções"), ("a​b\xad", "ab"), ("no. 5", "no. 5"), ("𝗈𝗉𝗍", "opt"), ("𝚃𝚑𝚎", "The"), ("quasi‑x", "quasi-x"), ("5 µm", "5 μm"), ("Å", "Å"), ("ab︎", "ab"), ("", "⁠"), ("ɡ", "g"), ("ᎪᎷ", "AM"), ("ё", "ë")]
OTHER = [("m²", "m2"), ("H₂O", "H2O"), ("²", "₂"), ("A", "a"), ("e", "é"), ("a–b", "a-b"), ("a", "a."), ("ab", "a b"), ("ß", "ss"), ("œ", "oe"), ("(", "["), ("i", "ı"), ("½", "1/2"), ("1", "l"), ("“", '"')]


def frame(spark, pairs, kind):
    return spark.createDataFrame([(f"{kind}{n}", 2 * n + i, t) for n, p in enumerate(pairs) for i, t in enumerate(p)], "key string, id long, text string")


def test_pairs(spark):
    rows = frame(spark, SAME, "s").unionAll(frame(spark, OTHER, "o"))
    got = {(r.key_a, r.key_b) for r in L.same_look_pairs(frame(spark, SAME, "s")).collect()}
    assert got == {(2 * n, 2 * n + 1) for n in range(len(SAME))}
    assert L.same_look_pairs(frame(spark, OTHER, "o")).collect() == []
    assert L.same_look_pairs(rows).count() == len(SAME)


def test_nulls_copies_and_keys(spark):
    rows = spark.createDataFrame([("k", 1, "ab"), ("k", 2, "ab"), ("k", 3, "a​b"), ("j", 4, "a\xadb"), (None, 5, "ab"), (None, 6, "a\xadb"), ("k", 7, None)], "key string, id long, text string")
    assert {(r.key_a, r.key_b) for r in L.same_look_pairs(rows).collect()} == {(1, 3), (2, 3)}
    assert L.same_look_pairs(rows.limit(0)).count() == 0


def test_consistent(spark):
    rows = spark.createDataFrame([("k", n, t) for n, t in enumerate(["ção 1", "ção\xa01", "ção​ 1", "other", None, "Ｘ"])], "key string, id long, text string")
    got = {r.id: r for r in L.consistent(rows).collect()}
    assert {got[i].text for i in range(3)} == {"ção 1"} and {got[i].member for i in range(3)} == {"ção 1"} or {got[i].text for i in range(3)} == {"ção 1"}
    assert got[3].text == "other" and got[4].text is None and got[5].text == "X" and len(got) == 6


def test_consistent_by_classes(spark):
    """One text a class, over all rows, and the rough number is the same inside a class."""
    more = [("a\U000e0101b", "ab"), ("한", "\u1112\u1161\u11ab"), ("ǖ", "u\u0308\u0304"), ("が", "か\u3099"), ("\u1e9b\u0323", "\u017f\u0323\u0307")]
    rows = frame(spark, SAME + more + OTHER, "c")
    got = {r.id: r.text for r in L.consistent(rows).collect()}
    n = len(SAME + more)
    assert [i for i in range(n) if got[2 * i] != got[2 * i + 1]] == []
    assert [p for i, p in enumerate(OTHER, n) if got[2 * i] == got[2 * i + 1]] == []


def test_ascii_controls(spark):
    """Both queries have one class for texts that differ by controls without a glyph, and several for those that differ by blanks."""
    same = [(f"ab{chr(c)}c", "abc") for c in [*range(9), *range(14, 32), 127]]
    other = [(f"x{a}y", f"x{b}y") for a, b in [("\r", ""), ("\x0b", ""), ("\x0c", ""), ("\n", ""), ("\n", " ")]] + [("é\ry", "éy"), ("é\x85y", "éy"), ("q\x01\r", "q")]
    rows = frame(spark, same + other, "c")
    pairs = {(r.key_a, r.key_b) for r in L.same_look_pairs(rows).collect()}
    got = {r.id: r.text for r in L.consistent(rows).collect()}
    assert pairs == {(2 * n, 2 * n + 1) for n in range(len(same))}
    assert {got[i] for i in range(2 * len(same))} == {"abc"}
    assert [p for i, p in enumerate(other, len(same)) if got[2 * i] == got[2 * i + 1]] == []


@pytest.mark.parametrize("n", [400])
def test_hot_key(spark, n):
    rows = spark.createDataFrame([("hot", i, "same text" if i else "same\xa0text") for i in range(n)], "key string, id long, text string")
    assert L.same_look_pairs(rows).count() == n - 1


def test_class_sizes(spark):
    """One row a group, however many rows look alike; keys with one text, and rows without key or text, have none."""
    rows = spark.createDataFrame([("k", i, "same text" if i % 3 else "same\xa0text") for i in range(300)] + [("k", 900, "other"), ("j", 901, "same text"), (None, 902, "a"), (None, 903, "a\xad"), ("k", 904, None)], "key string, id long, text string")
    got = [r.asDict() for r in L.class_sizes(rows).collect()]
    assert [(r["key"], r["rows"], r["texts"], r["member"]) for r in got] == [("k", 300, 2, "same text")]
    assert L.class_sizes(rows.limit(0)).count() == 0

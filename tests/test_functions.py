"""Value tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from treeline.functions import symbols, textnorm, vectors
from treeline.operators import embed


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("printed", "canonical"),
    [("A01B 1/02", "A01B0001020000"), ("A01B 1/00", "A01B0001000000"), ("H04L 67/10", "H04L0067100000"), ("G06F 9/451", "G06F0009451000"), ("A61K 31/4745", "A61K0031474500"), ("A01B", "A01B"), ("A", "A")],
)
def test_symbols_round_trip(spark, printed, canonical):
    assert one(spark, printed, symbols.try_normalize) == canonical
    assert one(spark, canonical, symbols.pretty) == printed


@pytest.mark.parametrize(
    ("raw", "canonical"),
    [(" a01b1/02 ", "A01B0001020000"), ("A01B\xa01/02\x1f", "A01B0001020000"), ("not a symbol", None), ("", None), (None, None), ("A01B 00001/02", None), ("A01B 1/2", None), ("I01B", None), ("A01B ١/02", "A01B0001020000"), ("A01B0001020000\n", "A01B0001020000")],
)
def test_try_normalize(spark, raw, canonical):
    assert one(spark, raw, symbols.try_normalize) == canonical


def test_labels(spark):
    assert [one(spark, x, symbols.label) for x in ("A", "A01", "A01B", "A01B0003000000", "A01B0003141500")] == ["A", "01", "B", "3", "/1415"]


def test_normalize_stops(spark):
    assert one(spark, None, symbols.normalize) is None
    with pytest.raises(Exception, match="not a symbol"):
        one(spark, "nothing", symbols.normalize)


def test_levels(spark):
    s = "A01B0001040000"
    assert [one(spark, s, lambda c, lv=lv: symbols.truncate(c, lv)) for lv in symbols.LEVELS] == ["A", "A01", "A01B", "A01B0001000000", s]
    assert [one(spark, x, symbols.level) for x in ("A", "A01", "A01B", "A01B0001000000", s, "A0")] == ["section", "class", "subclass", "group", "subgroup", None]
    assert [one(spark, x, symbols.level_of_kind) for x in ("s", "c", "u", "m", "7", "g", "")] == ["section", "class", "subclass", "group", "subgroup", None, None]


@pytest.mark.parametrize(
    ("text", "query"),
    [("  PÁ COM   DENTES ", "pá com dentes"), ("Mixed DNA case", "Mixed DNA case"), ("SHOUT\n \nquiet  one", "shout\n\nquiet one"), ("", ""), ("123", "123"), (None, None), ("a\xa0b", "a b"), ("ABCab", "ABCab"), ("ABCDab", "abcdab")],
)
def test_normalize_query(spark, text, query):
    assert one(spark, text, textnorm.normalize_query) == query


def test_clean_title(spark):
    t = lambda h, k="": one(spark, h, lambda c: textnorm.clean_title(c, F.lit(k)))
    assert t('Pás <span>(ancinhos A01D)</span> <a rel="versions" href="#">[2006.01]</a>; ') == "Pás"
    assert t('x<div class="txt lvl2">Arados ( ) [2006.01]</div>') == "Arados"
    assert t("SEÇÃO A — NECESSIDADES", "s") == "NECESSIDADES"
    assert t("SEÇÃO A — NECESSIDADES", "c") == "SEÇÃO A — NECESSIDADES"


def test_strip_repeated_title(spark):
    f = lambda a, t: spark.createDataFrame([(a, t)], "a string, t string").select(textnorm.strip_repeated_title(F.col("a"), F.col("t")).alias("y")).first().y
    assert f("PÁ  COM DENTES. A pá", "Pá com dentes") == "A pá"
    assert f("Outra coisa", "Pá") == "Outra coisa"
    assert f("Pá", "Pá") == ""
    assert f("texto", "") == "texto"


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.normalize, "array<float>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.normalize, "array<float>") == [0.0, 0.0]
    assert one(spark, [0.0, -254.0, 1.0], lambda v: vectors.quantize(v, vectors.int8_scale(v)), "array<float>") == [0, -127, 0]
    assert one(spark, None, vectors.normalize, "array<float>") is None


@pytest.mark.parametrize("dim", [64, 100])
def test_hash_embed_is_the_embedder(spark, dim):
    texts = ["The red rocks, the RED rocks 12", "", None, "çã"]
    got = embed.hash_embed(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), ["id"], "t", dim).orderBy("id").collect()
    want = embed.HashEmbedder(dim).embed_queries([t or "" for t in texts])
    for g, w in zip(got, want):
        assert g.vector == pytest.approx(w)


def test_factories():
    assert embed.get_embedder("hash:32").dim == 32
    e = embed.HashEmbedder(8)
    assert embed.get_embedder(e) is e
    for f in (embed.get_embedder, embed.get_reranker):
        with pytest.raises(ValueError, match="unknown"):
            f("none:x")
    with pytest.raises(ValueError, match="needs a model"):
        embed.get_embedder("st")
    assert embed.prefixes("intfloat/multilingual-e5-base") == ("query: ", "passage: ")


def test_strip_repeated_title_long(spark, tmp_path):
    """Titles of any length are rows and are stripped."""
    from treeline.plans import texts

    long = {n: " ".join(["ab"] * n) for n in (1, 49, 50, 51, 200, 3000, 12_345)}
    spark.createDataFrame([(2 * n, t, "Rest of it") for n, t in long.items()], "row_id long, title string, abstract string").write.parquet(str(tmp_path / "eval_cases.parquet"))
    got = {r.row_id: r.abstract for r in texts.strip_repeated_title(spark, str(tmp_path)).collect()}
    assert got == {2 * n: "Rest of it" for n in long}
